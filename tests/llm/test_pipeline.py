import corpus_pipeline
from pledgelens.llm import bpe, decontam, pii, quality
from pledgelens.llm.common import table

from .test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontaminate", "redact", "tokens"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    vocabulary, letters = bpe.loaded(bpe.default_vocabulary()), quality.piece_letters(quality.default_pieces())
    lang = {r.doc_id: r.lang for r in docs.collect()}
    want = {i for i, t in texts.items() if quality.measure(vocabulary, letters, t, lang[i], quality.BANDS)[-1]}
    first = corpus_pipeline.quality_rules(spark, docs, SF)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == want

    ids = sorted(want)
    kept = {i for i, c in zip(ids, brute_components(ids, [brute_print(texts[i]) for i in ids])) if i == c}
    second = corpus_pipeline.near_dedup(spark, first, SF)
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == kept

    third = corpus_pipeline.decontaminate(spark, second, SF)
    bench = [(str(r.item_id), decontam.words_of(r.text.encode())) for r in table(spark, SF, "benchmark").collect()]
    automaton = decontam.Automaton(bench, decontam.WINDOW)
    after = {r.doc_id: r for r in third.collect()}
    assert third.columns == docs.columns and set(after) <= kept
    for i in kept:
        words = decontam.words_of(texts[i].encode())
        spans, _ = automaton.hits(words)
        if 2 * sum(b - a for a, b in spans) > len(words):
            assert i not in after
        else:
            assert after[i].text == decontam.without(texts[i].encode(), spans).decode() and after[i].n_chars == len(after[i].text)

    fourth = corpus_pipeline.redact(spark, third, SF)
    assert fourth.columns == docs.columns and fourth.count() == third.count()
    base = pii.report(fourth).agg({"n_email": "sum", "n_ip": "sum", "n_card": "sum", "n_phone": "sum"}).first()
    assert set(base) == {0}
    last = {r.doc_id: r for r in corpus_pipeline.tokens(spark, fourth, SF).collect()}
    for r in fourth.collect():
        assert last[r.doc_id].text == bpe.decoded(vocabulary, last[r.doc_id].ids) == r.text and last[r.doc_id].n_tokens == len(last[r.doc_id].ids)
