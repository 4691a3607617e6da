import html
import random
import re

import pytest
from pyspark.sql import functions as F

from pledgelens.functions import text as T
from pledgelens.functions.lexicons import RUSSIAN
from pledgelens.operators import features as E

TEXTS = [
    None, "", "12345 67", "Hello world. Only Latin!", "&nbsp;5 000 &#8381; &amp;lt; <b>Мы</b> т.е. так!",
    "&notit; &ampfoo &#x41;&#128; &bogus; a & b &#0; &#xD800; &#1114112; &#x7F; &Alpha &Alpha;",
    "огромное спасибо и Спасибо нам, возможно. Наша команда", "5кг и 5 кг", "500 руб., 2.5 тыс, 1 млн",
    "5 000 руб", "одно слово без точки", "Вместе! Мы: наш, нашу, наших. Я? мою... моей", "x_y 3,14 <i\n>tag</i>  конец",
    "БЛАГОДАРНОСТЬ и признательность. Низкий поклон", "Ёлка\tёж\x0bи пробел", "1" * 2000,
]


def py_clean(text):
    text = html.unescape(text or "")
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text)).strip()


def py_features(text):
    """A row-wise restatement of the definitions, used as the brute force."""
    raw, readable = text or "", py_clean(text)
    words = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", readable)).strip()
    find = lambda t: re.findall("[а-яёА-ЯЁa-zA-Z]+", t)
    tokens = [t.lower() for t in find(words)]
    n = len(tokens)
    share = lambda terms: sum(t in set(terms) for t in tokens) / n if n else 0.0
    grat = len(re.findall("|".join(RUSSIAN.gratitude), words, re.I))
    we, i = (sum(t in set(f) for t in tokens) for f in (RUSSIAN.we_forms, RUSSIAN.i_forms))
    money = len(re.findall(r"\d[\d\s,.]*\s*(?:" + "|".join(RUSSIAN.currency) + ")", raw, re.I))
    numbers = len(re.findall(r"\b\d+(?:[.,]\d+)?\b", raw))
    out = {
        "social_score": share(RUSSIAN.social), "gratitude_score": grat / max(n, 1), "has_gratitude": int(grat > 0),
        "we_count": we, "i_count": i, "we_ratio": we / n if n else 0.0, "i_ratio": i / n if n else 0.0,
        "we_vs_i": we / (i + 1), "certainty_score": share(RUSSIAN.certainty),
        "uncertainty_score": share(RUSSIAN.uncertainty), "money_mentions": money,
        "number_density": numbers / max(len(find(raw)), 1), "has_specific_sum": int(money > 0),
        "readability_flesch": None, "readability_fog": None, "readability_lix": None,
    }
    toks = find(readable)
    if toks:
        sents = max(len([s for s in re.split(r"[.!?]+", readable) if s.strip()]), 1)
        syl = [sum(c in RUSSIAN.both_case_vowels for c in t) for t in toks]
        asl = len(toks) / sents
        out["readability_flesch"] = 206.835 - 1.015 * asl - 84.6 * sum(syl) / len(toks)
        out["readability_fog"] = 0.4 * (asl + 100 * sum(s >= 3 for s in syl) / len(toks))
        out["readability_lix"] = asl + 100 * sum(len(t) > 6 for t in toks) / len(toks)
    return out


def random_texts(n, seed=5):
    rng = random.Random(seed)
    pool = RUSSIAN.social + RUSSIAN.we_forms + RUSSIAN.i_forms + RUSSIAN.certainty + RUSSIAN.uncertainty + [
        "спасибо", "огромное спасибо", "благодарим", "500", "2,5", "руб", "тыс", "Слово", "КОМАНДА", "&amp;", "<p>",
        "</p>", ".", "!", "?", "\n", " ", "_", "ё1", "длинноеслово", "&#8381;", "word"]
    return [rng.choice([" ", "  ", ", "]).join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate(TEXTS + random_texts(120)))
    return spark.createDataFrame(rows, "id int, t string").persist(), dict(rows)


def test_unescape_equals_the_standard(spark, texts):
    df, raw = texts
    for r in df.where("t is not null").select("id", T.html_unescape("t").alias("u")).collect():
        assert r.u == html.unescape(raw[r.id])


def test_cleaning(spark, texts):
    df, raw = texts
    got = df.select("id", T.clean_readable("t").alias("r"), T.clean_words("t").alias("w"),
                    T.clean_topics("t").alias("z")).collect()
    for r in got:
        readable = py_clean(raw[r.id])
        assert r.r == readable
        assert r.w == re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", readable)).strip()
        letters = re.sub(r"[^а-яёА-ЯЁa-zA-Z\s]", " ", re.sub(r"<[^>]+>", " ", html.unescape(raw[r.id] or "")))
        assert r.z == re.sub(r"\s+", " ", letters).strip()


def test_features_equal_brute_force(spark, texts):
    df, raw = texts
    for r in E.extract_text_features(df, "t").collect():
        for name, want in py_features(raw[r.id]).items():
            got = r[name]
            assert (got is None) == (want is None), (name, raw[r.id])
            if want is not None:
                assert got == pytest.approx(want, abs=6e-5 if name.startswith("read") else 1e-12), (name, raw[r.id])


def test_long_digit_run_is_linear(spark):
    df = spark.createDataFrame([("7" * 20000 + " руб",)], "t string")
    row = E.with_numeric_mentions(df, "t").first()
    assert row.money_mentions == 1 and row.has_specific_sum == 1


def test_sentence_scores_read_every_sentence_whole(spark):
    long = "да " * 400 + "плохо"
    many = ". ".join(["хорошо"] * 200 + ["плохо"] * 50)
    df = spark.createDataFrame([(1, long), (2, many), (3, "")], "id int, t string")
    out = {r.id: r for r in E.score_sentences(df, "id", "t", E.lexicon_scorer(["хорошо"], ["плохо"])).collect()}
    e = 2.718281828
    assert out[1].sentiment_negative == pytest.approx(e / (e + 2), rel=1e-6)
    assert out[2].sentiment_positive == pytest.approx((200 * e + 50) / (250 * (e + 2)), rel=1e-6)
    assert out[3].sentiment_positive is None
    assert sum(out[2][f"sentiment_{k}"] for k in ("positive", "negative", "neutral")) == pytest.approx(1)


def test_lemmas_by_table_and_by_reached_forms_agree(spark):
    forms = spark.createDataFrame(
        [("команды", "команда"), ("командой", "команда"), ("друзья", "друг"), ("может", "мочь")], "form string, lemma string")
    df = spark.createDataFrame([(1, "Команды и командой, друзья"), (2, "может быть"), (3, "")], "id int, t string")
    tokens = df.select("id", T.tokenize("t").alias("tok"))
    lemmas = {r.id: r.lemmas for r in E.lemmatize(tokens, "id", "tok", forms).collect()}
    assert lemmas == {1: ["команда", "и", "команда", "друг"], 2: ["мочь", "быть"], 3: []}
    scored = {r.id: r for r in E.with_lexicon_features(df.select("id", T.clean_words("t").alias("w")), "w", RUSSIAN, forms).collect()}
    for i, ls in lemmas.items():
        want = sum(x in set(RUSSIAN.social) for x in ls) / len(ls) if ls else 0.0
        assert scored[i].social_score == pytest.approx(want)
    assert scored[2].uncertainty_score == 0.0


def test_inventory_sizes(spark):
    sizes = {r.category: r.n_terms for r in E.lexicon_inventory(spark).collect()}
    assert sizes == {"social": 88, "gratitude": 11, "we": 14, "i": 15, "certainty": 30, "uncertainty": 28}
    assert len(RUSSIAN.topic_stop) == 43 and len(RUSSIAN.tfidf_stop) == 58


def test_coverage_and_redundant(spark, texts):
    df, _ = texts
    out = E.extract_text_features(df, "t").withColumn("topic_4", F.lit(0.0))
    cov = {r.feature: r for r in E.lexicon_coverage(out).collect()}
    assert cov["social_score"].n_docs == df.count() and not cov["social_score"].is_weak
    assert "topic_4" not in E.drop_redundant(out).columns
