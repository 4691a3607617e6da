import random
import re

import pytest

from pledgelens.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    words, hit, found = brute_words(text), set(), set()
    for name, item in items:
        w = brute_words(item)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            for j in range(len(words) - k + 1):
                if words[j:j + k] == w[i:i + k]:
                    hit |= set(range(j, j + k))
                    found.add(str(name) if name is not None else "null")
    return len(words), len(hit), sorted(found)


def corpus(seed):
    rnd = random.Random(seed)
    said = lambda n: " ".join(rnd.choice(["a", "B", "c", "É", "d-e"]) for _ in range(n))
    items = [(i if i else None, said(rnd.randint(1, 12))) for i in range(12)] + [(3, "a a a a a a"), (50, ""), (51, None), (52, "..")]
    texts = [None, "", "...", "a", *(said(rnd.randint(1, 90)) for _ in range(40))]
    texts += [f"xx {t} yy" for _, t in items if t]
    return [(i, t, 1.5) for i, t in enumerate(texts)] + [(3, "a", 1.5)], items


@pytest.mark.parametrize("window,block", [(4, 100_000), (3, 20), (6, 12)])
def test_hits(spark, window, block):
    rows, items = corpus(window)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words double").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontam.scan(docs, bench, window=window, block_words=block).withColumn("n_hit", decontam.n_hit())
    got = sorted((r.doc_id, r.text or "", r.n_words, r.n_hit, list(r.hit_items)) for r in out.collect())
    assert got == sorted((i, t or "", *brute(t, items, window)) for i, t, _ in rows)


def test_clean(spark):
    passage = "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"
    clean = "There is nothing to be found here, and so it stays. " * 3
    rows = [(1, f"Before it ({passage}), after. " + clean), (2, clean), (3, passage.upper()), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, passage)], "item_id bigint, text string")
    got = {r.doc_id: r.text for r in decontam.decontaminated(docs, bench).collect()}
    assert got == {1: "Before it (), after. " + clean, 2: clean, 4: None}
    assert decontam.report(docs.limit(0), bench).count() == 0
    assert [r.contaminated for r in decontam.report(docs, bench.limit(0)).collect()] == [False] * 4
