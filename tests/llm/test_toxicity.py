import math
import random
import re
import zlib

import numpy as np

from pledgelens.llm import toxicity

CLEAN = "the of and to in is it was for that with as on by at from stone river house wind rain".split()
BAD = ["vile", "rotten"]


def corpus(n=900, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(rnd.choice(CLEAN) for _ in range(rnd.randint(3, 9))) for _ in range(rnd.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            at = rnd.randrange(len(sentences))
            sentences[at] += " " + rnd.choice(BAD)
        docs.append((i, ". ".join(sentences) + ".", "x"))
        labels.append((i, toxic and 1 or 0))
    return docs, labels


def slow(model, text):
    """The noisy-or straight from its definition: no heads remembered, no logarithms."""
    clean = 1.0
    for sentence in re.split("[.!?\n]", text or ""):
        words = {w for w in re.findall(r"[^\W_]+", sentence.lower())}
        if words:
            z = model.bias + sum(model.weights.get(w, 0) + sum(model.weights.get(w[:k] + "*", 0) for k in (4, 5, 6, 7) if len(w) > k) for w in words)
            clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_descent_lowers_the_loss():
    docs, labels = corpus(200)
    names = ["vile", "rotten", "stone"]
    rows = [(y, *(np.array(x, np.int64) for x in toxicity.bag_of(t, {n: i for i, n in enumerate(names)}))) for (_, t, _), (_, y) in zip(docs, labels)]
    loss = {steps: toxicity._loss(toxicity._descend(rows, 3, (1.0, 1.0), 0.05, 3e-4, steps), rows, (1.0, 1.0)) for steps in (1, 200)}
    assert loss[200] < 0.1 * loss[1]


def test_whole_query_equals_the_slow_form(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 5)
    docs, labels = corpus(300, seed=4)
    df = spark.createDataFrame(docs + [(900, "viler VILE! rottenest, vile\n\n...", "x")], "doc_id bigint, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(df, lab)
    known = [(t, y) for (i, t, _), (_, y) in zip(docs, labels) if zlib.crc32(str(i).encode()) % 5]
    near = toxicity.fit([t for t, _ in known], [y for _, y in known])
    assert set(model.weights) == set(near.weights) and all(abs(model.weights[f] - near.weights[f]) < 1e-9 for f in near.weights)
    text = {d: t for d, t, _ in [*docs, (900, "viler VILE! rottenest, vile\n\n...", "x")]}
    for r in toxicity.toxicity(df, lab).collect():
        assert abs(r.score - slow(model, text[r.doc_id])) < 1e-9


def test_forms_share_their_head():
    """Every form of a stem stands in too few documents to be learned by itself."""
    rnd = random.Random(2)
    docs = [" ".join(rnd.choice(CLEAN) for _ in range(8)) + ("." if i % 3 else f". zorgel{rnd.choice('abcdefghijklmnopqrstuvwxyz')}{i}.") for i in range(300)]
    model = toxicity.fit(docs, [int(i % 3 == 0) for i in range(300)])
    assert model.score("The zorgelxyz house.")[0] > 0.5 > model.score("The zebra house.")[0]


def test_noisy_or_by_hand():
    m = toxicity.Model(-2.0, {"bad": 3.0})
    p = lambda z: 1 / (1 + math.exp(-z))
    score, found = m.score("So good. A bad thing! ... Fine")
    assert abs(score - (1 - (1 - p(-2)) ** 2 * (1 - p(1)))) < 1e-12
    assert [(a, b) for a, b, _ in found] == [(8, 20)] and abs(found[0][2] - p(1)) < 1e-12
    assert abs(m.score("one. two")[0] - (1 - (1 - p(-2)) ** 2)) < 1e-12 and m.score("")[0] == 0


def test_held_out_and_located(spark):
    docs, labels = corpus()
    rows = docs + [(None, "vile", "x"), (7000, None, "x"), (7001, "", "x"), (0, docs[0][1], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string").repartition(3)
    lab = spark.createDataFrame(labels + [(3, None), (None, 1), (99999, 1)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(rows)
    truth, text = dict(labels), {d: t for d, t, _ in docs}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 100 and all(r.predicted == truth[r.doc_id] for r in out)
    for r in out:
        said = [text[r.doc_id][s.start:s.end] for s in r.offending]
        assert all(any(b in s for b in BAD) for s in said) and bool(said) == bool(truth[r.doc_id])
    assert toxicity.toxicity(df.limit(0), lab).count() == 0
    none = toxicity.toxicity(df, lab.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
