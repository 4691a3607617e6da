import random
from collections import Counter, defaultdict

import pytest

from pledgelens.operators import features as E
from pledgelens.operators import lemmas as L


def rule_of(form, lemma):
    p = 0
    while p < min(len(form), len(lemma)) and form[p] == lemma[p]:
        p += 1
    return len(form) - p, lemma[p:]


def brute_rules(pairs, longest=6, least=2):
    counts = defaultdict(Counter)
    for form, lemma in pairs:
        strip, add = rule_of(form, lemma)
        for s in range(strip, min(len(form), longest) + 1):
            counts[form[len(form) - s:]][strip, add] += 1
    out = {}
    for ending, of in counts.items():
        (strip, add), n = min(of.items(), key=lambda x: (-x[1], x[0]))
        if n >= least:
            out[ending] = (strip, add, n, n / sum(of.values()))
    return out


def brute_lemma(rules, form, longest=6):
    for s in range(min(len(form), longest), -1, -1):
        strip, add, *_ = rules.get(form[len(form) - s:], (None, None))
        if strip is not None and strip < len(form):
            return form[:len(form) - strip] + add
    return form


RULES = [("ами", "а"), ("ов", ""), ("ies", "y"), ("s", ""), ("ing", "e"), ("", "")]


def entries(n=400, seed=1):
    rnd = random.Random(seed)
    out = {}
    for _ in range(n):
        stem = "".join(rnd.choice("абвгдежabcdefgh") for _ in range(rnd.randint(1, 7)))
        end, lemma = rnd.choice(RULES)
        out[stem + end] = stem + lemma
    return sorted(out.items()) + [("went", "go"), ("s", "s"), ("ing", "ing")]


def test_rules_and_predictions_equal_brute_force(spark):
    pairs = entries()
    forms = spark.createDataFrame([*pairs, (None, "x"), ("y", None)], "form string, lemma string")
    rules = L.learn_rules(forms)
    want = brute_rules(pairs)
    got = {r.ending: (r.strip, r["add"], r.n, r.share) for r in rules.collect()}
    assert set(got) == set(want)
    for ending, (strip, add, n, share) in want.items():
        assert got[ending][:3] == (strip, add, n) and got[ending][3] == pytest.approx(share)
    words = [w for w, _ in entries(200, 2)] + ["ами", "s", "", "qqq", "ies"]
    out = {r.form: r.lemma for r in L.predict_lemmas(spark.createDataFrame([(w,) for w in words + words[:9]] + [(None,)], "form string"), rules).collect()}
    assert out == {w: brute_lemma(want, w) for w in words}


def test_completed_table_serves_lemmatize(spark):
    forms = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("cows", "cow"), ("mice", "mouse"), ("bus", "bus")], "form string, lemma string")
    docs = spark.createDataFrame([(1, ["Hens", "mice", "BUS", "pig", "cats"])], "id int, tokens array<string>")
    words = spark.createDataFrame([("hens",), ("mice",), ("bus",), ("pig",)], "form string")
    whole = L.complete_forms(words, forms)
    assert whole.count() == 7
    assert E.lemmatize(docs, "id", "tokens", whole).first().lemmas == ["hen", "mouse", "bus", "pig", "cat"]


def test_held_out_accuracy(spark):
    forms = spark.createDataFrame(entries(3000, 3), "form string, lemma string")
    r = L.rule_accuracy(forms).first()
    assert r.n > 400 and r.accuracy == r.correct / r.n and r.accuracy > 0.9 > r.unchanged / r.n


@pytest.mark.parametrize("name", ["lemma_rules", "predict_lemmas", "lemma_rule_accuracy"])
def test_texts_are_cut_into_forms_once(spark, name):
    """What follows the distinct forms reads them from their table, not from the documents again."""
    from pledgelens.catalog import all_queries

    assert not [f for f in all_queries()[name](spark, "/root/testdata/sf0.001").inputFiles() if "documents" in f]
