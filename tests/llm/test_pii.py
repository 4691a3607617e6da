import hashlib
import random
import re

from pledgelens.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else False,
        "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
    }[kind]


def brute(text):
    return sorted(
        (m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if good(k, m[0])
    )


def corpus():
    rnd = random.Random(9)
    bits = [
        "a.b@c.de", "a@b.c+d@e.f", "@", ".", "a", "1", "+1 (017) 555-7713", "4111111111111111", "4111 1111-1111 1111", "4111111111111112",
        "1.2.3.4", "256.1.1.1", "0001.002.3.255", "1.2.3.4.5.6.7.8", "+", " ", "-", "é", "\U0001f389", "_", "%", "\n", "12", "(", ")", "phone: 030 1234 567",
    ]
    texts = [None, "", "a" * 30000, "1" * 30000, "1 " * 30000, "+1" + " " * 30000, "a@" * 5000, "x@y.z " * 1500, "1." * 3000]
    texts += ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30))) for _ in range(400)]
    return [(i, t, "k") for i, t in enumerate(texts)] + [(None, "1.2.3.4", "k"), (3, "1.2.3.4", "k"), (3, "1.2.3.4", "k")]


def test_base_and_model(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, found string").repartition(4)
    none = pii.scan(docs, pii.Model([], {}))
    got = sorted((str(r.doc_id), [tuple(x) for x in r.found]) for r in none.collect())
    assert got == sorted((str(i), brute(t)) for i, t, _ in rows)
    model = pii.train(docs)
    assert len(model.trees) == pii.TREES
    with_model = pii.Model(model.trees, {k: 0.0 for k in pii.WIDE_PATTERNS})
    more = [[tuple(x) for x in r.found] for r in pii.scan(docs, with_model).collect()]
    assert any(x[3] == "phone_national" for f in more for x in f)
    assert pii.train(docs.limit(0)).trees == []
    assert pii.report(docs.limit(0)).count() == 0


def test_report_and_redaction(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, found string").repartition(4)
    model = pii.Model([], {})
    masked = {}
    for r in pii.redacted(docs, model=model).collect():
        masked.setdefault((r.doc_id, r.found), set()).add(r.text)
    for i, t, k in rows:
        if t is None:
            assert None in masked[i, k]
            continue
        out, at = [], 0
        for s, _, e, kind in brute(t):
            if s >= at:
                out += [t[at:s], f"[{kind.upper()}]"]
            at = max(at, e)
        assert "".join(out) + t[at:] in masked[i, k]
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, set()).add(t)
    for r in pii.report(docs).collect():
        sums = [hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in brute(t)).encode()).hexdigest() for t in texts[r.doc_id]]
        assert r.base_sha256 in sums


def wide_kinds(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: {x["kind"] for x in r.found} for r in pii.scan(docs, model).collect()}
    return [found[i] for i in range(len(texts))]


def card(rnd):
    d = [rnd.randrange(10) for _ in range(15)]
    return next("".join(map(str, d + [c])) for c in range(10) if luhn("".join(map(str, d + [c]))))


def test_trained_model_selects_planted_wide_spans(spark):
    """train() itself selects spelled addresses, dotted cards and national numbers, with and without a cue, from few documents."""
    rnd = random.Random(21)
    texts = []
    for i in range(12):
        texts.append(f"write to user{i}.name@host{i}.org or so, number {card(rnd)} and +49 {rnd.randrange(100, 999)} {rnd.randrange(1000000, 9999999)} today")
    for i in range(30):
        texts.append(f"on 0{i % 9 + 1}/0{i % 8 + 1}/2020 there were {rnd.randrange(10**14, 10**15)} things and {i} more")
    model = pii.train(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert set(model.thresholds) == set(pii.WIDE_PATTERNS)
    dotted, spoilt = "4111.1111.1111.1111", "4111.1111.1111.1112"
    got = wide_kinds(spark, model, [
        "mail: jane.doe at example dot org now", "jane.doe at example dot org now", f"card {dotted} is", f"the {dotted} is", f"the {spoilt} is",
        "phone 030 123 4567 or", "the 030 123 4567 or", "since 04/05/2021 or",
    ])
    assert got == [{"email_spelled"}, {"email_spelled"}, {"number_dotted"}, {"number_dotted"}, set(), {"phone_national"}, {"phone_national"}, set()]


def test_thresholds_by_kind():
    """Each kind has its own; too few positives take the fallback, and no precise score leaves the kind out."""
    sums = [("email_spelled", 190, 30, 30.0), ("email_spelled", 90, 40, 10.0), ("number_dotted", 199, 5, 5.0), ("phone_national", 150, 100, 50.0)]
    assert pii.thresholds(sums) == {"email_spelled": 190 / (pii.BINS - 1), "number_dotted": pii.FALLBACK}
