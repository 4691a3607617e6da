import hashlib
import random
import re

import pytest

from pledgelens.llm import secrets


def brute(text):
    found = []
    for order, rule in enumerate(secrets.BASE_RULES + secrets.MORE_RULES):
        for m in re.finditer(rule.pattern, text or "", re.A):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), order, m.end(), rule.kind))
    return sorted(found)


def joined(found):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)


def corpus():
    rnd = random.Random(6)
    bits = [
        "token", "Secret", "PASSWD", "api_key", "apikey", "=", ":", " ", "'", '"', "abcdefgh12", "short", "AKIA", "ABCDEFGHIJKL", "é",
        "\U0001f389", "0123456789abcdef" * 2, "deadbeef", "\n", "ghp_" + "a1" * 18, "xoxb-1234567890ab", "AIza" + "x" * 35, "==", "[",
        "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefghi.eyJabcdefghi.sig", "sk_live_" + "q" * 16, "ſecret", "toKen",
    ]
    texts = [None, "", "token: a secret: bbbbbbbb", "token: secret: abcdefgh12", "token=" + "b" * 20000, "token " * 3000, "a" * 50000]
    texts += ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    texts += [" ".join(["password = hunter2hunter2"] * 700)]
    return [(i, t, "k") for i, t in enumerate(texts)]


def test_trigram_queries():
    q = secrets.trigram_query(secrets.ASSIGN)
    assert q == [frozenset(map(secrets.trigrams, ["password", "passwd", "secret", "token", "apikey", "api_key"]))]
    assert secrets.trigram_query("[0-9a-f]{32,}") == [] and secrets.trigram_query("ab[0-9]+c") == []
    assert secrets.trigram_query("a?bcd(x|yz)e") == [frozenset(map(secrets.trigrams, ["bcdxe", "bcdyze"]))]
    assert secrets.trigram_query("abc[^x]+def") == [frozenset([frozenset(["abc"])]), frozenset([frozenset(["def"])])]
    assert secrets.trigram_query("abc|[0-9]+") == []


@pytest.mark.parametrize("block", [7, 4096])
def test_scan(spark, block):
    rows = corpus() + [(None, "token=abcdefgh1234", "k"), (3, "token=abcdefgh1234", "k"), (3, "token=abcdefgh1234", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string").repartition(4)
    got = sorted((str(r.doc_id), [tuple(x) for x in r.found]) for r in secrets.scan(docs, block_documents=block).collect())
    assert got == sorted((str(i), brute(t)) for i, t, _ in rows)


def test_report(spark):
    rows = corpus()[:60]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    texts = {i: t for i, t, _ in rows}
    for r in secrets.report(docs).collect():
        found = brute(texts[r.doc_id])
        base = [x for x in found if x[1] < 3]
        assert r.spans == joined(found) and r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))
    assert secrets.report(docs.limit(0)).count() == 0
