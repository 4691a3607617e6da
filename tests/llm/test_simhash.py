import hashlib
import random

import numpy as np
import pytest
import xxhash

from pledgelens.llm import components, simhash
from pledgelens.operators import lookup

SPACE = " \t\n\r\x0b\x0c"


def brute_print(text, k=3):
    words, word = [], ""
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "") + " ":
        if c in SPACE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, radius=3):
    n = len(ids)
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    known = {}
    for i in range(n):
        if ids[i] is not None:
            known[group[i]] = min(known.get(group[i], ids[i]), ids[i])
    return [known.get(g) for g in group]


def corpus():
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    near = []
    for t in base[:30]:
        for _ in range(rnd.randint(1, 4)):
            w = (t * rnd.choice([1, 1, 4])).split()
            w[rnd.randrange(len(w))] = "ZÉ"
            near.append("\t".join(w))
    texts = [None, "", "  \n", "one", "One", "two words", "x " * 5000, "\x85a\xa0b c\x1c", *base, *near, *near[:20]]
    return [(i, t, "k") for i, t in enumerate(texts)]


def test_fingerprint_is_the_definition():
    for _, t, _ in corpus():
        assert simhash.fingerprint((t or "").encode()) == brute_print(t)


def test_neighbours_cover_every_close_pair():
    rnd = random.Random(5)
    near = set(simhash.neighbours(3))
    for _ in range(2000):
        a = rnd.getrandbits(64)
        b = a
        for _ in range(rnd.randint(0, 3)):
            b ^= 1 << rnd.randrange(64)
        d = tuple((a >> s & 0xFFFF).bit_count() - (b >> s & 0xFFFF).bit_count() for s in (0, 16, 32, 48))
        assert d in near or tuple(-x for x in d) in near


@pytest.mark.parametrize("block", [4, 4096])
def test_links_of_random_prints(spark, block):
    rnd = random.Random(7)
    bits = set()
    for _ in range(40):
        a = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 8)):
            bits.add(a)
            for _ in range(rnd.randint(1, 3)):
                a ^= 1 << rnd.randrange(64)
    signed = np.array(sorted(bits), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "bits bigint")
    links = simhash.tile_links(df, 3, block)
    assert all((r.a ^ r.b).bit_count() <= 3 or ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in links.collect())
    got = {r.a: r.label for r in simhash.components(links).collect()}
    groups = brute_components(signed, [x & (2**64 - 1) for x in signed])
    assert [got.get(x, x) for x in signed] == groups


def test_near_duplicates(spark):
    rows = corpus() + [(None, "one", "k"), (None, "alone by itself " * 3, "k"), (3, "one", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, bits string").repartition(4)
    got = {}
    for r in simhash.near_duplicates(docs).collect():
        got.setdefault((r.doc_id, r.fingerprint, r.component_id), 0)
        got[r.doc_id, r.fingerprint, r.component_id] += 1
    prints = [brute_print(t) for _, t, _ in rows]
    want = {}
    for (i, _, _), p, c in zip(rows, prints, brute_components([r[0] for r in rows], prints)):
        want[i, f"{p:016x}", c] = want.get((i, f"{p:016x}", c), 0) + 1
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_deduplicated(spark):
    rnd = random.Random(11)
    rows = [(500 - i, t, "k") for i, (_, t, _) in enumerate(corpus())]
    rows += [rows[5], rows[5], (None, rows[9][1], "k"), (None, "only this one has no id at all", "k"), (None, "only this one has no id at all", "k")]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, bits string").repartition(4)
    prints = [brute_print(t) for _, t, _ in rows]
    best = {}
    for g, r in zip(brute_components(list(range(len(rows))), prints), rows):
        best[g] = min(best.get(g, r), r, key=lambda x: (x[0] is None, x[0] or 0, hashlib.sha256((x[1] or "").encode()).hexdigest()))
    got = [tuple(r) for r in simhash.deduplicated(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, best.values()))
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_components_of_a_chain_a_star_and_a_ring(spark, monkeypatch):
    """Also where labels and nodes with many links are joined without a broadcast."""
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 2400)] + [(3000 + i, 3000 + (i + 1) % 9) for i in range(9)]
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(5)
    want = {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(200, 2400)}, 7: 7, **{3000 + i: 3000 for i in range(9)}}
    for rows in (lookup.BROADCAST_ROWS, 50):
        monkeypatch.setattr(components.lookup_join, "__defaults__", ("left", rows, None, None))
        assert {r.a: r.label for r in components.components(df).collect()} == want
