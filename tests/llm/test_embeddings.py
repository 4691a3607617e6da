import math

import numpy as np
import pytest

from pledgelens.llm import embeddings as em

KIND = "vec_id bigint, embedding array<double>, label int, key string"


def brute(rows, cosine=0.9):
    """(id, links, component, kept) of rows of (id, vector), each row by itself."""
    units = [em.unit(v) for _, v in rows]
    group, links = list(range(len(rows))), [0] * len(rows)
    for i, x in enumerate(units):
        for j, y in enumerate(units):
            if i != j and x is not None and y is not None and len(x) == len(y) and float(x @ y) >= cosine:
                links[i] += 1
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    out = []
    for i, (name, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        first = min(ids, default=None)
        out.append((name, links[i], first, name is not None and name == first))
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "k") for i, v in rows], KIND)
    return sorted((tuple(r) for r in em.near_duplicates(df, **more).collect()), key=str)


def beside(rng, x, cosine):
    """A random unit vector of just this cosine to ``x``."""
    y = rng.normal(size=len(x))
    y -= (x @ y) * x
    return cosine * x + math.sqrt(1 - cosine * cosine) * y / np.linalg.norm(y)


def centre(rng, dim):
    x = rng.normal(size=dim)
    return x / np.linalg.norm(x)


@pytest.mark.parametrize("blocks", [(2048, 1024), (8, 4)])
def test_copies_and_clear_pairs_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(em, "BIT_BLOCK", blocks[0])
    monkeypatch.setattr(em, "VECTOR_BLOCK", blocks[1])
    rng, rows = np.random.default_rng(1), []
    for size in (60, 12, 5, 2, 2, 1, 1, 1):
        x = centre(rng, 64)
        rows += [3 * beside(rng, x, 0.99) for _ in range(size)]
    rows += [rows[0], rows[0], 2 * rows[0], rows[-1], -rows[-1]]
    # A chain: neighbours link, ends do not.
    x, y = centre(rng, 64), centre(rng, 64)
    y = (y - (x @ y) * x) / np.linalg.norm(y - (x @ y) * x)
    rows += [math.cos(a) * x + math.sin(a) * y for a in (0, 0.3, 0.6, 0.9)]
    rows += [centre(rng, 64) for _ in range(80)]
    order = rng.permutation(len(rows))
    rows = [(int(i), rows[k].tolist()) for i, k in enumerate(order)]
    assert found(spark, rows) == sorted(brute(rows), key=str)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0, 0, 0]), (4, [0, 0, 0]), (5, [1, None, 0]), (6, [1, nan, 0]), (7, [inf, 0, 0]), (8, [1, None, 0]),
        (9, [1e300, 1e300, 0]), (10, [1e-300, 1e-300, 0]), (11, [1, 1]), (12, [1, 1]), (13, [-1, -1]), (14, [5]), (15, [2]), (16, [-2]),
        (None, [0, 0, 1]), (17, [0, 0.0, 2]), (17, [-0.0, 0, 2]), (None, [0, 1, 0]), (None, [0, 1, 0]), (18, [3, 1, 0]),
    ]
    assert found(spark, rows) == sorted(brute(rows), key=str)
    assert found(spark, []) == []


def test_recall_of_pairs_near_the_limit_is_as_asked_and_none_is_below(spark):
    rng, rows = np.random.default_rng(3), []
    for k in range(1500):
        x = centre(rng, 64)
        rows += [x, beside(rng, x, 0.9002 if k % 3 else 0.8998)]
    got = found(spark, [(i, v.tolist()) for i, v in enumerate(rows)])
    links = {r[0]: r[1] for r in got}
    assert sum(links[2 * k] for k in range(1500) if k % 3) >= 0.97 * 1000
    assert not any(links[2 * k] or links[2 * k + 1] for k in range(0, 1500, 3))


def test_a_rotation_keeps_lengths_and_probes_are_next_likely():
    rng = np.random.default_rng(4)
    plan = em.Hashing(20, 2, 3)
    x = np.array([centre(rng, 20) for _ in range(50)])
    wide = np.zeros((50, plan.width))
    wide[:, :20] = x
    turned = em.rotated(wide, plan.signs[0, 0])
    assert np.allclose(turned @ turned.T, x @ x.T)
    codes = plan.codes(x)
    assert all(len(set(codes[i, t])) == plan.probes + 1 for i in range(50) for t in range(3))
    assert len({em.hashing_for(64, n).hashes for n in (10, 10**4, 10**6, 10**11)}) == 4
