import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pledgelens.functions import distributions as D
from pledgelens.operators import columns as C
from pledgelens.operators import compare as K
from pledgelens.operators import lookup as L
from pledgelens.operators import profile as H
from pledgelens.operators import ranks as R
from pledgelens.operators.scaling import Scaler


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, as a hot key would."""
    rng = random.Random(3)
    rows = [(i, 0.0 if i % 3 == 0 else round(rng.gauss(0, 5), 1), rng.random(), int(rng.random() < 0.4)) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, a double, b double, y int").persist()


def test_ranges_change_nothing(spark, skewed, monkeypatch):
    long = R.melt_numeric(skewed, ["a", "b"])
    plain = R.cumulate(long, ["feature"], max_rows=skewed.count())
    monkeypatch.setattr(R, "SINGLE_RANGE_ROWS", 100)
    monkeypatch.setattr(R, "RANGES", 13)
    ranged = R.cumulate(long, ["feature"])
    cols = ["feature", "value", "n", "n_before", "n_total"]
    assert sorted(map(tuple, ranged.select(cols).collect())) == sorted(map(tuple, plain.select(cols).collect()))


def test_rank_sum_and_quantiles(spark, skewed):
    cum = R.average_ranks(R.cumulate(R.melt_numeric(skewed, ["a"]), ["feature"]))
    n = skewed.count()
    assert cum.agg(F.sum(F.col("rank") * F.col("n"))).first()[0] == n * (n + 1) / 2
    values = np.array([r.a for r in skewed.select("a").collect()])
    q = R.quantiles(cum, ["feature"], {"p": 0.37, "m": 0.5}).first()
    assert q.p == pytest.approx(np.quantile(values, 0.37)) and q.m == pytest.approx(np.median(values))


def test_shuffled_numbers_are_a_permutation(spark, skewed):
    rows = R.shuffled_row_number(skewed, "id", ["y"], 1).select("y", "rn").collect()
    for y in (0, 1):
        got = sorted(r.rn for r in rows if r.y == y)
        assert got == list(range(1, len(got) + 1))


def test_split_and_folds(spark):
    df = spark.createDataFrame([(i, int(i < 42)) for i in range(99)], "id long, y int")
    parts = C.train_test_split(df, "id", "y").groupBy("is_test", "y").count().collect()
    assert {(r.is_test, r.y): r["count"] for r in parts} == {(0, 0): 45, (0, 1): 34, (1, 0): 12, (1, 1): 8}
    folds = C.fold_assign(df, "id", "y").groupBy("fold", "y").count().collect()
    assert {r.fold for r in folds} == set(range(5)) and all(8 <= r["count"] <= 12 for r in folds)
    tiny = C.fold_assign(df.limit(20), "id", "y", scheme="leave_one_out")
    assert tiny.select("fold").distinct().count() == 20
    w = C.balanced_weights(df, "y").groupBy("y").agg(F.sum("weight").alias("w")).collect()
    assert all(r.w == pytest.approx(49.5) for r in w)


def test_hot_key_join_equals_plain_join(spark, monkeypatch):
    big = spark.range(6000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)).alias("k"), "id")
    side = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        want = sorted(map(str, big.join(side, "k", how).collect()))
        assert sorted(map(str, L.hot_key_join(big, side, ["k"], how).collect())) == want
    assert not L.fits_broadcast(side, 399) and L.fits_broadcast(side, 400)
    assert L.lookup_join(big, side, ["k"], "inner", 10).count() == big.join(side, "k").count()


def test_known_comparison_row(spark):
    """23 of 42 against 24 of 57: published statistics of a 0/1 feature."""
    rows = [(1, int(i < 23)) for i in range(42)] + [(0, int(i < 24)) for i in range(57)]
    df = spark.createDataFrame(rows, "y int, has_gratitude int")
    r = K.test_table(df, ["has_gratitude", "absent"], "y").first()
    assert (r.n_success, r.n_fail, r.mw_U) == (42, 57, 1348.5)
    assert r.mw_p == pytest.approx(0.21647037, abs=1e-8)
    assert r.rank_biserial_r == pytest.approx(-0.12656642, abs=1e-8)
    assert r.pointbiserial_r == pytest.approx(0.12526507, abs=1e-8)
    assert r.pointbiserial_p == pytest.approx(0.21667604, abs=1e-7)


def test_mann_whitney_against_pairs(spark, skewed):
    rows = skewed.select("a", "b", "y").collect()
    out = {r.feature: r for r in K.test_table(skewed, ["a", "b"], "y").collect()}
    for f in ("a", "b"):
        one = np.array([r[f] for r in rows if r.y == 1])
        zero = np.array([r[f] for r in rows if r.y == 0])
        u = (one[:, None] > zero).sum() + 0.5 * (one[:, None] == zero).sum()
        assert out[f].mw_U == u
        assert out[f].median_success == pytest.approx(np.median(one))
        y = np.array([r.y for r in rows])
        assert out[f].pointbiserial_r == pytest.approx(np.corrcoef(y, [r[f] for r in rows])[0, 1])
    constant = spark.createDataFrame([(1, 1.0), (1, 1.0), (0, 1.0), (0, 1.0)], "y int, c double")
    r = K.test_table(constant, ["c"], "y").first()
    assert r.mw_U is None and r.pointbiserial_r is None


def test_tail_probabilities():
    assert D.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert D.student_two_sided(2.0, 1) == pytest.approx(1 - 2 / math.pi * math.atan(2.0))
    assert D.student_two_sided(0.0, 5) == pytest.approx(1.0)


def test_columns(spark):
    df = spark.createDataFrame([(-5.0, None, None), (9.0, 10, 2), (None, 0, 0)], "goal double, len int, videos int")
    got = C.prepare_campaigns(df, "goal", "len", "videos", None).collect()
    assert [r.log_goal for r in got] == [0.0, pytest.approx(math.log(10)), None]
    assert [r.log_text_length for r in got] == [0.0, pytest.approx(math.log(11)), 0.0]
    assert [r.has_video for r in got] == [0, 1, 0]
    assert C.varying_columns(df.withColumn("one", F.lit(1)), ["goal", "one"]) == ["goal"]
    hot = C.one_hot(spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "k string"), "k").collect()
    assert [(r.cat_b, r.cat_c) for r in hot] == [(1, 0), (0, 0), (0, 0), (0, 1)]
    codes = C.quantile_codes(spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 4, 5]], "v double"), "v").collect()
    assert [r.v_bin for r in codes] == [0, 0, 0, 0, 1, 1, 2, 2]


def test_scaler_round_trip(spark, skewed, tmp_path):
    df = skewed.select("id", F.col("a").alias("readability_avg"), F.lit(3.0).alias("readability_fog"), "b")
    scaler = Scaler().fit(df)
    scaler.save(spark, str(tmp_path / "p"))
    back = Scaler.load(spark, str(tmp_path / "p"))
    assert back == scaler and set(back.params) == {"readability_avg", "readability_fog"}
    out = back.transform(df).agg(F.avg("readability_avg"), F.stddev_pop("readability_avg"), F.max("readability_fog")).first()
    assert out[0] == pytest.approx(0, abs=1e-9) and out[1] == pytest.approx(1) and out[2] == 0.0
    with pytest.raises(ValueError):
        Scaler().transform(df)


def test_spearman_skips_rows_missing_either(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 20, 300).astype(float), rng.integers(0, 20, 300).astype(float)
    rows = [(None if i % 7 == 0 else float(a), None if i % 5 == 0 else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, y double")
    both = np.array([r for r in rows if None not in r], dtype=float)

    def rank(v):
        return np.array([(v < e).sum() + ((v == e).sum() + 1) / 2 for e in v])

    want = np.corrcoef(rank(both[:, 0]), rank(both[:, 1]))[0, 1]
    assert H.spearman_pairs(df, [("x", "y")]).first().r == pytest.approx(want)


def test_histogram_and_boxes(spark, skewed):
    h = H.histogram(skewed, ["b"]).collect()
    values = np.array([r.b for r in skewed.select("b").collect()])
    counts, edges = np.histogram(values, bins=30)
    assert [r["count"] for r in sorted(h, key=lambda r: r.bin)] == list(counts)
    box = H.box_stats(skewed, ["a"]).first()
    a = np.array([r.a for r in skewed.select("a").collect()])
    q1, q3 = np.quantile(a, [0.25, 0.75])
    reach = 1.5 * (q3 - q1)
    assert box.n_outliers == ((a < q1 - reach) | (a > q3 + reach)).sum()
    report = H.profile_report(skewed.withColumn("kind", F.when(F.col("id") % 4 > 0, F.concat(F.lit("k"), F.col("id") % 4))), "id", "y", "b", skip=["id"])
    assert {r.kind for r in report["categorical/success_kind"].collect()} == {"k1", "k2", "k3"}
    assert {"summary/overview", "target_analysis/group_stats", "bivariate/trends"} <= set(report)


@pytest.mark.parametrize("m, n", [(1, 1), (1, 5), (3, 4), (5, 2), (6, 6), (8, 8)])
def test_exact_rank_test_equals_enumeration(m, n):
    """Every choice of ranks for the first sample."""
    counts = Counter(sum(ranks) - m * (m - 1) // 2 for ranks in itertools.combinations(range(m + n), m))
    assert D.rank_sum_counts(m, n) == [counts[u] for u in range(m * n + 1)]
    for u in range(m * n + 1):
        tail = sum(c for v, c in counts.items() if abs(v - m * n / 2) >= abs(u - m * n / 2) - 1e-9)
        assert D.rank_sum_two_sided(u, m, n) == pytest.approx(min(1.0, tail / math.comb(m + n, m)))


def test_rank_test_is_exact_for_small_untied_samples_only(spark):
    rows = [(i, float(i * i), float(i // 2), float(i), int(i in (1, 3, 4, 9))) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y int")
    got = {r.feature: r for r in K.mann_whitney(df, ["a", "b"], "y").collect()}
    assert got["a"].mw_p == pytest.approx(D.rank_sum_two_sided(got["a"].mw_U, 4, 8))
    assert got["b"].mw_p == pytest.approx(math.erfc(abs(got["b"].mw_z) / math.sqrt(2)))
    many = spark.createDataFrame([(i, float(i), i % 2) for i in range(20)], "id int, a double, y int")
    r = K.mann_whitney(many, ["a"], "y").first()
    assert r.mw_p == pytest.approx(math.erfc(abs(r.mw_z) / math.sqrt(2)))
    table = {r.feature: r.mw_p for r in K.test_table(df, ["a", "b"], "y").collect()}
    assert table == pytest.approx({f: got[f].mw_p for f in "ab"})


def test_pairs_of_one_column_with_gaps_need_no_joint_counts(spark, monkeypatch):
    """Pairs with one incomplete column are ranked over its rows together; joint values are counted for pairs of two such columns only."""
    rng = np.random.default_rng(3)
    data = {c: rng.integers(0, 6, 400).astype(float) for c in "abcde"}
    data["d"][rng.random(400) < 0.3] = np.nan
    data["e"][:] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in zip(*data.values())], "a double, b double, c double, d double, e double")
    asked = []
    cells = H._pair_cells
    monkeypatch.setattr(H, "_pair_cells", lambda wide, pairs: asked.extend(pairs) or cells(wide, pairs))
    got = {(r.a, r.b): r.r for r in H.spearman_pairs(df, [("a", "b"), ("a", "d"), ("d", "c"), ("a", "e"), ("d", "e")]).collect()}
    assert asked == [("d", "e")] and set(got) == {("a", "b"), ("a", "d"), ("d", "c")}

    def ranks(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    for (a, b), r in got.items():
        both = ~np.isnan(data[a]) & ~np.isnan(data[b])
        assert r == pytest.approx(np.corrcoef(ranks(data[a][both]), ranks(data[b][both]))[0, 1], abs=1e-12)
