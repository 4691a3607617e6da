"""Two-class comparisons of many features at once.

All statistics come from one reduced table of distinct values with class
counts, so the test cost does not grow with ties and no feature is sorted in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import normal_p, rank_sum_p, student_p
from . import ranks as R


def class_counts(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Cumulated distinct values per feature with counts of both classes (``y`` is 0/1)."""
    long = R.melt_numeric(df.where(F.col(y).isin(0, 1)), features, [y])
    return R.cumulate(long, ["feature"], "value", {
        "n": F.count(F.lit(1)), "n1": F.count_if(F.col(y) == 1), "n0": F.count_if(F.col(y) == 0),
        "s": F.sum("value")}, max_rows=df.count())


def _class_median(side: str) -> list[Column]:
    """Lower and upper middle value of one class from cumulated counts."""
    total, before, here = F.col(f"{side}_total"), F.col(f"{side}_before"), F.col(side)
    found = []
    for index in (F.floor((total - 1) / 2), F.ceil((total - 1) / 2)):
        found.append(F.max(F.when((before <= index) & (index < before + here), F.col("value"))))
    return found


def _summaries(counts: DataFrame) -> DataFrame:
    """One row per feature with every sum the tests need."""
    n, n1, n0, v = (F.col(c).cast("double") for c in ("n", "n1", "n0", "value"))
    off = v - F.col("s_total") / F.col("n_total")
    lo1, hi1 = _class_median("n1")
    lo0, hi0 = _class_median("n0")
    return counts.groupBy("feature").agg(
        F.max("n1_total").alias("n_success"), F.max("n0_total").alias("n_fail"),
        ((lo1 + hi1) / 2).alias("median_success"), ((lo0 + hi0) / 2).alias("median_fail"),
        F.try_divide(F.sum(n1 * v), F.sum(n1)).alias("mean_success"),
        F.try_divide(F.sum(n0 * v), F.sum(n0)).alias("mean_fail"),
        F.count_if(n1 > 0).alias("d1"), F.count_if(n0 > 0).alias("d0"), F.count(F.lit(1)).alias("d"),
        F.sum(n1 * (F.col("n0_before") + n0 / 2)).alias("u"),
        F.sum(n * n * n - n).alias("ties"),
        F.sum(n * off * off).alias("spread"), F.sum(n1 * off).alias("lean"))


def class_location(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Rows, median and mean per class, nulls dropped per feature."""
    return _summaries(class_counts(df, features, y)).select(
        "feature", "n_success", "n_fail", "median_success", "median_fail", "mean_success", "mean_fail")


def rank_biserial(u, n1, n2) -> Column:
    """Effect size ``1 - 2U / (n1 n2)``: negative when the first sample is larger."""
    return 1 - F.try_divide(2 * u, (n1 * n2).cast("double"))


def _with_mann_whitney(s: DataFrame) -> DataFrame:
    n1, n0 = F.col("n_success").cast("double"), F.col("n_fail").cast("double")
    n = n1 + n0
    valid = (n1 >= 2) & (n0 >= 2) & (F.col("d1") + F.col("d0") > 2)
    variance = n1 * n0 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    # Continuity corrected, as large samples are tested.
    z = F.try_divide(F.greatest(F.abs(F.col("u") - n1 * n0 / 2) - 0.5, F.lit(-0.5)), F.sqrt(variance))
    return s.withColumns({
        "mw_U": F.when(valid, F.col("u")), "mw_z": F.when(valid, z),
        "rank_biserial_r": F.when(valid, rank_biserial(F.col("u"), n1, n0))})


def _with_point_biserial(s: DataFrame) -> DataFrame:
    n1, n0 = F.col("n_success").cast("double"), F.col("n_fail").cast("double")
    r = F.try_divide(F.col("lean"), F.sqrt(n1 * n0 / (n1 + n0)) * F.sqrt("spread"))
    valid = (F.col("d") > 1) & (n1 > 0) & (n0 > 0)
    return s.withColumn("pointbiserial_r", F.when(valid, r))


def mann_whitney(df: DataFrame, features: list[str], y: str, p_value: bool = True) -> DataFrame:
    """U of the success sample with its tie-corrected normal test.

    The p-value is exact where the samples are untied and one has at most ``EXACT_SIZE`` values.
    """
    out = _with_mann_whitney(_summaries(class_counts(df, features, y))).select(
        "feature", "n_success", "n_fail", "mw_U", "mw_z", "rank_biserial_r", "ties")
    return out.withColumn("mw_p", _mw_p()).drop("ties") if p_value else out.drop("ties")


#: The rank test is exact up to so many values of the lesser sample, without ties, and so many different U.
EXACT_SIZE = 8
EXACT_CELLS = 100_000


def _mw_p() -> Column:
    n1, n0 = F.col("n_success").cast("double"), F.col("n_fail").cast("double")
    small = (F.least(n1, n0) <= EXACT_SIZE) & (n1 * n0 <= EXACT_CELLS) & (F.col("ties") == 0)
    exact = rank_sum_p(*[F.when(small, c) for c in (F.col("mw_U"), n1, n0)])
    return F.coalesce(exact, F.least(normal_p(F.greatest(F.col("mw_z"), F.lit(0.0))), F.lit(1.0)))


def _student_p_of_r() -> Column:
    r, n = F.col("pointbiserial_r"), (F.col("n_success") + F.col("n_fail")).cast("double")
    t = F.try_divide(r * F.sqrt(n - 2), F.sqrt(1 - r * r))
    return student_p(t, n - 2)


def point_biserial(df: DataFrame, features: list[str], y: str, p_value: bool = True) -> DataFrame:
    """Pearson correlation of the 0/1 target with each feature."""
    long = R.melt_numeric(df.where(F.col(y).isin(0, 1)), features, [y])
    sums = long.groupBy("feature").agg(
        F.count_if(F.col(y) == 1).alias("n_success"), F.count_if(F.col(y) == 0).alias("n_fail"),
        F.corr(y, "value").alias("r"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    valid = (F.col("lo") < F.col("hi")) & (F.col("n_success") > 0) & (F.col("n_fail") > 0)
    out = sums.select("feature", "n_success", "n_fail", F.when(valid, F.col("r")).alias("pointbiserial_r"))
    return out.withColumn("pointbiserial_p", _student_p_of_r()) if p_value else out


def test_table(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Every comparison of every feature in one row, by ascending p-value."""
    features = [f for f in features if f in df.columns]
    s = _with_point_biserial(_with_mann_whitney(_summaries(class_counts(df, features, y))))
    full = s.withColumn("mw_p", _mw_p()).withColumn("pointbiserial_p", _student_p_of_r())
    return full.select(
        "feature", "n_success", "n_fail", "median_success", "median_fail", "mean_success", "mean_fail",
        "mw_U", "mw_p", "rank_biserial_r", "pointbiserial_r", "pointbiserial_p",
    ).orderBy(F.asc_nulls_last("mw_p"), "feature")


test_table.__test__ = False  # not a pytest case


def notable(results: DataFrame, p: float = 0.1) -> DataFrame:
    """The features whose rank test stays below ``p``."""
    return results.where(F.col("mw_p") < p).select("feature", "mw_p", "rank_biserial_r")
