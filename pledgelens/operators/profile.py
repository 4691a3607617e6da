"""Table profiles: overview, counts, histograms, boxes, correlations, class tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks as R
from .columns import MAX_CLASSES, class_sizes, numeric_columns, string_columns, varying_columns
from .gram import summed
from .lookup import lookup_join
from .stored import stored


def overview(df: DataFrame, order_by: str) -> DataFrame:
    """Per column: type, distinct values, missing values and a sample.

    The sample is the value of the row with the smallest ``order_by``. Distinct
    counting runs on pairs of column and 128-bit hash, so every column spreads over
    tasks and no long text is shuffled.
    """
    types = dict(df.dtypes)
    as_text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns],
                        F.col(order_by).alias("__key"))
    wide = as_text.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.struct(F.count(c).alias("n"), F.min_by(c, "__key").alias("s")).alias(c) for c in df.columns])
    basics = wide.unpivot(["n_rows"], df.columns, "column", "x")
    distinct = (
        as_text.select(*[F.md5(c).alias(c) for c in df.columns])
        .unpivot([], df.columns, "column", "value").where("value is not null")
        .groupBy("column", "value").agg(F.lit(1).alias("one"))
        .groupBy("column").agg(F.count(F.lit(1)).alias("n_unique")))
    kinds = F.create_map(*[F.lit(v) for item in types.items() for v in item])
    missing = F.col("n_rows") - F.col("x.n")
    return basics.join(F.broadcast(distinct), "column", "left").select(
        "column", F.element_at(kinds, F.col("column")).alias("dtype"),
        F.coalesce("n_unique", F.lit(0)).alias("n_unique"), missing.alias("n_missing"),
        F.round(F.try_divide(missing * 100.0, F.col("n_rows")), 2).alias("pct_missing"),
        F.col("x.s").alias("sample"))


def numeric_describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum, four decimals."""
    columns = columns or numeric_columns(df)
    long = R.melt_numeric(df, columns)
    basics = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quart = R.quantiles(R.cumulate(long, ["feature"], max_rows=df.count()), ["feature"], {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    joined = basics.join(F.broadcast(quart), "feature")
    return joined.select("feature", "count", *[
        F.round(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def value_counts(df: DataFrame, columns: list[str], top: int = 20) -> DataFrame:
    """The most frequent values per column, missing included; ties by the value's MD5.

    Values are counted by their 128-bit hash, and the top-k filter is pushed below
    the shuffle. A second scan fetches the values of the at most ``top`` winners per
    column, so no text is a key and a column with countless values never meets in one task.
    """
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    hashes = text.select(*[F.md5(c).alias(c) for c in columns]).unpivot([], columns, "column", "hash")
    counts = hashes.groupBy("column", "hash").agg(F.count(F.lit(1)).alias("count"))
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc_nulls_last("hash"))
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    values = (
        text.unpivot([], columns, "column", "value").withColumn("hash", F.md5("value"))
        .join(F.broadcast(best.select("column", "hash")), ["column", "hash"])
        .groupBy("column", "hash").agg(F.min("value").alias("value")))
    return best.join(F.broadcast(values), ["column", "hash"], "left").select(
        "column", F.coalesce("value", F.lit("nan")).alias("value"), "count", "rank")


def categorical_counts(df: DataFrame, top: int = 20, skip: list[str] = ()) -> DataFrame:
    return value_counts(df, string_columns(df, skip), top)


def missing_report(df: DataFrame) -> DataFrame:
    """Per cent missing of the columns that miss anything, most first."""
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in df.columns])
    long = wide.unpivot(["n"], df.columns, "column", "filled")
    pct = F.round(F.try_divide((F.col("n") - F.col("filled")) * 100.0, F.col("n")), 2)
    return long.select("column", pct.alias("pct_missing")).where("pct_missing > 0").orderBy(
        F.desc("pct_missing"), "column")


def target_balance(df: DataFrame, y: str) -> DataFrame:
    counts = df.groupBy(F.col(y).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("__n"))
    return counts.join(F.broadcast(total)).select(
        "class", "count", F.round(F.col("count") * 100.0 / F.col("__n"), 2).alias("pct"))


def dataset_meta(df: DataFrame) -> DataFrame:
    missing = sum((F.count(F.lit(1)) - F.count(c) for c in df.columns), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), missing.alias("n_missing_total")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"), F.lit(len(numeric_columns(df))).alias("n_numeric"),
        F.lit(len(string_columns(df))).alias("n_categorical"), "n_missing_total")


def histogram(df: DataFrame, columns: list[str], bins: int | None = None, by: list[str] = ()) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last bin closed, empty bins kept.

    Without ``bins`` their number is half the rows, within 5 and 30. With ``by``
    each group has its own range. Adds the density of the bin in its group.
    """
    keys = [*by, "feature"]
    if by:
        class_sizes(df, by)
    long = R.melt_numeric(df, columns, by)
    stats = long.groupBy(*keys).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n")).where("hi > lo")
    wanted = F.lit(bins) if bins else F.least(F.lit(30), F.greatest(F.lit(5), F.floor(F.col("n") / 2)))
    stats = stats.withColumn("bins", wanted.cast("int"))
    slot = F.least(
        F.floor((F.col("value") - F.col("lo")) * F.col("bins") / (F.col("hi") - F.col("lo"))).cast("int"),
        F.col("bins") - 1)
    # Few groups (checked) x columns x bins: bounded broadcasts.
    counts = long.join(F.broadcast(stats), keys).groupBy(*keys, slot.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return grid.join(F.broadcast(counts), [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("lo") + width * F.col("bin")).alias("edge_lo"),
        (F.col("lo") + width * (F.col("bin") + 1)).alias("edge_hi"),
        F.coalesce("count", F.lit(0)).alias("count"),
        (F.coalesce("count", F.lit(0)) / (F.col("n") * width)).alias("density"))


def class_histogram(df: DataFrame, columns: list[str], y: str, bins: int = 15) -> DataFrame:
    return histogram(df, columns, bins, [y])


def box_stats(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Quartiles, whiskers (farthest values within 1.5 ranges) and outlier count."""
    keys = [*by, "feature"]
    if by:
        class_sizes(df, by)
    cum = R.cumulate(R.melt_numeric(df, columns, by), keys, max_rows=df.count())
    quart = R.quantiles(cum, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    joined = cum.join(F.broadcast(quart), keys)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return joined.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("n_outliers"))


# --------------------------------------------------------------------------
# Correlations
# --------------------------------------------------------------------------
def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, r)`` for every column pair, pairwise complete, in one aggregate."""
    clean = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    pairs = list(combinations(columns, 2))
    wide = clean.agg(*[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    names = F.create_map(*[x for i, (a, b) in enumerate(pairs)
                           for x in (F.lit(f"p{i}"), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    return wide.unpivot([], [f"p{i}" for i in range(len(pairs))], "k", "r").select(
        F.element_at(names, F.col("k"))["a"].alias("a"), F.element_at(names, F.col("k"))["b"].alias("b"), "r")


def _pair_cells(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``(a, b, x, y, n)``: joint value counts of column pairs, both present."""
    columns = sorted({c for pair in pairs for c in pair})
    wide = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
        for a, b in pairs])
    return (
        wide.select(F.inline(cells)).where("x is not null and y is not null")
        .groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n")))


def _rank_products(cells: DataFrame, left: DataFrame, right: DataFrame, lkeys: list[str], rkeys: list[str]) -> DataFrame:
    """``(a, b, r)`` from joint counts and the ranks of both sides.

    The rank tables carry the value counts, so their heavy values are known.
    """

    def heavy(ranks: DataFrame) -> DataFrame:
        return ranks.where((F.col("w") >= 1000) & (F.col("w") >= F.col("w_total") * 0.002))

    joined = lookup_join(cells, left.drop("w", "w_total"), lkeys, "inner", hot=heavy(left))
    joined = lookup_join(joined, right.drop("w", "w_total"), rkeys, "inner", hot=heavy(right))
    n = F.sum("n").cast("double")
    sx, sy = F.sum(F.col("n") * F.col("rx")), F.sum(F.col("n") * F.col("ry"))
    sxy = F.sum(F.col("n") * F.col("rx") * F.col("ry"))
    sxx, syy = F.sum(F.col("n") * F.col("rx") * F.col("rx")), F.sum(F.col("n") * F.col("ry") * F.col("ry"))
    scale = F.sqrt(n * sxx - sx * sx) * F.sqrt(n * syy - sy * sy)
    return joined.groupBy("a", "b").agg(F.try_divide(n * sxy - sx * sy, scale).alias("r"))


def _column_ranks(wide: DataFrame, columns: list[str], n_rows: int) -> DataFrame:
    """``(feature, value, rank, w, w_total)``: average rank and number of rows of each distinct value."""
    ranks = R.average_ranks(R.cumulate(R.melt_numeric(wide, columns), ["feature"], max_rows=n_rows))
    return ranks.select("feature", "value", "rank", F.col("n").alias("w"), F.col("n_total").alias("w_total"))


def _rank_rows(wide: DataFrame, columns: list[str], ranks: DataFrame) -> DataFrame:
    """The rows with each value replaced by its rank: two shuffles of rows x columns, whatever the pairs.

    The rows are stored with a number first, so that a task that is repeated gives a row the same number.
    """
    heavy = ranks.where((F.col("w") >= 1000) & (F.col("w") >= F.col("w_total") * 0.002))
    long = R.melt_numeric(stored(wide.withColumn("__row", F.monotonically_increasing_id()), "ranked-rows"), columns, ["__row"])
    ranked = lookup_join(long, ranks.select("feature", "value", "rank"), ["feature", "value"], "inner", hot=heavy, salt_on=["__row"])
    return ranked.groupBy("__row").agg(*[F.max(F.when(F.col("feature") == c, F.col("rank"))).alias(c) for c in columns])


#: Distinct values of all columns whose ranks are sent to every executor: 16 bytes each.
RANK_ROWS = 2_000_000


def _rank_gram(wide: DataFrame, columns: list[str], ranks: DataFrame, n_rows: int) -> np.ndarray:
    """Sums of products of centred ranks; the ranks of bounded numbers of distinct values are looked up in place, without a shuffle."""
    found = ranks.select("feature", "value", "rank").toArrow().sort_by([("feature", "ascending"), ("value", "ascending")])
    names, values, rank = found.column("feature").to_numpy(), found.column("value").to_numpy(), found.column("rank").to_numpy()
    tables = [(values[names == c], rank[names == c]) for c in columns]
    shared = wide.sparkSession.sparkContext.broadcast(tables)

    def block(rows: np.ndarray) -> np.ndarray:
        x = np.column_stack([r[np.searchsorted(v, rows[:, i])] for i, (v, r) in enumerate(shared.value)]) - (n_rows + 1) / 2
        return (x.T @ x).ravel()

    return summed(wide, columns, block).reshape(len(columns), len(columns))


def _complete_pairs(wide: DataFrame, pairs: list[tuple[str, str]], n_rows: int) -> list[dict]:
    """Rank correlations of pairs whose columns have a value in all of the ``n_rows`` rows: each column is ranked once, one pass takes all pairs."""
    used = sorted({c for p in pairs for c in p})
    ranks = _column_ranks(wide, used, n_rows).persist()
    try:
        if n_rows and ranks.count() <= RANK_ROWS:
            gram = _rank_gram(wide, used, ranks, n_rows)
            scale = np.sqrt(np.diag(gram))
            at = {c: i for i, c in enumerate(used)}
            return [{"a": a, "b": b, "r": float(gram[at[a], at[b]] / s) if (s := scale[at[a]] * scale[at[b]]) else None} for a, b in pairs]
        ranked = _rank_rows(wide, used, ranks)
        row = ranked.agg(*[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
        return [{"a": a, "b": b, "r": row[f"p{i}"]} for i, (a, b) in enumerate(pairs)]
    finally:
        ranks.unpersist()


def spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``(a, b, r)``: rank correlation with average ranks of the complete rows.

    Columns without missing values are ranked once, the ranks go back into the rows (looked up in place where the distinct values are few
    enough to be sent, by a join otherwise), and one aggregate takes all their pairs. Pairs with one column that misses values are taken
    in the same way over the rows that have it, all pairs of that column together; only pairs of two such columns count their joint values.
    One number per pair comes back, so the result is computed at once and the shared counts are released.
    """
    columns = sorted({c for pair in pairs for c in pair})
    wide = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns]).persist()
    found = []
    try:
        filled = wide.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in columns]).first()
        n_rows = filled["__n"]
        full = {c for c in columns if filled[c] == n_rows}
        whole = [p for p in pairs if set(p) <= full]
        if whole:
            found += _complete_pairs(wide, whole, n_rows)
        for c in columns:
            own = [p for p in pairs if set(p) - full == {c}]
            if own and filled[c]:
                found += _complete_pairs(wide.where(F.col(c).isNotNull()), own, filled[c])
        partial = [p for p in pairs if len(set(p) - full) == 2]
        if partial:
            cells = _pair_cells(wide, partial).persist()

            def side_ranks(side: str) -> DataFrame:
                cum = R.cumulate(cells, ["a", "b"], side, {"n": F.sum("n")}, max_rows=n_rows)
                return R.average_ranks(cum).select(
                    "a", "b", side, F.col("rank").alias(f"r{side}"), F.col("n").alias("w"),
                    F.col("n_total").alias("w_total"))

            found += _rank_products(cells, side_ranks("x"), side_ranks("y"), ["a", "b", "x"], ["a", "b", "y"]).collect()
            cells.unpersist()
    finally:
        wide.unpersist()
    rows = [(r["a"], r["b"], r["r"]) for r in found]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def corr_matrix(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """Upper triangle of the correlation matrix, four decimals."""
    columns = varying_columns(df, columns or numeric_columns(df))
    if method == "pearson":
        out = pearson_matrix(df, columns)
    elif method == "spearman":
        out = spearman_pairs(df, list(combinations(columns, 2)))
    else:
        raise ValueError(f"unknown method {method}")
    return out.withColumn("r", F.round("r", 4))


def target_corr(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """Signed rank correlation of each feature with the target, ascending."""
    return spearman_pairs(df, [(c, y) for c in columns if c != y]).select(
        F.col("a").alias("feature"), F.col("r")).orderBy("r", "feature")


def top_corr(df: DataFrame, columns: list[str], targets: list[str], top: int = 20) -> DataFrame:
    """The strongest absolute rank correlations per target."""
    pairs = [(c, y) for y in targets for c in columns if c != y]
    out = spearman_pairs(df, pairs).select(
        F.col("b").alias("target"), F.col("a").alias("feature"), F.round(F.abs("r"), 4).alias("abs_corr_spearman"))
    order = Window.partitionBy("target").orderBy(F.desc("abs_corr_spearman"), "feature")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


# --------------------------------------------------------------------------
# By target
# --------------------------------------------------------------------------
def group_stats(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """Mean, exact median, sample deviation and count per feature and class."""
    long = R.melt_numeric(df.where(F.col(y).isNotNull()), columns, [y])
    keys = [y, "feature"]
    class_sizes(df, y)
    basics = long.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.count("value").alias("count"))
    medians = R.quantiles(R.cumulate(long, keys, max_rows=df.count()), keys, {"median": 0.5})
    return basics.join(F.broadcast(medians), keys).select(*keys, "mean", "median", "std", "count")


def linear_trend(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """Least-squares line of ``y`` on each feature with at least three complete rows."""
    wide = df.agg(*[
        F.struct(F.regr_slope(y, c).alias("slope"), F.regr_intercept(y, c).alias("intercept"),
                 F.regr_count(y, c).alias("n")).alias(c)
        for c in columns if c != y])
    return wide.unpivot([], [c for c in columns if c != y], "feature", "s").select(
        "feature", "s.slope", "s.intercept", "s.n").where("n >= 3")


def few_valued_columns(df: DataFrame, columns: list[str], max_distinct: int) -> list[str]:
    """Columns with at most ``max_distinct`` non-null values."""
    long = df.select(*[F.md5(F.col(c).cast("string")).alias(c) for c in columns]).unpivot([], columns, "column", "value")
    counts = long.where("value is not null").groupBy("column", "value").count().groupBy("column").count()
    many = {r["column"] for r in counts.where(F.col("count") > max_distinct).select("column").collect()}
    return [c for c in columns if c not in many]


def category_bars(df: DataFrame, columns: list[str] | None = None, top: int = 20, max_distinct: int | None = None) -> DataFrame:
    """Top values per column; ``max_distinct`` leaves out the columns that have more values."""
    columns = columns or string_columns(df)
    return value_counts(df, columns if max_distinct is None else few_valued_columns(df, columns, max_distinct), top)


def success_rate(df: DataFrame, col: str, y: str, top: int = 20) -> DataFrame:
    """Mean target and rows per category, best first, ties by name."""
    rates = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.avg(y).alias("mean"), F.count(y).alias("count"))
    return rates.where("count >= 1").orderBy(F.desc("mean"), col).limit(top)


def profile_report(
    df: DataFrame, order_by: str, y: str | None = None, target: str | None = None, skip: list[str] = ()
) -> dict[str, DataFrame]:
    """All profile tables by the path they are written under."""
    nums = varying_columns(df, numeric_columns(df, skip))
    cats = string_columns(df, skip)
    report = {
        "summary/overview": overview(df, order_by),
        "summary/numeric_describe": numeric_describe(df, numeric_columns(df)),
        "summary/missing_report": missing_report(df),
        "summary/dataset_meta": dataset_meta(df),
        "distributions/histograms": histogram(df, nums),
        "distributions/boxes": box_stats(df, nums),
    }
    if cats:
        report["summary/categorical_counts"] = categorical_counts(df, skip=skip)
        report["categorical/bars"] = category_bars(df, cats)
    if len(nums) >= 2:
        report["correlations/corr_pearson"] = corr_matrix(df, nums, "pearson")
        report["correlations/corr_spearman"] = corr_matrix(df, nums, "spearman")
        targets = [c for c in (y, target) if c in nums]
        if targets:
            report["correlations/top_corr_with_target"] = top_corr(df, nums, targets)
    if y is not None:
        report["summary/target_balance"] = target_balance(df, y)
        report["target_analysis/group_stats"] = group_stats(df, [c for c in nums if c != y], y)
        for c in few_valued_columns(df, cats, MAX_CLASSES) if cats else []:
            report[f"categorical/success_{c}"] = success_rate(df, c, y)
    if target is not None and target in df.columns:
        report["bivariate/trends"] = linear_trend(df, [c for c in nums if c != target], target)
    return report
