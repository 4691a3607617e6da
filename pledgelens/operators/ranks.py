"""Exact running counts, ranks and quantiles without a single-task sort.

The rows are first reduced to distinct values with counts, so ties and heavy
values cost nothing. The distinct values are then cut into value ranges; each
range is ordered on its own and shifted by the total of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions import text as T

#: Distinct-value groups up to this many rows are ordered in one task.
SINGLE_RANGE_ROWS = 500_000
#: Value ranges per group beyond that, at least; more rows get more ranges.
RANGES = 200


def melt_numeric(df: DataFrame, columns: list[str], ids: list[str] = ()) -> DataFrame:
    """``(ids.., feature, value)`` with values as double; NaN and null rows dropped."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot(list(ids), columns, "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


#: Limits per chunk of the two-step range search.
CHUNK = 14


def _range_bounds(long: DataFrame, keys: list[str], value: str, max_rows: int | None) -> DataFrame | None:
    """Inner range limits per group, or None when every group is small.

    The limits only steer how the work is spread; any limits give the same
    result. They are fixed on the driver (groups x ranges numbers) so that a
    recomputed task cuts exactly as the first one did.
    """
    most = max_rows or long.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    ranges = max(RANGES, 2 * most // SINGLE_RANGE_ROWS)
    fractions = [i / ranges for i in range(1, ranges)]
    stats = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx(value, fractions, 5 * ranges).alias("limits"))
    rows = stats.collect()
    if not rows or max(r["n"] for r in rows) <= SINGLE_RANGE_ROWS:
        return None
    doubles = t.ArrayType(t.DoubleType())
    schema = long.select(*keys).schema.add("heads", doubles).add("chunks", t.ArrayType(doubles))
    data = []
    for r in rows:
        limits = sorted({float(x) for x in r["limits"]})
        chunks = [limits[i: i + CHUNK] for i in range(0, len(limits), CHUNK)]
        heads = [c[-1] for c in chunks if len(c) == CHUNK]
        data.append(tuple(r[k] for k in keys) + (heads, chunks))
    return long.sparkSession.createDataFrame(data, schema)


def _range_of(value: Column) -> Column:
    """Number of limits below the value: full chunks first, then inside one chunk."""
    whole = F.size(F.filter("heads", lambda limit: limit < value))
    return T.bind(whole, lambda w: w * CHUNK + F.coalesce(
        F.size(F.filter(F.get("chunks", w), lambda limit: limit < value)), F.lit(0)))


def cumulate(
    long: DataFrame, keys: list[str], value: str = "value", measures: dict[str, Column] | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Distinct values per group with each measure's sum, running sum and total.

    ``max_rows`` is a known upper limit of a group's rows; a small one saves the
    pass that looks for range limits. Returns ``keys, value`` and for every measure ``m``: ``m`` (at the value),
    ``m_before`` (over smaller values) and ``m_total`` (over the group).
    """
    measures = measures or {"n": F.count(F.lit(1))}
    small = max_rows is not None and max_rows <= SINGLE_RANGE_ROWS
    bounds = None if small else _range_bounds(long, keys, value, max_rows)
    counts = long.groupBy(*keys, value).agg(*[expr.alias(m) for m, expr in measures.items()])
    if bounds is None:
        running = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*keys)
        return counts.select(
            "*",
            *[F.coalesce(F.sum(m).over(running), F.lit(0)).alias(f"{m}_before") for m in measures],
            *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures])
    ranged = counts.join(F.broadcast(bounds), keys).withColumn(
        "__range", _range_of(F.col(value))).drop("heads", "chunks")
    totals = ranged.groupBy(*keys, "__range").agg(*[F.sum(m).alias(f"__{m}") for m in measures])
    over_ranges = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "__range",
        *[F.coalesce(F.sum(f"__{m}").over(over_ranges), F.lit(0)).alias(f"__{m}_offset") for m in measures],
        *[F.sum(f"__{m}").over(Window.partitionBy(*keys)).alias(f"{m}_total") for m in measures])
    inside = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    # At most RANGES rows per group, so the offsets always fit a broadcast.
    placed = ranged.select(
        "*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"__{m}_inside") for m in measures]
    ).join(F.broadcast(offsets), [*keys, "__range"])
    return placed.select(
        *keys, value, *measures,
        *[(F.col(f"__{m}_inside") + F.col(f"__{m}_offset")).alias(f"{m}_before") for m in measures],
        *[f"{m}_total" for m in measures])


def average_ranks(cumulated: DataFrame) -> DataFrame:
    """Add ``rank``: the mean rank of tied values, starting at one."""
    return cumulated.withColumn("rank", F.col("n_before") + (F.col("n") + 1) / F.lit(2.0))


def quantiles(cumulated: DataFrame, keys: list[str], probs: dict[str, float], value: str = "value") -> DataFrame:
    """Exact interpolated quantiles per group from :func:`cumulate` output."""

    def order_statistic(index: Column) -> Column:
        at = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
        return F.max(F.when(at, F.col(value)))

    aggs = []
    for name, p in probs.items():
        position = (F.col("n_total") - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)
        aggs += [order_statistic(low).alias(f"__{name}_lo"), order_statistic(high).alias(f"__{name}_hi"),
                 F.max(position - low).alias(f"__{name}_w")]
    got = cumulated.groupBy(*keys).agg(*aggs)
    return got.select(*keys, *[
        (F.col(f"__{n}_lo") + (F.col(f"__{n}_hi") - F.col(f"__{n}_lo")) * F.col(f"__{n}_w")).alias(n)
        for n in probs])


# --------------------------------------------------------------------------
# Exact row numbers in hash order
# --------------------------------------------------------------------------
def hash_key(id_col: str, seed: int) -> Column:
    """A portable pseudo-random ordering key of a row."""
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def shuffled_row_number(df: DataFrame, id_col: str, by: list[str], seed: int, name: str = "rn") -> DataFrame:
    """Exact row numbers inside each ``by`` group, in hash order of the id.

    The hash spreads evenly, so its first digits cut a group of any size into
    even slices; a slice is numbered alone and shifted by the slices before it.
    """
    keyed = df.withColumn("__h", hash_key(id_col, seed)).withColumn("__s", F.substring("__h", 1, 3))
    sizes = keyed.groupBy(*by, "__s").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "__s", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    slot = Window.partitionBy(*by, "__s").orderBy("__h", id_col)
    numbered = keyed.withColumn("__r", F.row_number().over(slot))
    # 4096 slices per group: a bounded broadcast for class-like groups.
    return (
        numbered.join(F.broadcast(offsets), [*by, "__s"])
        .withColumn(name, F.col("__r") + F.col("__o"))
        .drop("__h", "__s", "__r", "__o")
    )
