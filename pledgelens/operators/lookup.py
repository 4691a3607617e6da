"""Joins of a large table with a lookup table of checked size.

A side is broadcast only after a bounded count of its rows and bytes proved it small. Beyond the bound the join
shuffles, and the keys that hold a large share of the rows are answered from a small broadcast of their own, so
no task receives a hot key. Rows with a null key match nothing and are spread too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest lookup table that is sent to every executor: in rows, and in bytes of its values as text.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when the table has at most ``max_rows`` rows and ``max_bytes`` bytes (reads no more rows than that)."""
    width = F.octet_length(F.to_json(F.struct(*df.columns)))
    found = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return found[0] <= max_rows and found[1] <= max_bytes


def lookup_join(
    big: DataFrame, lookup: DataFrame, on: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS,
    hot: DataFrame | None = None, salt_on: list[str] | None = None,
) -> DataFrame:
    """Join with a lookup table of unique keys, broadcast only when its size is checked."""
    if fits_broadcast(lookup, max_rows):
        return big.join(F.broadcast(lookup), on, how)
    return hot_key_join(big, lookup, on, how, hot, salt_on)


def hot_keys(big: DataFrame, on: list[str], share: float = 0.002) -> DataFrame:
    """Keys that hold at least ``share`` of all rows: at most ``1/share`` rows."""
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = big.agg(F.count(F.lit(1)).alias("__total"))
    return (
        counts.join(F.broadcast(total))
        .where(F.col("__n") >= F.greatest(F.col("__total") * share, F.lit(1000.0)))
        .select(*on)
    )


#: Pieces a hot key's rows are cut into on their way through the shuffle.
SALTS = 64


def _hashable(df: DataFrame) -> list[str]:
    """The columns that a hash can be taken of: those without a map in them."""
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def hot_key_join(
    big: DataFrame, lookup: DataFrame, on: list[str], how: str = "left", hot: DataFrame | None = None,
    salt_on: list[str] | None = None,
) -> DataFrame:
    """Shuffle join in which hot keys are answered by a small broadcast instead.

    ``lookup`` must have unique keys; ``hot`` may name the hot keys (a table of at most ``BROADCAST_ROWS`` rows)
    when they are known. Rows with a hot or a null key get a salt, from the columns ``salt_on`` or all that can be hashed, so
    the shuffle spreads them; hot ones take their values from the broadcast. The result equals
    ``big.join(lookup, on, how)`` for left, inner, left_semi and left_anti.
    """
    hot = hot_keys(big, on) if hot is None else hot.select(*on)
    values = [c for c in lookup.columns if c not in on]
    renamed = lookup.select(*on, F.lit(True).alias("__in_hot"), *[F.col(c).alias(f"__hot_{c}") for c in values])
    answers = hot.withColumn("__hot", F.lit(True)).join(renamed, on, "left")
    marked = big.join(F.broadcast(answers) if fits_broadcast(answers) else answers, on, "left")
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in salt_on or _hashable(big)]), F.lit(SALTS)) + 1
    unmatched = F.lit(False)
    for c in on:
        unmatched = unmatched | F.col(c).isNull()
    salted = marked.withColumn("__salt", F.when(F.col("__hot") | unmatched, spread).otherwise(F.lit(0)).cast("bigint"))
    cold = lookup.withColumns({"__salt": F.lit(0).cast("bigint"), "__in_cold": F.lit(True)})
    joined = salted.join(cold, [*on, "__salt"], "left")
    found = F.col("__in_hot").isNotNull() | F.col("__in_cold").isNotNull()
    if how == "left_anti":
        return joined.where(~found).select(*big.columns)
    if how == "left_semi":
        return joined.where(found).select(*big.columns)
    out = joined if how == "left" else joined.where(found)
    taken = [F.coalesce(F.col(c), F.col(f"__hot_{c}")).alias(c) for c in values]
    rest = [c for c in big.columns if c not in on]
    return out.select(*on, *rest, *taken)
