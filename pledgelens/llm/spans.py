"""Places of regular expressions in texts with DataFrame functions alone.

A text split at a pattern and the matches of that pattern alternate, so the lengths of the parts before a match add up to
its start. Both walk the text from the left without overlaps. Offsets are code points, ends exclusive.

Patterns are Java's. Possessive quantifiers and look-behinds keep them linear on long runs of one kind of character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = "array<struct<start:int,end:int,value:string>>"
#: Matches that are numbered at a time; blocks of them are numbered first.
BLOCK = 256


def _placed(gaps: Column, found: Column) -> Column:
    """The matches of one block with places that count from the block's start."""
    begin = F.struct(F.lit(0).alias("at"), F.lit(None).cast(MATCHES).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(acc["out"].isNull(), one).otherwise(F.concat(acc["out"], one)).alias("out"))

    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
    return F.aggregate(pairs, begin, step)


def placed(gaps: Column, found: Column) -> Column:
    """All matches with their places. Long lists go by blocks, so the work stays in proportion."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(found) / BLOCK).cast("int") - 1, F.lit(0))),
        lambda b: _placed(F.slice(gaps, b * BLOCK + 1, F.least(F.lit(BLOCK), F.size(found) - b * BLOCK)), F.slice(found, b * BLOCK + 1, BLOCK)),
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{MATCHES}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"]
        moved = F.transform(
            x["out"], lambda m: F.struct((m["start"] + at).alias("start"), (m["end"] + at).alias("end"), m["value"].alias("value"))
        )
        return F.struct((at + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    return F.flatten(F.aggregate(blocks, begin, step)["out"])


def with_matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """The rows with a column of ``MATCHES`` for each name; where its condition is false it is empty and nothing is searched."""
    none = F.array().cast("array<string>")
    found = {}
    for name, (pattern, condition) in patterns.items():
        all_found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        found[f"__{name}"] = F.coalesce(all_found if condition is None else F.when(condition, all_found), none)
    df = df.withColumns(found)
    places = {}
    for name, (pattern, _) in patterns.items():
        gaps = F.split(F.col(text), pattern, -1)
        places[name] = F.when(F.size(f"__{name}") > 0, placed(gaps, F.col(f"__{name}"))).otherwise(F.array().cast(MATCHES))
    return df.withColumns(places).drop(*found)


def tagged(matches: Column, order: int, kind: str) -> Column:
    """The places as rows that sort by start and then by the order of the kinds."""
    return F.transform(
        matches, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("kind_order"), m["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def listing(tags: Column) -> Column:
    """kind:start:end of sorted places, joined by commas."""
    return F.array_join(F.transform(tags, lambda t: F.concat_ws(":", t["kind"], t["start"], t["end"])), ",")
