"""Source divergence audit by three-dimensional cube partitioning.

Every source of a language is a group with smoothed, rounded frequencies of the language's common terms; the distance
of two sources is the sum of absolute differences over all of those terms. Groups are dealt to blocks, terms are dealt to
blocks, and a task owns a cell (group block, group block, term block): it gets the two slices of counts that the cell
needs, computes the partial distances of its group pairs, and the partials are summed along the term axis. A slice is
sent once for every group block of its language, so the work grows with pairs of sources, which are the result, and no task
holds more than two slices.

Terms are counted inside the tasks that read the documents, so what is shuffled grows with distinct terms, not with
text. All arithmetic is exact for totals below 9 * 10**15: shares are divided digit by digit in 64-bit integers.

Defined cases: null text, lang and source are empty texts, and the empty name is a group like any other; a group without a
kept term takes part with its smoothed frequencies; a language without kept terms has distances of 0; repeated rows are
documents of their own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pledgelens.operators.lookup import lookup_join

from .common import slices, strings, utf8, written

LEAST_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50
#: Groups and terms of a block, on average.
GROUP_BLOCK = 32
TERM_BLOCK = 1024
#: Distinct terms that a task holds before it sends their counts on, and bytes of a text that are split at once.
HELD_TERMS = 200_000
PIECE = 1 << 20

#: Letters of ASCII in lower case, bytes beyond ASCII as they are, all else a blank.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_in(data: bytes):
    """The terms of a UTF-8 text, in lists of about a megabyte."""
    folded, at = data.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents; one row with a null term for every group."""

    def rows(held):
        found = [(g, s, t, n, docs_of[t]) for (g, s), (n_of, docs_of) in held.items() for t, n in [(None, 0), *n_of.items()]]
        columns = list(zip(*found))
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        arrays[2] = arrays[2].cast(pa.string())
        for batch in pa.Table.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"]).to_batches(max_chunksize=65536):
            yield batch

    def counted(batches):
        held, size = defaultdict(lambda: (Counter(), Counter())), 0
        for batch in slices(batches):
            for g, s, data in zip(strings(batch.column("lang")), strings(batch.column("source")), utf8(batch.column("text"))):
                n_of, docs_of = held[g, s]
                size -= len(n_of)
                seen: set = set()
                for words in terms_in(data):
                    n_of.update(words)
                    seen.update(words)
                docs_of.update(seen)
                size += len(n_of)
                if size > HELD_TERMS:
                    yield from rows(held)
                    held, size = defaultdict(lambda: (Counter(), Counter())), 0
        if held:
            yield from rows(held)

    named = docs.select(*[F.col(c).cast("string").alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    parts = named.mapInArrow(counted, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, scale: int = SCALE) -> Column:
    """``1 + floor(scale * count / total)`` for a power of 1000 as scale and counts of at most the total, without overflow."""
    total = F.nullif(total, F.lit(0))
    whole, rest = F.call_function("div", count, total), F.pmod(count, total)
    while scale > 1:
        whole = whole * 1000 + F.call_function("div", rest * 1000, total)
        rest, scale = F.pmod(rest * 1000, total), scale // 1000
    return whole + 1


def _dealt(rows: DataFrame, key: str, size: int, axis: str) -> DataFrame:
    """The rows with a block of their language by hash (``<axis>block`` of ``<axis>blocks``) and a number in it (``<axis>no``)."""
    blocks = rows.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(f"{axis}blocks"))
    inside = Window.partitionBy("lang", f"{axis}block").orderBy(key)
    return (
        lookup_join(rows, blocks, ["lang"])
        .withColumn(f"{axis}block", F.pmod(F.xxhash64(key), F.col(f"{axis}blocks")).cast("int"))
        .withColumn(f"{axis}no", F.row_number().over(inside) - 1)
    )


def _cell(table: pa.Table) -> pa.Table:
    """Partial distances of the group pairs of a cell, from one slice or two."""
    sides = []
    for row in table.sort_by("block").to_pylist():
        p = np.repeat(np.array(row["p0"], np.int64)[:, None], row["width"], axis=1)
        p[row["gno"], row["tno"]] = row["p"]
        sides.append((row["source"], p))
    (names, p), (others, q) = sides[0], sides[-1]
    x, y, v = [], [], []
    for i, name in enumerate(names):
        first = i + 1 if len(sides) == 1 else 0
        v += np.abs(q[first:] - p[i]).sum(axis=1).tolist()
        y += others[first:]
        x += [name] * (len(others) - first)
    lang = [table.column("lang")[0].as_py()] * len(x)
    return pa.table({"lang": pa.array(lang, pa.string()), "x": pa.array(x, pa.string()), "y": pa.array(y, pa.string()),
                     "v": pa.array(v, pa.int64())})


def _distances(groups: DataFrame, kept: DataFrame, entries: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for both orders of every pair of sources of a language."""
    widths = kept.groupBy("lang", "tblock").agg(F.count(F.lit(1)).cast("int").alias("width"))
    spans = kept.groupBy("lang").agg(F.max("tblocks").alias("tblocks"))
    heads = lookup_join(groups, spans, ["lang"]).withColumn(
        "tblock", F.explode(F.sequence(F.lit(0), F.coalesce("tblocks", F.lit(1)) - 1)))
    heads = lookup_join(heads, widths, ["lang", "tblock"])
    axes = ["lang", "gblock", "tblock"]
    heads = heads.groupBy(*axes).agg(
        F.max("gblocks").alias("gblocks"), F.coalesce(F.max("width"), F.lit(0)).alias("width"),
        F.sort_array(F.collect_list(F.struct("gno", "source", F.coalesce("p0", F.lit(0)).alias("p0")))).alias("g"))
    filled = entries.groupBy(*axes).agg(F.collect_list(F.struct("gno", "tno", "p")).alias("e"))
    slices_ = heads.join(filled, axes, "left").select(
        "lang", F.col("gblock").alias("block"), "tblock", "gblocks", "width", F.col("g.source").alias("source"), F.col("g.p0").alias("p0"),
        *[F.coalesce(F.col(f"e.{c}"), F.array().cast(f"array<{t}>")).alias(c) for c, t in (("gno", "int"), ("tno", "int"), ("p", "bigint"))])
    sent = written(slices_, "divergence-slices").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("gblocks") - 1)))
    cells = sent.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("other", "gblocks")
    partial = cells.groupBy("lang", "a", "b", "tblock").applyInArrow(_cell, "lang string, x string, y string, v bigint")
    whole = partial.groupBy("lang", "x", "y").agg(F.sum("v").alias("value"))
    both = F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))
    return whole.select("lang", "value", F.inline(both))


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: distances to the other sources, and the terms a source uses most above its language.

    A language keeps the terms that stand in at least ``least_docs`` of its documents.
    """
    counts = written(term_counts(docs, text, lang, source), "divergence-counts")
    present = counts.where(F.col("term").isNotNull())
    common = present.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least_docs)
    kept = written(_dealt(common.select("lang", "term", "total"), "term", TERM_BLOCK, "t"), "divergence-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    occurring = written(lookup_join(present.select("lang", "term", "source", "n"), kept, ["lang", "term"], "inner"), "divergence-entries")

    sizes = occurring.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    named = counts.where(F.col("term").isNull()).select("lang", "source")
    groups = lookup_join(lookup_join(named, sizes, ["lang", "source"]), langs, ["lang"])
    smoothed = F.lit(SMOOTHING) * F.coalesce("v", F.lit(0))
    groups = groups.withColumn("size", F.coalesce("size", F.lit(0)) + smoothed).withColumn("p0", share(F.lit(SMOOTHING).cast("bigint"), F.col("size")))
    groups = written(_dealt(groups.select("lang", "source", "size", "p0"), "source", GROUP_BLOCK, "g"), "divergence-groups")

    entries = lookup_join(occurring, groups, ["lang", "source"], "inner").withColumn("p", share(F.col("n") + SMOOTHING, F.col("size")))
    pairs = _distances(groups, kept, entries).withColumn("part", F.lit("pair"))
    over = lookup_join(entries, langs, ["lang"]).withColumn(
        "value", F.col("p") - share(F.col("total") + SMOOTHING, F.col("lang_n") + F.col("v") * SMOOTHING))
    terms = over.where((F.col("value") > 0) & (F.col("n") > 0)).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # The limit is applied in the tasks that make the rows too, so a large source does not meet in one task.
    best = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.select(*columns).unionByName(best.select(*columns))
