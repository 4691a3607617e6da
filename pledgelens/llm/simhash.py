"""SimHash near-duplicates by tiled exact comparison.

Each whole text gets a 64-bit fingerprint. Distinct fingerprints are sorted into tiles by the population counts of
their four 16-bit words. The counts of two fingerprints differ in sum by no more than their bits do, so a pair of
tiles whose counts differ beyond the radius is skipped and no link is lost. The other tile pairs are compared
whole with numpy exclusive-or and bit counts. Large tiles are cut into blocks, so a task holds two blocks at a time, and a
pair of blocks reports a spanning forest of its links, not every pair.

Links join classes of equal fingerprints, so copies are never expanded into pairs. Components are found over those links alone.

Defined cases: a null or empty text has fingerprint zero, linked like any other; texts of fewer words than a
shingle are one shingle; repeated rows give a row each; rows without an id get a component from the ids they are
linked with, or null if there is none. Columns of the input that bear an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgelens.operators.lookup import lookup_join

from .common import extended, schema_with, slices, utf8, written
from .components import components

SEED = 42
#: Words of a shingle, and the most bits in which linked fingerprints differ.
SHINGLE = 3
RADIUS = 3
#: Most keys of leaving documents that are sent to every executor; beyond that the documents are shuffled once.
GONE = 2_000_000
#: Fingerprints of a block; two blocks are compared at a time.
BLOCK = 4096
#: Rows of a block that are compared with the other block at once.
STRIP = 256


def shingle_hashes(data: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every run of so many words, repeats included; of all words if there are fewer."""
    words = data.lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())], np.uint64
    )


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text: bit set if over half of its shingle hashes have it."""
    return majority(shingle_hashes(data, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[part:part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(hashes)))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, keep_text: bool = False) -> DataFrame:
    """The documents with ``bits``: the fingerprint as a signed 64-bit number."""
    drop = () if keep_text else (text,)

    def hashed(batches):
        for batch in slices(batches):
            made = [fingerprint(x, shingle) for x in utf8(batch.column(text))]
            yield extended(batch, drop, bits=pa.array(np.array(made, np.uint64).view(np.int64)))

    return docs.mapInArrow(hashed, schema_with(docs, drop, bits="bigint"))


def neighbours(radius: int) -> list[tuple[int, int, int, int]]:
    """Differences of the four counts within the radius, one of each pair of opposites (and none at all)."""
    span = range(-radius, radius + 1)
    near = [
        (a, b, c, d) for a in span for b in span for c in span for d in span
        if abs(a) + abs(b) + abs(c) + abs(d) <= radius
    ]
    return [x for x in near if x >= (0, 0, 0, 0)]


def _counts(bits):
    words = [F.bit_count(F.shiftrightunsigned(bits, 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    return [w.cast("int") for w in words]


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in a, places in b) of the fingerprints within the radius, strip by strip."""
    for at in range(0, len(a), STRIP):
        differing = np.bitwise_count(np.bitwise_xor(a[at:at + STRIP, None], b[None, :]))
        i, j = np.nonzero(differing <= radius)
        if len(i):
            yield i + at, j


class Forest:
    """Sets of numbers that are joined pair by pair."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        """True if the two were apart."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def tile_links(distinct: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` between the distinct ``bits``: every component of near fingerprints is connected by them."""
    # A tile's fingerprints are dealt to blocks by hash; the number of blocks follows the tile's size.
    tiled = distinct.select("bits", F.array(*_counts(F.col("bits"))).alias("tile"))
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(block / 2)).cast("int").alias("blocks"))
    blocks = (
        lookup_join(tiled, sizes, ["tile"])
        .withColumn("block", F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int"))
        .groupBy("tile", "block").agg(F.sort_array(F.collect_list("bits")).alias("members"))
    )
    blocks = written(blocks, "simhash-blocks")
    steps = F.array(*[F.array(*[F.lit(x) for x in d]) for d in neighbours(radius)])
    left = (
        blocks.select(F.col("tile").alias("from_tile"), F.col("block").alias("from_block"), "members", F.explode(steps).alias("step"))
        .select("from_tile", "from_block", F.col("members").alias("mine"),
                F.zip_with("from_tile", "step", lambda x, y: x + y).alias("tile"))
    )
    pairs = left.join(blocks, "tile").where(
        (F.col("from_tile") != F.col("tile")) | (F.col("from_block") <= F.col("block"))
    ).select("mine", F.when((F.col("from_tile") != F.col("tile")) | (F.col("from_block") != F.col("block")), F.col("members")).alias("other"))

    def compared(batches):
        for batch in batches:
            for mine, other in zip(batch.column("mine"), batch.column("other")):
                a = mine.values.to_numpy(zero_copy_only=False).view(np.uint64)
                b = a if other.values is None else other.values.to_numpy(zero_copy_only=False).view(np.uint64)
                forest, links = Forest(), []
                for i, j in close_pairs(a, b, radius):
                    x, y = a[i].view(np.int64).tolist(), b[j].view(np.int64).tolist()
                    links += [(p, q) for p, q in zip(x, y) if p != q and forest.join(p, q)]
                if links:
                    yield pa.RecordBatch.from_pydict({"a": [p for p, _ in links], "b": [q for _, q in links]})

    return pairs.mapInArrow(compared, "a bigint, b bigint")


def _grouped(classes: DataFrame, radius: int) -> DataFrame:
    """The classes of equal ``bits`` with the ``label`` of their component."""
    labels = components(tile_links(classes.select("bits"), radius)).withColumnRenamed("a", "bits")
    return classes.join(labels, "bits", "left").withColumn("label", F.coalesce("label", "bits"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per document: its id, ``fingerprint`` (16 hexadecimal digits), ``component_id`` and ``class_size`` (equal fingerprints)."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = written(fingerprints(keyed, "text", shingle), "simhash-prints")
    classes = prints.groupBy("bits").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("class_size"))
    grouped = _grouped(written(classes, "simhash-classes"), radius)
    lowest = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = written(lookup_join(grouped, lowest, ["label"]).select("bits", "component_id", "class_size"), "simhash-components")
    out = lookup_join(prints, named, ["bits"])
    return out.select(
        F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "class_size"
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each group of near copies, that with the smallest id, with all its columns.

    Groups are those of ``near_duplicates``. Rows without an id go before none with one; of rows equal in id and text one stays.
    """
    row = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.coalesce(F.col(text), F.lit("")))))
    keyed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), row.alias("row"))
    prints = written(fingerprints(keyed, "text", shingle), "dedup-prints")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = prints.groupBy("bits").agg(F.min(order).alias("first"))
    grouped = _grouped(written(classes, "dedup-classes"), radius)
    first = grouped.groupBy("label").agg(F.min("first").alias("kept"))
    named = written(lookup_join(grouped, first, ["label"]).select("bits", F.col("kept.row").alias("kept")), "dedup-named")
    # What leaves is known by its row key, 16 bytes; up to ``GONE`` keys reach the documents without a shuffle of their texts.
    judged = lookup_join(prints.groupBy("bits", "row").agg(F.count(F.lit(1)).alias("n")), named, ["bits"])
    judged = written(judged.select(F.col("row").alias("__row"), "n", (F.col("row") == F.col("kept")).alias("stays")), "dedup-rows")
    rows = docs.withColumn("__row", row).select("__row", F.struct(*docs.columns).alias("__doc"))
    kept = lookup_join(rows, judged.where(~F.col("stays")).select("__row"), ["__row"], "left_anti", GONE)
    again = judged.where(F.col("stays") & (F.col("n") > 1)).select("__row")
    if again.limit(1).count():
        # Rows that stay and are repeated.
        once = lookup_join(kept, again, ["__row"], "left_semi", GONE).groupBy("__row").agg(F.first("__doc").alias("__doc"))
        kept = lookup_join(kept, again, ["__row"], "left_anti", GONE).unionByName(once)
    return kept.select("__doc.*")
