"""Embedding near-duplicates by cross-polytope hashing.

A vector is turned by three random sign changes, each followed by a fast Hadamard transform; its hash is the nearest
vertex of the cross-polytope, the largest coordinate with its sign. A table's code joins as many hashes as keep random vectors
apart, so codes grow with the logarithm of the rows. Each vector stands in the bucket of its own code and asks at the next likely
ones (multiprobe: the vertices of the next largest coordinates, by lost height). The number of tables follows from the
probability, measured on random pairs of just the asked cosine, that a pair meets in one.

Buckets first hold identifiers and 128 sign bits alone. Only members with a partner within the bits that the cosine lets
expect get their vectors, and cosines in double precision decide. A pair may meet in several buckets; it counts in the first
one, which both sides can tell from their own codes, so pairs are never listed, shuffled or made distinct: a task returns
numbers of links per vector and a spanning forest. Large buckets are cut into blocks that are compared two by two.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, not even their
copies; vectors of different lengths do not link; equal vectors are one class and are not expanded into pairs; repeated rows are
vectors of their own; a row without an id is counted as a partner, and its component is named by the ids in it or null if
there is none. Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgelens.operators.lookup import lookup_join

from .common import slices, written
from .components import components

SEED = 42
COSINE = 0.9
#: Random vectors that share a bucket on average, probes a table, and the share of pairs of just the asked cosine to find.
BUCKET = 4
PROBES = 3
RECALL = 0.99
#: Members of a block of identifiers with sign bits, and of a block of vectors.
BIT_BLOCK = 2048
VECTOR_BLOCK = 1024
SKETCH_WORDS = 2


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows after a sign change and a Hadamard transform for each row of ``signs``; their length is a power of two."""
    n, d = x.shape
    for row in signs:
        x = (x * row).reshape(n, d)
        width = 1
        while width < d:
            pairs = x.reshape(n, d // (2 * width), 2, width)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
            width *= 2
        x = x / math.sqrt(d)
    return x


def _mixed(code: np.ndarray, salt: int) -> np.ndarray:
    """Evenly spread 64 bits of a code: a published mixing step."""
    with np.errstate(over="ignore"):
        x = code + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Hashing:
    """Cross-polytope tables for vectors of ``dim`` components: ``hashes`` a code, ``probes`` beside the own bucket."""

    dim: int
    hashes: int
    tables: int
    probes: int = PROBES
    cosine: float = COSINE

    @cached_property
    def width(self) -> int:
        return 1 << max(0, self.dim - 1).bit_length()

    @cached_property
    def signs(self) -> np.ndarray:
        """Of each table, hash and turn."""
        rng = np.random.default_rng([SEED, self.dim])
        return rng.choice([-1.0, 1.0], (self.tables, self.hashes, 3, self.width))

    @cached_property
    def planes(self) -> np.ndarray:
        return np.random.default_rng([SEED, self.dim, 1]).normal(size=(self.dim, 64 * SKETCH_WORDS))

    @cached_property
    def radius(self) -> int:
        """Sign bits within which practically all pairs of the asked cosine lie: 4.5 deviations above the expected ones."""
        bits, p = 64 * SKETCH_WORDS, math.acos(self.cosine) / math.pi
        return min(bits, math.ceil(bits * p + 4.5 * math.sqrt(bits * p * (1 - p))))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Per row and table the code of its own bucket, then those of the probes; a probe that does not exist repeats the own code."""
        wide = np.zeros((len(x), self.width))
        wide[:, :self.dim] = x
        ranks = min(self.probes + 1, self.width)
        # A choice of the r-th vertices is among the first m only if the product of all r + 1 is at most m.
        choices = np.array([c for c in itertools.product(range(ranks), repeat=self.hashes) if math.prod(r + 1 for r in c) <= self.probes + 1])
        out = np.zeros((len(x), self.tables, self.probes + 1), np.uint64)
        for t in range(self.tables):
            lost = np.zeros((len(x), len(choices)))
            code = np.zeros((len(x), len(choices)), np.uint64)
            for h in range(self.hashes):
                y = rotated(wide, self.signs[t, h])
                best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :ranks]
                height = np.take_along_axis(y, best, 1)
                vertex = (2 * best + (height < 0)).astype(np.uint64)
                lost += ((np.abs(height[:, :1]) - np.abs(height)) ** 2)[:, choices[:, h]]
                with np.errstate(over="ignore"):
                    code = code * np.uint64(2 * self.width) + vertex[:, choices[:, h]]
            first = np.argsort(lost, axis=1, kind="stable")[:, :self.probes + 1]
            got = _mixed(np.take_along_axis(code, first, 1), (self.dim << 16) + t)
            out[:, t, :] = got[:, :1]
            out[:, t, :got.shape[1]] = got
        return out

    def sketch(self, x: np.ndarray) -> np.ndarray:
        """Sign bits of random projections, as words."""
        return np.packbits(x @ self.planes > 0, axis=1, bitorder="little").view(np.uint64)


@cache
def success(dim: int, hashes: int, probes: int, cosine: float, pairs: int = 1000) -> float:
    """The measured probability that a pair of just this cosine meets in one table."""
    rng = np.random.default_rng([SEED, dim, hashes])
    x, y = rng.normal(size=(2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim > 1:
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * y / np.linalg.norm(y, axis=1, keepdims=True)
    else:
        y = x
    one = Hashing(dim, hashes, 1, probes, cosine)
    a, b = one.codes(x)[:, 0], one.codes(y)[:, 0]
    return float(((a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)).mean())


def hashing_for(dim: int, rows: int, cosine: float = COSINE, probes: int = PROBES, recall: float = RECALL) -> Hashing:
    """Hashes a code by the number of rows, tables by the recall asked for."""
    width = 1 << max(0, dim - 1).bit_length()
    hashes = max(1, math.ceil(math.log(max(1.0, rows / BUCKET)) / math.log(2 * width) - 1e-9))
    met = min(max(success(dim, hashes, probes, cosine), 1e-3), 1 - 1e-9)
    return Hashing(dim, hashes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - met))), probes, cosine)


def unit(value: list | np.ndarray | None) -> np.ndarray | None:
    """The vector divided by its length, in double precision; None if it can link with nothing."""
    if value is None or len(value) == 0:
        return None
    x = np.array([np.nan if v is None else v for v in value] if isinstance(value, list) else value, np.float64)
    most = np.abs(x).max()
    if not np.isfinite(most) or most == 0:
        return None
    # Scaled first, so that no square overflows or vanishes; zero has one sign.
    x = x / most
    return x / math.sqrt(float(x @ x)) + 0.0


def _units(column: pa.Array) -> list[np.ndarray | None]:
    return [unit(v.values.to_numpy(zero_copy_only=False) if v.is_valid and v.values.null_count == 0 else v.as_py()) for v in column]


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return np.array(_units(column)).reshape(-1, dim)


def _keyed(vectors: DataFrame) -> DataFrame:
    """With ``key``, equal for equal directions; null where a vector links with nothing."""

    def named(batches):
        for batch in slices(batches, 4096):
            keys = [None if x is None else xxhash.xxh3_128_digest(x.tobytes()) for x in _units(batch.column("embedding"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("embedding"), pa.array(keys, pa.binary())], names=["vec_id", "embedding", "key"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(named, f"vec_id {kinds['vec_id']}, embedding {kinds['embedding']}, key binary")


BUCKET_KEY = ["dim", "turn", "bucket"]


def _blocks(rows: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Members of each bucket against each other, in blocks: ``mine`` and ``other``, which is null for a block against itself."""
    large = rows.groupBy(*BUCKET_KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size)
    large = large.select(*BUCKET_KEY, F.ceil(F.col("n") * 2 / F.lit(size)).cast("int").alias("blocks"))
    dealt = lookup_join(rows, written(large, "embedding-large"), BUCKET_KEY).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    held = dealt.groupBy(*BUCKET_KEY, "blocks", "block").agg(F.collect_list(F.struct(*columns)).alias("m"))
    packed = F.struct(*[F.col(f"m.{c}").alias(c) for c in columns])
    held = held.where((F.size("m") > 1) | (F.col("blocks") > 1)).select(*BUCKET_KEY, "blocks", "block", packed.alias("mine"))
    held = written(held, "embedding-blocks")
    alone = held.select(*BUCKET_KEY, "mine", F.lit(None).cast(held.schema["mine"].dataType).alias("other"))
    asking = held.where("blocks > 1").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("with > block")
    far = held.select(*BUCKET_KEY, F.col("block").alias("with"), F.col("mine").alias("other"))
    # As many tasks as there are pairs of blocks for, dealt evenly.
    pairs = asking.join(far, [*BUCKET_KEY, "with"]).repartition(*BUCKET_KEY, "block", "with")
    return alone.unionByName(pairs.select(*BUCKET_KEY, "mine", "other"))


def _strips(left: np.ndarray, right: np.ndarray, radius: int, mine: np.ndarray, theirs: np.ndarray):
    """(i, j) of the members within the radius of which one at least stands in its own bucket."""
    for at in range(0, len(left), 256):
        part = left[at:at + 256]
        apart = sum(np.bitwise_count(part[:, None, k] ^ right[None, :, k]).astype(np.int16) for k in range(left.shape[1]))
        i, j = np.nonzero((apart <= radius) & (mine[at:at + 256, None] | theirs[None, :]))
        yield i + at, j


def _members(classes: DataFrame, plans: dict[int, Hashing]) -> DataFrame:
    """Each class in its own buckets and at its probes, with its sign bits."""

    def placed(batches):
        for batch in slices(batches, 1024):
            nodes, units = batch.column("node").to_numpy(), _units(batch.column("vector"))
            dims = np.array([len(x) for x in units])
            for dim in np.unique(dims):
                plan, at = plans[int(dim)], np.flatnonzero(dims == dim)
                x = np.array([units[i] for i in at])
                codes, bits = plan.codes(x), plan.sketch(x).view(np.int64)
                own = np.zeros(codes.shape, bool)
                own[:, :, 0] = True
                real = own | (codes != codes[:, :, :1])
                i, t, _ = np.nonzero(real)
                yield pa.RecordBatch.from_pydict({
                    "dim": np.full(len(i), dim, np.int32), "turn": t.astype(np.int32), "bucket": codes[real].view(np.int64),
                    "node": nodes[at[i]], "own": own[real], **{f"s{k}": bits[i, k] for k in range(SKETCH_WORDS)}})

    words = "".join(f", s{k} bigint" for k in range(SKETCH_WORDS))
    return classes.mapInArrow(placed, f"dim int, turn int, bucket bigint, node bigint, own boolean{words}")


def _flat(members: pa.StructScalar, name: str) -> np.ndarray:
    return members[name].values.to_numpy(zero_copy_only=False)


def _live(members: DataFrame, plans: dict[int, Hashing]) -> DataFrame:
    """Members of buckets that have a partner by sign bits there."""
    words = [f"s{k}" for k in range(SKETCH_WORDS)]

    def found(batches):
        for batch in slices(batches, 1):
            dim, turn, bucket, mine, other = (batch.column(c)[0] for c in (*BUCKET_KEY, "mine", "other"))
            sides = []
            for side in (mine, other) if other.is_valid else (mine,):
                sides.append((np.stack([_flat(side, w).view(np.uint64) for w in words], 1), _flat(side, "own"), _flat(side, "node")))
            (a, own, nodes), (b, far, others) = sides[0], sides[-1]
            live, live_far = np.zeros(len(a), bool), np.zeros(len(b), bool)
            for i, j in _strips(a, b, plans[dim.as_py()].radius, own, far):
                if len(sides) == 1:
                    i, j = i[i < j], j[i < j]
                live[i] = live_far[j] = True
            if len(sides) == 1:
                live |= live_far
            ids = np.concatenate([nodes[live]] + [others[live_far]] * (len(sides) - 1))
            if len(ids):
                owned = np.concatenate([own[live]] + [far[live_far]] * (len(sides) - 1))
                yield pa.RecordBatch.from_pydict({
                    "dim": np.full(len(ids), dim.as_py(), np.int32), "turn": np.full(len(ids), turn.as_py(), np.int32),
                    "bucket": np.full(len(ids), bucket.as_py(), np.int64), "node": ids, "own": owned})

    pairs = _blocks(members, ["node", "own", *words], BIT_BLOCK)
    return pairs.mapInArrow(found, "dim int, turn int, bucket bigint, node bigint, own boolean").distinct()


def _first_here(a: np.ndarray, b: np.ndarray, turn: int, bucket: np.uint64) -> np.ndarray:
    """Whether rows of codes of pairs meet in this bucket of this table and in none before it.

    Two members meet where one has its own bucket and the other has it or asks at it.
    """
    early = np.zeros(len(a), bool)
    for t in range(turn):
        early |= (b[:, t] == a[:, t, :1]).any(axis=1) | (a[:, t] == b[:, t, :1]).any(axis=1)
    # In one table they may meet in the own bucket of either; the lesser counts.
    mine, theirs = a[:, turn, 0], b[:, turn, 0]
    also_mine, also_theirs = (b[:, turn] == mine[:, None]).any(axis=1), (a[:, turn] == theirs[:, None]).any(axis=1)
    early |= also_mine & (mine < bucket) | also_theirs & (theirs < bucket)
    return ~early


def _verified(live: DataFrame, plans: dict[int, Hashing]) -> DataFrame:
    """``(a, b, links)``: numbers of links of a class where ``b`` is null, links of a spanning forest where it is not."""

    def checked(batches):
        for batch in slices(batches, 1):
            dim, turn, bucket, mine, other = (batch.column(c)[0] for c in (*BUCKET_KEY, "mine", "other"))
            plan, here, sides = plans[dim.as_py()], np.int64(bucket.as_py()).view(np.uint64), []
            for side in (mine, other) if other.is_valid else (mine,):
                x = _matrix(side["vector"].values, plan.dim)
                sides.append((x, plan.codes(x), plan.sketch(x), *(_flat(side, c) for c in ("own", "node", "copies"))))
            (x, codes, bits, own, nodes, copies), (y, codes_y, bits_y, far, others, copies_y) = sides[0], sides[-1]
            links, links_y, forest, kept = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), {}, []

            def root(p: int) -> int:
                while (q := forest.get(p, p)) != p:
                    forest[p] = forest.get(q, q)
                    p = q
                return p

            for at in range(0, len(x), 256):
                near = (x[at:at + 256] @ y.T >= plan.cosine) & (own[at:at + 256, None] | far[None, :])
                i, j = np.nonzero(near)
                i = i + at
                if len(sides) == 1:
                    i, j = i[i < j], j[i < j]
                good = np.bitwise_count(bits[i] ^ bits_y[j]).sum(axis=1, dtype=np.int64) <= plan.radius
                i, j = i[good], j[good]
                first = _first_here(codes[i], codes_y[j], turn.as_py(), here)
                i, j = i[first], j[first]
                np.add.at(links, i, copies_y[j])
                np.add.at(links_y, j, copies[i])
                for p, q in zip(nodes[i].tolist(), others[j].tolist()):
                    u, v = root(p), root(q)
                    if u != v:
                        forest[max(u, v)] = min(u, v)
                        kept.append((p, q))
            if kept:
                ids, counts = np.concatenate([nodes, others]), np.concatenate([links, links_y])
                some = counts > 0
                yield pa.RecordBatch.from_arrays([
                    pa.array([*ids[some].tolist(), *[p for p, _ in kept]], pa.int64()), pa.array([None] * int(some.sum()) + [q for _, q in kept], pa.int64()),
                    pa.array([*counts[some].tolist(), *[None] * len(kept)], pa.int64())], names=["a", "b", "links"])

    pairs = _blocks(live, ["node", "own", "copies", "vector"], VECTOR_BLOCK)
    return pairs.mapInArrow(checked, "a bigint, b bigint, links bigint")


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, probes: int = PROBES, recall: float = RECALL,
) -> DataFrame:
    """Per row its id, ``n_links``, ``component_id`` and ``kept`` (it names its component).

    Linked pairs have a cosine of ``cosine`` or more; ``recall`` is the share of pairs of just that cosine to be found.
    """
    rows = written(_keyed(vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))), "embedding-rows")
    classes = rows.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("embedding").alias("vector"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "embedding-classes")
    # Lengths of vectors with their numbers of classes: few rows.
    sizes = classes.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()
    plans = {r["dim"]: hashing_for(r["dim"], r["n"], cosine, probes, recall) for r in sizes}
    live = written(_live(_members(classes, plans), plans), "embedding-live")
    held = live.join(classes.select("node", "copies", "vector"), "node")
    found = written(_verified(held, plans), "embedding-links")
    labels = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    counted = found.where(F.col("b").isNull()).groupBy("a").agg(F.sum("links").alias("links"))
    grouped = classes.select("key", "node", "first_id", "copies").join(counted.withColumnRenamed("a", "node"), "node", "left")
    grouped = grouped.join(labels.withColumnRenamed("a", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = lookup_join(grouped, lowest, ["label"]).select(
        "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = lookup_join(rows.select("vec_id", "key"), written(named, "embedding-components"), ["key"])
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("vec_id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
