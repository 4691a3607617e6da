"""Boosted trees and forests by histograms: many models grown together over one binned table.

Features are cut into bins once. A model is a set of features, a row weight (its training part: fold, nested subset, class
weights) and a ``Boost`` rule. All models ask in step: in a round each has a tree with open nodes, and one pass over the rows
answers every model's question, the gradient, hessian and weight of each bin of each feature in each open node. Gains are of
second order, or of first order for the classic kind; trees grow by level or by leaf, the node of largest gain first.
Growth by leaf asks ahead for the nodes that will be split if no unknown node gains more, and takes the order of gains
again when the answers are in, so a tree needs about as many passes as it is deep and equals the one grown leaf by leaf.
The trees of a forest are models of one round: each has Poisson row counts drawn by a hash of row and tree, and a random choice of
features at every node.

Rows are asked in one of two ways, with the same questions and answers. A table of few bytes (checked) is broadcast and the
models are dealt to tasks. A larger one stays where it is: every pass is a job in which tasks add up histograms by model and
node, nodes are summed and split on the cluster, and one line per node reaches the driver; margins are stored with the rows
every few rounds.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import to_matrix
from .stored import stored

#: Largest binned table that is sent to every executor.
LOCAL_BYTES = 32 << 20
#: Bytes of histograms that a task holds in a pass.
ASK_BYTES = 256 << 20
#: Bytes of histograms that are added and split in one group, from each task.
PIECE_BYTES = 256 << 10
#: Rounds after which margins are stored with the rows of a large table.
STORE_EVERY = 10


@dataclass(frozen=True)
class Boost:
    """How trees are grown: ``leaves`` by largest gain, or all nodes of ``depth`` levels where ``leaves`` is None."""

    rounds: int = 200
    rate: float = 0.1
    leaves: int | None = 31
    depth: int | None = None
    l2: float = 0.0
    min_hessian: float = 1e-3
    min_rows: int = 20
    min_gain: float = 0.0
    order: int = 2
    bins: int = 255
    #: Features that a node may choose from (all if None), and the seed of a tree that draws rows and features and takes means of classes.
    tried: int | None = None
    seed: int | None = None


@dataclass(frozen=True)
class Forest:
    """Trees over drawn rows, the square root of the features at each node; a score is the mean share of class 1."""

    trees: int = 300
    depth: int = 10
    seed: int = 42
    bins: int = 64

    def rules(self, features: int) -> list[Boost]:
        tried = max(1, math.isqrt(features))
        return [
            Boost(1, 1.0, None, self.depth, min_hessian=0.0, min_rows=1, order=1, bins=self.bins, tried=tried, seed=self.seed * 100_003 + t)
            for t in range(self.trees)]


def leaf_wise(rounds: int = 200, rate: float = 0.1, depth: int | None = None) -> Boost:
    """Trees of 31 leaves, the node of largest gain first."""
    return Boost(rounds, rate, 31, depth)


def level_wise(rounds: int = 200, depth: int = 4, rate: float = 0.3) -> Boost:
    """Whole levels with penalised leaf values."""
    return Boost(rounds, rate, None, depth, l2=1.0, min_hessian=1.0, min_rows=1)


def first_order(rounds: int = 200, depth: int = 3, rate: float = 0.1) -> Boost:
    """Splits by the squared error of the gradients, leaves by one Newton step."""
    return Boost(rounds, rate, None, depth, min_hessian=0.0, min_rows=1, order=1)


# --------------------------------------------------------------------------
# Gains
# --------------------------------------------------------------------------
def best_by_feature(hist: np.ndarray, rule: Boost) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gain, bin, left sums, right sums) of each node and feature of histograms ``(nodes, features, bins, [gradient, hessian, rows])``.

    ``rows`` are counts, or weights for rules of first order, where they stand in for the hessian. Gain 0 means no split.
    """
    if hist.shape[2] < 2:
        whole = hist.sum(axis=2)
        return np.zeros(hist.shape[:2]), np.zeros(hist.shape[:2], np.int64), whole, whole
    # A kind of sums at a time, in arrays without gaps.
    sums = [np.cumsum(hist[..., k], axis=2) for k in range(3)]
    by = 1 if rule.order == 2 else 2
    before = _score(sums[0][:, :, -1], sums[by][:, :, -1], rule)
    gain, allowed = np.zeros(1), True
    for side in ("left", "right"):
        part = [x[:, :, :-1] if side == "left" else x[:, :, -1:] - x[:, :, :-1] for x in sums]
        if rule.min_hessian > 0:
            allowed = allowed & (part[1] >= rule.min_hessian)
        allowed = allowed & (part[2] >= rule.min_rows if rule.order == 2 else part[2] > 1e-9)
        gain = gain + _score(part[0], part[by], rule)
    gain -= before[:, :, None]
    gain[~allowed] = 0.0
    at = gain.argmax(axis=2)[:, :, None]
    best = np.take_along_axis(gain, at, 2)[:, :, 0]
    # Differences of rounding are no gains.
    best = np.where(best > np.maximum(np.maximum(rule.min_gain, 1e-9 * before), 1e-12), best, 0.0)
    left = np.stack([np.take_along_axis(x, at, 2)[:, :, 0] for x in sums], axis=-1)
    right = np.stack([x[:, :, -1] for x in sums], axis=-1) - left
    return best, at[:, :, 0], left, right


def _score(gradient: np.ndarray, below: np.ndarray, rule: Boost) -> np.ndarray:
    """What a node's rows explain: the square of the gradients over their penalised hessian or weight."""
    below = below + rule.l2
    with np.errstate(divide="ignore", invalid="ignore"):
        out = gradient * gradient / below
    out[~(below > 1e-12)] = 0.0
    return out


def chosen(
    gain: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, rule: Boost, nodes: list[int], ways: dict[int, int],
) -> dict[int, tuple[float, int, int, tuple, tuple]]:
    """Per node (gain, feature, bin, left sums, right sums) of the feature that it is split by.

    A rule with few tries takes the best of them, or the next feature that gains where none does.
    """
    if rule.tried is not None and rule.tried < gain.shape[1]:
        drawn_at = _mixed(np.array([ways[n] for n in nodes], np.uint64)[:, None] * np.uint64(gain.shape[1]) + np.arange(gain.shape[1], dtype=np.uint64), 2 * rule.seed + 1)
        rank = drawn_at.argsort(axis=1).argsort(axis=1)
        first = np.where(rank < rule.tried, gain, 0.0)
        later = np.where(gain > 0, rank, gain.shape[1]).argmin(axis=1)
        f = np.where(first.max(axis=1) > 0, first.argmax(axis=1), later)
    else:
        f = gain.argmax(axis=1)
    every = np.arange(len(nodes))
    columns = (gain[every, f].tolist(), f.tolist(), cut[every, f].tolist(), left[every, f].tolist(), right[every, f].tolist())
    return {n: (g, f, b, tuple(x), tuple(y)) for n, g, f, b, x, y in zip(nodes, *columns)}


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Evenly spread 64 bits: a published mixing step."""
    with np.errstate(over="ignore"):
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x += np.uint64(salt * 0xD1B54A32D192ED03 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
    return x


# --------------------------------------------------------------------------
# The way of rows down a tree
# --------------------------------------------------------------------------
#: Levels whose ends fit the bits of a word.
TOP_LEVELS = 6
_EVERY_END = 2**64 - 1
#: A published multiplier that maps each single bit to a number of its own, and the bit of each such number.
_BIT_FACTOR = 0x03F79D71B4CB0A89
_BIT = np.empty(64, np.int64)
_BIT[[((1 << i) * _BIT_FACTOR % 2**64) >> 58 for i in range(64)]] = np.arange(64)


class Reach:
    """The last node of each row, by bits: a feature's bin leaves those ends of the top levels that rows of this bin may
    reach; the first end that all features leave is the row's. Lower levels are walked.
    """

    def __init__(self, feature, cut, left, right, width: int):
        self.feature, self.cut, self.left, self.right = (np.asarray(x) for x in (feature, cut, left, right))
        ends, masks = [], {}

        def visit(node: int, level: int) -> None:
            if left[node] < 0 or level == TOP_LEVELS:
                ends.append(node)
                return
            first = len(ends)
            visit(left[node], level + 1)
            gone = np.uint64(_EVERY_END ^ ((1 << len(ends)) - (1 << first)))
            masks.setdefault(int(feature[node]), np.full(width, _EVERY_END, np.uint64))[int(cut[node]) + 1:] &= gone
            visit(right[node], level + 1)

        visit(0, 0)
        self.masks = list(masks.items())
        #: Ends by the numbers of their bits.
        self.ends = np.array(ends + [0] * (64 - len(ends)), np.int64)[_BIT]
        self.whole = all(left[n] < 0 for n in ends)

    def number(self, bins: np.ndarray) -> np.ndarray:
        """The numbers of the ends in the top levels; ``bins`` has a line per feature."""
        if not self.masks:
            return np.full(bins.shape[1], _BIT_FACTOR >> 58, np.int64)
        f, mask = self.masks[0]
        left = mask.take(bins[f])
        for f, mask in self.masks[1:]:
            left &= mask.take(bins[f])
        with np.errstate(over="ignore"):
            left &= ~left + np.uint64(1)
            left *= np.uint64(_BIT_FACTOR)
        left >>= np.uint64(58)
        return left.view(np.int64)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = self.ends.take(self.number(bins))
        if not self.whole:
            rows = np.flatnonzero(self.left[at] >= 0)
            while len(rows):
                node = at[rows]
                at[rows] = node = np.where(bins[self.feature[node], rows] <= self.cut[node], self.left[node], self.right[node])
                rows = rows[self.left[node] >= 0]
        return at

    def values(self, bins: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The value of each row's last node."""
        return value[self.ends].take(self.number(bins)) if self.whole else value.take(self.nodes(bins))


# --------------------------------------------------------------------------
# A tree in growth
# --------------------------------------------------------------------------
@dataclass
class Tree:
    """Nodes as lists; children of -1 mark a node that is not split (yet). Splits send bins up to ``bin`` to the left."""

    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for name, empty in (("feature", 0), ("bin", 0), ("left", -1), ("right", -1), ("value", 0.0), ("cover", 0.0), ("gain", 0.0)):
            getattr(self, name).append(empty)
        return len(self.left) - 1

    def reach(self) -> Reach:
        return Reach(self.feature, self.bin, self.left, self.right, 256)

    def reached(self, bins: np.ndarray) -> np.ndarray:
        """The last node of each row of bins."""
        return self.reach().nodes(bins.T)


class Growth:
    """One model in growth: what it asks of the rows next, and what the answers make of its tree."""

    def __init__(self, rule: Boost, base: float):
        self.rule, self.base, self.done = rule, base, []
        self._plant()

    def _plant(self) -> None:
        self.tree, self.known, self.level = Tree(), {}, {0: 0}
        #: A node's way from the root, by which it draws features.
        self.way = {0: 1}
        self.sums: dict[int, tuple] = {}
        self.asked = [0]

    def finished(self) -> bool:
        return len(self.done) >= self.rule.rounds

    def answer(self, found: dict[int, tuple]) -> None:
        """``found``: best splits of the asked nodes."""
        self.known.update(found)
        if 0 in found:
            gain, _, _, left, right = found[0]
            self.sums[0] = tuple(a + b for a, b in zip(left, right)) if gain else left
        self.asked = self._open()
        if not self.asked:
            self._finish()

    def _split(self, node: int) -> tuple[int, int]:
        """The children of a node, made when it is first split."""
        t = self.tree
        if t.left[node] < 0:
            gain, t.feature[node], t.bin[node], left, right = self.known[node]
            t.gain[node] = gain
            t.left[node], t.right[node] = t.add(), t.add()
            for child, sums in ((t.left[node], left), (t.right[node], right)):
                self.sums[child], self.level[child] = sums, self.level[node] + 1
                self.way[child] = (2 * self.way[node] + (child == t.right[node])) % 2**64
        return t.left[node], t.right[node]

    def _may_split(self, node: int) -> bool:
        """Whether a question about the node makes sense."""
        enough = 2 * self.rule.min_rows if self.rule.order == 2 else 0
        g, h, rows = self.sums[node]
        # All of one class: nothing to gain.
        pure = self.rule.seed is not None and not 1e-9 * h < -g < (1 - 1e-9) * h
        return not pure and (self.rule.depth is None or self.level[node] < self.rule.depth) and rows >= enough

    def _open(self) -> list[int]:
        """Nodes to ask about next; none when the tree is whole."""
        ahead, chosen, heap = [], 0, [(-self.known[0][0], 0)]
        self.kept: set[int] = set()
        settled = True
        while heap and (self.rule.leaves is None or chosen < self.rule.leaves - 1):
            gain, node = heapq.heappop(heap)
            if gain >= 0:
                break
            chosen += 1
            if settled:
                self.kept.add(node)
            for child in self._split(node):
                if child in self.known:
                    heapq.heappush(heap, (-self.known[child][0], child))
                elif self._may_split(child) and chosen + 1 != self.rule.leaves:
                    ahead.append(child)
                    settled = settled and self.rule.leaves is None
        return ahead

    def _finish(self) -> None:
        """Leaf values; nodes asked ahead and not taken give way to their last kept ancestor's value."""
        t, rule = self.tree, self.rule

        def value(node: int) -> float:
            g, h, _ = self.sums[node]
            return -rule.rate * g / (h + rule.l2) if h + rule.l2 > 1e-12 else 0.0

        final, places, at = Tree(), {0: 0}, [0]
        while at:
            node = at.pop()
            mine = places[node]
            final.cover[mine] = float(self.sums[node][2])
            if node not in self.kept:
                final.value[mine] = value(node)
                continue
            final.feature[mine], final.bin[mine], final.gain[mine] = t.feature[node], t.bin[node], t.gain[node]
            final.left[mine], final.right[mine] = final.add(), final.add()
            places[t.left[node]], places[t.right[node]] = final.left[mine], final.right[mine]
            at += [t.left[node], t.right[node]]
        self.done.append(final)
        self._plant()


# --------------------------------------------------------------------------
# Answers from a block of rows
# --------------------------------------------------------------------------
@dataclass(frozen=True)
class Job:
    """A model to grow: its rule, places of its features and of its weight."""

    rule: Boost
    features: tuple[int, ...]
    weight: int
    #: Bits by which the bins of each feature are made coarser.
    shifts: tuple[int, ...] = ()


#: Chances of at most 0, 1, 2, ... draws of a row.
_DRAWS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


#: Draws by the first 16 bits of the hash; -1 where further bits decide.
_FIRST_BITS = np.searchsorted(_DRAWS, np.arange(65537) / 65536, "right")
_DRAWS_OF = np.where(_FIRST_BITS[:-1] == _FIRST_BITS[1:], _FIRST_BITS[:-1], -1).astype(np.float64)


def drawn(keys: np.ndarray, seed: int) -> np.ndarray:
    """How often a tree draws each row: a Poisson number by a hash of row and tree."""
    hashes = _mixed(keys.astype(np.uint64, copy=False), 2 * seed)
    out = _DRAWS_OF.take((hashes >> np.uint64(48)).view(np.int64))
    near = np.flatnonzero(out < 0)
    out[near] = np.searchsorted(_DRAWS, hashes[near] / 2.0**64, "right")
    return out


class Block:
    """Rows of the binned table as one model sees them: bins (here a line per feature), gradients, hessians and the node of each row."""

    def __init__(self, job: Job, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, margin: np.ndarray, keys: np.ndarray | None = None):
        if job.rule.seed is not None:
            weight = weight * drawn(keys, job.rule.seed)
        some = np.flatnonzero(weight > 0)
        self.rule, self.bins = job.rule, _own_bins(job, bins.T).take(some, axis=1)
        self.y, self.weight, self.margin = y[some].astype(np.float64), weight[some].astype(np.float64), margin[some].astype(np.float64)
        self.grow()

    def grow(self) -> None:
        """Gradients for a new tree at the present margins."""
        if self.rule.seed is not None:
            return
        p = 1.0 / (1.0 + np.exp(-np.clip(self.margin, -500, 500)))
        self.g, self.h = self.weight * (p - self.y), self.weight * p * (1 - p)
        self.rows = np.ones(len(p)) if self.rule.order == 2 else self.weight

    def histograms(self, node: np.ndarray, asked: list[int], width: int) -> np.ndarray:
        """``(asked nodes, features, bins, 3)``."""
        slot = _slots(node, asked)
        place = slot[node]
        inside = np.flatnonzero(place >= 0)
        place, bins = place[inside], self.bins.take(inside, axis=1)
        if self.rule.seed is not None:
            return _forest_histograms(_forest_sums(place, bins, self.y[inside], self.weight[inside], len(asked), width))
        out = np.empty((3, len(asked), len(bins), width))
        parts = [x[inside] for x in (self.g, self.h, self.rows)]
        place *= width
        for f, own in enumerate(bins):
            at = place + own
            for k, part in enumerate(parts):
                out[k, :, f] = np.bincount(at, part, len(asked) * width).reshape(len(asked), width)
        return np.moveaxis(out, 0, -1)


def _own_bins(job: Job, bins: np.ndarray) -> np.ndarray:
    """The lines of the job's features, made coarser."""
    every = job.features == tuple(range(len(bins)))
    own = bins if every else bins[list(job.features)]
    return own >> np.array(job.shifts, own.dtype)[:, None] if any(job.shifts) else own


def _slots(node: np.ndarray, asked: list[int]) -> np.ndarray:
    """The place of each node among the asked ones, -1 for others."""
    slot = np.full(max(int(node.max(initial=0)), *asked) + 1, -1)
    slot[asked] = np.arange(len(asked))
    return slot


def _forest_sums(place: np.ndarray, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, asked: int, width: int) -> np.ndarray:
    """``(features, asked nodes, classes, bins)``: weights; all that a tree of classes needs."""
    start = (2 * place + y.astype(np.int64, copy=False)) * width
    return np.stack([np.bincount(start + own, weight, 2 * asked * width) for own in bins]).reshape(len(bins), asked, 2, width)


def _forest_histograms(sums: np.ndarray) -> np.ndarray:
    whole = sums.sum(axis=2)
    return np.stack([-sums[:, :, 1], whole, whole], axis=-1).swapaxes(0, 1)


def _grow_here(job: Job, growth: Growth, block: Block, width: int) -> list[Tree]:
    """All rounds of one model over rows that are at hand."""
    node = np.zeros(len(block.y), np.int64)
    while not growth.finished():
        tree, rounds = growth.tree, len(growth.done)
        asked = growth.asked
        hist = block.histograms(node, asked, width)
        growth.answer(chosen(*best_by_feature(hist, job.rule), job.rule, asked, growth.way))
        if growth.finished():
            break
        if len(growth.done) > rounds:
            final = growth.done[-1]
            block.margin += final.reach().values(block.bins, np.array(final.value))
            block.grow()
            node[:] = 0
        else:
            node = _moved(tree, node, block.bins)
    return growth.done


def _moved(tree: Tree, node: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Rows further down the splits made since."""
    left, right, feature, cut = (np.array(x) for x in (tree.left, tree.right, tree.feature, tree.bin))
    rows = np.flatnonzero(left[node] >= 0)
    while len(rows):
        at = node[rows]
        node[rows] = at = np.where(bins[feature[at], rows] <= cut[at], left[at], right[at])
        rows = rows[left[at] >= 0]
    return node


# --------------------------------------------------------------------------
# The binned table
# --------------------------------------------------------------------------
def cut_points(df: DataFrame, features: list[str], bins: int = 255) -> list[np.ndarray]:
    """Inner limits of each feature's bins: between all neighbours if values are few, else by quantiles.

    At most ``features x bins`` numbers reach the driver.
    """
    if not features:
        return []
    marks = [i / bins for i in range(1, bins)]
    rough = df.agg(*[F.percentile_approx(c, marks, 20 * bins).alias(c) for c in features], *[F.approx_count_distinct(c).alias(f"__n_{c}") for c in features]).first()
    out = []
    for c in features:
        values = None
        if rough[f"__n_{c}"] <= 2 * bins:
            values = [r[0] for r in df.select(c).distinct().limit(bins + 1).collect()]
        if values is not None and len(values) <= bins:
            v = np.sort(np.array(values, np.float64))
            out.append((v[:-1] + v[1:]) / 2)
        else:
            out.append(np.unique(np.array(rough[c] or [], np.float64)))
    return out


def binned(df: DataFrame, y: str, features: list[str], cuts: list[np.ndarray], weights: list[Column]) -> DataFrame:
    """``(y, weights, bins, key)``: a byte per feature, and a number of the row."""
    wide = max((len(c) for c in cuts), default=0)
    if wide > 255:
        raise ValueError("more than 256 bins")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.searchsorted(c, batch.column(f).to_numpy(zero_copy_only=False), "left") for f, c in zip(features, cuts)], 1)
            rows = [r.tobytes() for r in x.astype(np.uint8)]
            made = [batch.column("__y"), batch.column("__w"), pa.array(rows, pa.binary()), batch.column("__k")]
            yield pa.RecordBatch.from_arrays(made, names=["y", "weights", "bins", "key"])

    wanted = df.select(
        F.col(y).cast("int").alias("__y"), F.array(*[w.cast("double") for w in weights]).alias("__w"), F.monotonically_increasing_id().alias("__k"), *features)
    return wanted.mapInArrow(code, "y int, weights array<double>, bins binary, key bigint")


ROW = ["y", "weights", "bins", "key"]
ROW_KIND = "y int, weights array<double>, bins binary, key bigint"


def _arrays(table: pa.Table | pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels, weights and keys."""
    n, column = table.num_rows, {c: _whole(table.column(c)) for c in ROW}
    bins = _bytes(column["bins"], n).reshape(n, features)
    # Features lie together, and wide numbers serve as places in other arrays as they are.
    return (np.ascontiguousarray(bins.T, np.int64).T, column["y"].to_numpy(zero_copy_only=False),
            _lists(column["weights"], n), column["key"].to_numpy(zero_copy_only=False))


def _bytes(column: pa.Array, n: int) -> np.ndarray:
    """The bytes of all values one after another, as the column holds them."""
    if not n:
        return np.empty(0, np.uint8)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset: column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[ends[0]: ends[-1]] if data is not None else np.empty(0, np.uint8)


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _lists(column: pa.Array, n: int) -> np.ndarray:
    """Lists of one length as lines."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, len(values) // n if n else 0)


def _bases(table: DataFrame, n: int) -> list[float]:
    """The log-odds of each weight's rows."""
    sums = table.agg(*[F.sum(F.get("weights", F.lit(i)) * F.col("y")).alias(f"p{i}") for i in range(n)], *[F.sum(F.get("weights", F.lit(i))).alias(f"n{i}") for i in range(n)]).first()
    out = []
    for i in range(n):
        whole = sums[f"n{i}"] or 0.0
        share = min(max((sums[f"p{i}"] or 0.0) / whole, 1e-6), 1 - 1e-6) if whole else 0.5
        out.append(math.log(share / (1 - share)))
    return out


def grow(table: DataFrame, jobs: list[Job], features: int, width: int, local_bytes: int = LOCAL_BYTES) -> list[tuple[float, list[Tree]]]:
    """(base margin, trees) of every job over a table of :func:`binned`."""
    weights = max(j.weight for j in jobs) + 1
    bases = _bases(table, weights)
    rows = table.count()
    if rows * (features + 8 * weights + 12) <= local_bytes:
        return _grow_by_model(table, jobs, features, width, bases)
    return _grow_by_rows(table, jobs, features, width, bases)


def _grow_by_model(table: DataFrame, jobs: list[Job], features: int, width: int, bases: list[float]) -> list[tuple[float, list[Tree]]]:
    """Models dealt to tasks, over a broadcast table of few bytes."""
    spark = table.sparkSession
    # Ordered, so that sums do not depend on the order in which tasks end.
    bins, *others = _arrays(table.select(*ROW).toArrow().sort_by("key"), features)
    shared = spark.sparkContext.broadcast((bins.astype(np.uint8), *others))
    # Dealt at random: models of one kind stand together and take alike long.
    order = np.random.default_rng(len(jobs)).permutation(len(jobs)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, y, w, keys = shared.value
        for batch in batches:
            for at in batch.column("id").to_pylist():
                i = order[at]
                job = jobs[i]
                block = Block(job, bins, y, w[:, job.weight], np.full(len(y), bases[job.weight]), keys)
                trees = _grow_here(job, Growth(job.rule, bases[job.weight]), block, min(width, job.rule.bins))
                yield pa.RecordBatch.from_pydict({"job": pa.array([i], pa.int32()), "trees": pa.array([pickle.dumps([vars(t) for t in trees])], pa.binary())})

    try:
        made = spark.range(0, len(jobs), 1, min(len(jobs), 8 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "job int, trees binary").collect()
    finally:
        shared.unpersist()
    trees = {r["job"]: [Tree(**t) for t in pickle.loads(r["trees"])] for r in made}
    return [(bases[j.weight], trees[i]) for i, j in enumerate(jobs)]


def _questions(growths: list[Growth], seen: list[int], jobs: list[Job], width: int) -> dict[int, tuple[list[Tree], Tree, list[int]]]:
    """Per model the trees that its stored margins lack, its tree and the nodes asked about; histograms of a pass take bounded memory."""
    out, left = {}, ASK_BYTES
    for i, (g, s) in enumerate(zip(growths, seen)):
        if not g.finished():
            size = len(jobs[i].features) * min(width, jobs[i].rule.bins) * 24
            nodes = g.asked[:max(left // size, 0 if out else 1)]
            if nodes:
                out[i] = (g.done[s:], g.tree, nodes)
                left -= len(nodes) * size
    return out


def _pieces(features: int, wide: int) -> tuple[int, int]:
    """Features of a node's histograms that are sent as one piece, and numbers of neighbouring nodes whose pieces are added in one group."""
    step = max(1, min(features, PIECE_BYTES // (24 * wide)))
    return step, max(1, PIECE_BYTES // (24 * wide * features))


def _grow_by_rows(table: DataFrame, jobs: list[Job], features: int, width: int, bases: list[float]) -> list[tuple[float, list[Tree]]]:
    """Every pass is a job over the rows where they lie."""
    spark = table.sparkSession
    growths = [Growth(j.rule, bases[j.weight]) for j in jobs]
    # Trees of forests have no margins.
    place = {i: at for at, i in enumerate(i for i, j in enumerate(jobs) if j.rule.seed is None)}
    start = F.array(*[F.lit(float(bases[jobs[i].weight])) for i in place]).cast("array<double>")
    held, seen = stored(table.withColumn("margins", start), "boost-rows"), [0] * len(jobs)

    def margins(bins: np.ndarray, base: np.ndarray, i: int, trees: list[tuple[Reach, np.ndarray]]) -> np.ndarray:
        own = _own_bins(jobs[i], bins.T)
        out = base[:, place[i]].copy()
        for t, value in trees:
            out += t.values(own, value)
        return out

    def ways(trees: list[Tree]) -> list[tuple[Reach, np.ndarray]]:
        return [(t.reach(), np.array(t.value)) for t in trees]

    while any(not g.finished() for g in growths):
        if max((len(growths[i].done) - seen[i] for i in place), default=0) >= STORE_EVERY:
            news = spark.sparkContext.broadcast({i: growths[i].done[seen[i]:] for i in place})

            def moved(batches, news=news):
                late = {i: ways(trees) for i, trees in news.value.items()}
                for batch in batches:
                    bins, *_ = _arrays(batch, features)
                    base = _lists(batch.column("margins"), batch.num_rows)
                    now = np.stack([margins(bins, base, i, trees) for i, trees in late.items()], 1)
                    starts = pa.array(np.arange(0, now.size + 1, now.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c) for c in ROW], pa.ListArray.from_arrays(starts, pa.array(now.ravel()))], names=[*ROW, "margins"])

            held = stored(held.mapInArrow(moved, f"{ROW_KIND}, margins array<double>"), "boost-rows")
            seen = [len(g.done) for g in growths]
        open_jobs = _questions(growths, seen, jobs, width)
        shared = spark.sparkContext.broadcast(open_jobs)

        def asked(batches, shared=shared):
            total: dict[int, np.ndarray] = {}
            late = {i: (ways(news), tree.reach(), nodes, _slots(np.array([len(tree.left) - 1]), nodes)) for i, (news, tree, nodes) in shared.value.items()}
            for batch in batches:
                bins, y, w, keys = _arrays(batch, features)
                base = _lists(batch.column("margins"), batch.num_rows)
                hashed, labels = keys.view(np.uint64), y.astype(np.int64)
                for i, (news, reach, nodes, slot) in late.items():
                    job = jobs[i]
                    wide = min(width, job.rule.bins)
                    if job.rule.seed is None:
                        block = Block(job, bins, y, w[:, job.weight], margins(bins, base, i, news), keys)
                        if not len(block.y):
                            continue
                        hist = block.histograms(reach.nodes(block.bins), nodes, wide)
                    else:
                        own = _own_bins(job, bins.T)
                        spot = slot.take(reach.nodes(own))
                        weight = drawn(hashed, job.rule.seed)
                        weight *= w[:, job.weight]
                        inside = np.flatnonzero((spot >= 0) & (weight > 0))
                        if not len(inside):
                            continue
                        hist = _forest_sums(spot.take(inside), own.take(inside, axis=1), labels.take(inside), weight.take(inside), len(nodes), wide)
                    if i in total:
                        total[i] += hist
                    else:
                        total[i] = hist
            for i, hist in total.items():
                nodes = late[i][2]
                hist = hist if jobs[i].rule.seed is None else _forest_histograms(hist)
                kept = np.flatnonzero(hist[:, 0, :, 2].any(axis=1))
                own, wide = hist.shape[1:3]
                step, together = _pieces(own, wide)
                for f in range(0, own, step):
                    if len(kept):
                        asked_of = np.array(nodes, np.int32)[kept]
                        yield pa.RecordBatch.from_pydict({
                            "job": pa.array(np.full(len(kept), i, np.int32)), "part": pa.array(asked_of // together),
                            "f": pa.array(np.full(len(kept), f, np.int32)), "node": pa.array(asked_of),
                            "hist": pa.array([hist[n, f: f + step].tobytes() for n in kept], pa.binary())})

        def split(group: pa.Table) -> pa.Table:
            # Added in a fixed order, so that a repeated task gives the same sums.
            i, f = group.column("job")[0].as_py(), group.column("f")[0].as_py()
            wide, parts = min(width, jobs[i].rule.bins), {}
            for node, h in sorted(zip(group.column("node").to_pylist(), group.column("hist").to_pylist())):
                h = np.frombuffer(h, np.float64)
                parts[node] = parts[node] + h if node in parts else h
            found = best_by_feature(np.stack([h.reshape(-1, wide, 3) for h in parts.values()]), jobs[i].rule)
            gain, b, left, right = (x.reshape(len(parts), -1).tolist() for x in found)
            n = len(parts)
            return pa.table([
                pa.array([i] * n, pa.int32()), pa.array(list(parts), pa.int32()), pa.array([f] * n, pa.int32()), pa.array(gain, pa.list_(pa.float64())),
                pa.array(b, pa.list_(pa.int32())), pa.array(left, pa.list_(pa.float64())), pa.array(right, pa.list_(pa.float64()))],
                names=["job", "node", "f", "gain", "b", "l", "r"])

        parts = held.mapInArrow(asked, "job int, part int, f int, node int, hist binary")
        lines = parts.groupBy("job", "part", "f").applyInArrow(
            split, "job int, node int, f int, gain array<double>, b array<int>, l array<double>, r array<double>").collect()
        shared.unpersist()
        by_job: dict[int, list] = {}
        for r in lines:
            by_job.setdefault(r["job"], []).append(r)
        for i, (_, _, nodes) in open_jobs.items():
            own, at = len(jobs[i].features), {n: k for k, n in enumerate(nodes)}
            gain, cut, left, right = np.zeros((len(nodes), own)), np.zeros((len(nodes), own), np.int64), *np.zeros((2, len(nodes), own, 3))
            for r in by_job.get(i, ()):
                place_of = at[r["node"]], slice(r["f"], r["f"] + len(r["gain"]))
                gain[place_of], cut[place_of] = r["gain"], r["b"]
                left[place_of], right[place_of] = np.reshape(r["l"], (-1, 3)), np.reshape(r["r"], (-1, 3))
            growths[i].answer(chosen(gain, cut, left, right, jobs[i].rule, nodes, growths[i].way))
    return [(g.base, g.done) for g in growths]


# --------------------------------------------------------------------------
# Models
# --------------------------------------------------------------------------
class BoostedModel:
    """Grown trees with real-valued cuts; the margin is the sum of the trees and ``base``."""

    def __init__(self, base: float, trees: list[Tree], cuts: list[np.ndarray], n_features: int):
        self.base, self.trees, self.n_features = base, [], n_features
        gains = np.zeros(n_features)
        for t in trees:
            left, feature = np.array(t.left), np.array(t.feature)
            cut = np.array([cuts[f][b] if x >= 0 else 0.0 for f, b, x in zip(t.feature, t.bin, t.left)])
            self.trees.append((feature, cut, left, np.array(t.right), np.array(t.value), np.array(t.cover)))
            np.add.at(gains, feature[left >= 0], np.array(t.gain)[left >= 0])
        self.importances = gains / gains.sum() if gains.sum() else gains

    def _ways(self) -> tuple[list[np.ndarray], list[tuple[Reach, np.ndarray]]]:
        """The limits of each feature in all trees, and each tree over the places among them."""
        if getattr(self, "_way", None) is None:
            used = [[t[1][(t[2] >= 0) & (t[0] == f)] for t in self.trees] for f in range(self.n_features)]
            cuts = [np.unique(np.concatenate(u)) if u else np.empty(0) for u in used]
            width = max((len(c) for c in cuts), default=0) + 1
            ways = []
            for feature, cut, left, right, value, _ in self.trees:
                at = np.array([np.searchsorted(cuts[f], c) if x >= 0 else 0 for f, c, x in zip(feature, cut, left)])
                ways.append((Reach(feature, at, left, right, width), value))
            self._way = cuts, ways
        return self._way

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        cuts, ways = self._ways()
        # Blocks that stay in the cache of a core.
        for start in range(0, len(x), 1 << 13):
            rows = slice(start, start + (1 << 13))
            bins = np.stack([np.searchsorted(c, x[rows, f], "left") for f, c in enumerate(cuts)]) if cuts else np.empty((0, len(x[rows])), np.int64)
            for way, value in ways:
                out[rows] += way.values(bins, value)
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "_way"}

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -500, 500)))


class ForestModel(BoostedModel):
    """Trees whose values add up to the mean share of class 1."""

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.margin(x), 0.0, 1.0)


#: The bits of each byte, and the first place of each byte of a word.
_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
_BYTES = 256 * np.arange(8)


class FreeFeature:
    """How many rows reach each leaf of a model if one feature could be anything: the mean margin for any value of it follows.

    A leaf is a bit; each other feature's bin leaves the bits whose interval holds it.
    """

    def __init__(self, model: BoostedModel, free: int):
        self.free, self.base = free, model.base
        self.cuts, ways = model._ways()
        width = max((len(c) for c in self.cuts), default=0) + 1
        low, high, values = [], [], []
        for way, value in ways:
            at = [(0, (0,) * len(self.cuts), (width - 1,) * len(self.cuts))]
            while at:
                node, a, b = at.pop()
                if way.left[node] < 0:
                    low.append(a)
                    high.append(b)
                    values.append(value[node])
                    continue
                f, cut = int(way.feature[node]), int(way.cut[node])
                at.append((int(way.left[node]), a, (*b[:f], min(b[f], cut), *b[f + 1:])))
                at.append((int(way.right[node]), (*a[:f], max(a[f], cut + 1), *a[f + 1:]), b))
        gap = -len(values) % 64
        self.low, self.high = (np.array(x + [(0,) * len(self.cuts)] * gap, np.int64).reshape(-1, len(self.cuts)) for x in (low, high))
        self.values = np.array(values + [0.0] * gap)
        every = np.arange(width)
        inside = ((every >= self.low[:, :, None]) & (every <= self.high[:, :, None])).reshape(-1, 64, len(self.cuts), width)
        words = np.zeros((len(inside), len(self.cuts), width), np.uint64)
        for i in range(64):
            words |= inside[:, i].astype(np.uint64) << np.uint64(i)
        self.words = words

    def counts(self, x: np.ndarray) -> np.ndarray:
        """Rows that meet all conditions of each leaf but those on the free feature."""
        out = np.zeros((len(self.words), 64), np.int64)
        others = [f for f, c in enumerate(self.cuts) if f != self.free and len(c)]
        for start in range(0, len(x), 1 << 13):
            rows = x[start: start + (1 << 13)]
            bins = [np.searchsorted(self.cuts[f], rows[:, f], "left") for f in others]
            for i, words in enumerate(self.words):
                left = np.full(len(rows), _EVERY_END, np.uint64)
                for f, b in zip(others, bins):
                    left &= words[f].take(b)
                found = np.bincount((left.astype("<u8").view(np.uint8).reshape(-1, 8) + _BYTES).ravel(), minlength=2048).reshape(8, 256)
                out[i] += (found @ _BITS).ravel()
        return out.ravel()

    def means(self, counts: np.ndarray, rows: float, grid: list[float]) -> np.ndarray:
        """The mean margin at each value of the free feature."""
        at = np.searchsorted(self.cuts[self.free], np.array(grid, np.float64), "left")[:, None]
        reached = (at >= self.low[:, self.free]) & (at <= self.high[:, self.free])
        return self.base + reached @ (self.values * counts) / rows


def scored(df: DataFrame, x: list[Column], model: BoostedModel, name: str) -> DataFrame:
    """The rows with the class-1 probability ``name``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(*columns: pd.Series) -> pd.Series:
        return pd.Series(shared.value.probability(np.stack([c.to_numpy(np.float64) for c in columns], 1)))

    return df.withColumn(name, probability(*x))


def fit_many(
    df: DataFrame, y: str, weights: dict[str, Column], models: list[tuple[Boost | Forest, list[str], str]], local_bytes: int = LOCAL_BYTES,
    limits: dict[str, np.ndarray] | None = None,
) -> list[BoostedModel]:
    """A model for each ``(rule, features, name of its row weight)``, all over one table of bins.

    Rows of weight 0 or null are not in a model's training part. ``limits`` are the inner limits of each feature's bins where they are known.
    """
    features = sorted({c for _, names, _ in models for c in names})
    names = {w: f"__w{i}" for i, w in enumerate(weights)}
    named = df.withColumns({names[w]: F.coalesce(e.cast("double"), F.lit(0.0)) for w, e in weights.items()})
    matrix = to_matrix(named, features, [y, *names.values()])
    cuts = cut_points(matrix, features, min(256, max(rule.bins for rule, _, _ in models))) if limits is None else [limits[c] for c in features]
    width = max((len(c) for c in cuts), default=0) + 1
    table = stored(binned(matrix, y, features, cuts, [F.col(c) for c in names.values()]), "boost-bins")
    places = {w: i for i, w in enumerate(weights)}
    jobs: list[Job] = []
    for rule, own, w in models:
        at = tuple(features.index(c) for c in own)
        shifts = tuple(next(s for s in range(9) if len(cuts[f]) >> s < rule.bins) for f in at)
        jobs += [Job(r, at, places[w], shifts) for r in (rule.rules(len(own)) if isinstance(rule, Forest) else [rule])]
    grown = iter(zip(jobs, grow(table, jobs, len(features), width, local_bytes)))

    def finished(rule: Boost | Forest) -> BoostedModel:
        parts = [next(grown) for _ in range(rule.trees if isinstance(rule, Forest) else 1)]
        job = parts[0][0]
        trees = [t for _, (_, own) in parts for t in own]
        for t in trees:
            # Back from coarser bins to the table's.
            t.bin = [((b + 1) << job.shifts[f]) - 1 for f, b in zip(t.feature, t.bin)]
            if isinstance(rule, Forest):
                t.value = [v / rule.trees for v in t.value]
        kind, base = (ForestModel, 0.0) if isinstance(rule, Forest) else (BoostedModel, parts[0][1][0])
        return kind(base, trees, [cuts[f] for f in job.features], len(job.features))

    return [finished(rule) for rule, _, _ in models]
