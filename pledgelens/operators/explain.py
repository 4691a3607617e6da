"""Explanations of fitted models as long tables ``(id, feature, shap)``."""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import ranks as R
from .boosting import BoostedModel, fit_many, leaf_wise
from .columns import balanced_weights, to_matrix
from .gram import summed
from .metrics import ranking_metrics
from .models import Fitted, L1Logit, fit_logits
from .stored import stored


# --------------------------------------------------------------------------
# Linear contributions
# --------------------------------------------------------------------------
def background_rows(df: DataFrame, id_col: str, rows: int = 50, seed: int = 42) -> DataFrame:
    """A fixed small reference sample: the first rows in hash order."""
    return df.orderBy(R.hash_key(id_col, seed), id_col).limit(rows)


def linear_shap(
    df: DataFrame, id_col: str, coefficients: dict[str, float], background: dict[str, float]
) -> DataFrame:
    """``coef * (x - background mean)`` per row and feature."""
    names = list(coefficients)
    parts = F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 (F.lit(float(coefficients[c])) * (F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                                                   - F.lit(float(background.get(c, 0.0))))).alias("shap"))
        for c in names])
    return df.select(id_col, F.inline(parts))


def background_means(df: DataFrame, features: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in features]).first()
    return {c: row[c] or 0.0 for c in features}


def sparse_linear_ranking(
    weights: DataFrame, coefficients: DataFrame, n_docs: int, background: DataFrame | None = None,
    term: str = "term", weight: str = "scaled",
) -> DataFrame:
    """Mean absolute and mean contribution per term from sparse weights.

    Documents without the term contribute ``-coef * mean`` each; they are counted,
    not materialised. ``coefficients`` is ``(term, coef)``, ``background`` ``(term, mean)``.
    """
    means = background if background is not None else weights.groupBy(term).agg(
        (F.sum(weight) / F.lit(float(n_docs))).alias("mean"))
    side = coefficients.join(means, term, "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    present = weights.join(side, term).withColumn("s", F.col("coef") * (F.col(weight) - F.col("mean"))).groupBy(
        term).agg(F.sum(F.abs("s")).alias("a"), F.sum("s").alias("m"), F.count(F.lit(1)).alias("k"))
    absent = (F.lit(n_docs) - F.coalesce("k", F.lit(0))) * F.col("coef") * F.col("mean")
    return side.join(present, term, "left").select(
        term, "coef", ((F.coalesce("a", F.lit(0.0)) + F.abs(absent)) / n_docs).alias("shap_mean_abs"),
        ((F.coalesce("m", F.lit(0.0)) - absent) / n_docs).alias("shap_mean"))


# --------------------------------------------------------------------------
# Tree contributions
# --------------------------------------------------------------------------
@dataclass
class Leaf:
    """One root-to-leaf path, reduced to an interval and a cover share per feature."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cover: np.ndarray
    share: float


def _model_nodes(fitted: Fitted, spark: SparkSession) -> list[list[dict]]:
    """Nodes of every tree, read back from the saved model's table."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/trees-{uuid.uuid4().hex}"
    fitted.model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, dict[int, object]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    return [trees[t] for t in sorted(trees)]


def tree_leaves(fitted: Fitted, spark: SparkSession) -> tuple[list[Leaf], float]:
    """All leaf paths with class-1 values, scaled so that leaf values add up to the output.

    A forest's output is the class-1 probability, a boosted model's the log-odds.
    """
    model = fitted.model
    if isinstance(model, BoostedModel):
        return _boosted_leaves(model)
    boosted = not hasattr(model, "numClasses") or type(model).__name__.startswith("GBT")
    weights = model.treeWeights
    leaves: list[Leaf] = []
    expected = 0.0
    for nodes, weight in zip(_model_nodes(fitted, spark), weights):
        scale = 2.0 * weight if boosted else 1.0 / len(weights)
        total = _cover(nodes[0])

        def walk(node, bounds: dict[int, tuple[float, float, float]]):
            nonlocal expected
            if node["leftChild"] < 0:
                stats = node["impurityStats"]
                raw = node["prediction"] if boosted else stats[1] / max(sum(stats), 1e-300)
                f = np.array(sorted(bounds), dtype=np.int64)
                b = [bounds[i] for i in f]
                share = _cover(node) / total
                leaves.append(Leaf(
                    raw * scale, f, np.array([x[0] for x in b]), np.array([x[1] for x in b]),
                    np.array([x[2] for x in b]), share))
                expected += raw * scale * share
                return
            split = node["split"]
            feature, cut = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            low, high, cover = bounds.get(feature, (-math.inf, math.inf, 1.0))
            left, right = nodes[node["leftChild"]], nodes[node["rightChild"]]
            parent = max(_cover(node), 1e-300)
            walk(left, bounds | {feature: (low, min(high, cut), cover * _cover(left) / parent)})
            walk(right, bounds | {feature: (max(low, cut), high, cover * _cover(right) / parent)})

        walk(nodes[0], {})
    return leaves, expected


def _boosted_leaves(model: BoostedModel) -> tuple[list[Leaf], float]:
    """All leaf paths of grown trees, and the expected margin."""
    leaves, expected = [], model.base
    for feature, cut, left, right, value, cover in model.trees:
        at: list[tuple[int, dict]] = [(0, {})]
        while at:
            node, bounds = at.pop()
            if left[node] < 0:
                f = np.array(sorted(bounds), dtype=np.int64)
                b = [bounds[i] for i in f]
                share = cover[node] / max(cover[0], 1e-300)
                leaves.append(Leaf(float(value[node]), f, *[np.array([x[k] for x in b]) for k in range(3)], share))
                expected += value[node] * share
                continue
            low, high, under = bounds.get(int(feature[node]), (-math.inf, math.inf, 1.0))
            parent = max(cover[node], 1e-300)
            for child, edges in ((left[node], (low, min(high, cut[node]))), (right[node], (max(low, cut[node]), high))):
                at.append((int(child), bounds | {int(feature[node]): (*edges, under * cover[child] / parent)}))
    return leaves, float(expected)


def _cover(node) -> float:
    """Weighted training rows that reach a node."""
    stats = node["impurityStats"]
    return float(sum(stats)) if len(stats) != 3 else float(stats[0])


def _path_dependent(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for leaf in leaves:
        d = len(leaf.features)
        if d == 0:
            continue
        cols = x[:, leaf.features]
        inside = ((cols > leaf.low) & (cols <= leaf.high)).astype(np.float64)
        sizes = [math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)]
        for j in range(d):
            # Coefficients by subset size of the product over the other features.
            poly = np.zeros((len(x), d))
            poly[:, 0] = 1.0
            for m in range(d):
                if m != j:
                    grown = poly * leaf.cover[m]
                    grown[:, 1:] += poly[:, :-1] * inside[:, m: m + 1]
                    poly = grown
            out[:, leaf.features[j]] += leaf.value * (inside[:, j] - leaf.cover[j]) * (poly @ sizes)
    return out


def _bits(leaf: Leaf, x: np.ndarray) -> np.ndarray:
    """Per row the conditions of the leaf's path that it meets, as a number of bits."""
    cols = x[:, leaf.features]
    return ((cols > leaf.low) & (cols <= leaf.high)) @ (1 << np.arange(len(leaf.features), dtype=np.int64))


#: Cells of a group of leaves: a cell's contributions are worked out once and looked up by all rows in it.
CELLS = 512


@dataclass
class LeafGroup:
    """Neighbouring leaves, the features that they ask for and each feature's cuts; None for a leaf with more cells than are worked out."""

    leaves: list[Leaf]
    features: list[int]
    cuts: list[np.ndarray] | None

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(c) + 1 for c in self.cuts)

    def sample(self, width: int) -> np.ndarray:
        """A row out of each cell, in the order of their numbers."""
        x = np.zeros((math.prod(self.shape), width))
        if self.features:
            for f, c, place in zip(self.features, self.cuts, np.indices(self.shape).reshape(len(self.features), -1)):
                x[:, f] = np.append(c, math.inf)[place]
        return x


def leaf_groups(leaves: list[Leaf]) -> list[LeafGroup]:
    """All leaves in their order, in groups whose cuts leave at most ``CELLS`` cells: rows of one cell meet the same conditions of all its leaves."""

    def cuts_of(leaf: Leaf, known: dict[int, frozenset]) -> dict[int, frozenset]:
        return known | {
            int(f): known.get(int(f), frozenset()) | {c for c in (float(low), float(high)) if math.isfinite(c)}
            for f, low, high in zip(leaf.features, leaf.low, leaf.high)}

    def cells(cuts: dict[int, frozenset]) -> int:
        return math.prod(len(c) + 1 for c in cuts.values())

    groups: list[LeafGroup] = []
    held: list[Leaf] = []
    cuts: dict[int, frozenset] = {}

    def close() -> None:
        if held:
            few = cells(cuts) <= CELLS
            groups.append(LeafGroup(held, sorted(cuts), [np.array(sorted(cuts[f])) for f in sorted(cuts)] if few else None))

    for leaf in leaves:
        grown = cuts_of(leaf, cuts)
        if cells(grown) > CELLS:
            close()
            held, grown = [], cuts_of(leaf, {})
        held, cuts = [*held, leaf], grown
    close()
    return groups


class CellNumbers:
    """The number of each row's cell in every group: a value is placed once among all cuts of its feature, groups look their share up there."""

    def __init__(self, groups: list[LeafGroup], width: int):
        every: list[list[np.ndarray]] = [[] for _ in range(width)]
        for g in groups:
            for f, c in zip(g.features, g.cuts or ()):
                every[f].append(c)
        self.edges = [np.unique(np.concatenate(c)) if c else None for c in every]
        self.shares = []
        for g in groups:
            own = []
            for i, (f, c) in enumerate(zip(g.features, g.cuts or ())):
                place = np.searchsorted(np.searchsorted(self.edges[f], c), np.arange(len(self.edges[f]) + 1))
                own.append((f, place * math.prod(g.shape[i + 1:])))
            self.shares.append(own)

    def places(self, x: np.ndarray) -> list[np.ndarray | None]:
        return [None if e is None else np.searchsorted(e, x[:, f]) for f, e in enumerate(self.edges)]

    def of(self, group: int, places: list[np.ndarray | None], rows: int) -> np.ndarray:
        cell = np.zeros(rows, dtype=np.int64)
        for f, share in self.shares[group]:
            cell += share.take(places[f])
        return cell


def _sent(spark: SparkSession, value: object) -> Broadcast:
    """The value as bytes that executors without this package can read too."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def leaf_patterns(leaves: list[Leaf], background: DataFrame, features: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Per leaf the patterns of met conditions among the background rows with their shares, and the number of rows.

    A leaf asks for d conditions, so it has at most 2^d patterns, however many rows there are. Rows are counted by cell of a group, a
    task's once for all its rows; only a leaf with too many cells has its patterns counted row by row.
    """
    groups = leaf_groups(leaves)
    numbers = CellNumbers(groups, len(features))
    shared = _sent(background.sparkSession, (groups, numbers))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups, numbers = pickle.loads(shared.value)
        sums = [None if g.cuts is None else np.zeros(math.prod(g.shape), dtype=np.int64) for g in groups]
        for batch in batches:
            if len(batch):
                x = batch.to_numpy(np.float64)
                places = numbers.places(x)
                for i, g in enumerate(groups):
                    if g.cuts is None:
                        bits, n = np.unique(_bits(g.leaves[0], x), return_counts=True)
                        yield pd.DataFrame({"place": np.full(len(n), i, dtype=np.int32), "bits": bits, "n": n})
                    else:
                        sums[i] += np.bincount(numbers.of(i, places, len(x)), minlength=len(sums[i]))
        for i, n in enumerate(sums):
            if n is not None and n.any():
                cells = np.flatnonzero(n)
                yield pd.DataFrame({"place": np.full(len(cells), i, dtype=np.int32), "bits": cells, "n": n[cells]})

    parts = to_matrix(background, features).mapInPandas(counted, "place int, bits bigint, n bigint")
    table = parts.groupBy("place", "bits").agg(F.sum("n").alias("n")).orderBy("place", "bits").toArrow()
    place, bits, n = (table.column(c).to_numpy() for c in ("place", "bits", "n"))
    edges = np.searchsorted(place, np.arange(len(groups) + 1))
    rows = int(n[:edges[1]].sum()) if groups else 0
    patterns = []
    for g, i, j in zip(groups, edges, edges[1:]):
        if g.cuts is None:
            patterns.append((bits[i:j], n[i:j] / max(rows, 1)))
            continue
        x = g.sample(len(features))[bits[i:j]]
        for leaf in g.leaves:
            met, at = np.unique(_bits(leaf, x), return_inverse=True)
            found = np.zeros(len(met), dtype=np.int64)
            np.add.at(found, at, n[i:j])
            patterns.append((met, found / max(rows, 1)))
    return patterns, rows


def _interventional(leaves: list[Leaf], patterns: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Contributions against a background given by its patterns: cost follows the leaves, not rows times background."""
    out = np.zeros_like(x)
    fact = [float(math.factorial(i)) for i in range(64)]
    for leaf, (theirs, weight) in zip(leaves, patterns):
        d = len(leaf.features)
        if d == 0:
            continue
        mine, place = np.unique(_bits(leaf, x), return_inverse=True)
        each = np.arange(d)
        here, there = (mine[:, None] >> each & 1).astype(bool), (theirs[:, None] >> each & 1).astype(bool)
        a = here[:, None, :] & ~there[None, :, :]
        b = ~here[:, None, :] & there[None, :, :]
        reachable = ~np.any(~here[:, None, :] & ~there[None, :, :], axis=2)
        na, nb = a.sum(2), b.sum(2)
        table_a, table_b = np.zeros((d + 1, d + 1)), np.zeros((d + 1, d + 1))
        for p in range(d + 1):
            for q in range(d + 1 - p):
                if p:
                    table_a[p, q] = fact[p - 1] * fact[q] / fact[p + q]
                if q:
                    table_b[p, q] = fact[p] * fact[q - 1] / fact[p + q]
        plus, minus = table_a[na, nb] * reachable, table_b[na, nb] * reachable
        effect = ((a * plus[:, :, None] - b * minus[:, :, None]) * weight[None, :, None]).sum(axis=1)
        out[:, leaf.features] += leaf.value * effect[place]
    return out


@dataclass
class ContributionTables:
    """Contributions of every cell of the groups of leaves; leaves without a table are worked out row by row."""

    numbers: CellNumbers
    tables: list[np.ndarray | None]
    features: list[list[int]]
    alone: list[tuple[Leaf, tuple[np.ndarray, np.ndarray] | None]]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Contributions of the rows: cost follows the groups, a lookup for each of their features."""
        out = np.zeros((x.shape[1], len(x)))
        places = self.numbers.places(x)
        for i, table in enumerate(self.tables):
            if table is not None:
                cell = self.numbers.of(i, places, len(x))
                for f, values in zip(self.features[i], table):
                    out[f] += values.take(cell)
        out = out.T
        for leaf, theirs in self.alone:
            out = out + _leaf_contributions([leaf], None if theirs is None else [theirs], x)
        return out


def _leaf_contributions(leaves: list[Leaf], patterns: list[tuple[np.ndarray, np.ndarray]] | None, x: np.ndarray) -> np.ndarray:
    return _path_dependent(leaves, x) if patterns is None else _interventional(leaves, patterns, x)


def contribution_tables(
    leaves: list[Leaf], patterns: list[tuple[np.ndarray, np.ndarray]] | None, width: int
) -> ContributionTables:
    """The contributions of each cell, by path covers or against a background's patterns: as large as the model, whatever the rows."""
    groups = leaf_groups(leaves)
    tables: list[np.ndarray | None] = []
    alone, at = [], 0
    for g in groups:
        own = None if patterns is None else patterns[at: at + len(g.leaves)]
        at += len(g.leaves)
        if g.cuts is None:
            tables.append(None)
            alone.append((g.leaves[0], own[0] if own else None))
        else:
            tables.append(np.ascontiguousarray(_leaf_contributions(g.leaves, own, g.sample(width))[:, g.features].T))
    return ContributionTables(CellNumbers(groups, width), tables, [g.features for g in groups], alone)


def tree_shap(fitted: Fitted, df: DataFrame, id_col: str, background: DataFrame | None = None) -> tuple[DataFrame, float]:
    """Class-1 contributions of every row and feature, and the base value.

    Without ``background`` the training cover weighs the paths; with it, the given rows do, of any number: they are counted by the
    patterns that they leave at the leaves. Contributions and base add up to the model output.
    """
    spark = df.sparkSession
    leaves, base = tree_leaves(fitted, spark)
    features, patterns = fitted.features, None
    if background is not None:
        patterns, rows = leaf_patterns(leaves, background, features)
        if not rows:
            raise ValueError("the background has no rows")
        # The leaf that a row reaches is the one all of whose conditions it meets.
        reached = [float(w[bits == (1 << len(leaf.features)) - 1].sum()) for leaf, (bits, w) in zip(leaves, patterns)]
        base = getattr(fitted.model, "base", 0.0) + float(sum(leaf.value * r for leaf, r in zip(leaves, reached)))
    tables = contribution_tables(leaves, patterns, len(features))
    shared = _sent(spark, tables)
    block = 4096

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = pickle.loads(shared.value)
        for batch in batches:
            for start in range(0, len(batch), block):
                part = batch.iloc[start: start + block]
                phi = tables.of(part[features].to_numpy(np.float64))
                yield pd.DataFrame({
                    id_col: np.repeat(part[id_col].to_numpy(), len(features)),
                    "feature": np.tile(features, len(part)), "shap": phi.ravel()})

    id_type = dict(df.dtypes)[id_col]
    long = to_matrix(df, features, [id_col]).mapInPandas(explain, f"`{id_col}` {id_type}, feature string, shap double")
    return long, base


# --------------------------------------------------------------------------
# Tables from contributions
# --------------------------------------------------------------------------
def shap_ranking(shap: DataFrame, top: int | None = None, signed: bool = False) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    out = shap.groupBy("feature").agg(
        F.avg(F.abs("shap")).alias("mean_abs"), *([F.avg("shap").alias("mean")] if signed else [])
    ).orderBy(F.desc("mean_abs"), "feature")
    return out if top is None else out.limit(top)


def shap_by_category(
    shap: DataFrame, categories: DataFrame, id_col: str, category: str, top: int = 8, absolute: bool = False,
    missing: str = "Неизвестно",
) -> DataFrame:
    """Mean contribution of the strongest features per category, one column per feature."""
    names = [r["feature"] for r in shap_ranking(shap, top).collect()]
    side = categories.select(id_col, F.coalesce(F.col(category).cast("string"), F.lit(missing)).alias(category))
    value = F.avg(F.abs("shap") if absolute else F.col("shap"))
    return shap.where(F.col("feature").isin(names)).join(side, id_col).groupBy(category).pivot("feature", names).agg(value)


def shap_dependence(shap: DataFrame, df: DataFrame, id_col: str, top: int = 4) -> DataFrame:
    """``(id, feature, value, shap)`` of the strongest features."""
    names = [r["feature"] for r in shap_ranking(shap, top).collect()]
    values = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        [id_col], names, "feature", "value")
    return shap.where(F.col("feature").isin(names)).join(values, [id_col, "feature"]).select(
        id_col, "feature", "value", "shap")


def word_report(linear: DataFrame, boosted: DataFrame | None = None, word: str = "term") -> DataFrame:
    """Coefficient and contributions of both models per word, strongest first."""
    left = linear.select(
        F.col(word).alias("word"), F.col("coef").alias("logreg_coef"),
        F.col("shap_mean_abs").alias("shap_logreg_mean_abs"), F.col("shap_mean").alias("shap_logreg_mean"))
    if boosted is None:
        return left.orderBy(F.desc(F.abs("logreg_coef")), "word")
    right = boosted.select(
        F.col("feature").alias("word"), F.col("mean_abs").alias("shap_boost_mean_abs"),
        F.col("mean").alias("shap_boost_mean"))
    return left.join(right, "word", "full").orderBy(F.desc_nulls_last(F.abs("shap_boost_mean_abs")), "word")


def word_rankings(
    weights: DataFrame, labels: DataFrame, id_col: str, y: str, c: float = 1.0, rounds: int = 200, depth: int = 4, rate: float = 0.05,
    term: str = "term", weight: str = "weight", scaled: str = "scaled",
) -> tuple[DataFrame, DataFrame]:
    """Contributions of words in two models of ``y``, for :func:`word_report`: an L1 logit on scaled and boosted trees on plain weights.

    ``weights`` are sparse, of a bounded number of terms; ``labels`` has a row for every document and ``y`` of 0 and 1. Both models weigh the
    classes alike. Documents without a term have weight 0 there.
    """
    spark = labels.sparkSession
    weights = stored(weights.select(id_col, term, weight, scaled), "word-weights")
    marks = [i / 254 for i in range(1, 254)]
    known = weights.groupBy(term).agg(F.min(weight).alias("least"), F.percentile_approx(weight, marks, 10_000).alias("marks")).orderBy(term).collect()
    terms = [r[term] for r in known]
    names = [f"w{i:05d}" for i in range(len(terms))]
    if not terms:
        return (spark.createDataFrame([], f"{term} string, coef double, shap_mean_abs double, shap_mean double"),
                spark.createDataFrame([], "feature string, mean_abs double, mean double"))
    places = spark.createDataFrame(list(zip(terms, range(len(terms)))), f"`{term}` string, place int")
    packed = weights.join(F.broadcast(places), term).groupBy(id_col).agg(F.collect_list(F.struct("place", weight, scaled)).alias("own"))
    rows = stored(labels.select(id_col, F.col(y).cast("int").alias("__label")).join(packed, id_col, "left").select(
        id_col, "__label", *[F.col("own")[f].alias(n) for n, f in (("places", "place"), ("plain", weight), ("even", scaled))]), "word-rows")

    def dense(value: str) -> DataFrame:
        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for start in range(0, len(batch), 2048):
                    part = batch.iloc[start: start + 2048]
                    x = np.zeros((len(part), len(names)))
                    for i, (at, v) in enumerate(zip(part["places"], part[value])):
                        if at is not None:
                            x[i, at] = v
                    out = pd.DataFrame(x, columns=names)
                    out.insert(0, "__label", part["__label"].to_numpy())
                    out.insert(0, id_col, part[id_col].to_numpy())
                    yield out

        kind = dict(rows.dtypes)[id_col]
        return rows.select(id_col, "__label", "places", value).mapInPandas(
            fill, f"`{id_col}` {kind}, __label int, " + ", ".join(f"{n} double" for n in names))

    logit = fit_logits(dense("even").withColumn("fold", F.lit(0)), "__label", [(L1Logit(c, False), True, names, None)])[0]
    coef = spark.createDataFrame([(t, float(v)) for t, v in zip(terms, logit.weights)], f"`{term}` string, coef double")
    linear = sparse_linear_ranking(weights, coef, rows.count(), term=term, weight=scaled)
    # No weight is a bin of its own, other bins follow the weights that are there.
    limits = {n: np.unique([r["least"] / 2, *r["marks"]]) for n, r in zip(names, known)}
    plain = dense("plain")
    balanced = balanced_weights(plain, "__label", "__w")
    model = fit_many(balanced, "__label", {"all": F.col("__w")}, [(leaf_wise(rounds, rate, depth), names, "all")], limits=limits)[0]
    shap, _ = tree_shap(Fitted(model, names), plain, id_col)
    words = spark.createDataFrame(list(zip(names, terms)), "feature string, word string")
    boosted = shap_ranking(shap, signed=True).join(F.broadcast(words), "feature").select(F.col("word").alias("feature"), "mean_abs", "mean")
    return linear, boosted


def top_signed(coefficients: DataFrame, n: int = 20, name: str = "term", value: str = "coef") -> DataFrame:
    """The largest and the smallest values, ascending; both ends are taken from one evaluation."""
    coefficients = stored(coefficients, "coefficients")
    high = coefficients.orderBy(F.desc(value), name).limit(n)
    low = coefficients.orderBy(F.asc(value), name).limit(n)
    return high.unionByName(low).orderBy(value, name)


# --------------------------------------------------------------------------
# Local surrogate
# --------------------------------------------------------------------------
def _bin_table(train: DataFrame, features: list[str]) -> dict[str, list[tuple]]:
    """Per feature its quartile bins: upper edge, share, mean, deviation, minimum, maximum."""
    long = R.melt_numeric(train, features)
    cum = R.cumulate(long, ["feature"])
    edges = {r["feature"]: sorted({r["q1"], r["q2"], r["q3"]}) for r in R.quantiles(
        cum, ["feature"], {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()}
    marks = F.lit(0)
    for name, cuts in edges.items():
        code = sum(((F.col("value") > c).cast("int") for c in cuts), F.lit(0))
        marks = F.when(F.col("feature") == name, code).otherwise(marks)
    rows = long.withColumn("bin", marks).groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"),
        F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
    out = {}
    for name in features:
        mine = sorted((r for r in rows if r["feature"] == name), key=lambda r: r["bin"])
        total = sum(r["n"] for r in mine)
        out[name] = [(r["bin"], r["n"] / total, r["m"], r["s"], r["lo"], r["hi"]) for r in mine], edges[name]
    return out


def local_surrogate(
    fitted: Fitted, train: DataFrame, rows: DataFrame, id_col: str, samples: int = 200, n_features: int = 10,
    seed: int = 42, ridge: float = 1.0,
) -> DataFrame:
    """Weighted linear fit around each row: ``(id, condition, weight)``, strongest first.

    Every row is perturbed bin-wise after the training distribution; the model
    scores all samples in one job, and each row's small system is solved alone.
    """
    features = fitted.features
    bins = _bin_table(to_matrix(train, features), features)
    base = to_matrix(rows, features, [id_col])

    def uniform(name: str, stream: int):
        key = F.xxhash64(F.col(id_col), F.col("sample"), F.lit(name), F.lit(seed * 1000 + stream))
        return (F.pmod(key, F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))

    drawn = base.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    for i, name in enumerate(features):
        table, cuts = bins[name]
        own = sum(((F.col(name) > c).cast("int") for c in cuts), F.lit(0))
        total, pick = 0.0, F.lit(table[-1][0])
        ladder = None
        for code, share, *_ in table[:-1]:
            total += share
            test = F.col("__u") < total
            ladder = F.when(test, code) if ladder is None else ladder.when(test, code)
        pick = ladder.otherwise(table[-1][0]) if ladder is not None else pick
        normal = F.sqrt(-2.0 * F.log(uniform(name, 1))) * F.cos(2.0 * math.pi * uniform(name, 2))
        value = F.col(name)
        for code, _, mean, std, lo, hi in table:
            draw = F.least(F.greatest(F.lit(mean) + F.lit(std) * normal, F.lit(lo)), F.lit(hi))
            value = F.when((F.col("sample") > 0) & (F.col("__k") == code), draw).otherwise(value)
        drawn = drawn.withColumn("__u", uniform(name, 0)).withColumn("__o", own).withColumn(
            "__k", F.when(F.col("sample") == 0, F.col("__o")).otherwise(pick)).withColumn(
            f"__z{i}", (F.col("__k") == F.col("__o")).cast("double")).withColumn(f"__v{i}", value)
        drawn = drawn.withColumn(f"__c{i}", F.col("__o")).drop("__u", "__o", "__k")
    z, c = [f"__z{i}" for i in range(len(features))], [f"__c{i}" for i in range(len(features))]
    perturbed = drawn.select(id_col, "sample", *z, *c, *[F.col(f"__v{i}").alias(f) for i, f in enumerate(features)])
    scored = fitted.predict(perturbed).select(id_col, "sample", *z, *c, "probability")
    labels = {f: bins[f][1] for f in features}
    width = 0.75 * math.sqrt(len(features))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        zz, target = pdf[z].to_numpy(np.float64), pdf["probability"].to_numpy(np.float64)
        distance = np.sqrt(((zz - 1.0) ** 2).sum(1))
        w = np.sqrt(np.exp(-(distance ** 2) / width ** 2))

        def fit(cols: list[int]) -> np.ndarray:
            x, t = zz[:, cols], target
            xm, tm = np.average(x, axis=0, weights=w), np.average(t, weights=w)
            xc = x - xm
            return np.linalg.solve((xc * w[:, None]).T @ xc + ridge * np.eye(len(cols)), (xc * w[:, None]).T @ (t - tm))

        first = fit(list(range(len(features))))
        cols = list(np.argsort(-np.abs(first * zz[0]), kind="stable")[:n_features])
        out = []
        for j, weight in zip(cols, fit(cols)):
            name, cuts, code = features[j], labels[features[j]], int(pdf[c[j]].iloc[0])
            if not cuts:
                text = name
            elif code == 0:
                text = f"{name} <= {cuts[0]:.2f}"
            elif code >= len(cuts):
                text = f"{name} > {cuts[-1]:.2f}"
            else:
                text = f"{cuts[code - 1]:.2f} < {name} <= {cuts[code]:.2f}"
            out.append((pdf[id_col].iloc[0], text, float(weight)))
        out.sort(key=lambda r: -abs(r[2]))
        return pd.DataFrame(out, columns=[id_col, "condition", "weight"])

    # A group is one row's samples: a fixed, small number.
    return scored.groupBy(id_col).applyInPandas(solve, f"`{id_col}` {dict(rows.dtypes)[id_col]}, condition string, weight double")


# --------------------------------------------------------------------------
# Additive logit
# --------------------------------------------------------------------------
def _spline_basis(x: np.ndarray, low: float, high: float, n: int, degree: int = 3) -> np.ndarray:
    """Uniform B-spline basis on [low, high]; values outside count at the border."""
    t = (np.clip(x, low, high) - low) / ((high - low) or 1.0)
    inner = n - degree
    knots = np.arange(-degree, n + 1) / inner
    t = np.minimum(t, 1.0 - 1e-12)[:, None]
    basis = ((t >= knots[None, :-1]) & (t < knots[None, 1:])).astype(np.float64)
    for p in range(1, degree + 1):
        m = basis.shape[1] - 1
        step = p / inner
        left = (t - knots[None, :m]) / step
        right = (knots[None, p + 1: p + 1 + m] - t) / step
        basis = left * basis[:, :m] + right * basis[:, 1: m + 1]
    return basis


@dataclass
class AdditiveLogit:
    """A fitted sum of smooth effects on the log-odds scale."""

    features: list[str]
    ranges: list[tuple[float, float]]
    n_splines: int
    beta: np.ndarray
    cov: np.ndarray
    stats: dict

    def _design(self, x: np.ndarray) -> np.ndarray:
        blocks = [_spline_basis(x[:, i], *self.ranges[i], self.n_splines) for i in range(len(self.features))]
        return np.hstack([np.ones((len(x), 1)), *blocks])

    def predict(self, df: DataFrame, id_col: str, keep: list[str] = ()) -> DataFrame:
        """``(id, keep.., probability)``."""
        features, design, beta = self.features, self._design, self.beta
        ids = [id_col, *keep]

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                eta = design(batch[features].to_numpy(np.float64)) @ beta
                yield batch[ids].assign(probability=1.0 / (1.0 + np.exp(-np.clip(eta, -500, 500))))

        types = dict(df.dtypes)
        schema = ", ".join(f"`{c}` {types[c]}" for c in ids) + ", probability double"
        return to_matrix(df, features, ids).mapInPandas(score, schema)

    def partial_effects(self, spark: SparkSession, points: int = 100, z: float = 1.959963984540054) -> DataFrame:
        """``(feature, value, effect, lo, hi)`` on a grid of each feature."""
        rows = []
        for i, name in enumerate(self.features):
            grid = np.linspace(*self.ranges[i], points)
            basis = _spline_basis(grid, *self.ranges[i], self.n_splines)
            part = slice(1 + i * self.n_splines, 1 + (i + 1) * self.n_splines)
            effect = basis @ self.beta[part]
            band = z * np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", basis, self.cov[part, part], basis), 0))
            rows += [(name, float(v), float(e), float(e - b), float(e + b)) for v, e, b in zip(grid, effect, band)]
        return spark.createDataFrame(rows, "feature string, value double, effect double, lo double, hi double")


def additive_logit(
    df: DataFrame, features: list[str], y: str, n_splines: int = 20, lam: float = 0.6, max_iter: int = 100,
    tol: float = 1e-4, max_columns: int = 1000,
) -> AdditiveLogit:
    """Penalised spline logit: one small-matrix pass over the rows per step."""
    k = len(features)
    size = 1 + k * n_splines
    if size > max_columns:
        raise ValueError(f"{k} features x {n_splines} splines exceed {max_columns} columns")
    data = to_matrix(df, features, [y]).persist()
    try:
        lows = data.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(features)],
                        *[F.max(c).alias(f"b{i}") for i, c in enumerate(features)]).first()
        ranges = [(lows[f"a{i}"], lows[f"b{i}"]) for i in range(k)]
        second = np.diff(np.eye(n_splines), 2, axis=0)
        penalty = np.zeros((size, size))
        for i in range(k):
            part = slice(1 + i * n_splines, 1 + (i + 1) * n_splines)
            # A slight ridge fixes the level of each effect.
            penalty[part, part] = lam * second.T @ second + 1e-3 * np.eye(n_splines)
        model = AdditiveLogit(features, ranges, n_splines, np.zeros(size), np.zeros((size, size)), {})
        hessian = np.eye(size)
        for _ in range(max_iter):
            design, beta = model._design, model.beta

            def step(rows: np.ndarray) -> np.ndarray:
                x, t = design(rows[:, :k]), rows[:, k]
                eta = np.clip(x @ beta, -500, 500)
                p = 1.0 / (1.0 + np.exp(-eta))
                ll = float(np.sum(t * eta - np.logaddexp(0.0, eta)))
                return np.concatenate([((x * (p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (t - p), [ll, len(t), t.sum()]])

            out = summed(data, [*features, y], step)
            hessian = out[: size * size].reshape(size, size)
            gradient = out[size * size: size * size + size] - penalty @ beta
            move = np.linalg.solve(hessian + penalty + 1e-9 * np.eye(size), gradient)
            llf, n, ones = out[-3:]
            model.beta = beta + move
            if np.linalg.norm(move) < tol * max(np.linalg.norm(model.beta), 1e-12):
                break
        bread = np.linalg.inv(hessian + penalty + 1e-9 * np.eye(size))
        model.cov = bread @ hessian @ bread
        share = ones / n
        null = n * (share * math.log(share) + (1 - share) * math.log(1 - share))
        model.stats = {"llf": float(llf), "mcfadden_r2": float(1 - llf / null), "n": int(n)}
        return model
    finally:
        data.unpersist()


def additive_report(model: AdditiveLogit, df: DataFrame, id_col: str, y: str) -> DataFrame:
    """ROC-AUC on the given rows and McFadden R2 of the fit."""
    scored = model.predict(df, id_col, [y])
    return ranking_metrics(scored, y, "probability").select(
        "ROC_AUC", F.lit(model.stats["mcfadden_r2"]).alias("mcfadden_r2"))
