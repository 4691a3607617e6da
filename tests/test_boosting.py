import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pledgelens.operators import boosting as B
from pledgelens.operators import explain as X
from pledgelens.operators import metrics as M
from pledgelens.operators import models as Z


def sums(rule, g, h, w):
    return g.sum(), h.sum(), float(len(g)) if rule.order == 2 else w.sum()


def brute_gain(rule, x, g, h, w):
    """The best gain over every threshold of every feature, straight from the definition."""
    def score(rows):
        below = (h if rule.order == 2 else w)[rows].sum() + rule.l2
        return g[rows].sum() ** 2 / below if below > 1e-12 else 0.0

    best = (0.0, None, None)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            fits = all(h[s].sum() >= rule.min_hessian and s.sum() >= (rule.min_rows if rule.order == 2 else 1) for s in (left, ~left))
            gain = score(left) + score(~left) - score(np.ones(len(g), bool))
            if fits and gain > best[0] + 1e-12:
                best = (gain, f, cut)
    return best


def brute_tree(rule, x, g, h, w):
    """Grown leaf by leaf (or all levels): {frozenset of rows: leaf value}."""
    leaves = [(np.arange(len(g)), 0)]
    done = []
    while leaves and (rule.leaves is None or len(leaves) + len(done) < rule.leaves):
        found = []
        for i, (rows, level) in enumerate(leaves):
            deep = rule.depth is not None and level >= rule.depth
            gain, f, cut = (0.0, None, None) if deep else brute_gain(rule, x[rows], g[rows], h[rows], w[rows])
            found.append((gain, -i, f, cut))
        gain, i, f, cut = max(found, key=lambda r: r[:2])
        if gain <= 1e-9:
            break
        rows, level = leaves.pop(-i)
        left = x[rows, f] <= cut
        leaves += [(rows[left], level + 1), (rows[~left], level + 1)]
    return {tuple(rows): -rule.rate * g[rows].sum() / (h[rows].sum() + rule.l2) for rows, _ in leaves}


RULES = [
    B.Boost(3, 0.1, 6, min_rows=5), B.Boost(3, 0.1, 31, 3, min_rows=10), B.Boost(3, 0.3, None, 3, l2=1.0, min_hessian=1.0, min_rows=1),
    B.Boost(3, 0.1, None, 2, min_hessian=0.0, order=1),
]


@pytest.mark.parametrize("rule", RULES)
def test_trees_of_200_rows_equal_brute_force(rule):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (200, 3)).astype(np.uint8)
    y = (rng.random(200) < 1 / (1 + np.exp(-(x[:, 0] - 6) / 3 * (x[:, 1] > 5)))).astype(int)
    w = rng.choice([0.5, 2.0], 200)
    job = B.Job(rule, (0, 1, 2), 0)
    trees = B._grow_here(job, B.Growth(rule, 0.2), B.Block(job, x, y, w, np.full(200, 0.2)), 12)
    margin = np.full(200, 0.2)
    for tree in trees:
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        want = brute_tree(rule, x, g, h, w)
        at = tree.reached(x)
        got = {tuple(np.flatnonzero(at == n)): tree.value[n] for n in np.unique(at)}
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx(want[k]) for k in want)
        margin += np.array(tree.value)[at]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(600, 4)), 2)
    y = (rng.random(600) < 1 / (1 + np.exp(-(1.5 * x[:, 0] + np.where(x[:, 1] > 0, 1.0, -1.0) * x[:, 2])))).astype(int)
    data = [(i, *map(float, r), int(t), "uvw"[i % 3]) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, d double, y int, tag string").repartition(5).persist(), x, y


def test_both_ways_of_asking_give_the_same_trees(spark, rows, monkeypatch):
    df, *_ = rows
    monkeypatch.setattr(B, "STORE_EVERY", 2)
    monkeypatch.setattr(B, "ASK_BYTES", 30_000)
    names = ["a", "b", "c"]
    weights = {"all": F.lit(1.0), "most": F.when(F.col("id") % 3 != 0, F.lit(2.0)), "none": F.lit(0.0)}
    models = [(B.Boost(5, 0.1, 5, bins=40), names, "all"), (B.Boost(4, 0.3, None, 2, l2=1.0, min_rows=1, bins=40), ["b", "d"], "most"),
              (B.Boost(2, 0.1, None, 1, order=1, bins=40), names, "none"), (B.Forest(4, 4, bins=16), ["a", "b", "c", "d"], "most")]
    near, far = (B.fit_many(df, "y", weights, models, local_bytes=n) for n in (B.LOCAL_BYTES, 0))
    for a, b in zip(near, far):
        assert a.base == pytest.approx(b.base)
        for s, t in zip(a.trees, b.trees):
            assert all(np.allclose(u, v) for u, v in zip(s, t))
    assert len(near[3].trees) == 4 and len({tuple(t[0]) for t in near[3].trees}) == 4
    assert len(near[0].trees) == 5 and len(near[2].trees) == 2 and near[2].margin(np.zeros((1, 3)))[0] == 0.0


@pytest.mark.parametrize("spec", [Z.slow_boost(rounds=3, depth=3, rate=0.3), (B.level_wise(3, 3), False), Z.shallow_forest(20, 4)])
def test_scores_importances_and_contributions(spark, rows, spec):
    df, x, _ = rows
    fitted = Z.fit(df, ["a", "b", "c"], "y", spec)
    scored = {r.id: r.probability for r in fitted.predict(df).collect()}
    assert [scored[i] for i in range(600)] == pytest.approx(fitted.model.probability(x[:, :3]).tolist())
    assert Z.impurity_top(fitted, spark).first().feature == "a" and fitted.model.importances.sum() == pytest.approx(1)
    leaves, _ = X.tree_leaves(fitted, spark)
    shap, base = X.tree_shap(fitted, df.where("id < 4"), "id")
    got = {(r.id, r.feature): r.shap for r in shap.collect()}
    for i in range(4):
        def value(known, i=i):
            out = fitted.model.base
            for leaf in leaves:
                part = leaf.value
                for f, lo, hi, cover in zip(leaf.features, leaf.low, leaf.high, leaf.cover):
                    part *= float(lo < x[i, f] <= hi) if f in known else cover
                out += part
            return out

        for j, name in enumerate("abc"):
            rest = [f for f in range(3) if f != j]
            want = sum(
                math.factorial(n) * math.factorial(2 - n) / 6 * (value({*s, j}) - value(set(s))) for n in range(3) for s in itertools.combinations(rest, n))
            assert got[i, name] == pytest.approx(want, abs=1e-9)
        forest = isinstance(fitted.model, B.ForestModel)
        assert base + sum(got[i, c] for c in "abc") == pytest.approx(scored[i] if forest else math.log(scored[i] / (1 - scored[i])))


def test_a_forest_tree_is_the_best_of_its_draw():
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 10, (300, 4)).astype(np.uint8), rng.integers(0, 2, 300)
    keys = np.arange(300)
    for rule in B.Forest(6, 1).rules(4):
        draws = B.drawn(keys, rule.seed)
        job = B.Job(rule, (0, 1, 2, 3), 0)
        tree = B._grow_here(job, B.Growth(rule, 0.0), B.Block(job, x, y, np.ones(300), np.zeros(300), keys), 10)[0]
        left = x[:, tree.feature[0]] <= tree.bin[0]
        impurity = lambda s: draws[s].sum() * (p := (draws * y)[s].sum() / draws[s].sum()) * (1 - p)
        mine = impurity(left) + impurity(~left)
        others = {f: min(impurity(x[:, f] <= b) + impurity(x[:, f] > b) for b in range(9)) for f in range(4)}
        assert mine == pytest.approx(others[tree.feature[0]])
        assert sum(v < mine - 1e-9 for v in others.values()) <= 2
        assert tree.value[tree.left[0]] == pytest.approx((draws * y)[left].sum() / draws[left].sum())
    many = B.drawn(np.arange(100_000), 5)
    assert many.mean() == pytest.approx(1, abs=0.02) and many.var() == pytest.approx(1, abs=0.03)


def test_a_background_of_all_rows_equals_all_subsets(spark, rows):
    """Four features, the whole table as background; every subset's value is the mean over its rows."""
    df, x, _ = rows
    fitted = Z.fit(df, ["a", "b", "c", "d"], "y", (B.Boost(4, 0.3, 9, bins=40), False))
    shap, base = X.tree_shap(fitted, df.where("id < 3"), "id", df)
    got = {(r.id, r.feature): r.shap for r in shap.collect()}
    assert base == pytest.approx(fitted.model.margin(x).mean())
    for i in range(3):
        def value(known, i=i):
            z = x.copy()
            z[:, list(known)] = x[i, list(known)]
            return fitted.model.margin(z).mean()

        for j, name in enumerate("abcd"):
            rest = [f for f in range(4) if f != j]
            want = sum(
                math.factorial(n) * math.factorial(3 - n) / 24 * (value({*s, j}) - value(set(s))) for n in range(4) for s in itertools.combinations(rest, n))
            assert got[i, name] == pytest.approx(want, abs=1e-9)


def test_zoo_scores_each_row_by_models_of_other_folds(spark, rows):
    df, x, y = rows
    zoo = {"LeafBoost": (B.leaf_wise(5), True), "LevelBoost": (B.level_wise(5, 2), False), "LogReg_L1": Z.model_zoo()["LogReg_L1"]}
    entries = [Z.Entry({"set": "A", "model": m}, ["a", "b", "c"], s, "tag") for m, s in zoo.items()]
    scored = Z.oof_many(df, "id", "y", entries, 3).persist()
    assert scored.count() == 1800 and scored.select("id", "model").distinct().count() == 1800
    folds = {r.id: r.fold for r in scored.collect()}
    got = {r.id: r.probability for r in scored.where("model = 'LeafBoost'").collect()}
    fold = np.array([folds[i] for i in range(600)])
    held = {i: got[i] for i in range(600) if fold[i] == 0}
    train = df.where(F.col("id").isin([int(i) for i in np.flatnonzero(fold != 0)]))
    flat = Z.one_hot(train, "tag", values=["u", "v", "w"])
    alone = Z.fit(flat, ["a", "b", "c", "cat_v", "cat_w"], "y", zoo["LeafBoost"])
    again = {r.id: r.probability for r in alone.predict(Z.one_hot(df, "tag", values=["u", "v", "w"])).collect()}
    # The bins come from all rows there, and from the training rows here: few values differ.
    assert np.mean([abs(again[i] - p) for i, p in held.items()]) < 0.02
    table = {r.model: r for r in Z.compare_models(df, "id", "y", {"A": ["a", "b", "c"]}, zoo, 3, category="tag").collect()}
    assert set(table) == set(zoo) and all(r.ROC_AUC > 0.7 for r in table.values())
    assert table["LeafBoost"].ROC_AUC == pytest.approx(M.ranking_metrics(scored.where("model = 'LeafBoost'"), "y", "probability").first().ROC_AUC)
    curve = Z.learning_curve(df, "id", "y", ["a", "b"], zoo["LevelBoost"], sizes=[0.3, 1.0]).collect()
    assert [r.share for r in curve] == [0.3, 1.0] and curve[1].n_train == 400 and curve[0].train_mean > curve[0].validation_mean


@pytest.mark.parametrize("rule", [B.Forest(1, 4).rules(4)[0], B.Forest(1, 10).rules(4)[0], B.Boost(1, 0.1, 31, min_rows=5)])
def test_bits_lead_to_the_node_that_a_walk_finds(rule):
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 60, (4000, 4)).astype(np.uint8), rng.integers(0, 2, 4000)
    job, keys = B.Job(rule, (0, 1, 2, 3), 0), np.arange(4000)
    tree = B._grow_here(job, B.Growth(rule, 0.0), B.Block(job, x, y, np.ones(4000), np.zeros(4000), keys), 60)[0]

    def walk(row):
        at = 0
        while tree.left[at] >= 0:
            at = tree.left[at] if row[tree.feature[at]] <= tree.bin[at] else tree.right[at]
        return at

    nodes = [walk(row) for row in x]
    assert len(set(nodes)) > 10
    assert tree.reach().nodes(x.T).tolist() == nodes
    assert np.array_equal(tree.reach().values(x.T, np.array(tree.value)), np.array(tree.value)[nodes])


def test_draws_by_first_bits_are_those_of_the_whole_hash():
    keys = np.arange(200_000)
    share = B._mixed(keys.astype(np.uint64), 2 * 7) / 2.0**64
    assert (B._DRAWS_OF < 0).sum() >= 4 and np.array_equal(B.drawn(keys, 7), np.searchsorted(B._DRAWS, share, "right"))


@pytest.mark.parametrize("cells", [1, 16, 512])
def test_cells_of_leaves_give_what_each_row_gives(spark, rows, monkeypatch, cells):
    """Contributions and background patterns looked up by cell equal those worked out row by row, with and without leaves beyond the limit."""
    rng = np.random.default_rng(5)
    leaves = []
    for _ in range(40):
        f = np.sort(rng.choice(4, rng.integers(0, 5), replace=False))
        low, high = np.sort(rng.integers(-3, 4, (2, len(f))), axis=0).astype(float)
        high[rng.random(len(f)) < 0.3] = np.inf
        low[rng.random(len(f)) < 0.3] = -np.inf
        leaves.append(X.Leaf(float(rng.normal()), f, low, high, rng.random(len(f)), 0.1))
    x, base = rng.integers(-4, 5, (500, 4)).astype(float), rng.integers(-4, 5, (300, 4)).astype(float)
    monkeypatch.setattr(X, "CELLS", cells)
    names = list("abcd")
    patterns, n = X.leaf_patterns(leaves, spark.createDataFrame(base.tolist(), "a double, b double, c double, d double").repartition(3), names)
    assert n == 300
    for leaf, (bits, share) in zip(leaves, patterns, strict=True):
        want, count = np.unique(X._bits(leaf, base), return_counts=True)
        assert np.array_equal(bits, want) and np.allclose(share, count / 300)
    calls = []
    path = X._path_dependent
    monkeypatch.setattr(X, "_path_dependent", lambda leaves, x: calls.append(len(x)) or path(leaves, x))
    tables = X.contribution_tables(leaves, None, 4)
    calls.clear()
    assert np.allclose(tables.of(x), path(leaves, x))
    if cells == 512:
        assert not calls  # no row is worked out by itself
    assert np.allclose(X.contribution_tables(leaves, patterns, 4).of(x), X._interventional(leaves, patterns, x))


def test_logits_of_all_folds_share_their_passes_and_equal_spark(spark, monkeypatch):
    """Each fold's logit is the one that Spark fits to the fold's training rows; all take one pass at a time together."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from pledgelens.operators import columns as C
    from pledgelens.operators import regress as J

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) * [1.0, 50.0, 0.02] + [0.0, 1000.0, 0.0]
    y = (rng.random(300) < 1 / (1 + np.exp(-x[:, 0] - (x[:, 1] - 1000) / 80))).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t), "uvw"[i % 3]) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int, tag string")
    passes, plain = [], J.summed
    monkeypatch.setattr(J, "summed", lambda *a: passes.append(1) or plain(*a))
    rule = Z.model_zoo()["LogReg_L1"]
    entries = [Z.Entry({"set": "all"}, ["a", "b", "c"], rule, "tag"), Z.Entry({"set": "two"}, ["a", "c"], rule)]
    got = {(r["set"], r.id): r for r in Z.oof_many(df, "id", "y", entries, k=3).collect()}
    assert len(passes) < 25 and len(got) == 600
    folds = spark.createDataFrame([(r.id, r.fold) for (s, _), r in got.items() if s == "all"], "id long, fold int")
    data = C.one_hot(df.join(folds, "id"), "tag")
    for name, features in (("all", ["a", "b", "c", "cat_v", "cat_w"]), ("two", ["a", "c"])):
        rows = VectorAssembler(inputCols=features, outputCol="x").transform(data)
        train = C.balanced_weights(rows.where("fold <> 1"), "y", "w")
        model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", elasticNetParam=1.0, regParam=1.0 / train.count(), maxIter=1000, tol=1e-12).fit(train)
        for r in model.transform(rows.where("fold = 1")).collect():
            assert got[name, r.id].probability == pytest.approx(r.probability[1], abs=2e-4)


@pytest.mark.parametrize("depth", [2, 9])
def test_response_of_a_forest_from_leaf_counts_is_the_mean_of_all_scores(spark, depth):
    """One pass over the rows gives what scoring every row at every grid value gives, also for trees of more leaves than a word has bits."""
    rng = np.random.default_rng(depth)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int")
    fitted = Z.fit(df, ["a", "b", "c"], "y", (B.Forest(7, depth, 1), True))
    grid = [-9.0, -0.5, 0.0, 0.25, 9.0]
    want = {r.grid: r.m for r in Z.ice_curves(fitted, df, "id", "b", grid).groupBy("grid").agg(F.avg("probability").alias("m")).collect()}
    leaves = B.FreeFeature(fitted.model, 1)
    got = Z.partial_dependence(fitted, df, "b", grid).collect()
    assert [r.grid for r in got] == grid and {r.feature for r in got} == {"b"}
    for r in got:
        assert r.mean_probability == pytest.approx(want[r.grid], abs=1e-12)
    assert len(leaves.values) % 64 == 0 and leaves.counts(x).max() <= 400


@pytest.mark.parametrize("piece", [1, 30_000])
def test_pieces_of_histograms_give_the_trees_of_whole_ones(spark, rows, monkeypatch, piece):
    """Pieces of one feature and one node, or of all features and some nodes: the same trees, and few groups where pieces are small."""
    df, *_ = rows
    features = [c for c in df.columns if c not in ("id", "y")]
    whole = B.fit_many(df, "y", {"all": F.lit(1.0)}, [(B.leaf_wise(3), features, "all"), (B.Forest(3, 4, 1), features, "all")])
    monkeypatch.setattr(B, "PIECE_BYTES", piece)
    parted = B.fit_many(df, "y", {"all": F.lit(1.0)}, [(B.leaf_wise(3), features, "all"), (B.Forest(3, 4, 1), features, "all")], local_bytes=0)
    for a, b in zip(whole, parted):
        for s, t in zip(a.trees, b.trees):
            assert all(np.allclose(u, v) for u, v in zip(s, t))
    assert B._pieces(5, 64) == ((5, 3) if piece == 30_000 else (1, 1))


def test_bytes_of_a_slice_are_those_of_its_values():
    for kind in ("binary", "large_binary"):
        column = B.pa.array([b"abc", b"def", b"", b"ghi", b"jkl"], kind)
        for start, n in ((0, 5), (1, 3), (4, 1), (2, 1), (3, 0)):
            assert B._bytes(column.slice(start, n), n).tobytes() == b"".join(column.slice(start, n).to_pylist())
