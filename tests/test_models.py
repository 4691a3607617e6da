import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pledgelens.functions.lexicons import WESTERN
from pledgelens.operators import columns as C
from pledgelens.operators import explain as X
from pledgelens.operators import metrics as M
from pledgelens.operators import models as Z
from pledgelens.operators import regress as J
from pledgelens.operators import terms as W
from pledgelens.operators import topics as T
from pledgelens.operators.scaling import Scaler
from pledgelens.streaming import score as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3))
    eta = 0.3 + 1.2 * x[:, 0] - 0.8 * x[:, 1]
    y = (rng.random(400) < 1 / (1 + np.exp(-eta))).astype(int)
    amount = np.maximum(0.5 + x[:, 0] + 0.7 * rng.normal(size=400), 0.0)
    rows = [(i, float(a), float(b), float(c), int(t), float(m)) for i, ((a, b, c), t, m) in enumerate(zip(x, y, amount))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int, amount double").persist()
    return df, x, y, amount


def test_ols_against_numpy(spark, data):
    df, x, _, amount = data
    m, names = C.design_matrix(df, ["a", "b", "c", "gone"], ["amount"])
    fit = J.ols(m, names, "amount")
    z = np.column_stack([np.ones(400), x])
    beta = np.linalg.lstsq(z, amount, rcond=None)[0]
    e = amount - z @ beta
    bread = np.linalg.inv(z.T @ z)
    cov = bread @ (z * (e ** 2)[:, None]).T @ z @ bread * 400 / 396
    assert names == ["const", "a", "b", "c"]
    assert fit.beta == pytest.approx(beta) and fit.cov == pytest.approx(cov)
    assert fit.stats["r2"] == pytest.approx(1 - e @ e / ((amount - amount.mean()) ** 2).sum())
    vifs = {r.feature: r.VIF for r in J.vif(m, names).collect()}
    for i, c in enumerate("abc"):
        others = np.delete(x, i, axis=1)
        res = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        assert vifs[c] == pytest.approx((x[:, i] @ x[:, i]) / (res @ res))
    assert J.ols(m.limit(3), names, "amount").skipped


def test_logit_solves_the_score_equations(spark, data):
    df, x, y, _ = data
    m, names = C.design_matrix(df, ["a", "b", "c"], ["y"])
    fit = J.logit(m, names, "y")
    z = np.column_stack([np.ones(400), x])
    p = 1 / (1 + np.exp(-z @ fit.beta))
    assert fit.converged and np.max(np.abs(z.T @ (y - p))) < 1e-6
    assert fit.stats["llf"] == pytest.approx(np.sum(y * np.log(p) + (1 - y) * np.log(1 - p)))
    odds = {r.feature: r.OR for r in J.odds_ratios(fit.coefficients(spark)).collect()}
    assert odds["a"] == pytest.approx(math.exp(fit.beta[1]), abs=1e-4)


def test_log_cdf_is_accurate():
    u = np.array([-30.0, -8.0, -4.3, -4.2, -1.0, 0.0, 2.0, 8.0])
    want = [math.log(0.5 * math.erfc(-v / math.sqrt(2))) if v > -30 else -454.3212439955959 for v in u]
    assert J._log_normal_cdf(u) == pytest.approx(want, rel=1e-9)


def test_tobit_is_a_maximum(spark, data):
    df, x, _, amount = data
    m, names = C.design_matrix(df, ["a", "b"], ["amount"])
    fit = J.tobit(m, names, "amount")
    z = np.column_stack([np.ones(400), x[:, :2]])

    def ll(beta, sigma):
        u = (amount - z @ beta) / sigma
        cut = amount <= 0
        return sum(math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in u[cut]) + np.sum(
            -0.5 * u[~cut] ** 2 - 0.5 * math.log(2 * math.pi) - math.log(sigma))

    best = ll(fit.beta, fit.stats["sigma"])
    assert fit.converged and fit.stats["llf"] == pytest.approx(best)
    assert fit.stats["n_censored"] == (amount <= 0).sum()
    for step in itertools.product((-0.02, 0, 0.02), repeat=3):
        for s in (-0.01, 0, 0.01):
            assert ll(fit.beta + np.array(step), fit.stats["sigma"] + s) <= best + 1e-9
    assert fit.beta == pytest.approx([0.5, 1.0, 0.0], abs=0.2)


def test_staged_specifications_share_their_passes(spark, data, monkeypatch):
    """All fits of all specifications take one pass at a time together; a weight without a maximum ends with the gains."""
    from pledgelens.operators import gram as G

    df, _, _, amount = data
    passes, plain = [], G.summed
    monkeypatch.setattr(G, "summed", lambda *a: passes.append(1) or plain(*a))
    rows = df.withColumn("some", (F.col("amount") > 0).cast("int"))
    specs = {"M0": ["a"], "M1": ["b"], "M_full": ["a", "b", "some"]}
    out = {r.label: r for r in J.staged_specs(rows, "id", "y", "amount", "tobit", specs=specs, with_lasso=False)["tobit"].collect()}
    assert len(passes) < 45 and all(r.converged for r in out.values())
    for name, features in list(specs.items())[:2]:
        m, names = C.design_matrix(df, features, ["amount"])
        assert out[name].llf == pytest.approx(J.tobit(m, names, "amount").stats["llf"], rel=1e-12)
    assert out["M_full"].n_censored == (amount <= 0).sum()


def test_staged_and_lasso(spark, data):
    df, *_ = data
    out = J.staged_specs(df, "id", "y", "amount", specs={"M0": ["a"], "M_full": ["a", "b", "c"]}, with_lasso=False)
    assert [r.n_params for r in out["logit"].collect()] == [2, 4] and out["vif"].count() == 3
    best, coefs = J.lasso_logit_cv(df, ["a", "b", "c"], "y", "id", n_c=3)
    assert best is not None and coefs.first().feature == "a"


def test_metrics_goldens(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.05)]
    df = spark.createDataFrame(rows, "y int, probability double")
    r = M.binary_metrics(df).first()
    pairs = [(a > b) + 0.5 * (a == b) for t, a in rows if t for s, b in rows if not s]
    assert r.ROC_AUC == pytest.approx(np.mean(pairs))
    # steps: 1/1 at 0.9, 2/3 at 0.8, 3/5 at 0.05
    assert r.PR_AUC == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    single = M.binary_metrics(spark.createDataFrame([(1, 0.2)], "y int, probability double")).first()
    assert single.ROC_AUC is None and single.F1 == 0.0
    # 9 / 3 / 4 / 4: the published report of a 12 / 8 test part
    cells = [(0, 0.1)] * 9 + [(0, 0.9)] * 3 + [(1, 0.1)] * 4 + [(1, 0.9)] * 4
    report = {r["class"]: r for r in M.classification_report(spark.createDataFrame(cells, "y int, probability double")).collect()}
    assert [round(report["0"][m], 2) for m in ("precision", "recall", "f1")] == [0.69, 0.75, 0.72]
    assert [round(report["1"][m], 2) for m in ("precision", "recall", "f1")] == [0.57, 0.5, 0.53]
    assert [round(report["macro avg"][m], 2) for m in ("precision", "recall", "f1")] == [0.63, 0.62, 0.63]
    assert round(report["accuracy"].f1, 2) == 0.65 and report["weighted avg"].support == 20


@pytest.fixture(scope="module")
def forest(spark, data):
    df, *_ = data
    return Z.fit(df, ["a", "b", "c"], "y", Z.shallow_forest(trees=4, depth=3))


def test_oof_and_importance(spark, data, forest):
    df, *_ = data
    oof = Z.oof_predict(df, "id", "y", ["a", "b", "c"], Z.model_zoo()["LogReg_L1"], k=3).persist()
    assert oof.count() == 400 and oof.select("id").distinct().count() == 400
    assert M.ranking_metrics(oof, "y", "probability").first().ROC_AUC > 0.7
    imp = {r.feature: r.importance_mean for r in Z.permutation_importance(forest, df, "id", "y", repeats=3).collect()}
    assert max(imp, key=imp.get) == "a" and imp["a"] > 0.05
    ice = Z.ice_curves(forest, df, "id", "a", [-1.0, 0.0, 1.0])
    pd_ = {r.grid: r.mean_probability for r in Z.partial_dependence(forest, df, "a", [-1.0, 0.0, 1.0]).collect()}
    for r in ice.groupBy("grid").agg(F.avg("probability").alias("m")).collect():
        assert pd_[r.grid] == pytest.approx(r.m)
    assert len(Z.response_grid(df, "a")) == 100


def _brute(leaves, x, weigh):
    """Shapley values by all subsets; ``weigh(leaf, known)`` is a leaf's share given known features."""
    k = len(x)

    def value(known):
        return sum(leaf.value * weigh(leaf, known) for leaf in leaves)

    out = np.zeros(k)
    for j in range(k):
        rest = [f for f in range(k) if f != j]
        for size in range(k):
            for known in itertools.combinations(rest, size):
                w = math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k)
                out[j] += w * (value(set(known) | {j}) - value(set(known)))
    return out


@pytest.mark.parametrize("kind", ["forest", "boost"])
def test_tree_shap_against_all_subsets(spark, data, forest, kind):
    df, x, *_ = data
    model = forest if kind == "forest" else Z.fit(df, ["a", "b", "c"], "y", Z.slow_boost(rounds=3, depth=3, rate=0.3))
    leaves, base = X.tree_leaves(model, spark)
    rows = df.where("id < 6")
    shap, got_base = X.tree_shap(model, rows, "id")
    table = {(r.id, r.feature): r.shap for r in shap.collect()}
    reference = df.where("id >= 390")
    ishap, ibase = X.tree_shap(model, rows, "id", reference)
    itable = {(r.id, r.feature): r.shap for r in ishap.collect()}
    proba = {r.id: r.probability for r in model.predict(rows).collect()}
    for i in range(6):
        def on_path(leaf, known, i=i):
            out = 1.0
            for f, lo, hi, cover in zip(leaf.features, leaf.low, leaf.high, leaf.cover):
                out *= float(lo < x[i, f] <= hi) if f in known else cover
            return out

        def mixed(leaf, known, i=i):
            hits = [all(lo < (x[i, f] if f in known else x[b, f]) <= hi
                        for f, lo, hi in zip(leaf.features, leaf.low, leaf.high)) for b in range(390, 400)]
            return np.mean(hits)

        want, iwant = _brute(leaves, x[i], on_path), _brute(leaves, x[i], mixed)
        output = proba[i] if kind == "forest" else math.log(proba[i] / (1 - proba[i]))
        for j, f in enumerate("abc"):
            assert table[i, f] == pytest.approx(want[j], abs=1e-9)
            assert itable[i, f] == pytest.approx(iwant[j], abs=1e-9)
        assert got_base + sum(table[i, f] for f in "abc") == pytest.approx(output, abs=1e-8)
        assert ibase + sum(itable[i, f] for f in "abc") == pytest.approx(output, abs=1e-8)


def test_surrogate_and_additive(spark, data, forest):
    df, *_ = data
    out = X.local_surrogate(forest, df, df.where("id < 2"), "id", n_features=2).collect()
    assert len(out) == 4 and any(r.condition.startswith("a") or " a " in r.condition for r in out)
    model = X.additive_logit(df, ["a", "b"], "y", n_splines=6)
    report = X.additive_report(model, df, "id", "y").first()
    assert report.ROC_AUC > 0.75 and 0 < report.mcfadden_r2 < 1
    effects = [r for r in model.partial_effects(spark, 20).collect() if r.feature == "a"]
    assert effects[-1].effect > effects[0].effect and all(r.lo <= r.effect <= r.hi for r in effects)
    basis = X._spline_basis(np.linspace(0, 1, 50), 0.0, 1.0, 6)
    assert basis.sum(axis=1) == pytest.approx(np.ones(50)) and basis.shape == (50, 6)


def test_learning_curve(spark, data):
    df, *_ = data
    out = Z.learning_curve(df, "id", "y", ["a", "b"], Z.shallow_forest(trees=3, depth=3), sizes=[0.3, 1.0]).collect()
    assert [r.share for r in out] == [0.3, 1.0] and all(0 <= r.validation_mean <= 1 for r in out)


DOCS = ["the cat sat", "cat dog dog bird", "bird bird cat", "", "dog cat"]


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(i, d.split()) for i, d in enumerate(DOCS)], "id int, terms array<string>")
    got = {(r.id, r.term): r.weight for r in W.tfidf(df, "id", max_features=3, min_df=2).collect()}
    # In two documents and more: cat, dog, bird; by total count: cat 4, then bird 3 and dog 3
    n, dfreq = 5, {"cat": 4, "dog": 2, "bird": 2}
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in dfreq.items()}
    raw = {"cat": idf["cat"], "dog": (1 + math.log(2)) * idf["dog"], "bird": idf["bird"]}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    for t, v in raw.items():
        assert got[1, t] == pytest.approx(v / norm)
    assert {t for _, t in got} == {"cat", "dog", "bird"}


def test_ngrams_and_vocabulary(spark):
    df = spark.createDataFrame([(1, ["ab", "x", "cd", "ef"]), (2, [])], "id int, terms array<string>")
    got = {r.id: r.g for r in df.select("id", W.ngrams("terms").alias("g")).collect()}
    assert got == {1: ["ab", "cd", "ef", "ab cd", "cd ef"], 2: []}
    bags = spark.createDataFrame([(i, "all", 1) for i in range(40)] + [(1, "rare", 1), (1, "ok", 1), (2, "ok", 2)],
                                 "id int, term string, tf long")
    assert {r.term for r in W.vocabulary(bags, 40).collect()} == {"ok"}
    assert W.vocabulary(bags, 40, no_below=1, no_above=1.0).count() == 3
    counted = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, []), (3, ["a"]), (4, None)], "id int, terms array<string>")
    assert sorted(tuple(r) for r in W.term_rows(counted, "id").collect()) == [(1, "a", 1), (1, "b", 3), (3, "a", 1)]


def test_topics(spark):
    docs = [(i, (["sun", "sea", "sand"] if i % 2 else ["code", "bug", "test"]) * 5) for i in range(40)] + [(99, [])]
    df = spark.createDataFrame(docs, "id int, terms array<string>")
    model = W.TopicTransformer(k=2, passes=20).fit(df)
    rows = model.transform(df).collect()
    for r in rows:
        assert r.lda_topic_0 + r.lda_topic_1 == pytest.approx(1)
    assert {r.id: r.lda_topic_0 for r in rows}[99] == 0.5
    assert model.top_terms(3).count() == 6
    with pytest.raises(RuntimeError):
        W.TopicTransformer().transform(df)


def topic_corpus(spark):
    """60 documents of two kinds with 400 terms, an empty one, one with unknown terms and one without a list."""
    kinds = [[f"{kind}{i}" for i in range(200)] for kind in "ab"]
    docs = [(i, [kinds[i % 2][(i * 7 + j * j) % 200] for j in range(30 + i)]) for i in range(60)]
    return spark.createDataFrame([*docs, (97, ["new", "newer"]), (98, []), (99, None)], "id int, terms array<string>")


def test_topics_hold_bounded_values_on_the_driver(spark, monkeypatch):
    df = topic_corpus(spark)
    fitted = {}
    for values in (T.FREQUENT_VALUES, 60):
        monkeypatch.setattr(T, "FREQUENT_VALUES", values)
        model = W.TopicTransformer(k=2, passes=2, no_above=1.0).fit(df)
        assert model.model.hot.size <= max(values, 2) and model.vocabulary().count() > 200
        shares = {r.id: (r.lda_topic_0, r.lda_topic_1) for r in model.transform(df).collect()}
        fitted[values] = shares, [tuple(r) for r in model.top_terms(5).orderBy("topic", "rank").collect()]
    (whole, tops), *others = fitted.values()
    assert len(whole) == 63 and whole[97] == whole[98] == whole[99] == (0.5, 0.5) and len({round(a, 3) for a, _ in whole.values()}) > 2
    for shares, own in others:
        assert all(shares[i] == pytest.approx(whole[i], abs=1e-6) for i in whole)
        assert [r[:3] for r in own] == [r[:3] for r in tops]
        assert [r[3] for r in own] == pytest.approx([r[3] for r in tops])


def test_topic_counts_share_draws_and_terms(spark, monkeypatch):
    monkeypatch.setattr(T, "FREQUENT_VALUES", 100)
    df = topic_corpus(spark)
    model = W.TopicTransformer(passes=1).fit_many(df, [2, 3])
    assert model.hot.shape == (20, 5) and model.cold.count() + 20 == model.vocabulary.count()
    assert [model.top_terms(place, 4).count() for place in (0, 1)] == [8, 12]
    best, tried = W.select_k_by_coherence(df, "id", ks=range(2, 4), n_top=4, passes=1)
    assert [r.k for r in tried.collect()] == [2, 3] and best in (2, 3)
    assert all(r.coherence <= 0.7 for r in tried.collect())


def test_inference_is_the_plain_loop():
    draw = np.random.default_rng(3)
    lengths, alpha = np.array([1, 40, 7, 300]), np.array([0.2, 0.3, 0.5])
    beta = np.exp(draw.normal(-6, 1.5, (lengths.sum(), 3)))
    weights = lambda g: np.exp(T.digamma(g) - T.digamma(g.sum()))
    for part, got in zip(np.split(beta, np.cumsum(lengths)[:-1]), T.infer(beta.T.copy(), lengths, alpha)):
        gamma, last = np.ones(3), np.full(3, np.inf)
        while np.abs(gamma - last).mean() > 1e-3:
            last, theta = gamma, weights(gamma)
            gamma = theta * (part / (part @ theta + 1e-100)[:, None]).sum(0) + alpha
        assert got == pytest.approx(gamma)
    assert T.digamma(np.array([1.0, 0.5])) == pytest.approx([-0.5772156649, -1.9635100260])
    assert T.trigamma(np.array([1.0, 0.5])) == pytest.approx([np.pi**2 / 6, np.pi**2 / 2])


def test_sparse_ranking_equals_dense(spark):
    dense = {0: {"u": 1.0, "v": 0.0}, 1: {"u": 0.0, "v": 0.5}, 2: {"u": 0.2, "v": 0.0}}
    coef = {"u": 2.0, "v": -1.0}
    weights = spark.createDataFrame([(d, t, w) for d, ws in dense.items() for t, w in ws.items() if w], "id int, term string, scaled double")
    got = {r.term: r for r in X.sparse_linear_ranking(
        weights, spark.createDataFrame(list(coef.items()), "term string, coef double"), 3).collect()}
    for t in coef:
        col = np.array([dense[d][t] for d in dense])
        s = coef[t] * (col - col.mean())
        assert got[t].shap_mean_abs == pytest.approx(np.abs(s).mean()) and got[t].shap_mean == pytest.approx(0, abs=1e-12)


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"We thank you. It is {i} usd, and they go with us!" * (i % 4 + 1)) for i in range(30)],
                                 "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    scaler = Scaler().fit(S.score_documents(docs, "text", Scaler(fitted=True), WESTERN))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.score_stream(stream, "text", scaler, str(tmp_path / "out"), str(tmp_path / "ck"), WESTERN, True).awaitTermination()
    want = S.score_documents(docs, "text", scaler, WESTERN)
    got = spark.read.parquet(str(tmp_path / "out")).select(want.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == 30


def test_lasso_paths_meet_the_conditions_of_the_minimum(spark, data):
    """Every weight's gradient balances the penalty, or stays below it where the weight is 0."""
    df, x, y, _ = data
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    fold = np.arange(400) % 3
    rows = spark.createDataFrame([(*map(float, r), float(t), int(f)) for r, t, f in zip(z, y, fold)], "a double, b double, c double, y double, fold int")
    cells = [(p, f) for p in (1e4, 60.0, 5.0, 1e-3) for f in (0, 2, None)]
    weights = J.lasso_logit_paths(rows, ["a", "b", "c"], "y", cells)
    design = np.column_stack([np.ones(400), z])
    for (penalty, left), w in zip(cells, weights):
        inside = fold != (-1 if left is None else left)
        gradient = design[inside].T @ (1 / (1 + np.exp(-design[inside] @ w)) - y[inside])
        assert gradient[0] == pytest.approx(0, abs=1e-4)
        for g, v in zip(gradient[1:], w[1:]):
            assert g == pytest.approx(-math.copysign(penalty, v), abs=1e-3) if v else abs(g) <= penalty + 1e-3
    assert not weights[0, 1:].any() and weights[-1, 1:].all()


def test_l1_direction_is_the_minimum_for_features_that_add_up_to_each_other():
    """The fourth feature is the mean of the first two, as averaged scores are; steps by coordinates never got there."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    x = np.column_stack([np.ones(500), x, (x[:, 0] + x[:, 1]) / 2])
    hessian, gradient = x.T @ x, x.T @ rng.normal(size=500) * 10
    for penalty in (1e-4, 1.0, 50.0, 1e5):
        costs = np.array([0.0, *[penalty] * 4])
        w = np.array([0.1, 0.5, 0.0, -0.2, 0.3])
        v = w + J._l1_direction(w, gradient, hessian, costs)
        slope = gradient + hessian @ (v - w)
        scale = np.abs(gradient).max()
        for s, value, cost in zip(slope, v, costs):
            assert s == pytest.approx(-math.copysign(cost, value), abs=1e-6 * scale) if value else abs(s) <= cost + 1e-6 * scale


def test_lasso_keeps_the_features_that_matter(spark, data):
    df, *_ = data
    best, kept = J.lasso_logit_cv(df, ["a", "b", "c"], "y", "id")
    assert best > 1e-3 and [r.feature for r in kept.collect()][:2] == ["a", "b"]
    assert J.lasso_logit_cv(df.where("y = 1"), ["a"], "y", "id")[0] is None


def test_terms_are_made_once(spark):
    """TF-IDF, its scaling and the ranking of words make each document's terms once; missing terms are no terms."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def terms(text):
        made.add(1)
        return [None if w == "-" else w for w in text.split()]

    docs = spark.createDataFrame([(i, "aa bb - cc " * (i % 3 + 1)) for i in range(40)], "doc_id long, text string")
    scaled = W.max_abs_scale(W.tfidf(docs.select("doc_id", terms.asNondeterministic()("text").alias("terms")), "doc_id", longest=1))
    assert scaled.count() == 120 and made.value == 40
    coef = scaled.select("term").distinct().select("term", F.lit(1.0).alias("coef"))
    assert X.top_signed(X.sparse_linear_ranking(scaled, coef, 40).select("term", "coef"), 2).count() == 4 and made.value == 40
    bags = W.term_rows(spark.createDataFrame([(1, ["b", None, "a", "b", None]), (2, []), (3, [None])], "doc_id long, terms array<string>"), "doc_id")
    assert sorted(map(tuple, bags.collect())) == [(1, "a", 1), (1, "b", 2)]


def test_word_report_fits_both_models(spark):
    """Coefficients meet the conditions of the L1 minimum; trees and logit both find the word that tells the classes."""
    docs = [(i, ["good"] * (i % 2) + ["plain"] * (1 + i % 3) + ["other"] * (i % 5 == 0)) for i in range(120)]
    df = spark.createDataFrame([(i, t, int((i % 2 == 1) ^ (i % 11 == 0))) for i, t in docs], "doc_id long, terms array<string>, y int")
    weights = W.max_abs_scale(W.tfidf(df.select("doc_id", "terms"), "doc_id", longest=1))
    linear, boosted = X.word_rankings(weights, df.select("doc_id", "y"), "doc_id", "y", rounds=20)
    report = {r.word: r for r in X.word_report(linear, boosted).collect()}
    assert set(report) == {"good", "plain", "other"} and all(v is not None for r in report.values() for v in r)
    assert report["good"].logreg_coef > 1 and max(report.values(), key=lambda r: r.shap_boost_mean_abs).word == "good"
    x, y = np.zeros((120, 3)), np.array([r.y for r in df.orderBy("doc_id").collect()])
    terms = sorted(report)
    for r in weights.collect():
        x[r.doc_id, terms.index(r.term)] = r.scaled
    w = np.array([report[t].logreg_coef for t in terms])
    each = np.where(y == 1, 60 / y.sum(), 60 / (120 - y.sum()))
    # The free constant: where its gradient is 0.
    low, high = -50.0, 50.0
    for _ in range(200):
        b = (low + high) / 2
        low, high = (low, b) if (each * (1 / (1 + np.exp(-b - x @ w)) - y)).sum() > 0 else (b, high)
    gradient = x.T @ (each * (1 / (1 + np.exp(-b - x @ w)) - y))
    for g, v in zip(gradient, w):
        assert g == pytest.approx(-math.copysign(1.0, v), abs=1e-3) if v else abs(g) <= 1.001
