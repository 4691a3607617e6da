"""Whole analyses as plain functions of DataFrames; each returns named tables.

Nothing is written here. Pass the tables to
:func:`pledgelens.sources.tables.write_report`, or chain further operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import RUSSIAN, LanguagePack
from ..functions.text import clean_model_text
from ..operators import columns as C
from ..operators import compare as K
from ..operators import explain as X
from ..operators import features as E
from ..operators import metrics as M
from ..operators import models as Z
from ..operators import pages as B
from ..operators import terms as W
from ..operators.scaling import scale_on_train


def build_features(
    df: DataFrame, id_col: str, text_col: str, pack: LanguagePack = RUSSIAN, forms: DataFrame | None = None,
    scorer: Callable[[DataFrame], DataFrame] | None = None, n_topics: int | None = 5,
) -> DataFrame:
    """Text features, sentence scores and topic shares; redundant columns dropped."""
    out = E.extract_text_features(df, text_col, pack, forms)
    if scorer is not None:
        out = E.score_sentences(out, id_col, "clean_text", scorer)
    if n_topics:
        with_terms = W.topic_terms(out, "clean_text", pack, "__terms")
        out = W.fit_topics(with_terms, "__terms", n_topics).transform(with_terms).drop("__terms")
        out = E.drop_redundant(out, ("sentiment_neutral", f"topic_{n_topics - 1}"))
    return out


def campaign_table(records: DataFrame, link_words: str = C.LINK_WORDS, categories: DataFrame | None = None) -> DataFrame:
    """Nested page records to the flat campaign table with its derived columns."""
    flat = C.flatten_record(records.where(F.col("status") == "ok"))
    flat = C.array_counts(flat, {
        "image_count": "media_imageUrls", "video_count": "media_videoUrls",
        "reward_count": "rewards_items", "external_link_count": "media_externalLinks"})
    texts = {"title": "card_title", "subtitle": "card_subtitle", "description": "description_text",
             "meta_description": "meta_description"}
    lengths: dict[str, Column] = {}
    for name, col in texts.items():
        lengths[f"{name}_len_chars"] = C.text_len_chars(col)
        lengths[f"{name}_word_count"] = C.text_word_count(col)
    flat = flat.withColumns(lengths).withColumns({
        "description_has_link_word": C.has_link_word("description_text", link_words),
        "funding_ratio": C.funding_ratio("card_collectedAmount_value", "card_targetAmount_value"),
        "campaign_duration_days": C.duration_days(
            F.try_to_timestamp("card_startAt"), F.try_to_timestamp("card_finishAt")),
    }).withColumn("is_successful", C.is_successful("funding_ratio"))
    if categories is not None:
        flat = C.category_grouped(flat, "card_mainCategory_tagName", categories)
    return flat


def pages_to_campaigns(pages: DataFrame, html_col: str = "html", url_col: str = "url",
                       categories: DataFrame | None = None) -> DataFrame:
    """Stored pages straight to the flat campaign table."""
    return campaign_table(B.build_records(pages, html_col, url_col), categories=categories)


def compare_classes(df: DataFrame, y: str = "is_successful", features: list[str] = E.TEXT_FEATURES) -> dict[str, DataFrame]:
    """The test table and its notable rows."""
    table = K.test_table(df, C.present_columns(df, features), y)
    return {"tests": table, "notable": K.notable(table)}


def model_report(
    df: DataFrame, id_col: str, y: str, models: dict | None = None, category: str | None = None
) -> dict[str, DataFrame]:
    """Out-of-fold comparison of feature sets and models, the best row and the forest's contributions."""
    models = models or Z.model_zoo()
    sets = C.feature_sets(df)
    table = Z.compare_models(df, id_col, y, sets, models, category=category).persist()
    features = sets["C (controls + cat + text)"]
    shap, _ = X.tree_shap(Z.fit(df, features, y, models["RandomForest"]), df, id_col)
    return {"models": table, "best": M.best_model(table), "shap_ranking": X.shap_ranking(shap)}


def explain_report(
    df: DataFrame, id_col: str, y: str, features: list[str], category: str | None = None, goal: str | None = None,
    spec: tuple | None = None, repeats: int = 20, top: int = 6, background: int | None = None,
) -> dict[str, DataFrame]:
    """Split, scale, fit and every explanation table of one model."""
    split = C.train_test_split(df, id_col, y).persist()
    train, test = split.where("is_test = 0"), split.where("is_test = 1")
    readable = [c for c in features if "readability" in c]
    train, test, scaler = scale_on_train(train, test, readable)
    features = C.varying_columns(C.to_matrix(split, features), C.present_columns(split, features))
    model = Z.fit(train, features, y, spec or Z.shallow_forest())
    scored = model.predict(test)
    reference = train if background is None else X.background_rows(train, id_col, background)
    shap, _ = X.tree_shap(model, test, id_col, reference)
    shap = shap.persist()
    spark = df.sparkSession
    strongest = [r["feature"] for r in Z.impurity_top(model, spark, top).collect()]
    out = {
        "scaler": scaler.summary(spark),
        "metrics": M.binary_metrics(scored, y),
        "classification_report": M.classification_report(scored, y),
        "permutation_importance": Z.permutation_importance(model, test, id_col, y, repeats),
        "shap_ranking": X.shap_ranking(shap, 2 * top),
        "shap_dependence": X.shap_dependence(shap, test, id_col),
        "local_surrogate": X.local_surrogate(model, train, X.background_rows(test, id_col, 3), id_col),
        "additive": X.additive_report(X.additive_logit(train, features, y), test, id_col, y),
        "learning_curve": Z.learning_curve(split, id_col, y, features, spec or Z.shallow_forest()),
    }
    for feature in strongest:
        out[f"partial_dependence/{feature}"] = Z.partial_dependence(model, train, feature)
    segments = []
    if category is not None:
        segments.append(category)
        out["shap_by_category"] = X.shap_by_category(shap, test, id_col, category)
    if goal is not None:
        filled = scored.withColumn("__goal", F.coalesce(F.col(goal), F.lit(0)))
        scored = C.quantile_codes(filled, "__goal", 4, "goal_quartile")
        segments.append("goal_quartile")
    if "has_video" in scored.columns:
        segments.append("has_video")
    if segments:
        out["segment_errors"] = M.segment_errors(scored, segments, y)
    return out


def word_models(df: DataFrame, id_col: str, text_col: str, y: str, pack: LanguagePack = RUSSIAN,
                max_features: int = 500, c: float = 1.0) -> dict[str, DataFrame]:
    """TF-IDF words, an L1 logit on them and the words' contributions."""
    docs = W.tfidf_terms(df.select(id_col, y, clean_model_text(text_col).alias("__text")), "__text", pack).drop("__text")
    scaled = W.max_abs_scale(W.tfidf(docs, id_col, max_features=max_features)).persist()
    words = sorted(r["term"] for r in scaled.select("term").distinct().collect())
    # At most max_features entries per document.
    packed = scaled.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("term", "scaled"))).alias("__w"))
    rows = docs.select(id_col, y).join(packed, id_col, "left")
    dense = F.transform(F.lit(words), lambda w: F.coalesce(F.try_element_at(F.col("__w"), w), F.lit(0.0)))
    data = C.balanced_weights(rows.select(
        id_col, F.col(y).cast("double").alias("label"), array_to_vector(dense).alias("features")), "label")
    n = docs.count()
    model = LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (c * n), standardization=False,
                               weightCol="weight", maxIter=200).fit(data)
    coef = df.sparkSession.createDataFrame(
        [(w, float(v)) for w, v in zip(words, model.coefficients.toArray())], "term string, coef double")
    sample = X.background_rows(docs.select(id_col), id_col)
    means = scaled.join(F.broadcast(sample), id_col, "left_semi").groupBy("term").agg(
        (F.sum("scaled") / F.lit(float(min(50, n)))).alias("mean"))
    ranking = X.sparse_linear_ranking(scaled, coef, n, means)
    return {"tfidf": scaled, "top_words": X.top_signed(coef), "word_report": X.word_report(ranking),
            "empty": W.empty_text_count(docs)}
