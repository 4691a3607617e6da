from pyspark.sql import functions as F

from pledgelens.functions.lexicons import WESTERN
from pledgelens.operators import models as Z
from pledgelens.operators.features import lexicon_scorer
from pledgelens.plans import workflows as P
from tests.test_pages import state_page


def test_feature_build_and_words(spark):
    rows = [(i, "We thank you for the good boat and sail. " * (1 + i % 3) + ("storm wind " if i % 2 else "calm sea ") * 3, i % 2)
            for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, y int")
    out = P.build_features(df, "id", "text", WESTERN, scorer=lexicon_scorer(["good"], ["bad"], WESTERN), n_topics=2)
    assert {"topic_0", "sentiment_positive", "readability_avg"} <= set(out.columns)
    assert not {"topic_1", "sentiment_neutral"} & set(out.columns) and out.count() == 40
    words = P.word_models(df, "id", "text", "y", WESTERN)
    top = [r.term for r in words["top_words"].collect()]
    assert "storm" in " ".join(top) and words["empty"].first().n_empty == 0
    assert P.compare_classes(out, "y")["tests"].count() > 10


def test_pages_to_campaigns(spark):
    pages = spark.createDataFrame([("https://p.x/1", state_page()), ("https://p.x/2", "<p>no</p>")], "url string, html string")
    r = P.pages_to_campaigns(pages).first()
    assert r.funding_ratio == 5 / 10.5 and r.is_successful == 0 and r.image_count == 4 and r.description_word_count == 3


def test_explain_report(spark):
    df = spark.range(240).select(
        "id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + F.rand(1)).alias("log_goal"),
        F.rand(2).alias("readability_avg"), (F.col("id") % 3).cast("string").alias("kind"),
        (F.col("id") * 10.0).alias("goal"), F.lit(1).alias("constant"))
    spec = Z.shallow_forest(trees=3, depth=3)
    out = P.explain_report(df, "id", "y", ["log_goal", "readability_avg", "constant"], "kind", "goal", spec, repeats=2,
                           top=2, background=10)
    assert out["metrics"].first().ROC_AUC > 0.9
    assert out["permutation_importance"].first().feature == "log_goal"
    assert out["segment_errors"].where("segment = 'goal_quartile'").count() == 4
    assert out["shap_by_category"].count() == 3
