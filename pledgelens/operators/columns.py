"""Derived campaign columns, model-matrix preparation, splits and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions.text import SPACE, as_column
from . import ranks as R
from .lookup import lookup_join

NUMERIC = (t.NumericType,)

CONTROLS_BASE = [
    "log_goal", "campaign_duration_days", "counts_newsCount", "counts_commentsCount",
    "card_author_campaignsAmount", "has_video", "log_text_length",
]
CONTROLS = [*CONTROLS_BASE, "image_count", "external_link_count"]
TEXT_READABILITY = ["readability_avg", "description_word_count"]
TEXT_SENTIMENT = ["sentiment_positive", "sentiment_negative"]
TEXT_LEXICON = [
    "social_score", "gratitude_score", "we_ratio", "i_ratio", "certainty_score", "uncertainty_score",
]
MODEL_TEXT = [
    "social_score", "gratitude_score", "we_ratio", "i_ratio", "certainty_score", "uncertainty_score",
    "money_mentions", "number_density", "has_specific_sum", "readability_avg",
    "sentiment_positive", "sentiment_negative", "sentiment_neutral",
]
TEXT_GROUPS = {
    "H1_social": ["social_score"],
    "H2_gratitude": ["gratitude_score"],
    "H3_we": ["we_ratio", "i_ratio"],
    "H4_certainty": ["certainty_score", "uncertainty_score"],
    "H4.5_numeric": ["money_mentions", "number_density", "has_specific_sum"],
    "H5_readab": ["readability_avg"],
    "H6_sentim": ["sentiment_positive", "sentiment_negative", "sentiment_neutral"],
}


# --------------------------------------------------------------------------
# Schema helpers
# --------------------------------------------------------------------------
def present_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def numeric_columns(df: DataFrame, skip: list[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in skip]


def string_columns(df: DataFrame, skip: list[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, t.StringType) and f.name not in skip]


def flatten_record(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested structs to top-level columns named by their path."""

    def walk(schema: t.StructType, path: tuple[str, ...]):
        for f in schema:
            here = (*path, f.name)
            if isinstance(f.dataType, t.StructType):
                yield from walk(f.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here))

    return df.select(*walk(df.schema, ()))


def nan_to_null(df: DataFrame) -> DataFrame:
    """One kind of missing value: NaN becomes null in every float column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (t.DoubleType, t.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


# --------------------------------------------------------------------------
# Derived columns
# --------------------------------------------------------------------------
def funding_ratio(collected, target) -> Column:
    return F.try_divide(as_column(collected).cast("double"), as_column(target).cast("double"))


def is_successful(ratio) -> Column:
    return (as_column(ratio) >= 1).cast("int")


def duration_days(start, finish) -> Column:
    """Days between two timestamps, fractions kept."""
    seconds = (as_column(finish) - as_column(start)).cast("interval second").cast("decimal(20,6)")
    return seconds.cast("double") / F.lit(86_400.0)


def text_len_chars(col) -> Column:
    return F.length(as_column(col))


def text_word_count(col) -> Column:
    return F.regexp_count(as_column(col), F.lit(f"[^{SPACE}]++"))


#: Default markers of a link or platform mention.
LINK_WORDS = r"(?iu)https?://|www\.|ссылк|vk\.com|t\.me|telegram|youtube|instagram"


def has_link_word(col, pattern: str = LINK_WORDS) -> Column:
    return F.coalesce(as_column(col).rlike(pattern).cast("int"), F.lit(0))


def array_counts(df: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """Sizes of array columns as ``new name -> array column``; null counts zero."""
    return df.withColumns({n: F.coalesce(F.size(c), F.lit(0)) if c in df.columns else F.lit(0)
                           for n, c in arrays.items()})


def category_grouped(df: DataFrame, tag_col: str, mapping: DataFrame, default: str = "Other") -> DataFrame:
    """Coarse category from a ``(tag, category)`` table; unknown tags get ``default``."""
    table = mapping.select(F.col("tag").alias(tag_col), F.col("category").alias("category_grouped"))
    return lookup_join(df, table, [tag_col], "left").withColumn(
        "category_grouped", F.coalesce("category_grouped", F.lit(default)))


def clip_lower(col, lower: float = 0.0) -> Column:
    """Values below ``lower`` raised to it; null stays null."""
    col = as_column(col).cast("double")
    return F.when(col < lower, F.lit(float(lower))).otherwise(col)


def log1p_clip(col, lower: float = 0.0) -> Column:
    """``log1p`` of the clipped value; null stays null."""
    return F.log1p(clip_lower(col, lower))


def log1p_filled(col) -> Column:
    """``log1p`` with null taken as zero."""
    return F.log1p(F.coalesce(as_column(col).cast("double"), F.lit(0.0)))


def flag_positive(col) -> Column:
    return (F.coalesce(as_column(col), F.lit(0)) > 0).cast("int")


def prepare_campaigns(
    df: DataFrame, goal: str = "card_targetAmount_value", length: str = "description_len_chars",
    videos: str = "video_count", ratio: str | None = "funding_ratio", log_target: bool = False,
) -> DataFrame:
    """``log_goal, log_text_length, has_video`` and, given a ratio, ``funding_pct``."""
    out = df.withColumns({
        "log_goal": log1p_clip(goal), "log_text_length": log1p_filled(length), "has_video": flag_positive(videos)})
    if ratio is not None and ratio in df.columns:
        out = out.withColumn("funding_pct", clip_lower(ratio))
        if log_target:
            out = out.withColumn("log_funding_pct", F.log1p("funding_pct"))
    return out


# --------------------------------------------------------------------------
# Model matrix
# --------------------------------------------------------------------------
def categories(df: DataFrame, col: str, limit: int = 1000) -> list[str]:
    """Sorted distinct non-null values of a low-cardinality column."""
    rows = df.select(F.col(col).cast("string").alias("v")).where("v is not null").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} categories; group them first")
    return sorted(r.v for r in rows)


def one_hot(
    df: DataFrame, col: str, prefix: str = "cat", drop_first: bool = True,
    baseline: str | None = None, values: list[str] | None = None,
) -> DataFrame:
    """0/1 columns ``prefix_value``; the first or the baseline category is left out.

    Pass ``values`` found on the training rows to keep the test rows out of the fit.
    """
    values = categories(df, col) if values is None else values
    left_out = baseline if baseline is not None else (values[0] if drop_first and values else None)
    return df.withColumns({
        f"{prefix}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values if v != left_out})


def to_matrix(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """Numeric coercion of the features that exist: bad values and null become 0."""

    def number(c: str) -> Column:
        value = F.col(c).try_cast("double")
        return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0)).alias(c)

    return df.select(*keep, *[number(c) for c in present_columns(df, features)])


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at least two distinct non-null values, found in one pass."""
    if not columns:
        return []
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def drop_constant(df: DataFrame, columns: list[str]) -> DataFrame:
    keep = set(varying_columns(df, columns))
    return df.drop(*[c for c in columns if c not in keep])


def add_intercept(df: DataFrame, name: str = "const") -> DataFrame:
    return df.withColumn(name, F.lit(1.0))


def design_matrix(df: DataFrame, features: list[str], keep: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """Matrix of the varying features with a constant, and the column order."""
    matrix = to_matrix(df, features, keep)
    names = varying_columns(matrix, present_columns(df, features))
    return add_intercept(matrix.select(*keep, *names)), ["const", *names]


def feature_sets(df: DataFrame, cat_prefix: str = "cat_") -> dict[str, list[str]]:
    """The three comparison sets: controls with categories, text only, all."""
    cats = [c for c in df.columns if c.startswith(cat_prefix)]
    controls, text = present_columns(df, CONTROLS), present_columns(df, MODEL_TEXT)
    return {
        "A (controls + cat)": controls + cats,
        "B (text only)": text,
        "C (controls + cat + text)": controls + cats + text,
    }


def staged_features(df: DataFrame, cat_prefix: str = "cat_") -> dict[str, list[str]]:
    """The nested regression specifications from controls only to everything."""
    base = CONTROLS_BASE + [c for c in df.columns if c.startswith(cat_prefix)]
    specs = {
        "M0 (controls)": base,
        "M1 (+readability)": base + TEXT_READABILITY,
        "M2 (+sentiment)": base + TEXT_SENTIMENT,
        "M3 (+lexicons)": base + TEXT_LEXICON,
        "M_full": base + TEXT_READABILITY + TEXT_SENTIMENT + TEXT_LEXICON,
    }
    return {name: present_columns(df, cols) for name, cols in specs.items()}


# --------------------------------------------------------------------------
# Splits, folds, weights, quantile codes
# --------------------------------------------------------------------------
#: Most classes or groups that a per-class operator accepts.
MAX_CLASSES = 100


def class_sizes(df: DataFrame, by: str | list[str], limit: int = MAX_CLASSES) -> dict:
    """Rows per class on the driver; more than ``limit`` classes are refused."""
    by = [by] if isinstance(by, str) else list(by)
    rows = df.groupBy(*by).count().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{by} has more than {limit} groups")
    return {(r[0] if len(by) == 1 else tuple(r[:-1])): r["count"] for r in rows}


def train_test_split(df: DataFrame, id_col: str, y: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: an exact, stratified share in hash order of the id.

    The test size is the ceiling of the share; classes get their floor quota
    and the largest remainders the rest. Without two rows per class and two
    test rows the split is not stratified.
    """
    sizes = class_sizes(df, y)
    n = sum(sizes.values())
    n_test = -int(-n * share // 1)
    stratify = bool(sizes) and min(sizes.values()) >= 2 and n * share >= 2
    groups = sizes if stratify else {None: n}
    exact = {c: n_test * k / n for c, k in groups.items()}
    quota = {c: int(e) for c, e in exact.items()}
    order = sorted(groups, key=lambda c: (quota[c] - exact[c], str(c)))
    for c in order[: n_test - sum(quota.values())]:
        quota[c] += 1
    if not stratify:
        numbered = R.shuffled_row_number(df.withColumn("__all", F.lit(1)), id_col, ["__all"], seed, "__rn")
        return numbered.withColumn("is_test", (F.col("__rn") <= n_test).cast("int")).drop("__rn", "__all")
    limit = F.lit(0)
    for c, q in quota.items():
        limit = F.when(F.col(y).eqNullSafe(F.lit(c)), F.lit(q)).otherwise(limit)
    numbered = R.shuffled_row_number(df, id_col, [y], seed, "__rn")
    return numbered.withColumn("is_test", (F.col("__rn") <= limit).cast("int")).drop("__rn")


def fold_assign(
    df: DataFrame, id_col: str, y: str, k: int = 5, seed: int = 42, scheme: str = "stratified"
) -> DataFrame:
    """Add ``fold``: ``stratified`` shuffled folds, or ``leave_one_out`` with a fold per row."""
    if scheme not in ("stratified", "leave_one_out"):
        raise ValueError(f"unknown scheme {scheme}")
    if scheme == "leave_one_out":
        numbered = R.shuffled_row_number(df.withColumn("__all", F.lit(1)), id_col, ["__all"], seed, "__rn")
        return numbered.withColumn("fold", (F.col("__rn") - 1).cast("int")).drop("__rn", "__all")
    numbered = R.shuffled_row_number(df, id_col, [y], seed, "__rn")
    return numbered.withColumn("fold", F.pmod(F.col("__rn") - 1, F.lit(k)).cast("int")).drop("__rn")


def balanced_weights(df: DataFrame, y: str, name: str = "weight") -> DataFrame:
    """Add weights that give every class the same total: n / (classes * class size)."""
    sizes = class_sizes(df, y)
    n, weight = sum(sizes.values()), F.lit(None).cast("double")
    for value, size in sizes.items():
        weight = F.when(F.col(y).eqNullSafe(F.lit(value)), F.lit(n / (len(sizes) * size))).otherwise(weight)
    return df.withColumn(name, weight)


def quantile_codes(df: DataFrame, col: str, q: int = 4, name: str | None = None) -> DataFrame:
    """Quantile bin codes with right-closed, interpolated, de-duplicated edges.

    The edges come from exact order statistics and are ``q - 1`` numbers.
    """
    name = name or f"{col}_bin"
    long = R.melt_numeric(df, [col])
    cum = R.cumulate(long, ["feature"], max_rows=df.count())
    first = cum.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("d")).first()
    q = min(q, first["d"] or 0)
    if q < 1:
        return df.withColumn(name, F.lit(None).cast("int"))
    probs = {f"q{i}": i / q for i in range(1, q)}
    inner = list(R.quantiles(cum, ["feature"], probs).first().asDict().values())[1:] if probs else []
    edges = sorted({first["lo"], first["hi"], *inner})
    value = F.col(col).cast("double")
    code = sum(((value > e).cast("int") for e in edges[1:-1]), F.lit(0))
    return df.withColumn(name, F.when(value.isNotNull() & ~F.isnan(value), code))
