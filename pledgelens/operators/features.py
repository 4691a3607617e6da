"""Per-document text features.

One pass over the text: clean, tokenize, then every feature from the shared
token array or from a regex count. No shuffle, no Python in the hot path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import RUSSIAN, LanguagePack, lexicon_table
from .lookup import BROADCAST_ROWS, lookup_join

COVERAGE_SCORES = ["social_score", "gratitude_score", "certainty_score", "uncertainty_score"]

TEXT_FEATURES = [
    "social_score", "gratitude_score", "has_gratitude",
    "we_count", "i_count", "we_ratio", "i_ratio", "we_vs_i",
    "certainty_score", "uncertainty_score",
    "money_mentions", "number_density", "has_specific_sum",
    "readability_flesch", "readability_fog", "readability_lix", "readability_avg",
]


# --------------------------------------------------------------------------
# Lemmas
# --------------------------------------------------------------------------
def lemmatize(df: DataFrame, id_col: str, tokens_col: str, forms: DataFrame | None) -> DataFrame:
    """Add ``lemmas``, one per token in token order, to a table with unique ids."""
    if forms is None:
        return df.withColumn("lemmas", F.transform(tokens_col, F.lower))
    # Only the distinct forms that have an entry leave their document; the rest is mapped inside the row.
    distinct = df.select(id_col, F.explode(F.array_distinct(F.transform(tokens_col, F.lower))).alias("form"))
    known = lookup_join(distinct, forms.select("form", "lemma"), ["form"], "inner")
    maps = known.groupBy(id_col).agg(F.map_from_entries(F.collect_set(F.struct("form", "lemma"))).alias("__forms"))

    def lemma(token: Column) -> Column:
        form = F.lower(token)
        return F.coalesce(F.col("__forms")[form], form)

    lemmas = F.coalesce(F.transform(tokens_col, lemma), F.array().cast("array<string>"))
    return df.join(maps, id_col, "left").withColumn("lemmas", lemmas).drop("__forms")


def forms_reaching(terms: Iterable[str], forms: DataFrame | None) -> list[str]:
    """Lower-case word forms whose lemma lies in ``terms``.

    Testing a token against these forms equals lemmatizing it and testing the
    lemma, so lexicon features need no per-token join. The list is bounded by
    the forms of the lexicon's own terms.
    """
    terms = sorted(set(terms))
    if forms is None:
        return terms
    hits = forms.where(F.col("lemma").isin(terms)).select("form")
    remapped = forms.where(F.col("form").isin(terms) & ~F.col("lemma").isin(terms)).select("form")
    found = [r.form for r in hits.limit(BROADCAST_ROWS + 1).collect()]
    if len(found) > BROADCAST_ROWS:
        raise ValueError("lexicon reaches too many forms; join exploded tokens instead")
    lost = {r.form for r in remapped.collect()}
    return sorted((set(terms) - lost) | set(found))


# --------------------------------------------------------------------------
# Feature expressions
# --------------------------------------------------------------------------
def hits_in(tokens: Column, terms: list[str]) -> Column:
    """Number of tokens that are in ``terms`` (hash lookup per token)."""
    return F.size(F.filter(tokens, lambda t: t.isin(terms)))


def share(count: Column, total: Column) -> Column:
    """``count / total``, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(count, total), F.lit(0.0))


def gratitude_pattern(pack: LanguagePack) -> str:
    return T.any_pattern(pack.gratitude)


def with_readability(
    df: DataFrame, text_col: str, pack: LanguagePack = RUSSIAN, n_tokens: Column | None = None
) -> DataFrame:
    """Flesch, Fog and LIX of readable text; null when it holds no word.

    The five counts are columns of their own, so each regex runs once per row.
    ``n_tokens`` saves one of them when the caller has counted already.
    """
    counted = df.withColumns({
        "__words": T.count_tokens(text_col, pack) if n_tokens is None else n_tokens,
        "__sents": F.greatest(T.count_sentences(text_col), F.lit(1)),
        "__syll": T.count_syllables(text_col, pack.both_case_vowels),
        "__complex": T.count_complex_tokens(text_col, pack),
        "__long": T.count_long_tokens(text_col, pack),
    })
    scores = readability_from_counts(*(F.col(c) for c in ("__words", "__sents", "__syll", "__complex", "__long")))
    return counted.withColumns(scores).drop("__words", "__sents", "__syll", "__complex", "__long")


def readability_from_counts(
    words: Column, sentences: Column, syllables: Column, complex_words: Column, long_words: Column
) -> dict[str, Column]:
    asl = words / sentences
    scores = {
        "readability_flesch": F.lit(206.835) - F.lit(1.015) * asl - F.lit(84.6) * F.try_divide(syllables, words),
        "readability_fog": F.lit(0.4) * (asl + F.try_divide(F.lit(100) * complex_words, words)),
        "readability_lix": asl + F.try_divide(F.lit(100) * long_words, words),
    }
    return {name: F.when(words > 0, F.round(expr, 4)) for name, expr in scores.items()}


def readability_avg(df: DataFrame) -> DataFrame:
    """Mean of the three raw indices, with Fog and LIX turned so that higher is easier."""
    return df.withColumn(
        "readability_avg",
        (F.col("readability_flesch") - F.col("readability_fog") - F.col("readability_lix")) / F.lit(3.0))


def with_numeric_mentions(
    df: DataFrame, raw_col: str, pack: LanguagePack = RUSSIAN, n_tokens: Column | None = None
) -> DataFrame:
    """Sums of money and numbers in the raw text, tags included.

    ``n_tokens`` is the token count of the cleaned text, reused for texts that
    hold no tag and no entity.
    """
    tokens = T.count_tokens(raw_col, pack)
    if n_tokens is not None:
        marked = F.contains(F.col(raw_col), F.lit("<")) | F.contains(F.col(raw_col), F.lit("&"))
        tokens = F.when(marked, tokens).otherwise(n_tokens)
    counted = df.withColumns({
        "money_mentions": T.count_matches(raw_col, T.money_pattern(pack.currency)),
        "__numbers": T.count_matches(raw_col, T.NUMBER_PATTERN),
        "__tokens": tokens,
    })
    return counted.withColumns({
        "number_density": F.col("__numbers") / F.greatest(F.col("__tokens"), F.lit(1)),
        "has_specific_sum": (F.col("money_mentions") > 0).cast("int"),
    }).drop("__numbers", "__tokens")


def legacy_we_ratio(df: DataFrame) -> DataFrame:
    """The older "we" share among first-person pronouns only."""
    return df.withColumn(
        "we_ratio_old", F.col("we_ratio") / (F.col("we_ratio") + F.col("i_ratio") + F.lit(1e-6)))


# --------------------------------------------------------------------------
# Operators
# --------------------------------------------------------------------------
def with_lexicon_features(
    df: DataFrame, words_col: str, pack: LanguagePack = RUSSIAN, forms: DataFrame | None = None,
    n_tokens: Column | None = None,
) -> DataFrame:
    """Social, gratitude, pronoun and certainty features of cleaned words."""
    social = forms_reaching(pack.social, forms)
    certain = forms_reaching(pack.certainty, forms)
    uncertain = forms_reaching(pack.uncertainty, forms)
    every = sorted({*social, *certain, *uncertain, *pack.we_forms, *pack.i_forms})
    counted = (
        df.withColumn("__n", T.count_tokens(words_col, pack) if n_tokens is None else n_tokens)
        .withColumn("__g", T.count_matches(F.col(words_col), gratitude_pattern(pack)))
        # One scan of the tokens keeps the few that any list knows.
        .withColumn("__hits", F.filter(
            F.transform(T.tokenize(words_col, pack.token_pattern), F.lower), lambda t: t.isin(every)))
    )
    lists = {"__social": social, "we_count": pack.we_forms, "i_count": pack.i_forms,
             "__certain": certain, "__uncertain": uncertain}
    counted = counted.withColumns({name: hits_in(F.col("__hits"), terms) for name, terms in lists.items()})
    n, we, i = F.col("__n"), F.col("we_count"), F.col("i_count")
    return counted.withColumns({
        "social_score": share(F.col("__social"), n),
        "gratitude_score": F.col("__g") / F.greatest(n, F.lit(1)),
        "has_gratitude": (F.col("__g") > 0).cast("int"),
        "we_ratio": share(we, n),
        "i_ratio": share(i, n),
        "we_vs_i": we / (i + 1),
        "certainty_score": share(F.col("__certain"), n),
        "uncertainty_score": share(F.col("__uncertain"), n),
    }).drop("__n", "__g", "__hits", "__social", "__certain", "__uncertain")


def extract_text_features(
    df: DataFrame, text_col: str, pack: LanguagePack = RUSSIAN, forms: DataFrame | None = None
) -> DataFrame:
    """Append ``clean_text`` and every column of ``TEXT_FEATURES``."""
    # Cleaning keeps every letter, so one token count serves all features.
    cleaned = df.withColumn("clean_text", T.clean_readable(text_col)).withColumns({
        "__words_only": T.words_only("clean_text"), "__tokens_all": T.count_tokens("clean_text", pack)})
    n = F.col("__tokens_all")
    out = with_lexicon_features(cleaned, "__words_only", pack, forms, n)
    out = with_numeric_mentions(out, text_col, pack, n)
    out = with_readability(out, "clean_text", pack, n)
    return readability_avg(out).drop("__words_only", "__tokens_all")


def score_sentences(
    df: DataFrame,
    id_col: str,
    text_col: str,
    scorer: Callable[[DataFrame], DataFrame],
    prefix: str = "sentiment",
    labels: tuple[str, ...] = ("positive", "negative", "neutral"),
) -> DataFrame:
    """Mean class probability over all sentences of a document.

    The scorer receives ``(id, pos, sentence)`` with whole sentences and adds one
    column per label; a model that reads short inputs only cuts them itself.
    """
    sentences = df.select(id_col, F.posexplode(T.split_sentences(text_col)).alias("pos", "sentence"))
    means = scorer(sentences).groupBy(id_col).agg(
        *[F.avg(label).alias(f"{prefix}_{label}") for label in labels])
    return df.join(means, id_col, "left")


def lexicon_scorer(positive: list[str], negative: list[str], pack: LanguagePack = RUSSIAN):
    """A scorer from two word lists: softmax over hit counts, neutral at zero."""

    def score(sentences: DataFrame) -> DataFrame:
        tokens = T.tokenize(F.lower("sentence"), pack.token_pattern)
        counted = sentences.withColumn("__t", tokens).withColumns({
            "__p": F.exp(hits_in(F.col("__t"), positive).cast("double")),
            "__m": F.exp(hits_in(F.col("__t"), negative).cast("double")),
        })
        total = F.col("__p") + F.col("__m") + F.lit(1.0)
        return counted.withColumns({
            "positive": F.col("__p") / total,
            "negative": F.col("__m") / total,
            "neutral": F.lit(1.0) / total,
        }).drop("__t", "__p", "__m")

    return score


def lexicon_coverage(df: DataFrame, scores: list[str] = COVERAGE_SCORES, floor: float = 0.1) -> DataFrame:
    """Share of documents in which each score is positive; flags the weak ones."""
    present = [c for c in scores if c in df.columns]
    wide = df.agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.count_if(F.col(c) > 0).alias(c) for c in present])
    long = wide.unpivot(["n_docs"], present, "feature", "n_covered")
    coverage = F.try_divide(F.col("n_covered"), F.col("n_docs"))
    return long.select(
        "feature", "n_covered", "n_docs", coverage.alias("coverage"), (coverage < floor).alias("is_weak"))


def feature_summary(df: DataFrame, columns: list[str] = TEXT_FEATURES) -> DataFrame:
    """Mean, sample deviation, minimum and maximum per feature, four decimals."""
    present = [c for c in columns if c in df.columns]
    wide = df.agg(*[
        F.struct(
            F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev(c), 4).alias("std"),
            F.round(F.min(c).cast("double"), 4).alias("min"), F.round(F.max(c).cast("double"), 4).alias("max"),
        ).alias(c)
        for c in present
    ])
    return wide.unpivot([], present, "feature", "s").select("feature", "s.mean", "s.std", "s.min", "s.max")


def drop_redundant(df: DataFrame, columns: tuple[str, ...] = ("sentiment_neutral", "topic_4")) -> DataFrame:
    """Drop one column of each group that sums to one."""
    return df.drop(*[c for c in columns if c in df.columns])


def lexicon_inventory(spark, pack: LanguagePack = RUSSIAN) -> DataFrame:
    """Distinct terms per category: their number and the sorted list."""
    return (
        lexicon_table(spark, pack).groupBy("category")
        .agg(F.countDistinct("term").alias("n_terms"), F.sort_array(F.collect_set("term")).alias("terms"))
    )
