"""Corpus vocabulary, bags of words, TF-IDF and topics.

A document's terms are counted inside its row; only a row per distinct term of a
task is shuffled. Nothing holds a corpus, and a term of every document is only a counter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import RUSSIAN, LanguagePack
from . import topics
from .features import lemmatize
from .lookup import lookup_join
from .stored import stored


# --------------------------------------------------------------------------
# Terms of a document
# --------------------------------------------------------------------------
def _keep_terms(lemmas: Column, stop: list[str], longer_than: int) -> Column:
    return F.filter(lemmas, lambda t: (F.length(t) > longer_than) & ~t.isin(stop))


def _with_lemmas(df: DataFrame, tokens: Column, id_col: str | None, forms: DataFrame | None) -> DataFrame:
    """Add ``lemmas`` of the tokens; without a ``(form, lemma)`` table the tokens themselves."""
    if forms is None:
        return df.withColumn("lemmas", tokens)
    if id_col is None:
        raise ValueError("lemmas need the name of a column of unique ids")
    return lemmatize(df.withColumn("__tokens", tokens), id_col, "__tokens", forms).drop("__tokens")


def topic_terms(
    df: DataFrame, text_col: str, pack: LanguagePack = RUSSIAN, name: str = "terms", forms: DataFrame | None = None,
    id_col: str | None = None,
) -> DataFrame:
    """Add the lower-case terms for topic models as an array: lemmas, then short and stop words dropped."""
    tokens = T.tokenize(F.lower(T.clean_topics(text_col, pack.letters)), pack.token_pattern)
    out = _with_lemmas(df, tokens, id_col, forms)
    return out.withColumn(name, _keep_terms(F.col("lemmas"), pack.topic_stop, 2)).drop("lemmas")


def tfidf_terms(
    df: DataFrame, text_col: str, pack: LanguagePack = RUSSIAN, name: str = "terms", forms: DataFrame | None = None,
    id_col: str | None = None,
) -> DataFrame:
    """Add the lower-case terms for TF-IDF: short tokens out before, stop words after the lemma."""
    tokens = T.tokenize(F.lower(F.coalesce(text_col, F.lit(""))), pack.tfidf_pattern)
    out = _with_lemmas(df, F.filter(tokens, lambda t: F.length(t) >= 3), id_col, forms)
    return out.withColumn(name, F.filter("lemmas", lambda t: ~t.isin(pack.tfidf_stop))).drop("lemmas")


def empty_text_count(df: DataFrame, terms_col: str = "terms") -> DataFrame:
    """Documents without a single term."""
    return df.agg(F.count_if(F.size(terms_col) == 0).alias("n_empty"), F.count(F.lit(1)).alias("n_docs"))


def ngrams(terms: Column | str, longest: int = 2, shortest_word: int = 2) -> Column:
    """One- to ``longest``-word runs over words of at least ``shortest_word`` characters."""

    def runs(words: Column) -> Column:
        found = [words]
        for n in range(2, longest + 1):
            # Append each run's next word; the two slices have the same length.
            count = F.greatest(F.size(words) - (n - 1), F.lit(0))
            found.append(F.zip_with(
                F.slice(found[-1], F.lit(1), count), F.slice(words, F.lit(n), count),
                lambda run, word: F.concat(run, F.lit(" "), word)))
        return F.concat(*found)

    return T.bind(F.filter(T.as_column(terms), lambda w: F.length(w) >= shortest_word), runs)


# --------------------------------------------------------------------------
# Counts over the corpus
# --------------------------------------------------------------------------
def term_rows(df: DataFrame, id_col: str, terms_col: str = "terms") -> DataFrame:
    """``(id, term, tf)`` of a table with a row per document; counted inside the row, without a shuffle."""
    # Equal terms stand together once sorted: a term's count is the distance to where the next one starts.
    ordered = df.select(id_col, F.sort_array(terms_col).alias("__t"))
    starts = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size("__t"), F.lit(1))),
        lambda i: (F.size("__t") > 0) & ((i == 1) | ~F.get("__t", i - 1).eqNullSafe(F.get("__t", i - 2))))
    ordered = ordered.withColumn("__s", starts)
    ends = F.concat(F.slice("__s", F.lit(2), F.greatest(F.size("__s"), F.lit(0))), F.array(F.size("__t") + 1))
    counts = F.zip_with("__s", F.slice(ends, F.lit(1), F.size("__s")), lambda a, b: F.struct(
        F.get("__t", a - 1).alias("term"), (b - a).cast("bigint").alias("tf")))
    return ordered.select(id_col, F.inline(counts)).where(F.col("term").isNotNull())


def vocabulary(
    bags: DataFrame, n_docs: int, no_below: int = 2, no_above: float = 0.9
) -> DataFrame:
    """``(term, df, n)``: document and total frequency of the terms in ``no_below`` documents and up to the share ``no_above``."""
    counts = bags.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))
    return counts.where((F.col("df") >= no_below) & (F.col("df") <= F.lit(no_above * n_docs)))


def bag_of_words(bags: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(id, term, tf)`` rows whose term is in the vocabulary.

    The vocabulary is broadcast only if its checked size allows it.
    """
    return lookup_join(bags, vocab.select("term"), ["term"], "left_semi")


def tfidf(
    df: DataFrame, id_col: str, terms_col: str = "terms", max_features: int = 500, min_df: int = 2, longest: int = 2
) -> DataFrame:
    """``(id, term, tf, weight)``: sublinear, smoothed, unit-length document vectors.

    The vocabulary is the ``max_features`` most frequent terms, ties by name, so
    it is small by construction; other terms leave a document before they are counted there.
    The documents' terms are stored first, so they are made once for both passes.
    """
    docs = stored(df.select(id_col, F.col(terms_col).alias("__terms")), "tfidf-terms")
    n_docs = docs.count()
    grams = docs.select(id_col, ngrams("__terms", longest).alias("__g"))
    counts = term_rows(grams, id_col, "__g").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))
    vocab = counts.where(F.col("df") >= min_df).orderBy(F.desc("n"), "term").limit(max_features).select("term", "df").collect()
    known = df.sparkSession.createDataFrame(vocab, "term string, df bigint")
    idf = (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf")
    rows = term_rows(grams.select(id_col, F.filter("__g", lambda t: t.isin([r["term"] for r in vocab])).alias("__g")), id_col, "__g")
    kept = rows.join(F.broadcast(known.select("term", idf)), "term")
    weighted = kept.withColumn("w", (F.lit(1.0) + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return weighted.select(id_col, "term", "tf", (F.col("w") / norm).alias("weight"))


def max_abs_scale(weights: DataFrame, term_col: str = "term", weight_col: str = "weight") -> DataFrame:
    """Divide by the largest absolute weight of the term; the weights are stored first, as their maxima are needed before them."""
    weights = stored(weights, "weights")
    top = weights.groupBy(term_col).agg(F.max(F.abs(weight_col)).alias("__m"))
    scaled = F.when(F.col("__m") == 0, F.col(weight_col)).otherwise(F.col(weight_col) / F.col("__m"))
    return lookup_join(weights, top, [term_col], "inner").withColumn("scaled", scaled).drop("__m")


# --------------------------------------------------------------------------
# Topics
# --------------------------------------------------------------------------
@dataclass
class TopicTransformer:
    """Vocabulary and topic model from the training documents only.

    ``fit`` needs an array column of terms; ``transform`` appends one share per
    topic. Documents without a known term get equal shares.
    """

    k: int = 5
    passes: int = 10
    seed: int = 42
    no_below: int = 2
    no_above: float = 0.9
    #: Most frequent terms kept; None keeps all, as many as there are.
    max_vocabulary: int | None = None
    prefix: str = "lda_topic_"
    terms_col: str = "terms"
    #: The fitted model, and the place of this topic count in it.
    model: topics.Topics | None = None
    place: int = 0

    def fit(self, df: DataFrame, terms_col: str = "terms") -> "TopicTransformer":
        self.model, self.place, self.terms_col = self.fit_many(df, [self.k], terms_col), 0, terms_col
        return self

    def fit_many(self, df: DataFrame, ks: list[int], terms_col: str = "terms") -> topics.Topics:
        """Models of several topic counts; they share the vocabulary and the draws."""
        return topics.fit(df, terms_col, ks, self.passes, self.seed, self.no_below, self.no_above, self.max_vocabulary)

    def _fitted(self) -> topics.Topics:
        if self.model is None:
            raise RuntimeError("fit the topic model first")
        return self.model

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._fitted().shares(df, self.terms_col, self.place, "__shares")
        equal = F.lit(1.0 / self.k)
        return out.withColumns({
            name: F.coalesce(F.get("__shares", F.lit(i)), equal) for i, name in enumerate(self.feature_names())
        }).drop("__shares")

    def feature_names(self) -> list[str]:
        return [f"{self.prefix}{i}" for i in range(self.k)]

    def vocabulary(self) -> DataFrame:
        """``(term, df, n)``"""
        return self._fitted().vocabulary

    def top_terms(self, n: int = 8) -> DataFrame:
        """``(topic, rank, term, weight)``: the heaviest terms of each topic."""
        return self._fitted().top_terms(self.place, n)


def fit_topics(df: DataFrame, terms_col: str = "terms", k: int = 5, passes: int = 10, seed: int = 42,
               prefix: str = "topic_") -> TopicTransformer:
    return TopicTransformer(k=k, passes=passes, seed=seed, prefix=prefix).fit(df, terms_col)


def coherence(bags: DataFrame, id_col: str, tops: DataFrame) -> DataFrame:
    """Mean u_mass coherence per topic from ``(topic, rank, term)``.

    Only rows of the top terms take part; a document contributes at most one
    pair per pair of top terms.
    """
    words = tops.select("term").distinct()
    docs = stored(bags.join(F.broadcast(words), "term", "left_semi").groupBy(id_col).agg(
        F.sort_array(F.collect_set("term")).alias("__w")), "top-term-sets")
    single = docs.select(F.explode("__w").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("d"))
    pairs = docs.select(F.explode("__w").alias("a"), "__w").select("a", F.explode("__w").alias("b")).groupBy(
        "a", "b").agg(F.count(F.lit(1)).alias("both"))
    left = tops.select("topic", F.col("rank").alias("i"), F.col("term").alias("a"))
    right = tops.select("topic", F.col("rank").alias("j"), F.col("term").alias("b"))
    wanted = left.join(right, "topic").where("i > j")
    scored = (
        wanted.join(pairs, ["a", "b"], "left")
        .join(single.select(F.col("term").alias("b"), "d"), "b")
        .withColumn("s", F.log((F.coalesce("both", F.lit(0)) + 1.0) / F.col("d"))))
    return scored.groupBy("topic").agg(F.avg("s").alias("coherence"))


def select_k_by_coherence(
    df: DataFrame, id_col: str, terms_col: str = "terms", ks: range = range(2, 11), n_top: int = 8, **kwargs
) -> tuple[int, DataFrame]:
    """Topic count with the best mean coherence, and the table of tried counts.

    The fits share the vocabulary, every draw and every job; the topics of all counts are judged in one job.
    """
    spark = df.sparkSession
    docs = topics.numbered(df.select(id_col, terms_col))
    model = TopicTransformer(**kwargs).fit_many(docs, list(ks), terms_col)
    tops = None
    for place, k in enumerate(ks):
        own = model.top_terms(place, n_top).withColumn("topic", F.struct(F.lit(k).alias("k"), F.col("topic").alias("topic")))
        tops = own if tops is None else tops.unionByName(own)
    tops = stored(tops, "top-terms")
    judged = coherence(term_rows(docs, id_col, terms_col), id_col, tops)
    means = {r["k"]: r["mean"] for r in judged.groupBy(F.col("topic.k").alias("k")).agg(F.avg("coherence").alias("mean")).collect()}
    tried = [(k, float(means[k])) for k in ks]
    best = max(tried, key=lambda item: item[1])[0]
    return best, spark.createDataFrame(tried, "k int, coherence double")
