"""Queries over documents and pages: cleaning, tokens, text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import WESTERN
from ..operators import features as E
from ..operators import lemmas as LM
from ..operators.stored import stored
from .base import query, r6, sql_words, table

P = WESTERN
SP = T.SPACE
V = P.both_case_vowels

# Entities that occur in the page table, decoded in one pass order-safely: the
# ampersand last, since decoded text is never decoded twice.
_UNESCAPE = (
    "replace(replace(replace(replace(replace(replace(html,'&middot;','·'),'&copy;','©'),"
    "'&quot;','\"'),'&lt;','<'),'&gt;','>'),'&amp;','&')"
)
_NO_TAGS = f"regexp_replace({_UNESCAPE},'<[^>]+>',' ','g')"


def _squeeze_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr},'[{SP}]+',' ','g'))"


@query("clean_words", f"""
SELECT page_id, {_squeeze_sql(f"regexp_replace({_NO_TAGS},'[^{T.WORD}{SP}]',' ','g')")} AS words FROM pages""")
def clean_words(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_words("html").alias("words"))


@query("clean_readable", f"SELECT page_id, {_squeeze_sql(_NO_TAGS)} AS readable FROM pages")
def clean_readable(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_readable("html").alias("readable"))


@query("clean_model_text", f"""
SELECT doc_id, {_squeeze_sql("regexp_replace(text,'<[^>]+>',' ','g')")} AS clean_text FROM documents""")
def clean_model_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_model_text("text").alias("clean_text"))


@query("clean_topics", f"""
SELECT page_id, {_squeeze_sql(f"regexp_replace({_NO_TAGS},'[^{P.letters}{SP}]',' ','g')")} AS topic_text
FROM pages""")
def clean_topics(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_topics("html", P.letters).alias("topic_text"))


@query("html_unescape", f"SELECT page_id, {_UNESCAPE} AS html FROM pages")
def html_unescape(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_unescape("html").alias("html"))


@query("tokenize", f"""
SELECT doc_id, len(t)::INT AS n_tokens, array_to_string(t,' ') AS tokens
FROM (SELECT doc_id, regexp_extract_all(text,'{P.token_pattern}') AS t FROM documents)""")
def tokenize(spark, sf):
    tokens = T.tokenize("text", P.token_pattern)
    return table(spark, sf, "documents").select("doc_id", tokens.alias("t")).select(
        "doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


# A lemma table derived from the corpus itself: plural-like forms ending in "s"
# map to the form without it when that form occurs too.
_FORMS_SQL = f"""
toks AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t,1)-1 AS pos
         FROM (SELECT doc_id, regexp_extract_all(text,'{P.token_pattern}') AS t FROM documents)),
seen AS (SELECT DISTINCT lower(token) AS form FROM toks),
forms AS (SELECT s.form, b.form AS lemma FROM seen s JOIN seen b ON s.form = b.form || 's')"""


def corpus_seen(documents):
    """The distinct lower-case forms of the corpus; stored, as every table of forms is made of them."""
    tokens = T.tokenize(F.lower("text"), P.token_pattern)
    return stored(documents.select(F.explode(F.array_distinct(tokens)).alias("form")).distinct(), "seen-forms")


def corpus_forms(documents, seen=None):
    seen = corpus_seen(documents) if seen is None else seen
    base = seen.select(F.col("form").alias("lemma"), F.concat("form", F.lit("s")).alias("form"))
    return base.join(seen, "form", "left_semi").select("form", "lemma")


@query("lemmatize", f"""
WITH {_FORMS_SQL}
SELECT doc_id, count(token)::INT AS n_lemmas, coalesce(string_agg(coalesce(lemma, lower(token)), ' ' ORDER BY pos), '') AS lemmas
FROM documents LEFT JOIN toks USING (doc_id) LEFT JOIN forms ON lower(token) = form GROUP BY doc_id""")
def lemmatize(spark, sf):
    docs = table(spark, sf, "documents")
    tokenized = docs.select("doc_id", T.tokenize("text", P.token_pattern).alias("tokens"))
    out = E.lemmatize(tokenized, "doc_id", "tokens", corpus_forms(docs))
    return out.select(
        "doc_id", F.size("lemmas").alias("n_lemmas"), F.array_join("lemmas", " ").alias("lemmas"))


# Entries for suffix rules: the table above, and forms of four letters and more in "s" without a base as their own lemma.
_ENTRIES_SQL = f"""{_FORMS_SQL}, entries AS (
  SELECT form, lemma FROM forms UNION ALL
  SELECT form, form FROM seen WHERE form LIKE '%s' AND length(form) >= 4 AND form NOT IN (SELECT form FROM forms)),
ended AS (
  SELECT form, CASE WHEN form = lemma THEN 0 ELSE 1 END AS strip, '' AS add, unnest(generate_series(
    CASE WHEN form = lemma THEN 0 ELSE 1 END, least(length(form), {{longest}}))) AS s FROM entries),
counted AS (SELECT right(form, s::INT) AS ending, strip, add, count(*) AS n FROM ended GROUP BY ALL),
rules AS (
  SELECT ending, strip, add, n, n / sum(n) OVER (PARTITION BY ending) AS share, row_number() OVER (PARTITION BY ending ORDER BY n DESC, strip, add) AS best
  FROM counted QUALIFY best = 1 AND n >= {{least}})"""
_ENTRIES_SQL = _ENTRIES_SQL.replace("{longest}", str(LM.LONGEST)).replace("{least}", str(LM.LEAST))


def corpus_entries(documents, seen=None):
    seen = corpus_seen(documents) if seen is None else seen
    forms = corpus_forms(documents, seen)
    own = seen.where(F.col("form").endswith("s") & (F.length("form") >= 4)).join(forms, "form", "left_anti")
    return stored(forms.unionByName(own.select("form", F.col("form").alias("lemma"))), "form-entries")


@query("lemma_rules", f"""WITH {_ENTRIES_SQL} SELECT ending, strip::INT AS strip, add, n, round(share, 6) + 0.0 AS share FROM rules""")
def lemma_rules(spark, sf):
    rules = LM.learn_rules(corpus_entries(table(spark, sf, "documents")))
    return rules.select("ending", "strip", "add", "n", r6("share").alias("share"))


@query("predict_lemmas", f"""WITH {_ENTRIES_SQL},
asked AS (SELECT form, right(form, s::INT) AS ending, s FROM (
  SELECT form, unnest(generate_series(0, least(length(form), {LM.LONGEST}))) AS s FROM seen WHERE form NOT IN (SELECT form FROM entries))),
taken AS (SELECT form, strip, add FROM asked JOIN rules USING (ending) WHERE strip < length(form) QUALIFY row_number() OVER (PARTITION BY form ORDER BY s DESC) = 1)
SELECT form, lemma FROM entries UNION ALL
SELECT form, CASE WHEN strip IS NULL THEN form ELSE left(form, (length(form) - strip)::INT) || add END
FROM (SELECT form FROM seen WHERE form NOT IN (SELECT form FROM entries)) LEFT JOIN taken USING (form)""")
def predict_lemmas(spark, sf):
    """Every form of the corpus with its lemma: from the table, else by rule."""
    docs = table(spark, sf, "documents")
    seen = corpus_seen(docs)
    return LM.complete_forms(seen, corpus_entries(docs, seen))


@query("lemma_rule_accuracy")
def lemma_rule_accuracy(spark, sf):
    return LM.rule_accuracy(corpus_entries(table(spark, sf, "documents")))


@query("split_sentences", f"""
SELECT doc_id, len(s)::INT AS n_sentences, array_to_string(s,'|') AS sentences
FROM (SELECT doc_id, list_filter(string_split_regex(text,'[.!?]+'),
             lambda x: regexp_matches(x,'[^{SP}]')) AS s FROM documents)""")
def split_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.split_sentences("text").alias("s")).select(
        "doc_id", F.size("s").alias("n_sentences"), F.array_join("s", "|").alias("sentences"))


@query("count_syllables", f"""
SELECT doc_id, length(regexp_replace(text,'[^{V}]','','g'))::INT AS n_syllables FROM documents""")
def count_syllables(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.count_syllables("text", V).alias("n_syllables"))


_WORD_SQL = f"""
base AS (SELECT doc_id, text, {_squeeze_sql("regexp_replace(text,'<[^>]+>',' ','g')")} AS readable FROM documents),
words AS (SELECT *, {_squeeze_sql(f"regexp_replace(readable,'[^{T.WORD}{SP}]',' ','g')")} AS w FROM base),
lists AS (SELECT *, regexp_extract_all(w,'{P.token_pattern}') AS t,
                 regexp_extract_all(readable,'{P.token_pattern}') AS rt FROM words)"""


def _hits(terms) -> str:
    return f"len(list_filter(t, lambda x: lower(x) IN ({sql_words(terms)})))"


def _words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", T.clean_words("text").alias("w"))


def _features(spark, sf, *columns):
    return E.with_lexicon_features(_words(spark, sf), "w", P).select(
        "doc_id", *[F.col(c).cast("int").alias(c) if c.endswith("count") or c.startswith("has")
                    else r6(c).alias(c) for c in columns])


_GRAT = "|".join(P.gratitude).replace(r"\w", f"[{T.WORD}]")
_SOCIAL = f"round(coalesce({_hits(P.social)}::DOUBLE/nullif(len(t),0),0),6)+0.0"
_CERT = f"round(coalesce({_hits(P.certainty)}::DOUBLE/nullif(len(t),0),0),6)+0.0"
_UNCERT = f"round(coalesce({_hits(P.uncertainty)}::DOUBLE/nullif(len(t),0),0),6)+0.0"
_GRATN = f"len(regexp_extract_all(w,'(?i)(?:{_GRAT})'))"
_WE, _I = _hits(P.we_forms), _hits(P.i_forms)


@query("lexicon_share", f"WITH {_WORD_SQL} SELECT doc_id, {_SOCIAL} AS social_score FROM lists")
def lexicon_share(spark, sf):
    return _features(spark, sf, "social_score")


@query("pattern_rate", f"""WITH {_WORD_SQL}
SELECT doc_id, round({_GRATN}::DOUBLE/greatest(len(t),1),6)+0.0 AS gratitude_score,
       ({_GRATN}>0)::INT AS has_gratitude FROM lists""")
def pattern_rate(spark, sf):
    return _features(spark, sf, "gratitude_score", "has_gratitude")


@query("pronoun_balance", f"""WITH {_WORD_SQL}
SELECT doc_id, {_WE}::INT AS we_count, {_I}::INT AS i_count,
       round(coalesce({_WE}::DOUBLE/nullif(len(t),0),0),6)+0.0 AS we_ratio,
       round(coalesce({_I}::DOUBLE/nullif(len(t),0),0),6)+0.0 AS i_ratio,
       round({_WE}::DOUBLE/({_I}+1),6)+0.0 AS we_vs_i FROM lists""")
def pronoun_balance(spark, sf):
    return _features(spark, sf, "we_count", "i_count", "we_ratio", "i_ratio", "we_vs_i")


@query("certainty", f"""WITH {_WORD_SQL}
SELECT doc_id, {_CERT} AS certainty_score, {_UNCERT} AS uncertainty_score FROM lists""")
def certainty(spark, sf):
    return _features(spark, sf, "certainty_score", "uncertainty_score")


_MONEY = f"len(regexp_extract_all(text,'(?i)[0-9][0-9{SP},.]*(?:{'|'.join(P.currency)})'))"
_NUMBERS = r"len(regexp_extract_all(text,'\b[0-9]+(?:[.,][0-9]+)?\b'))"


@query("numeric_mentions", f"""
SELECT doc_id, {_MONEY}::INT AS money_mentions,
       round({_NUMBERS}::DOUBLE/greatest(len(regexp_extract_all(text,'{P.token_pattern}')),1),6)+0.0
         AS number_density, ({_MONEY}>0)::INT AS has_specific_sum FROM documents""")
def numeric_mentions(spark, sf):
    out = E.with_numeric_mentions(table(spark, sf, "documents").select("doc_id", "text"), "text", P)
    return out.select("doc_id", "money_mentions", r6("number_density").alias("number_density"), "has_specific_sum")


_COUNTS_SQL = f"""counts AS (SELECT *, len(rt)::DOUBLE AS nw,
  greatest(len(list_filter(string_split_regex(readable,'[.!?]+'),
           lambda x: regexp_matches(x,'[^{SP}]'))),1)::DOUBLE AS ns,
  list_sum(list_transform(rt, lambda x: length(regexp_replace(x,'[^{V}]','','g'))))::DOUBLE AS ny,
  len(list_filter(rt, lambda x: length(regexp_replace(x,'[^{V}]','','g'))>=3))::DOUBLE AS nc,
  len(list_filter(rt, lambda x: length(x)>6))::DOUBLE AS nl FROM lists),
scores AS (SELECT *, CASE WHEN nw>0 THEN round(206.835-1.015*(nw/ns)-84.6*(ny/nw),4) END AS f,
  CASE WHEN nw>0 THEN round(0.4*(nw/ns+100*nc/nw),4) END AS g,
  CASE WHEN nw>0 THEN round(nw/ns+100*nl/nw,4) END AS x FROM counts)"""


@query("readability", f"""WITH {_WORD_SQL}, {_COUNTS_SQL}
SELECT doc_id, f AS readability_flesch, g AS readability_fog, x AS readability_lix FROM scores""")
def readability(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", T.clean_readable("text").alias("c"))
    return E.with_readability(docs, "c", P).drop("c")


@query("readability_avg", f"""WITH {_WORD_SQL}, {_COUNTS_SQL}
SELECT doc_id, round((f-g-x)/3.0,6)+0.0 AS readability_avg FROM scores""")
def readability_avg(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", T.clean_readable("text").alias("c"))
    return E.readability_avg(E.with_readability(docs, "c", P)).select("doc_id", r6("readability_avg").alias("readability_avg"))


_ALL_SQL = f"""feat AS (SELECT doc_id, readable AS clean_text, {_SOCIAL} AS social_score,
  round({_GRATN}::DOUBLE/greatest(len(t),1),6)+0.0 AS gratitude_score, ({_GRATN}>0)::INT AS has_gratitude,
  {_WE}::INT AS we_count, {_I}::INT AS i_count,
  round(coalesce({_WE}::DOUBLE/nullif(len(t),0),0),6)+0.0 AS we_ratio,
  round(coalesce({_I}::DOUBLE/nullif(len(t),0),0),6)+0.0 AS i_ratio,
  round({_WE}::DOUBLE/({_I}+1),6)+0.0 AS we_vs_i,
  {_CERT} AS certainty_score, {_UNCERT} AS uncertainty_score,
  {_MONEY}::INT AS money_mentions,
  round({_NUMBERS}::DOUBLE/greatest(len(regexp_extract_all(text,'{P.token_pattern}')),1),6)+0.0 AS number_density,
  ({_MONEY}>0)::INT AS has_specific_sum,
  f AS readability_flesch, g AS readability_fog, x AS readability_lix,
  round((f-g-x)/3.0,6)+0.0 AS readability_avg FROM scores)"""
FEATURE_CTE = f"{_WORD_SQL}, {_COUNTS_SQL}, {_ALL_SQL}"
INT_FEATURES = {"has_gratitude", "we_count", "i_count", "money_mentions", "has_specific_sum"}


def feature_table(spark, sf):
    """All text features of the documents, rounded for comparison."""
    out = E.extract_text_features(table(spark, sf, "documents"), "text", P)
    return rounded_features(out, "doc_id", "clean_text")


def rounded_features(df, *keep):
    return df.select(*keep, *[
        F.col(c).cast("int").alias(c) if c in INT_FEATURES else r6(c).alias(c) for c in E.TEXT_FEATURES])


@query("text_features", f"WITH {FEATURE_CTE} SELECT * FROM feat")
def text_features(spark, sf):
    return feature_table(spark, sf)


@query("legacy_we_ratio", f"""WITH {FEATURE_CTE}
SELECT doc_id, round(we_ratio/(we_ratio+i_ratio+1e-6),6)+0.0 AS we_ratio_old FROM feat""")
def legacy_we_ratio(spark, sf):
    return E.legacy_we_ratio(feature_table(spark, sf)).select("doc_id", r6("we_ratio_old").alias("we_ratio_old"))


@query("lexicon_coverage", f"""WITH {FEATURE_CTE},
c AS ({" UNION ALL ".join(
    f"SELECT '{s}' AS feature, count(*) FILTER ({s}>0) AS n_covered, count(*) AS n_docs FROM feat"
    for s in E.COVERAGE_SCORES)})
SELECT feature, n_covered, n_docs, round(n_covered::DOUBLE/n_docs,6)+0.0 AS coverage,
       (n_covered::DOUBLE/n_docs<0.1)::INT AS is_weak FROM c""")
def lexicon_coverage(spark, sf):
    return E.lexicon_coverage(feature_table(spark, sf)).select(
        "feature", "n_covered", "n_docs", r6("coverage").alias("coverage"), F.col("is_weak").cast("int").alias("is_weak"))


@query("feature_summary", f"""WITH {FEATURE_CTE},
c AS ({" UNION ALL ".join(
    f"SELECT '{s}' AS feature, round(avg({s}),4)+0.0 AS mean, round(stddev_samp({s}),4)+0.0 AS std, "
    f"round(min({s})::DOUBLE,4)+0.0 AS min, round(max({s})::DOUBLE,4)+0.0 AS max FROM feat"
    for s in E.TEXT_FEATURES)}) SELECT * FROM c""")
def feature_summary(spark, sf):
    return E.feature_summary(feature_table(spark, sf)).select(
        "feature", *[(F.col(c) + F.lit(0.0)).alias(c) for c in ("mean", "std", "min", "max")])


@query("drop_redundant", f"""WITH {FEATURE_CTE} SELECT doc_id, certainty_score FROM feat""")
def drop_redundant(spark, sf):
    wide = feature_table(spark, sf).select("doc_id", "certainty_score", "uncertainty_score")
    return E.drop_redundant(wide, ("uncertainty_score", "topic_4"))


@query("lexicon_usage", f"""WITH {_WORD_SQL},
lex AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS category, unnest([{sql_words(t)}]) AS term"
    for c, t in P.lexicons().items() if c != "gratitude")}),
used AS (SELECT lower(u.token) AS term, doc_id FROM lists, unnest(t) AS u(token))
SELECT category, lex.term AS term, count(doc_id) AS n_tokens, count(DISTINCT doc_id) AS n_docs
FROM lex LEFT JOIN used ON lex.term = used.term GROUP BY 1,2""")
def lexicon_usage(spark, sf):
    """Inventory joined to the corpus: which listed terms occur, and how often."""
    lex = E.lexicon_table(spark, P).where("kind = 'term'").select("category", "term")
    tokens = _words(spark, sf).select("doc_id", F.explode(T.tokenize(F.lower("w"), P.token_pattern)).alias("term"))
    counts = (
        tokens.groupBy("term", "doc_id").count().groupBy("term")
        .agg(F.sum("count").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs")))
    # The counts side streams; only the fixed lexicon travels to the executors.
    used = counts.join(F.broadcast(lex), "term", "inner")
    return lex.join(used, ["category", "term"], "left").select(
        "category", "term", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


_POS, _NEG = P.certainty, P.uncertainty


@query("score_sentences", f"""WITH {_WORD_SQL},
sents AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s,1)-1 AS pos FROM
  (SELECT doc_id, list_filter(string_split_regex(readable,'[.!?]+'),
          lambda x: regexp_matches(x,'[^{SP}]')) AS s FROM lists)),
hit AS (SELECT doc_id, regexp_extract_all(lower(x),'{P.token_pattern}') AS t FROM sents),
e AS (SELECT doc_id, exp(len(list_filter(t, lambda x: x IN ({sql_words(_POS)})))) AS p,
             exp(len(list_filter(t, lambda x: x IN ({sql_words(_NEG)})))) AS m FROM hit)
SELECT base.doc_id, round(avg(p/(p+m+1.0)),6)+0.0 AS sentiment_positive,
       round(avg(m/(p+m+1.0)),6)+0.0 AS sentiment_negative, round(avg(1.0/(p+m+1.0)),6)+0.0 AS sentiment_neutral
FROM base LEFT JOIN e ON base.doc_id = e.doc_id GROUP BY 1""")
def score_sentences(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", T.clean_model_text("text").alias("c"))
    out = E.score_sentences(docs, "doc_id", "c", E.lexicon_scorer(_POS, _NEG, P))
    return out.select("doc_id", *[r6(f"sentiment_{k}").alias(f"sentiment_{k}")
                                  for k in ("positive", "negative", "neutral")])
