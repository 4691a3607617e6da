"""License scans with a positional rare-token index.

The templates of known licence notices are indexed by word: for each word its templates and positions. A first pass over
all documents counts in how many each template word occurs. The second pass looks up, for every document and template, the
``RARE`` words of highest IDF that the document has, and intersects their postings by relative position: the template
starts where the document position less the template position agrees for at least ``AGREE`` of them. A start counts if the
template's mandatory phrases stand in the document. Fixed base phrases are found at every place besides.

Everything is DataFrame functions and row-local but for the word counts, which are summed before they are shuffled.
What is sent to the tasks is bounded by the templates' words.

Words are runs of digits, letters and characters above ASCII after A-Z became a-z. Defined cases: a null or empty text
has no words, no places, no labels and score 0; repeated rows give a row each; a corpus without template words gives
no template labels. Extra columns are left behind but for the named ones.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Template(NamedTuple):
    label: str
    words: str
    #: Phrases that must stand in the document.
    phrases: tuple[str, ...]


# Opening sentences of public licence notices, in normalised words.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted",),
    ),
    Template(
        "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that",
        ("source and binary forms",),
    ),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template(
        "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        ("gnu general public license",),
    ),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
)
#: Highest-IDF words of a template that are looked up in a document, and how many must agree on a start.
RARE = 6
AGREE = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The words with one space before, between and after them."""
    spaced = F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(spaced), F.lit(" "))


def has(norm: Column, phrase: str) -> Column:
    return F.contains(norm, F.lit(f" {phrase} "))


def words_of(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda w: w != "")


def document_frequencies(docs: DataFrame, text: str, templates: tuple[Template, ...]) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that hold each template word."""
    known = sorted({w for t in templates for w in t.words.split()})
    norm = docs.select(normalised(F.coalesce(F.col(text), F.lit(""))).alias("norm"))
    present = F.array_compact(F.array(*[F.when(has(F.col("norm"), w), F.lit(w)) for w in known]))
    counts = norm.select(F.explode(present).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return docs.count(), {r.word: r.n for r in counts.collect()}  # at most a row for each template word


def inverse_frequencies(total: int, counts: dict[str, int]) -> dict[str, float]:
    return {w: math.log((1 + total) / (1 + n)) for w, n in counts.items()}


def ranked(template: Template, idf: dict[str, float]) -> list[str]:
    """The template's words that occur in the corpus, rarest first."""
    return sorted({w for w in template.words.split() if w in idf}, key=lambda w: (-idf[w], w))


def _starts(template: Template, words: list[str]) -> Column:
    """How many of the looked-up words agree on the best start, as a share of those looked up."""
    postings: dict[str, list[int]] = {}
    for i, w in enumerate(template.words.split()):
        postings.setdefault(w, []).append(i)
    rarest = F.slice(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("norm"), F.concat(F.lit(" "), w, F.lit(" ")))), 1, RARE)
    places = F.create_map(*[x for w in words for x in (F.lit(w), F.array(*map(F.lit, postings[w])))])

    def of_word(w: Column) -> Column:
        """The starts that a word's places in the document and in the template give, each once."""
        here = F.transform(
            F.filter(F.transform("words", lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()),
            lambda i: F.transform(F.element_at(places, w), lambda p: i - p),
        )
        return F.array_distinct(F.flatten(here))

    starts = F.array_sort(F.flatten(F.transform(rarest, of_word)))
    begin = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, s: Column) -> Column:
        run = F.when(acc["last"] == s, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(s.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    best = F.aggregate(starts, begin, step)["best"]
    return F.when(best >= F.least(F.lit(AGREE), F.size(rarest)), best / F.size(rarest)).otherwise(F.lit(0.0))


def base_places() -> Column:
    """The word positions at which a base phrase starts, in order."""
    parts = []
    for phrase in BASE_PHRASES:
        ws = phrase.split()
        parts.append(_phrase_starts(ws))
    return F.array_sort(F.concat(*parts))


def _phrase_starts(ws: list[str]) -> Column:
    def stands(w: Column, i: Column) -> Column:
        fits = w == ws[0]
        for k, other in enumerate(ws[1:], 2):
            fits = fits & (F.get("words", i + (k - 1)) == other)
        return F.when(fits, i)

    found = F.filter(F.transform("words", stands), lambda i: i.isNotNull())
    return F.when(has(F.col("norm"), " ".join(ws)), found).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """The columns ``keep`` with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    idf = inverse_frequencies(*document_frequencies(docs, text, templates))
    kept = F.struct(*[F.col(c) for c in keep]).alias("kept")
    norm = docs.select(kept, normalised(F.coalesce(F.col(text), F.lit(""))).alias("norm"))
    usable = [(t, ranked(t, idf)) for t in templates]
    usable = [(t, ws) for t, ws in usable if len(ws) == len(set(t.words.split()))]
    phrases = [*BASE_PHRASES, *sorted({p for t, _ in usable for p in t.phrases})]
    # Words are numbered only where a phrase that a verdict needs stands at all.
    likely = F.lit(False)
    for p in phrases:
        likely = likely | has(F.col("norm"), p)
    counted = norm.withColumns({
        "n_words": (F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) - 1).cast("bigint"),
        "words": F.when(likely, words_of(F.col("norm"))),
    }).withColumn("n_words", F.when(F.length("norm") > 2, F.col("n_words")).otherwise(F.lit(0).cast("bigint")))
    none = F.array().cast("array<int>")
    scored = counted.withColumn("places", F.when(F.col("words").isNotNull(), base_places()).otherwise(none))
    shares = {}
    for i, (t, ws) in enumerate(usable):
        verified = has(F.col("norm"), t.phrases[0])
        for p in t.phrases[1:]:
            verified = verified & has(F.col("norm"), p)
        shares[f"share{i}"] = F.when(verified, _starts(t, ws)).otherwise(F.lit(0.0))
    scored = scored.withColumns(shares) if shares else scored
    base = F.array_compact(F.array(*[F.when(has(F.col("norm"), p), F.lit(label)) for p, label in BASE_PHRASES.items()]))
    more = F.array_compact(F.array(*[F.when(F.col(f"share{i}") > 0, F.lit(t.label)) for i, (t, _) in enumerate(usable)])) if usable else F.array().cast("array<string>")
    n_base = F.size("places").cast("bigint")
    return scored.select(
        "kept.*", "n_words", n_base.alias("n_base"), F.get("places", F.lit(0)).cast("bigint").alias("first_word"),
        F.get("places", F.size("places") - 1).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.greatest(F.when(n_base > 0, 1.0).otherwise(0.0), *[F.col(c) for c in shares], F.lit(0.0)).alias("score"),
    )
