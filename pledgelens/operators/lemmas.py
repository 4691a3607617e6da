"""Lemmas of forms that no table holds, by suffix rules learnt from a ``(form, lemma)`` table.

A pair gives the rule that turns its form into its lemma: so many letters off, other letters on. The rule is counted under every
ending of the form that holds the letters it takes off, up to ``LONGEST`` letters and down to the empty ending; an ending keeps
its most frequent rule. A form takes the rule of its longest known ending. The rules are a table like the entries they come from,
so they can be stored, joined and read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import lookup_join

#: Letters of the longest ending, and pairs that an ending's rule needs.
LONGEST = 6
LEAST = 2


def _shared(form: Column, lemma: Column) -> Column:
    """Letters that both begin with."""
    upto = F.least(F.length(form), F.length(lemma))
    same = F.filter(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), lambda i: F.left(form, i) == F.left(lemma, i))
    return F.when(upto > 0, F.size(same)).otherwise(0)


def learn_rules(forms: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``(ending, strip, add, n, share)`` from ``(form, lemma)``: the most frequent rule of each ending, ties by fewer letters off, then by ``add``.

    ``n`` pairs follow it, the given share of the ending's pairs.
    """
    pairs = forms.where(F.col("form").isNotNull() & F.col("lemma").isNotNull()).select("form", "lemma", _shared(F.col("form"), F.col("lemma")).alias("p"))
    rules = pairs.select(
        "form", (F.length("form") - F.col("p")).alias("strip"), F.substring("lemma", F.col("p") + 1, F.length("lemma")).alias("add")).where(F.col("strip") <= longest)
    endings = rules.select("strip", "add", F.explode(F.transform(
        F.sequence("strip", F.least(F.length("form"), F.lit(longest))), lambda s: F.right("form", s))).alias("ending"))
    counts = endings.groupBy("ending", "strip", "add").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("ending").agg(F.min(F.struct((-F.col("n")).alias("n"), "strip", "add")).alias("r"), F.sum("n").alias("total"))
    return best.select("ending", "r.strip", "r.add", (-F.col("r.n")).alias("n"), (-F.col("r.n") / F.col("total")).alias("share")).where(F.col("n") >= least)


def predict_lemmas(words: DataFrame, rules: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``(form, lemma)`` of distinct ``form``: by the rule of the longest known ending that leaves a letter, else the form itself."""
    distinct = words.where(F.col("form").isNotNull()).select("form").distinct()
    asked = distinct.select("form", F.explode(F.transform(
        F.sequence(F.lit(0), F.least(F.length("form"), F.lit(longest))), lambda s: F.right("form", s))).alias("ending"))
    found = lookup_join(asked, rules.select("ending", "strip", "add"), ["ending"], "inner").where(F.col("strip") < F.length("form"))
    taken = found.groupBy("form").agg(F.max_by(F.struct("strip", "add"), F.length("ending")).alias("r"))
    lemma = F.concat(F.left("form", F.length("form") - F.col("r.strip")), F.col("r.add"))
    return distinct.join(taken, "form", "left").select("form", F.coalesce(lemma, F.col("form")).alias("lemma"))


def complete_forms(words: DataFrame, forms: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """The table's entries, and predicted ones for the other words: what ``features.lemmatize`` takes as its table."""
    known = forms.select("form", "lemma")
    unknown = lookup_join(words.select("form").distinct(), known.select("form").distinct(), ["form"], "left_anti")
    return known.unionByName(predict_lemmas(unknown, learn_rules(known, longest, least), longest))


def rule_accuracy(forms: DataFrame, folds: int = 5, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``(n, correct, unchanged, accuracy)`` over entries held out by the hash of their form; ``unchanged`` counts those whose lemma is the form."""
    held = F.pmod(F.crc32(F.col("form").cast("binary")), F.lit(folds)) == 0
    rules = learn_rules(forms.where(~held), longest, least)
    tested = forms.where(held).select("form", F.col("lemma").alias("true"))
    judged = tested.join(predict_lemmas(tested, rules, longest), "form")
    right = F.count_if(F.col("lemma") == F.col("true"))
    return judged.agg(
        F.count(F.lit(1)).alias("n"), right.alias("correct"), F.count_if(F.col("form") == F.col("true")).alias("unchanged"),
        F.try_divide(right, F.count(F.lit(1))).alias("accuracy"))
