"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query of trigrams is derived: every match contains, for each of its
mandatory parts, all trigrams of one of the part's alternatives. The index has, per block of documents and trigram
of any query, the list of documents that contain it. Queries are evaluated block by block on those lists; the rules
are verified on their candidates alone. Rules without a mandatory trigram scan every document.

Everything is DataFrame functions. A block holds a bounded number of documents, so no list grows with the corpus,
and only candidate lists, not texts, are shuffled into blocks. The index keys documents by a hash of id and text; two
documents of one key merely share candidates, since every text is verified itself.

Defined cases: a null or empty text has no spans; repeated rows and rows without an id give a row each; extra columns are left
behind by ``scan`` but for the named ones.
"""

from __future__ import annotations

from itertools import chain
from re import _constants as C
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pledgelens.operators.lookup import lookup_join

from .common import written
from .spans import listing, tagged, with_matches

ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


class SecretRule(NamedTuple):
    kind: str
    pattern: str
    #: Least length of the match's group ``group``.
    least: int = 0
    group: int = 0


# The three base rules, in the order in which they are listed.
BASE_RULES = (
    SecretRule("assign", ASSIGN, 8, 2), SecretRule("access", "AKIA[A-Z0-9]{12,}"), SecretRule("hex", "[0-9a-f]{32,}"),
)
#: Published formats of access tokens and keys.
MORE_RULES = (
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", "AIza[A-Za-z0-9_-]{35}"),
    SecretRule("stripe", "[sr]k_live_[A-Za-z0-9]{16,}"),
    SecretRule("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+"),
    SecretRule("key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: Documents of a block of the index.
BLOCK_DOCUMENTS = 4096
#: Alternatives of a mandatory part; a part with more gives no condition.
ALTERNATIVES = 64

#: A query: every condition must hold; a condition holds if all trigrams of one alternative occur.
Query = list[frozenset[frozenset[str]]]


def _letters(items) -> set[str] | None:
    """The characters of a small class."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 4:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _exact(op, arg) -> set[str] | None:
    """All strings, in lower case, that a part can match, if they are few."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        return _letters(arg)
    if op is C.SUBPATTERN:
        return _exact_all(arg[3])
    if op is C.BRANCH:
        parts = [_exact_all(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[1] == 1:
        once = _exact_all(arg[2])
        return once and (once if arg[0] else once | {""})
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}
    return None


def _exact_all(parts) -> set[str] | None:
    out = {""}
    for op, arg in parts:
        more = _exact(op, arg)
        if more is None or len(out) * len(more) > ALTERNATIVES:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> Query:
    """The conditions that every match's text, in lower case, fulfils. None at all: the rule scans fully."""
    query: Query = []

    def close(run: set[str]) -> None:
        if all(len(s) >= 3 for s in run):
            sets = set(map(trigrams, run))
            # An alternative that holds another's trigrams adds nothing to it.
            query.append(frozenset(x for x in sets if not any(y < x for y in sets)))

    def walk(parts) -> None:
        run = {""}
        for op, arg in parts:
            more = _exact(op, arg)
            if more is not None and len(run) * len(more) <= ALTERNATIVES:
                run = {a + b for a in run for b in more}
                continue
            close(run)
            run = {""}
            if op is C.SUBPATTERN:
                walk(arg[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
                walk(arg[2])
        close(run)

    walk(_parser.parse(pattern))
    return query


def inverted_index(docs: DataFrame, wanted: list[str], block_documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """``block``, ``trigram``, ``postings`` (sorted keys) for rows of ``key``, ``text``."""
    blocks = max(1, -(-docs.count() // block_documents))
    low = docs.select("key", F.lower("text").alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))
    posted = low.select(F.pmod(F.col("key"), F.lit(blocks)).alias("block"), "key", F.explode(has).alias("trigram"))
    return posted.groupBy("block", "trigram").agg(F.sort_array(F.collect_set("key")).alias("postings"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """``key``, ``rules``: the documents that fulfil a rule's query."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "postings"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def has_all(names: frozenset[str]) -> Column:
        out = None
        for t in sorted(names):
            one = F.coalesce(F.col("lists")[t], none)
            out = one if out is None else F.array_intersect(out, one)
        return out

    def fulfilling(query: Query) -> Column:
        out = None
        for condition in query:
            any_of = None
            for names in sorted(condition, key=sorted):
                any_of = has_all(names) if any_of is None else F.array_union(any_of, has_all(names))
            out = any_of if out is None else F.array_intersect(out, any_of)
        return out

    def named(rule: str) -> Column:
        return F.transform(fulfilling(queries[rule]), lambda k: F.struct(k.alias("key"), F.lit(rule).alias("rule")))

    per_rule = F.array(*map(named, queries))
    found = lists.select(F.explode(F.flatten(per_rule)).alias("c")).select("c.key", "c.rule")
    return found.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def scan(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES,
    block_documents: int = BLOCK_DOCUMENTS,
) -> DataFrame:
    """The columns ``keep`` and ``found``: the spans (start, kind_order, end, kind) of all rules, in order."""
    kept = F.struct(*[F.col(c) for c in keep]).alias("kept")
    keyed = docs.select(kept, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "key", F.xxhash64(F.to_json("kept"), F.col("text"))
    )
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    if queries:
        wanted = sorted(set(chain.from_iterable(t for q in queries.values() for c in q for t in c)))
        index = written(inverted_index(keyed.select("key", "text"), wanted, block_documents), "trigram-index")
        keyed = lookup_join(keyed, written(candidates(index, queries), "secret-candidates"), ["key"], salt_on=["key"])
    conditions = {r.kind: F.array_contains("rules", r.kind) if r.kind in queries else None for r in rules}
    out = with_matches(keyed, "text", {r.kind: (r.pattern, conditions[r.kind]) for r in rules})
    tags = [tagged(_long_enough(r), order, r.kind) for order, r in enumerate(rules)]
    return out.select("kept.*", F.sort_array(F.concat(*tags)).alias("found"))


def _long_enough(rule: SecretRule) -> Column:
    """The rule's matches whose group is no shorter than asked."""
    if not rule.least:
        return F.col(rule.kind)
    return F.filter(rule.kind, lambda m: F.length(F.regexp_extract(m["value"], rule.pattern, rule.group)) >= rule.least)


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs)
    count = lambda i: F.size(F.filter("found", lambda x: x["kind_order"] == i)).cast("bigint")
    base = F.filter("found", lambda x: x["kind_order"] < len(BASE_RULES))
    return found.select(
        "doc_id", *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)],
        F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("found")).alias("spans"),
    )
