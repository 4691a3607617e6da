"""The registered queries of the training-data operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontam, divergence, embeddings, licences, pii, quality, secrets, simhash, toxicity, urls, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``(spark, sf_dir)`` and, if given, its SQL twin."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op5_bpe_tree")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


OP9_COLUMNS = ["doc_id", "fingerprint", "component_id"]


@query("op9_simhash_tiles")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(*OP9_COLUMNS)


@query("op10_fertility")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.quality_rules(docs, keep_text=False).drop("lang")


OP2_SQL = r"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
places AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM docs, (SELECT DISTINCT k FROM windows) AS sizes WHERE len(w) >= k)),
hits AS (SELECT r, places.k, i, item FROM places JOIN windows USING (k, win)),
words AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT r, k, i FROM hits), generate_series(0, 9) AS s(j) WHERE j < k GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""


@query("op2_suffix_automaton", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _glob_sql(glob: str) -> str:
    """A glob as a regular expression for SQL."""
    out = glob.replace(".", "[.]").replace("?", "[^/]").replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*")
    return f"regexp_full_match(url0, '{out}', 's')"


def _rules_sql() -> str:
    rules = sorted(urls.SITE_RULES, key=lambda r: -len(r.name))
    fits = [
        f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in rules
    ]
    verdicts = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in rules)
    globs = " ".join(f"WHEN {_glob_sql(g)} THEN '{g}'" for g in urls.BLOCK_GLOBS)
    return f"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
judged AS (
  SELECT page_id, host, path, CASE {' '.join(fits)} END AS rule, CASE {globs} END AS "glob"
  FROM (SELECT *, '.' || host || path AS url0 FROM parts))
SELECT page_id, host, path, rule, "glob",
       CASE {verdicts} WHEN "glob" IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query("op3_url_globs", _rules_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


OP1_SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages),
based AS (
  SELECT page_id, payload_bytes, digest,
         list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           (CAST('0x' || substr(digest, 1 + 10 * (i // 8), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
         min(page_id) OVER (PARTITION BY digest) AS first_id
  FROM hashed)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM based
"""


@query("op1_warc_ranges", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op8_noisy_or")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("bigint").alias("n_offending"))


def _secrets_sql() -> str:
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    quoted = lambda p: p.replace("'", "''")
    found = " UNION ALL ".join(
        f"""
  SELECT r, {i} AS o, '{rule.kind}' AS kind, m[i] AS v,
         list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT r, m, g, unnest(generate_series(1, len(m))) AS i FROM (
    SELECT r, regexp_extract_all(t, '{quoted(rule.pattern)}') AS m, string_split_regex(t, '{quoted(rule.pattern)}') AS g
    FROM docs WHERE regexp_matches(t, '{quoted(rule.pattern)}')))
  {f"WHERE length(regexp_extract(v, '{quoted(rule.pattern)}', {rule.group})) >= {rule.least}" if rule.least else ""}"""
        for i, rule in enumerate(rules)
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
listed AS (
  SELECT r, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
         string_agg(kind || ':' || CAST(s AS INT) || ':' || CAST(s + length(v) AS INT), ',' ORDER BY s, o) AS spans,
         string_agg(kind || ':' || CAST(s AS INT) || ':' || CAST(s + length(v) AS INT), ',' ORDER BY s, o) FILTER (o < 3) AS base
  FROM found GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (r)
"""


@query("op4_trigram_index", _secrets_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


@query("op6_rare_tokens")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query("op7_boosted_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
inside AS (SELECT r, lang, source, term, count(*) AS c FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(c) AS total FROM inside GROUP BY ALL HAVING count(*) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, sum(c) AS c FROM inside JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
shares AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 5)) // (coalesce(sizes.n, 0) + 5 * v) AS p,
         1 + (1000000000 * (total + 5)) // (langs.n + 5 * v) AS q
  FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN counts USING (lang, source, term) LEFT JOIN sizes USING (lang, source)),
items AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM items QUALIFY part = 'pair' OR rank <= 50
"""


@query("op12_cube_divergence", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def _repair_sql() -> str:
    """The DP from the last row to the first; a state's value is (cost, audit, repaired rows), of which the least counts."""
    after = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}
    forward = {1: (3, "user"), 2: (3, "user"), 3: (4, "assistant"), 4: (3, "user")}
    value = "{{cost: {0}, audit: {1}, lines: {2}}}".format

    def row(s: int) -> str:
        arcs = [value(f"4 + v[{s}].cost", f"'D' || v[{s}].audit", f"v[{s}].lines")]
        for initial, h in after[s].items():
            kept = value(f"o + v[{h}].cost", f"'K' || v[{h}].audit", f"list_prepend(role || ':' || text, v[{h}].lines)")
            arcs.append(f"CASE WHEN NOT forced AND first = '{initial}' THEN {kept} END")
        f, name = forward[s]
        given = value(f"3 + o + v[{f}].cost", f"'R' || v[{f}].audit", f"list_prepend('{name}:' || text, v[{f}].lines)")
        return f"list_sort([{', '.join([*arcs, f'CASE WHEN NOT forced THEN {given} END'])}])[1]"

    def inserted(s: int) -> str:
        f, name = forward[s]
        g, more = forward[f]
        one = value(f"3 + w[{f}].cost", f"'I' || w[{f}].audit", f"list_prepend('{name}:', w[{f}].lines)")
        two = value(f"6 + w[{g}].cost", f"'II' || w[{g}].audit", f"list_prepend('{name}:', list_prepend('{more}:', w[{g}].lines))")
        return f"list_sort([w[{s}], {one}, {two}])[1]"

    none = "CAST([] AS VARCHAR[])"
    end = [value("0::BIGINT", "''", none), value("6::BIGINT", "'II'", "['user:', 'assistant:']"), value("3::BIGINT", "'I'", "['assistant:']"),
           value("0::BIGINT", "''", none)]
    return rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: unicode(x)::BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS roll
  FROM conversations),
damaged AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, CASE WHEN roll = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN roll = 1 THEN '' WHEN roll = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN roll = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM raw WHERE roll <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, left(role, 1) AS first FROM damaged),
faults AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open, lag(first) OVER (PARTITION BY g ORDER BY i) || first AS two
  FROM numbered),
rows_ AS (SELECT g, i, role, text, first, blank OR again AS forced, CASE WHEN open THEN 3 ELSE 0 END AS o FROM faults),
counts AS (
  SELECT g, any_value(conv_id) AS conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (open AND NOT again AND NOT blank) AS truncated,
         count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY g),
b AS (
  SELECT g, n + 1 AS i, [{', '.join(end)}] AS v FROM counts
  UNION ALL
  SELECT g, i, [{', '.join(inserted(s) for s in (1, 2, 3, 4))}] AS v
  FROM (SELECT b.g, b.i - 1 AS i, [{', '.join(row(s) for s in (1, 2, 3, 4))}] AS w FROM b JOIN rows_ ON rows_.g = b.g AND rows_.i = b.i - 1))
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(v[1].cost, 0) AS cost, coalesce(v[1].audit, '') AS audit,
       sha256(coalesce(array_to_string(v[1].lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN b ON b.g = counts.g AND b.i = 1
"""


@query("op11_path_ranking", _repair_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(rows), rows)


OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (
  SELECT r, vec_id, e FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r, b.r AS s, b.vec_id AS other FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT r, r AS s FROM v UNION SELECT reach.r, links.s FROM reach JOIN links ON links.r = reach.s),
named AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.s GROUP BY reach.r),
counted AS (SELECT r, count(*) AS n_links FROM links GROUP BY r)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN named USING (r) LEFT JOIN counted USING (r)
"""


@query("op13_cross_polytope", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
