import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pledgelens.llm import divergence
from pledgelens.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(rows, least, top):
    """``rows`` of (text, lang, source); plain Python integers."""
    docs = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), g or "", s or "") for t, g, s in rows]
    counts, spread, out = defaultdict(Counter), defaultdict(Counter), []
    for words, g, s in docs:
        counts[g, s].update(words)
        spread[g].update(set(words))
    for g in {g for _, g, _ in docs}:
        kept = [t for t, n in spread[g].items() if n >= least]
        sources = sorted(s for h, s in counts if h == g)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 5)) // (n + 5 * len(kept)) for t in kept}

        whole = sum((counts[g, s] for s in sources), Counter())
        q, p = shares(whole), {s: shares(counts[g, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[g, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top if part == "term" else None]
                out += [(g, s, part, item, v, k + 1) for k, (item, v) in enumerate(items)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_equals_brute_force_on_cells_of_few_groups_and_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GROUP_BLOCK", 3)
    monkeypatch.setattr(divergence, "TERM_BLOCK", 7)
    docs = table(spark, SF, "documents")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    want = brute(rows, 5, 50)
    assert len({r[:2] for r in want}) > 20
    assert result(divergence.audit(docs, least_docs=5)) == want


def test_nulls_ties_repeats_and_names_that_clash(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 4)
    monkeypatch.setattr(divergence, "PIECE", 3)
    rows = [
        ("Über ÜBER x", "de", "a"), ("Über ÜBER x", "de", "a"), ("über y z Z", "de", None), ("", "de", "c"), (None, "de", "d"),
        (None, None, None), ("alone 1 2", None, "b"), ("wort " * 50, "xx", "only"), ("wort", "xx", "only"), ("a-b a_b", "yy", "s"), ("\x7fa\x00b", "yy", "t"),
    ]
    docs = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "text string, lang string, source string, term string, n int")
    for least in (1, 2, 3):
        assert result(divergence.audit(docs, least_docs=least, top=2)) == brute(rows, least, 2)
    assert result(divergence.audit(docs.limit(0))) == []


@pytest.mark.parametrize("count, total", [(5, 5), (5, 7), (0, 3), (9 * 10**14, 9 * 10**15), (123456789012345, 8999999999999999)])
def test_shares_are_exact(spark, count, total):
    got = spark.range(1).select(divergence.share(F.lit(count).cast("bigint"), F.lit(total).cast("bigint"))).first()[0]
    assert got == 1 + 10**9 * count // total
