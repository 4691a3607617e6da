from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["text_features", "tfidf", "strip_html", "histogram", "train_test_split", "binary_metrics", "segment_errors", "build_records"]


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, SF)
    res = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([r[names.index(c)] for c in sorted(names)]) for r in res.fetchall())
    got = sorted(str([r[c] for c in sorted(names)]) for r in df.collect())
    assert got == want


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
