import base64
import hashlib

from pyspark.sql import functions as F

from pledgelens.llm import warc


def pages():
    html = [None, "", "<p>é</p>", "<p>é</p>", "a\r\n\r\nb: c\r\n", "x" * 300_000, "<p>é</p>", "\U0001f389", "x" * 300_000]
    urls = ["http://a/", None, "http://b/\r\nX: y", "", "http://é/", "u", "u", "u", "u"]
    rows = [(10 - i, u, h, "clash") for i, (u, h) in enumerate(zip(urls, html))]
    return rows + [rows[2], (None, "n", "<p>é</p>", "c"), (None, "n", "only null", "c"), (None, "n", "only null", "c")]


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, offset string").repartition(3)
    index = warc.write_archives(df, archive_bytes=2000)
    assert index.count() == len(rows) and index.select("archive").distinct().count() >= 3
    got = warc.read_records(index, with_payload=True).collect()
    assert all(r.intact for r in got)
    first = {}
    for i, _, h, _ in rows:
        h = h or ""
        if i is not None:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, u, h, _ in rows:
        h = h or ""
        refers = None if first.get(h) == i else first.get(h)
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        clean = u and u.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
        want.append((i, clean, len(h.encode()), digest, "response" if refers is None else "revisit", refers, h.encode() if refers is None else b""))
    key = lambda x: str(x)
    assert sorted([(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got], key=key) == sorted(want, key=key)
    some = warc.read_records(index.where("page_id % 3 = 0")).select("page_id").collect()
    assert sorted(r[0] for r in some) == sorted(i for i, *_ in rows if i is not None and i % 3 == 0)
    assert warc.round_trip(df.limit(0)).count() == 0
    made = index.agg(F.sum("length")).first()[0]
    assert made < 20_000  # revisits carry no payload


def test_ranges():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 200, 5), ("b", 205, 5), ("b", 210, 500), ("b", 710, 1)]
    got = list(warc.ranges(rows, gap=30, most=100))
    assert got == [rows[:3], rows[3:4], rows[4:5], rows[5:6], rows[6:]]


def test_reading_is_dealt_by_bytes_of_records(spark):
    """Two archives of 256 MB, in an index of a few kilobytes."""
    rows = [(f"a{k}", i << 18, 1 << 18) for k in range(2) for i in range(1024)]
    index = spark.createDataFrame(rows, "archive string, offset bigint, length bigint")
    parts = {}
    for r in warc.dealt(index).select("*", F.spark_partition_id().alias("part")).collect():
        parts.setdefault(r.part, []).append((r.archive, r.offset, r.length))
    assert len(parts) >= 6 and sorted(x for p in parts.values() for x in p) == sorted(rows)
    assert max(sum(n for _, _, n in p) for p in parts.values()) <= 192 << 20
    for p in parts.values():
        assert p == sorted(p) and len(list(warc.ranges(p))) <= len(p) / 8
