import json

import pytest
from pyspark.sql import functions as F

from pledgelens.functions import urls as U
from pledgelens.operators import columns as C
from pledgelens.operators import pages as B
from pledgelens.sources import tables as A

BASE = "https://Base.com/dir/sub/page.html?x=1#h"
# Expected values follow the URL standard.
URLS = {
    " https://A.com ": "https://a.com/", "//x.y/z.png": "https://x.y/z.png", "javascript:void(0)": None,
    "data:abc": None, "": None, "/a b/ü?q=1&amp;b=2": "https://base.com/a%20b/%C3%BC?q=1&b=2",
    "x/y": "https://base.com/dir/sub/x/y", "../up/./z": "https://base.com/dir/up/z",
    "#top": "https://base.com/dir/sub/page.html?x=1#top", "?p=2": "https://base.com/dir/sub/page.html?p=2",
    "mailto:a@b.c": "mailto:a@b.c", "HTTP://Host.com:80/p/../q": "http://host.com/q",
    "https://a.com?x=1": "https://a.com/?x=1", "https://": None,
}


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first().x


def test_normalize_url(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    got = {r.u: r.n for r in df.select("u", U.normalize_url("u", F.lit(BASE)).alias("n")).collect()}
    assert got == URLS
    assert one(spark, U.normalize_url("u"), u="x/y") is None


def test_extract_and_classify(spark):
    text = ('<img src="/i.png"><a href=\'https://youtu.be/v\'>x</a> see https://e.com/doc (//cdn.e/p.JPG) '
            '<iframe data-src="https://e.com/i?url=https%3A%2F%2Fz%2Fq.webp">')
    urls = one(spark, U.extract_urls("t", F.lit("https://b.com/")), t=text)
    assert urls == ["https://b.com/i.png", "https://youtu.be/v", "https://e.com/i?url=https%3A%2F%2Fz%2Fq.webp",
                    "https://e.com/doc", "https://cdn.e/p.JPG)"]
    kinds = one(spark, U.classify_urls("u"), u=urls[:4])
    assert kinds.imageUrls == [urls[0], urls[2]] and kinds.videoUrls == [urls[1]] and kinds.otherUrls == [urls[3]]


def test_strip_and_numbers(spark):
    t = "<STYLE>p{}</STYLE>a<script>\nx</script>&nbsp;b &amp;lt; &quot;c&quot; &#39;"
    assert one(spark, U.strip_html("t"), t=t) == "a b &lt; \"c\" '"
    assert one(spark, U.strip_html("t"), t="<p> </p>") is None
    assert one(spark, U.parse_int("t"), t="собрано 12 345 из 9") == 12345
    assert one(spark, U.parse_int("t"), t="нет") is None
    assert one(spark, U.parse_all_ints("t"), t="1 2 из 30 000 и 5") == [12, 30000, 5]
    assert one(spark, U.parse_percent("t"), t="12,5 %") == 12.5
    assert one(spark, U.date_like_strings("t"), t="до 3 Марта 2024, 15 мая и 3 Марта 2024") == ["3 Марта 2024", "15 мая"]
    assert one(spark, U.number_or_null("t"), t="1e400") is None
    assert one(spark, U.normalize_item_url("t", "e.com"), t="https://x.e.com/projects/1/a/?q#h") == "https://x.e.com/projects/1/a"
    assert one(spark, U.normalize_item_url("t", "e.com"), t="https://x.e.com/projects/1") is None


STATE = {
    "user": {"name": "x"},
    "c": {"campaignId": 7, "name": "a}b", "shortDescription": "s", "collectedAmount": {"value": 5},
          "targetAmount": {"value": 10.5}, "links": {"vk": "https://vk.com/p"}, "purchaseCount": "3",
          "imageUrl": "/c.png", "author": {"id": "u1", "campaignsAmount": 2}},
    "c2": {"campaignId": 8, "name": "later", "collectedAmount": {}, "targetAmount": {}},
    "d": {"description": "<p>Hi &amp; <a href='/more'>m</a></p>", "version": "2"},
    "r": {"donate": None, "rewards": [{"id": 1, "amount": "7", "available": True, "imageUrl": "r.jpg",
                                       "descriptionHtml": "<img src='//cdn.x/q.gif'>"}]},
    "k": {"total": {"newsCount": 3}},
}


def state_page(state=STATE):
    return ('<html><head><title>T &amp; t</title><meta property="og:image" content="/og.png">'
            "<meta name='description' content='about \"it\"'></head><body><span>Комментарии (12)</span>"
            '<iframe src="https://vimeo.com/1"></iframe><iframe src="https://maps.x/1"></iframe>'
            f"<script>window.INITIAL_STATE = {json.dumps(state, ensure_ascii=False)};foo({{}})</script></body></html>")


def test_state_record(spark):
    rows = [(1, "https://p.x/campaigns/7", state_page()), (2, "https://p.x/none", "<html></html>"),
            (3, "https://p.x/bad", "window.INITIAL_STATE = {bad")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    out = {r.sourceUrl: r for r in B.build_records(pages, "html", "url").collect()}
    r = out["https://p.x/campaigns/7"]
    assert r.status == "ok" and r.pageTitle == "T & t" and r.meta.description == 'about "it"'
    assert r.card.campaignId == 7 and r.card.title == "a}b" and r.card.targetAmount.value == 10.5
    assert r.card.author.campaignsAmount == 2 and r.card.purchaseCount == 3 and r.card.imageUrl == "https://p.x/c.png"
    assert r.description.text == "Hi & m"
    assert r.counts.newsCount == 3 and r.counts.commentsCount == 12 and r.counts.participantsCount is None
    assert r.rewards.totalRewards == 1 and r.rewards.donate is None
    assert r.rewards["items"][0].amount == 7 and r.rewards["items"][0].imageUrl == "https://p.x/campaigns/r.jpg"
    assert r.media.imageUrls == ["https://p.x/c.png", "https://p.x/og.png", "https://p.x/campaigns/r.jpg", "https://cdn.x/q.gif"]
    assert r.media.videoUrls == ["https://vimeo.com/1"]
    assert r.media.externalLinks == ["https://vk.com/p", "https://p.x/more"]
    assert {out[u].status for u in ("https://p.x/none", "https://p.x/bad")} == {"error"}
    good, bad = A.split_ok_error(B.build_records(pages, "html", "url"))
    assert good.count() == 1 and bad.count() == 2
    flat = C.flatten_record(good)
    assert {"card_targetAmount_value", "counts_newsCount"} <= set(flat.columns)


def test_campaign_needs_a_number_id(spark):
    state = {"c": STATE["c"] | {"campaignId": "7"}, "d": STATE["d"]}
    pages = spark.createDataFrame([("https://p.x/1", state_page(state))], "url string, html string")
    assert B.build_records(pages, "html", "url").first().status == "error"


def test_tab_links(spark):
    page = '<a href="/p/1/posts">News <b class="count">1 2</b></a><a href="/p/1/comments">Talk</a>'
    got = one(spark, B.tab_counts_by_link("t"), t=page)
    assert (got.newsCount, got.commentsCount, got.backersCount) == (12, 0, None)


def test_tab_labels_in_nested_tags(spark):
    page = "<ul><li><span>Комментарии <b>5</b></span></li>" + "<i>x</i>" * 1500 + "<li>Новости&nbsp;<em>12</em></li></ul>"
    got = one(spark, B.tab_counts_by_label("t"), t=page)
    assert (got.comments, got.news, got.participants) == (5, 12, None)


def test_snapshot_and_link_files(spark, tmp_path):
    items = [{"status": "ok", "sourceUrl": "a"}, {"status": "error", "sourceUrl": "b"}]
    (tmp_path / "snap.json").write_text(json.dumps({"stats": {"total": 2}, "items": items}))
    df = A.read_snapshot(spark, str(tmp_path / "snap.json"), "status string, sourceUrl string")
    stats = A.snapshot_stats(df).first()
    assert (stats.total, stats.success, stats.failed) == (2, 1, 1)
    links = tmp_path / "links"
    links.mkdir()
    (links / "a.json").write_text(json.dumps(["https://e.com/projects/1/a?x", "bad", "https://e.com/projects/1/a/"]))
    (links / "b.json").write_text(json.dumps({"urls": ["https://e.com/projects/2/b"]}))
    got = A.read_link_list(spark, str(links), lambda c: U.normalize_item_url(c, "e.com"))
    assert sorted(r.url for r in got.collect()) == ["https://e.com/projects/1/a", "https://e.com/projects/2/b"]


def test_states(spark):
    found = spark.createDataFrame([("u1", "live"), ("u1", "done"), ("u1", "live"), ("u2", "live")], "url string, state string")
    merged = B.merge_link_states(found)
    assert {r.url: r.states for r in merged.collect()} == {"u1": ["done", "live"], "u2": ["live"]}
    recs = spark.createDataFrame([("u1",), ("u9",)], "sourceUrl string")
    assert {r.sourceUrl: r.discoveredStates for r in B.attach_states(recs, merged).collect()} == {"u1": ["done", "live"], "u9": []}


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_table_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 2.5), (2, None), (3, float("nan"))], "a int, b double")
    A.write_table(df, str(tmp_path / fmt), fmt)
    back = A.read_table(spark, str(tmp_path / fmt), fmt, "a int, b double")
    assert sorted((r.a, r.b) for r in back.where("b is not null").collect()) == [(1, 2.5)]
    assert back.count() == 3


@pytest.mark.parametrize("html, classes, want", [
    ('<div class="a">x<div>y<div class="z"></div></div>w</div>tail</div>', ["a"], 'x<div>y<div class="z"></div></div>w'),
    ('<p><DIV id=1 class="b a c">x<Div>y</DIV >z</div>t', ["a"], "x<Div>y</DIV >z"),
    ('<div class="o"><div class="n">in</div></div><div class="n">out</div>', ["o", "n"], "in"),
    ('<div class="o"><i>q</i></div><div class="n">out</div>', ["o", "n"], ""),
    ('<span class="a">one</span><span class="a">two</span>', ["a"], "one"),
    ('<div class="a">never <div>closed</div>', ["a"], "never <div>closed"),
    ('<div class="a">open', ["a"], ""),
    ('<divx class="aa">no</divx><div class=\'a\'></div>', ["a"], ""),
    ('<b class="a"><base href="/">k<br></b>', ["a"], '<base href="/">k<br>'),
    ("", ["a"], ""), (None, ["a"], None),
])
def test_elements_are_read_by_structure(spark, html, classes, want):
    assert spark.createDataFrame([(html,)], "h string").select(B.element_html("h", classes)).first()[0] == want


def test_spread_deals_small_tables_to_all_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    dealt = A.spread(df, "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == spark.sparkContext.defaultParallelism and sum(r["count"] for r in dealt) == 1000
    assert A.spread(df, "id", bytes_per_task=1) is df


def test_tidy_links_are_their_own_normal_form(spark):
    urls = ["https://a.b/c/d.png?x=1&y=%20#z", "http://a-b.c", "https://a.b/", "https://a.b/c/../d", "https://a.b/.x", "https://A.b/c", "http://a.b:80/c",
            "https://a.b/ш", "https://a.b/c\\d", "https://a.b/c`d", "https://a.b?q", "https://a.b/c\n", "https://a.b/c//d/", "https://u@a.b/c"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    long_way = U.bind(U.bind(U.bind(F.col("u"), U._split_url), U._tidy_path), U._join_url)
    rows = df.select("u", F.col("u").rlike(U._TIDY).alias("tidy"), long_way.alias("made")).collect()
    assert all(r.made == r.u for r in rows if r.tidy) and [r.u for r in rows if r.tidy] == [urls[0], urls[2], urls[12]]


def test_tags_of_a_broken_page_are_read_as_before(spark):
    page = ('<title>t</title><META name="description" content="d"><a <img src="/1.png" <a href="/x">y</a><p <iframe src="https://youtu.be/1">'
            '<metadata name="description" content="no"><source\nsrc="/2.mp4"/><a href="/z"')
    r = B.page_meta(spark.createDataFrame([(page, "https://e.com/p")], "html string, url string"), "html", "url").first()
    assert r.meta.description == "d" and r.domImages == ["https://e.com/1.png"] and r.anchorLinks == ["https://e.com/x", "https://e.com/z"]
    assert r.domVideos == ["https://e.com/2.mp4", "https://youtu.be/1"]


def test_pages_are_dealt_after_a_join_of_large_tables(spark):
    from pledgelens.catalog import pages as queries
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert queries.state_pages(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
