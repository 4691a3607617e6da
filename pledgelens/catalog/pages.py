"""Queries over pages: links, markup, embedded state, records, link lists.

The page table has no embedded state or rewards, so those queries render pages
from the order rows first and then read them back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import columns as C
from ..operators import pages as B
from ..sources import tables as A
from .base import query, r6, table

SP = U.PAGE_SPACE
_ENC = r"""array_to_string(list_transform(regexp_extract_all({x},'[!-~]+|[^!-~]+'),
  lambda p: CASE WHEN regexp_matches(p,'[!-~]') THEN p ELSE url_encode(p) END),'')"""
_ORIGIN = "regexp_extract(url,'^([a-z]+://[^/?#]+)',1)"


def pages(spark, sf):
    return table(spark, sf, "pages")


_STRIP = """nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html,'(?is)<style.*?</style>',' ','g'),'(?is)<script.*?</script>',' ','g'),
  '<[^>]+>',' ','g'),'&nbsp;',' '),'&quot;','"'),'&#39;',''''),'&lt;','<'),'&gt;','>'),'&amp;','&'),
  '[""" + SP + """]+',' ','g')),'')"""


@query("strip_html", f"SELECT page_id, {_STRIP} AS visible_text FROM pages")
def strip_html(spark, sf):
    return pages(spark, sf).select("page_id", U.strip_html("html").alias("visible_text"))


@query("clean_ws", f"SELECT doc_id, nullif(trim(regexp_replace(text,'[{SP}]+',' ','g')),'') AS clean FROM documents")
def clean_ws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", U.clean_ws("text").alias("clean"))


_HREFS = """hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html,'(?i)(?:src|href|poster|image|data-src)\\s*=\\s*["'']([^"'']+)["'']',1)) AS raw FROM pages)"""


@query("normalize_url", f"""WITH {_HREFS}
SELECT page_id, raw, CASE WHEN raw LIKE '/%' THEN {_ORIGIN} || {_ENC.format(x='raw')} END AS link FROM hrefs""")
def normalize_url(spark, sf):
    raw = F.regexp_extract_all("html", F.lit(r"""(?i)(?:src|href|poster|image|data-src)\s*=\s*["']([^"']+)["']"""), F.lit(1))
    links = pages(spark, sf).select("page_id", "url", F.explode(raw).alias("raw"))
    return links.select("page_id", "raw", U.normalize_url("raw", "url").alias("link"))


@query("extract_urls", f"""WITH {_HREFS},
done AS (SELECT DISTINCT page_id, {_ORIGIN} || {_ENC.format(x='raw')} AS link FROM hrefs)
SELECT pages.page_id AS page_id, count(link) AS n_links, coalesce(string_agg(link,' ' ORDER BY link),'') AS links
FROM pages LEFT JOIN done ON pages.page_id=done.page_id GROUP BY 1""")
def extract_urls(spark, sf):
    found = pages(spark, sf).select("page_id", U.extract_urls("html", F.col("url")).alias("u"))
    return found.select("page_id", F.size("u").cast("bigint").alias("n_links"),
                        F.array_join(F.array_sort("u"), " ").alias("links"))


_KINDS = ["/a.png", "/clip.mp4?t=1", "/i?url=https%3A%2F%2Fcdn%2Fx.jpg&w=2", "/watch?site=youtube.com", "/text.html"]
_MADE = "u AS (SELECT page_id, [" + ", ".join(f"{_ORIGIN} || '{k}'" for k in _KINDS) + "] AS urls FROM pages)"


@query("classify_urls", f"""WITH {_MADE}
SELECT page_id, urls[1] || ' ' || urls[3] AS images, urls[2] || ' ' || urls[4] AS videos, urls[5] AS others FROM u""")
def classify_urls(spark, sf):
    origin = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    urls = F.array(*[F.concat(origin, F.lit(k)) for k in _KINDS])
    return pages(spark, sf).select("page_id", U.classify_urls(urls).alias("k")).select(
        "page_id", F.array_join("k.imageUrls", " ").alias("images"),
        F.array_join("k.videoUrls", " ").alias("videos"), F.array_join("k.otherUrls", " ").alias("others"))


@query("collect_url_strings", f"SELECT page_id, url || ' ' || {_ORIGIN} || '/media/' || page_id || '.png' AS links FROM pages")
def collect_url_strings(spark, sf):
    made = F.to_json(F.struct(
        F.col("url").alias("link"), F.lit("a plain title").alias("title"),
        F.struct(F.array(F.concat(F.lit("/media/"), "page_id", F.lit(".png"))).alias("files")).alias("deep")))
    return pages(spark, sf).select("page_id", U.collect_url_strings(made, F.col("url")).alias("u")).select(
        "page_id", F.array_join("u", " ").alias("links"))


@query("normalize_item_url", r"""SELECT page_id,
  CASE WHEN regexp_extract(url,'^[a-z]+://([^/?#]+)',1) LIKE '%example.com'
        AND regexp_extract(url,'^[a-z]+://[^/?#]+/([^/?#]+)',1)='en'
       THEN regexp_replace(regexp_replace(url,'[?#].*$',''),'/+$','') END AS item FROM pages""")
def normalize_item_url(spark, sf):
    return pages(spark, sf).select(
        "page_id", U.normalize_item_url("url", "example.com", section="en", min_parts=2).alias("item"))


@query("page_meta", """SELECT page_id,
  nullif(trim(regexp_replace(replace(replace(regexp_extract(html,'(?is)<title[^>]*>(.*?)</title>',1),
         '&quot;','"'),'&amp;','&'),'\\s+',' ','g')),'') AS "pageTitle",
  NULL::VARCHAR AS description, len(list_distinct(regexp_extract_all(html,'<a href="([^"]+)"',1))) AS n_anchors FROM pages""")
def page_meta(spark, sf):
    out = B.page_meta(pages(spark, sf), "html", "url")
    return out.select("page_id", "pageTitle", F.col("meta.description").alias("description"),
                      F.size("anchorLinks").cast("bigint").alias("n_anchors"))


# --------------------------------------------------------------------------
# Figures in text, rendered from the order lines
# --------------------------------------------------------------------------
def _figures(spark, sf):
    qty = F.col("l_quantity").cast("int")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.concat(F.lit("  собрано "), qty, F.lit(" "), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"),
                 F.lit(" из  90 000 ₽ "), (F.col("l_suppkey") % 10).cast("string"), F.lit(",5 %")).alias("t"),
        F.concat(F.lit("до "), F.col("l_linenumber").cast("string"), F.lit(" марта "),
                 F.year("l_shipdate").cast("string"), F.lit(" или 15 мая, до "), F.col("l_linenumber").cast("string"),
                 F.lit(" марта "), F.year("l_shipdate").cast("string")).alias("d"))


_FIG_KEY = "l_orderkey, l_linenumber, l_partkey"
_FIRST = "(floor(l_quantity)::INT || lpad((l_partkey%1000)::VARCHAR,3,'0'))::DOUBLE"


@query("parse_int", f"SELECT {_FIG_KEY}, {_FIRST} AS first_int FROM lineitem")
def parse_int(spark, sf):
    return _figures(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", U.parse_int("t").alias("first_int"))


@query("parse_all_ints", f"""SELECT {_FIG_KEY}, {_FIRST} + 90000 + l_suppkey%10 + 5 AS sum_ints, 4 AS n_ints
FROM lineitem""")
def parse_all_ints(spark, sf):
    found = _figures(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", U.parse_all_ints("t").alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", total.alias("sum_ints"), F.size("x").alias("n_ints"))


@query("parse_percent", f"SELECT {_FIG_KEY}, (l_suppkey%10)+0.5::DOUBLE AS percent FROM lineitem")
def parse_percent(spark, sf):
    return _figures(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", U.parse_percent("t").alias("percent"))


@query("date_like_strings", f"""SELECT {_FIG_KEY}, l_linenumber || ' марта ' || year(l_shipdate) || '|15 мая' AS dates
FROM lineitem""")
def date_like_strings(spark, sf):
    return _figures(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array_join(U.date_like_strings("d"), "|").alias("dates"))


@query("number_or_null", """SELECT event_id, try_cast(regexp_extract(props,'([0-9]+)',1) AS DOUBLE) AS k,
  try_cast(CASE WHEN event_id%3=0 THEN '' WHEN event_id%3=1 THEN event_type ELSE value::VARCHAR END AS DOUBLE) AS v
FROM events""")
def number_or_null(spark, sf):
    mixed = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(
        F.col("value").cast("string"))
    return table(spark, sf, "events").select(
        "event_id", U.number_or_null(F.get_json_object("props", "$.k")).alias("k"), U.number_or_null(mixed).alias("v"))


# --------------------------------------------------------------------------
# Pages with an embedded state, rendered from orders
# --------------------------------------------------------------------------
def state_pages(spark, sf):
    """One page per order: campaign, description, rewards and counters as embedded JSON."""
    orders = table(spark, sf, "orders")
    joined = orders.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = A.dealt(joined, "o_orderkey", size=A.table_bytes(orders))
    key = F.col("o_orderkey")
    campaign = F.struct(
        key.alias("campaignId"), F.concat(F.lit("Deal } "), key).alias("name"),
        F.struct(F.col("o_totalprice").alias("value")).alias("collectedAmount"),
        F.struct(F.col("c_acctbal").alias("value")).alias("targetAmount"),
        F.col("o_orderstatus").alias("status"), F.lit("/img/cover.png").alias("imageUrl"),
        F.lit("https://youtu.be/x1").alias("videoUrl"), F.lit("12").alias("purchaseCount"),
        F.struct(F.col("o_orderpriority").alias("tagName")).alias("mainCategory"),
        F.struct(F.lit("https://vk.com/deal").alias("vk")).alias("links"))
    description = F.struct(
        F.concat(F.lit("<p>Text &amp; <a href='/more'>more</a> "), F.col("c_mktsegment"),
                 F.lit("</p><img src=\"//cdn.example/pic.jpg\">")).alias("description"), F.lit("v2").alias("version"))
    reward = F.struct(
        key.alias("id"), F.lit("Cup").alias("name"), F.lit("/r.png").alias("imageUrl"),
        (key % 7).cast("string").alias("amount"), F.lit(True).alias("available"))
    rewards = F.struct(F.struct(F.lit("d1").alias("id")).alias("donate"), F.array(reward, reward).alias("rewards"))
    counters = F.struct(F.struct((key % 5).alias("newsCount")).alias("total"))
    state = F.to_json(F.struct(
        F.lit(1).alias("n"), campaign.alias("c"), description.alias("d"), rewards.alias("r"), counters.alias("k")))
    ok = F.concat(
        F.lit("<html><head><title>Deal &quot;"), key, F.lit("&quot;</title>"
              '<meta name="description" content="About &amp; more"></head><body><span>Комментарии: '),
        (key % 9), F.lit("</span><script>window.INITIAL_STATE = "), state, F.lit(";boot({})</script></body></html>"))
    bad = F.lit("<html><title>gone</title></html>")
    return o.select(
        key.alias("page_id"), F.concat(F.lit("https://deals.example/campaigns/"), key).alias("url"),
        F.when(key % 10 == 3, bad).otherwise(ok).alias("html"), "o_totalprice", "c_acctbal", "o_orderpriority")


_OK = "o_orderkey%10<>3"
_JOINED = "orders JOIN customer ON o_custkey=c_custkey"


@query("extract_state_json", f"""SELECT o_orderkey AS page_id, CASE WHEN {_OK} THEN 'n,c,d,r,k' END AS blocks FROM orders""")
def extract_state_json(spark, sf):
    return state_pages(spark, sf).select(
        "page_id", F.array_join(F.map_keys(B.extract_state_json("html")), ",").alias("blocks"))


@query("find_blocks", f"""SELECT o_orderkey AS page_id, CASE WHEN {_OK} THEN 'Deal }} ' || o_orderkey END AS name,
  CASE WHEN {_OK} THEN 'v2' END AS version, CASE WHEN {_OK} THEN 'd1' END AS donate,
  CASE WHEN {_OK} THEN (o_orderkey%5)::VARCHAR END AS news FROM orders""")
def find_blocks(spark, sf):
    found = state_pages(spark, sf).select("page_id", B.find_blocks(B.extract_state_json("html")).alias("b"))
    return found.select(
        "page_id", F.get_json_object("b.campaign", "$.name").alias("name"),
        F.get_json_object("b.descriptionBlock", "$.version").alias("version"),
        F.get_json_object("b.rewardsBlock", "$.donate.id").alias("donate"),
        F.get_json_object("b.countersBlock", "$.total.newsCount").alias("news"))


@query("map_rewards", f"""SELECT o_orderkey AS page_id, i::INT AS pos, o_orderkey::VARCHAR AS id, 'Cup' AS name,
  'https://deals.example/r.png' AS "imageUrl", (o_orderkey%7)::DOUBLE AS amount, 1 AS available
FROM orders, range(2) t(i) WHERE {_OK}""")
def map_rewards(spark, sf):
    block = state_pages(spark, sf).select(
        "page_id", "url", B.find_blocks(B.extract_state_json("html"))["rewardsBlock"].alias("r"))
    items = block.select("page_id", F.posexplode(B.map_rewards("r", "url")).alias("pos", "item"))
    return items.select("page_id", "pos", "item.id", "item.name", "item.imageUrl", "item.amount",
                        F.col("item.available").cast("int").alias("available"))


_RECORD_SQL = f"""SELECT CASE WHEN {_OK} THEN 'ok' ELSE 'error' END AS status,
  'https://deals.example/campaigns/' || o_orderkey AS "sourceUrl",
  CASE WHEN {_OK} THEN 'Deal "' || o_orderkey || '"' ELSE 'gone' END AS "pageTitle",
  CASE WHEN {_OK} THEN 'About & more' END AS meta_description,
  CASE WHEN {_OK} THEN o_orderkey END::DOUBLE AS campaign_id, CASE WHEN {_OK} THEN o_totalprice END AS collected,
  CASE WHEN {_OK} THEN c_acctbal END AS target, CASE WHEN {_OK} THEN o_orderpriority END AS tag,
  CASE WHEN {_OK} THEN 'Text & more ' || c_mktsegment END AS description,
  CASE WHEN {_OK} THEN (o_orderkey%5)::DOUBLE END AS news, CASE WHEN {_OK} THEN (o_orderkey%9)::DOUBLE END AS comments,
  CASE WHEN {_OK} THEN 12.0::DOUBLE END AS purchases, CASE WHEN {_OK} THEN 2 ELSE 0 END AS n_rewards,
  CASE WHEN {_OK} THEN 'https://deals.example/img/cover.png https://deals.example/r.png https://cdn.example/pic.jpg' ELSE '' END AS images,
  CASE WHEN {_OK} THEN 'https://youtu.be/x1' ELSE '' END AS videos,
  CASE WHEN {_OK} THEN 'https://vk.com/deal https://deals.example/more' ELSE '' END AS links FROM {_JOINED}"""


def records(spark, sf):
    return B.build_records(state_pages(spark, sf), "html", "url")


@query("build_records", _RECORD_SQL)
def build_records(spark, sf):
    return records(spark, sf).select(
        "status", "sourceUrl", "pageTitle", F.col("meta.description").alias("meta_description"),
        F.col("card.campaignId").cast("double").alias("campaign_id"),
        F.col("card.collectedAmount.value").alias("collected"), F.col("card.targetAmount.value").alias("target"),
        F.col("card.mainCategory.tagName").alias("tag"), F.col("description.text").alias("description"),
        F.col("counts.newsCount").alias("news"), F.col("counts.commentsCount").alias("comments"),
        F.col("counts.purchasesCount").alias("purchases"), F.col("rewards.totalRewards").alias("n_rewards"),
        *[F.array_join(f"media.{c}", " ").alias(n)
          for c, n in (("imageUrls", "images"), ("videoUrls", "videos"), ("externalLinks", "links"))])


@query("split_ok_error", f"""SELECT count(*) AS total, count(*) AS completed, count(*) FILTER ({_OK}) AS success,
  count(*) FILTER (NOT {_OK}) AS failed FROM {_JOINED}""")
def split_ok_error(spark, sf):
    """Both sides of the split, united again, give the envelope's totals."""
    good, bad = A.split_ok_error(records(spark, sf).select("status", "sourceUrl", "error"))
    return A.snapshot_stats(good.unionByName(bad))


@query("flatten_record", f"""SELECT o_orderkey AS id, CASE WHEN {_OK} THEN o_totalprice END AS "card_collectedAmount_value",
  CASE WHEN {_OK} THEN o_orderpriority END AS "card_mainCategory_tagName",
  CASE WHEN {_OK} THEN 2 ELSE 0 END AS "rewards_totalRewards" FROM {_JOINED}""")
def flatten_record(spark, sf):
    flat = C.flatten_record(records(spark, sf).select("sourceUrl", "card", "rewards"))
    key = F.regexp_extract("sourceUrl", r"(\d+)$", 1).cast("bigint")
    return flat.select(key.alias("id"), "card_collectedAmount_value", "card_mainCategory_tagName", "rewards_totalRewards")


@query("media_counts", f"""SELECT 'https://deals.example/campaigns/' || o_orderkey AS "sourceUrl",
  CASE WHEN {_OK} THEN 3 ELSE 0 END AS image_count, CASE WHEN {_OK} THEN 1 ELSE 0 END AS video_count,
  CASE WHEN {_OK} THEN 2 ELSE 0 END AS reward_count, CASE WHEN {_OK} THEN 2 ELSE 0 END AS external_link_count FROM {_JOINED}""")
def media_counts(spark, sf):
    flat = C.flatten_record(records(spark, sf).select("sourceUrl", "media", "rewards"))
    return C.array_counts(flat, {
        "image_count": "media_imageUrls", "video_count": "media_videoUrls",
        "reward_count": "rewards_items", "external_link_count": "media_externalLinks",
    }).select("sourceUrl", "image_count", "video_count", "reward_count", "external_link_count")


@query("reward_table", f"""SELECT 'https://deals.example/campaigns/' || o_orderkey AS "sourceUrl",
  CASE WHEN {_OK} THEN 'Cup' END AS name, CASE WHEN {_OK} THEN (o_orderkey%7)::DOUBLE END AS amount
FROM {_JOINED}, range(2) t(i) WHERE {_OK} OR i=0""")
def reward_table(spark, sf):
    return B.reward_table(records(spark, sf)).select("sourceUrl", "name", "amount")


# --------------------------------------------------------------------------
# Pages of the second family, rendered from orders
# --------------------------------------------------------------------------
def shop_pages(spark, sf):
    orders = table(spark, sf, "orders")
    o = A.dealt(orders, "o_orderkey", size=A.table_bytes(orders))
    key = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("bigint").cast("string")
    html = F.concat(
        F.lit('<html><head><title>Shop</title><meta property="twitter:player" content="https://vimeo.com/9"></head><body>'
              '<h1 class="title big">Shop '), key, F.lit('</h1><p class="blurb"> Sub  title </p>'
              '<div class="money-backed"><span class="backed-now">'), price, F.lit(' ₽</span>'
              '<span class="backed-target">из 70 000 ₽</span></div><div class="progress"><b class="percentage">'),
        (key % 100), F.lit(',5 %</b><i class="timer">до 3 марта 2024</i></div>'
              '<nav class="menu js-tabs"><a href="/projects/1/posts">News <span class="count">'), (key % 6),
        F.lit('</span></a><a href="/projects/1/comments">Talk</a></nav>'
              '<section class="description">Plain <a href="https://ext.example/a">x</a></section>'
              '<script>gon.Project={"id":'), key, F.lit('};gon.Rewards=[{"id":5,"photo":"/p.png","amount":"1 500"}];</script>'
              '</body></html>'))
    return o.select(key.alias("page_id"), F.concat(F.lit("https://shop.example/projects/"), key).alias("url"),
                    html.alias("html"))


@query("build_shop_records", """SELECT o_orderkey::VARCHAR AS project_id, 'Shop ' || o_orderkey AS title, 'Sub title' AS subtitle,
  trunc(o_totalprice)::DOUBLE AS funded_now, 70000.0::DOUBLE AS funded_target, (o_orderkey%100)+0.5::DOUBLE AS percent,
  (o_orderkey%6)::DOUBLE AS news, 0.0::DOUBLE AS comments, '3 марта 2024' AS dates, 1500.0::DOUBLE AS reward_amount,
  'https://shop.example/p.png' AS images, 'https://vimeo.com/9' AS videos, 'Plain x' AS description FROM orders""")
def build_shop_records(spark, sf):
    out = B.build_shop_records(shop_pages(spark, sf), "html", "url")
    return out.select(
        F.col("card.projectId").alias("project_id"), "card.title", "card.subtitle",
        F.col("card.fundedNow").alias("funded_now"), F.col("card.fundedTarget").alias("funded_target"),
        F.col("card.progressPercent").alias("percent"), F.col("counts.newsCount").alias("news"),
        F.col("counts.commentsCount").alias("comments"), F.array_join("card.dateLikeStrings", "|").alias("dates"),
        F.get("rewards.items", F.lit(0))["amount"].alias("reward_amount"),
        F.array_join("media.imageUrls", " ").alias("images"), F.array_join("media.videoUrls", " ").alias("videos"),
        F.col("description.text").alias("description"))


@query("tab_counts", """SELECT o_orderkey AS page_id, (o_orderkey%6)::DOUBLE AS by_link_news, 0.0::DOUBLE AS by_link_comments,
  NULL::DOUBLE AS by_link_backers, CASE WHEN o_orderkey%10<>3 THEN (o_orderkey%9)::DOUBLE END AS by_label_comments
FROM orders JOIN customer ON o_custkey=c_custkey""")
def tab_counts(spark, sf):
    by_link = shop_pages(spark, sf).select("page_id", B.tab_counts_by_link("html").alias("t")).select(
        "page_id", F.col("t.newsCount").alias("by_link_news"), F.col("t.commentsCount").alias("by_link_comments"),
        F.col("t.backersCount").alias("by_link_backers"))
    by_label = state_pages(spark, sf).select("page_id", B.tab_counts_by_label("html").alias("t")).select(
        "page_id", F.col("t.comments").alias("by_label_comments"))
    return by_link.join(by_label, "page_id")


# --------------------------------------------------------------------------
# Envelopes and link lists
# --------------------------------------------------------------------------
@query("read_snapshot", """SELECT event_id, i AS part, event_type AS status, value FROM events, range(2) t(i)""")
def read_snapshot(spark, sf):
    """Envelopes with two items each, rendered from the events and read back."""
    items = F.array(*[F.struct("event_id", F.lit(i).alias("part"), F.col("event_type").alias("status"), "value")
                      for i in range(2)])
    made = table(spark, sf, "events").select(
        F.to_json(F.struct(F.lit(True).alias("final"), items.alias("items"))).alias("envelope"))
    return A.snapshot_items(made, "envelope", "event_id bigint, part bigint, status string, value double")


@query("read_table", """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity),6)+0.0 AS qty FROM lineitem GROUP BY 1""")
def read_table(spark, sf):
    lines = A.read_table(spark, f"{sf}/lineitem.parquet")
    return lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("l_quantity")).alias("qty"))


def _item(col):
    return U.normalize_item_url(col, "example.com", section="en", min_parts=2)


_LISTS = "regexp_replace(regexp_replace(url,'[?#].*$',''),'/+$','')"
_LIST_OK = "regexp_matches(url,'^[a-z]+://[^/?#]*example\\.com/en/[^/?#]')"


def _link_texts(spark, sf):
    url = F.col("url")
    text = (
        F.when(F.col("page_id") % 3 == 0, F.to_json(F.array(url, F.lit("javascript:x"))))
        .when(F.col("page_id") % 3 == 1, F.to_json(F.struct(F.array(url, url).alias("projectUrls"))))
        .otherwise(F.to_json(F.struct(F.array(F.struct(
            url.alias("url"), F.array(F.lit("live"), F.lit("live"), F.lit("new")).alias("states"))).alias("projectStates")))))
    return pages(spark, sf).select("page_id", text.alias("value"))


@query("read_link_list", f"SELECT DISTINCT {_LISTS} AS url FROM pages WHERE {_LIST_OK}")
def read_link_list(spark, sf):
    return A.link_list(_link_texts(spark, sf), "value", _item)


@query("link_states", f"SELECT {_LISTS} AS url, 'live,new' AS states FROM pages WHERE {_LIST_OK} AND page_id%3=2")
def link_states(spark, sf):
    return A.link_states(_link_texts(spark, sf), "value", _item).select("url", F.array_join("states", ",").alias("states"))


_FOUND = "f AS (SELECT event_type AS state, 'https://shop.example/u/' || user_id AS url FROM events)"


def _found(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("state"), F.concat(F.lit("https://shop.example/u/"), "user_id").alias("url"))


@query("merge_link_states", f"WITH {_FOUND} SELECT url, string_agg(DISTINCT state, ',' ORDER BY state) AS states FROM f GROUP BY 1")
def merge_link_states(spark, sf):
    return B.merge_link_states(_found(spark, sf)).select("url", F.array_join("states", ",").alias("states"))


@query("state_totals", f"""WITH {_FOUND} SELECT state, count(DISTINCT url) AS "totalProjects" FROM f GROUP BY 1""")
def state_totals(spark, sf):
    return B.state_totals(_found(spark, sf))


@query("attach_states", f"""WITH {_FOUND}, s AS (SELECT url, string_agg(DISTINCT state, ',' ORDER BY state) AS states
  FROM f GROUP BY 1)
SELECT o_orderkey AS id, coalesce(states,'') AS states FROM orders
LEFT JOIN s ON s.url = 'https://shop.example/u/' || o_custkey""")
def attach_states(spark, sf):
    states = B.merge_link_states(_found(spark, sf))
    recs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("https://shop.example/u/"), "o_custkey").alias("sourceUrl"))
    return B.attach_states(recs, states).select("id", F.array_join("discoveredStates", ",").alias("states"))
