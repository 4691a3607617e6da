"""Stored pages to campaign records.

Two page families are supported. The first embeds its state as JSON after
``window.INITIAL_STATE =``; the second shows its figures in marked-up elements
and keeps rewards in a script object. Both end in the same nested record.

HTML is read with regular expressions over the stored source, not with a DOM:
an element's text runs to the next closing tag of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import as_column, bind, html_unescape
from .lookup import lookup_join

# ---------------------------------------------------------------------------
# Markers, field names and class names of the page formats.
# ---------------------------------------------------------------------------
STATE_MARKER = "window.INITIAL_STATE ="

META_FIELDS = {
    "description": ("name", "description"),
    "ogTitle": ("property", "og:title"),
    "ogDescription": ("property", "og:description"),
    "ogImage": ("property", "og:image"),
}
META_FIELDS_WIDE = META_FIELDS | {
    "ogUrl": ("property", "og:url"),
    "twitterPlayer": ("property", "twitter:player"),
    "twitterPlayerStream": ("property", "twitter:player:stream"),
    "twitterPlayerStreamContentType": ("property", "twitter:player:stream:content_type"),
}

REWARD_TEXT_FIELDS = [
    "id", "fid", "name", "description", "descriptionHtml", "imageUrl", "priceForOne", "purchaseCount", "amount",
    "remaining", "available", "deliveryInfo", "pickupInfo", "pickupAddress", "estimatedDeliveryDate",
    "deliveryAvailable", "pickupAvailable", "rewardInstruction",
]
REWARD_NUMBERS = ["purchaseCount", "amount", "remaining"]
REWARD_FLAGS = ["available", "deliveryAvailable", "pickupAvailable"]
DONATE_FIELDS = ["id", "fid", "name", "descriptionHtml", "purchaseCount", "imageUrl"]

CARD_TEXT_FIELDS = {
    "fid": "fid", "alias": "alias", "title": "name", "subtitle": "shortDescription", "status": "status",
    "targetStatus": "targetStatus", "startAt": "startAt", "finishAt": "finishAt", "region": "region",
    "additionalInfo": "additionalInfo",
}
CARD_NUMBER_FIELDS = ["progressInPercent", "purchaseCount", "daysToFinish", "ageLimit"]

TAB_LABELS = {
    "news": r"(?iu)новост[ьи][^\d]{0,10}(\d+)",
    "comments": r"(?iu)комментар[^\d]{0,10}(\d+)",
    "participants": r"(?iu)участник[^\d]{0,10}(\d+)",
}
TAB_LINKS = {"newsCount": "/posts", "commentsCount": "/comments", "backersCount": "/backers"}

#: Field, then the class names that lead to its element, outermost first.
ELEMENT_FIELDS = {
    "title": ["title"],
    "subtitle": ["blurb"],
    "location": ["main-extra-info", "location"],
    "category": ["main-extra-info", "category"],
    "creatorName": ["creator", "name"],
    "fundedNowText": ["money-backed", "backed-now"],
    "fundedTargetText": ["money-backed", "backed-target"],
    "backersText": ["backers-now"],
    "timeLeftText": ["time-left"],
    "progressPercentText": ["progress", "percentage"],
    "timerText": ["progress", "timer"],
}
SHOP_REWARD_FIELDS = [
    "id", "title", "description", "photo", "amount", "limit", "backings_count", "estimated_delivery", "delivery",
    "is_deliverable", "is_popular", "is_sold_out", "is_active", "reward_path",
]
FRAME_VIDEO_HOSTS = r"(?i)(?:youtube\.com|youtu\.be|vimeo\.com|rutube\.ru|video)"
# ---------------------------------------------------------------------------


def _or_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def _struct_of(fields: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


# --------------------------------------------------------------------------
# Markup readers
# --------------------------------------------------------------------------
def _attribute(tag_pattern: str, html: Column, attribute: str) -> Column:
    """First value of an attribute on the first tag that fits, as written."""
    opened = F.regexp_extract(html, f"(?is)<{tag_pattern}[^>]*>", 0)

    def value(tag: Column) -> Column:
        double = F.regexp_extract(tag, rf'(?is)\s{attribute}\s*=\s*"([^"]*)"', 1)
        single = F.regexp_extract(tag, rf"(?is)\s{attribute}\s*=\s*'([^']*)'", 1)
        return F.when(tag != "", F.coalesce(_or_null(double), _or_null(single)))

    return bind(opened, value)


def meta_content(html, kind: str, name: str) -> Column:
    """``content`` of the meta tag whose ``kind`` attribute equals ``name``."""
    return html_unescape(_meta_source(as_column(html), kind, name))


def _meta_source(html: Column, kind: str, name: str) -> Column:
    return _attribute(rf'meta(?=[^>]*\s{kind}\s*=\s*["\']{name}["\'])', html, "content")


def _title_source(html: Column) -> Column:
    return _or_null(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def _canonical_source(html: Column) -> Column:
    return _attribute(r'link(?=[^>]*\srel\s*=\s*["\']canonical["\'])', html, "href")


def meta_fields(html, fields: dict[str, tuple[str, str]] = META_FIELDS) -> Column:
    sources = F.array(*[_meta_source(as_column(html), kind, name) for kind, name in fields.values()])
    return bind(F.transform(sources, html_unescape), lambda a: _struct_of(
        {n: F.get(a, F.lit(i)) for i, n in enumerate(fields)}))


def page_title(html) -> Column:
    return U.clean_ws(html_unescape(_title_source(as_column(html))))


def canonical_url(html, base) -> Column:
    return U.normalize_url(html_unescape(_canonical_source(as_column(html))), base)


def tag_links(html, tags: list[str], attribute: str) -> Column:
    """Links of an attribute on the given tags, as written, in page order."""
    found = F.regexp_extract_all(
        as_column(html),
        F.lit(rf"(?is)<(?:{'|'.join(tags)})\b[^>]*?\s{attribute}\s*=\s*(?:\"([^\">]*)\"|'[^'>]*')"), F.lit(0))
    # The ampersand is decoded when the link is normalised.
    return F.transform(found, lambda t: F.regexp_extract(t, rf"(?is)\s{attribute}\s*=\s*[\"']([^\"']*)[\"']$", 1))


def tag_urls(html, tags: list[str], attribute: str, base) -> Column:
    """Normalised links of an attribute on the given tags."""
    return U.normalize_all(tag_links(html, tags, attribute), base)


def page_meta(df: DataFrame, html_col: str, url_col: str, wide: bool = False) -> DataFrame:
    """Title, canonical link, meta tags and media links of each page.

    All texts are decoded by one expression and all links normalised by one,
    which keeps the plan small.
    """
    html, base, tags = F.col(html_col), F.col(url_col), F.col("__tags")
    fields = META_FIELDS_WIDE if wide else META_FIELDS
    sources = [_title_source(html), _canonical_source(tags), *[_meta_source(tags, k, n) for k, n in fields.values()]]
    lists = [tag_links(tags, ["img"], "src"), tag_links(tags, ["video", "source"], "src"),
             tag_links(tags, ["iframe"], "src"), tag_links(tags, ["a"], "href")]
    # The page is searched once for the tags that are read; none of their patterns goes beyond a tag's end.
    found = F.regexp_extract_all(html, F.lit(r"(?is)<(?:meta|link|(?:img|video|source|iframe|a)\b)[^>]*+>?"), F.lit(0))
    staged = df.withColumn("__tags", F.array_join(found, "")).withColumns({
        "__texts": F.transform(F.array(*sources), html_unescape),
        "__links": F.transform(F.array(*lists), lambda urls: U.normalize_all(urls, base)),
    })
    frames = F.get("__links", F.lit(2))
    if not wide:
        frames = F.filter(frames, lambda u: u.rlike(FRAME_VIDEO_HOSTS))
    return staged.withColumns({
        "pageTitle": U.clean_ws(F.get("__texts", F.lit(0))),
        "canonicalUrl": U.normalize_url(F.get("__texts", F.lit(1)), base),
        "meta": _struct_of({n: F.get("__texts", F.lit(i)) for i, n in enumerate(fields, 2)}),
        "domImages": F.get("__links", F.lit(0)),
        "domVideos": F.array_union(F.get("__links", F.lit(1)), frames),
        "anchorLinks": F.get("__links", F.lit(3)),
    }).drop("__texts", "__links", "__tags")


def element_html(html, classes: list[str], tag: str = r"[a-z0-9]+") -> Column:
    """Inner source of the first element with the last class, inside the first elements with the classes before it.

    Elements are read by structure: one ends where as many tags of its name have closed as have opened in it. In a source
    that never gets there it ends at the next closing tag of its name.
    """
    text = as_column(html)
    for i, cls in enumerate(classes):
        text = _element(text, cls, tag if i == len(classes) - 1 else r"[a-z0-9]+")
    return text


def _element(text: Column, cls: str, tag: str) -> Column:
    opened = F.regexp_extract(text, rf'(?is)<{tag}\b[^>]*\sclass\s*=\s*["\'](?:[^"\']*\s)?{cls}(?:\s[^"\']*)?["\'][^>]*>.*$', 0)

    def inside(source: Column) -> Column:
        name = F.regexp_extract(source, "(?i)^<([a-z0-9]+)", 1)
        # The source from tag to tag of this name; every part begins with one.
        parts = F.split(source, F.concat(F.lit("(?i)(?=</?"), name, F.lit(r"\b)")))
        return F.when(source != "", bind(parts, _balanced)).otherwise(source)

    return bind(opened, inside)


def _balanced(parts: Column) -> Column:
    closes = lambda part: part.startswith("</")
    number = lambda n: F.lit(n).cast("int")

    def step(state: Column, part: Column) -> Column:
        depth = state["depth"] + F.when(closes(part), number(-1)).otherwise(number(1))
        return F.struct(depth.alias("depth"), (state["at"] + number(1)).alias("at"),
                        F.when((state["end"] < 0) & (depth <= 0), state["at"]).otherwise(state["end"]).alias("end"))

    start = F.struct(number(0).alias("depth"), number(0).alias("at"), number(-1).alias("end"))
    first = F.array_position(F.transform(parts, closes), F.lit(True)).cast("int") - 1
    found = bind(F.aggregate(parts, start, step, lambda s: s["end"]), lambda end: F.when(end >= 0, end).otherwise(first))
    return bind(found, lambda end: F.when(
        end > 0, F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), end), ""), F.lit("^<[^>]*>"), F.lit(""))).otherwise(F.lit("")))


def element_text(html, classes: list[str], tag: str = r"[a-z0-9]+") -> Column:
    return _inner_text(element_html(html, classes, tag))


def _inner_text(source: Column) -> Column:
    return U.clean_ws(html_unescape(F.regexp_replace(source, F.lit("<[^>]*>"), F.lit(""))))


def tab_counts_by_label(html, labels: dict[str, str] = TAB_LABELS) -> Column:
    """Number after a label anywhere in the page's text; tags between the two do not part them. The first wins."""
    text = F.regexp_replace(as_column(html), F.lit("<[^<>]*>"), F.lit(" "))
    return bind(text, lambda t: _struct_of({
        name: F.regexp_extract(t, pattern, 1).try_cast("double") for name, pattern in labels.items()
    }))


def tab_counts_by_link(html, links: dict[str, str] = TAB_LINKS) -> Column:
    """Number inside the tab anchor whose target holds a part; 0 if it shows none, null without the tab."""
    html = as_column(html)

    def count(part: str) -> Column:
        pattern = rf'(?is)<a\b[^>]*\shref\s*=\s*["\'][^"\']*{part}[^"\']*["\'][^>]*>(.*?)</a\s*>'
        shown = F.regexp_replace(F.regexp_extract(html, pattern, 1), F.lit("<[^>]*>"), F.lit(" "))
        return F.when(html.rlike(pattern), F.coalesce(U.parse_int(shown), F.lit(0.0)))

    return _struct_of({name: count(part) for name, part in links.items()})


# --------------------------------------------------------------------------
# Embedded state
# --------------------------------------------------------------------------
def extract_state_json(html, marker: str = STATE_MARKER) -> Column:
    """Top-level entries of the embedded state as ``map<string,string>``, null if it does not parse.

    The parser stops after the first complete object, so code behind it is ignored.
    """
    escaped = marker.replace(".", r"\.")
    text = F.regexp_extract(as_column(html), rf"(?s){escaped}[^{{]*+(\{{.*)$", 1)
    return F.from_json(_or_null(text), "map<string,string>")


def find_blocks(state) -> Column:
    """The first state value shaped like a campaign, a description, rewards and counters."""
    objects = F.filter(F.map_values(as_column(state)), lambda v: v.startswith("{"))
    parsed = F.transform(objects, lambda v: F.struct(v.alias("text"), F.try_parse_json(v).alias("json")))
    return bind(parsed, _first_blocks)


def _first_blocks(values: Column) -> Column:

    def kind(value: Column, path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(value["json"], path, "variant")), F.lit(""))

    def first(*tests) -> Column:
        def fits(value: Column) -> Column:
            out = tests[0](value)
            for test in tests[1:]:
                out = out & test(value)
            return out
        return F.get(F.filter(values, fits), F.lit(0))["text"]

    def mentions(key: str):
        return lambda v: F.contains(v["text"], F.lit(f'"{key}"'))

    number = r"^(?:BIGINT|DOUBLE|DECIMAL|FLOAT)"
    campaign = first(
        mentions("campaignId"),
        lambda v: kind(v, "$.campaignId").rlike(number), lambda v: kind(v, "$.name") == "STRING",
        lambda v: kind(v, "$.collectedAmount").startswith("OBJECT"),
        lambda v: kind(v, "$.targetAmount").startswith("OBJECT"))
    description = first(
        mentions("version"),
        lambda v: kind(v, "$.description") == "STRING", lambda v: kind(v, "$.version") == "STRING")
    rewards = first(
        mentions("rewards"),
        lambda v: kind(v, "$.donate") != "", lambda v: kind(v, "$.rewards").startswith("ARRAY"))
    counters = first(
        mentions("total"),
        lambda v: kind(v, "$.total").startswith("OBJECT"),
        lambda v: (kind(v, "$.total.newsCount") != "") | (kind(v, "$.total.commentsCount") != "")
        | (kind(v, "$.total.backersCount") != ""))
    return _struct_of({
        "campaign": campaign, "descriptionBlock": description, "rewardsBlock": rewards, "countersBlock": counters})


# --------------------------------------------------------------------------
# Rewards
# --------------------------------------------------------------------------
def map_rewards(block, base) -> Column:
    """The ``rewards`` array of a block as typed structs with absolute image links."""
    schema = "array<struct<" + ",".join(f"`{f}`:string" for f in REWARD_TEXT_FIELDS) + ">>"
    items = F.from_json(F.get_json_object(as_column(block), "$.rewards"), schema)
    base = as_column(base)

    def typed(r: Column) -> Column:
        fields = {f: r[f] for f in REWARD_TEXT_FIELDS}
        fields |= {f: U.number_or_null(r[f]) for f in REWARD_NUMBERS}
        fields |= {f: r[f].try_cast("boolean") for f in REWARD_FLAGS}
        fields["imageUrl"] = U.normalize_url(r["imageUrl"], base)
        return _struct_of(fields)

    return F.coalesce(F.transform(items, typed), F.array())


def map_donate(block, base) -> Column:
    """The free-donation entry of a rewards block, null without one."""
    donate = F.get_json_object(as_column(block), "$.donate")
    fields = {f: F.get_json_object(donate, f"$.{f}") for f in DONATE_FIELDS}
    fields["purchaseCount"] = U.number_or_null(fields["purchaseCount"])
    fields["imageUrl"] = U.normalize_url(fields["imageUrl"], base)
    return F.when(donate.startswith("{"), _struct_of(fields))


def map_shop_rewards(json, base) -> Column:
    """Reward objects of the second family: numbers may be texts, links become absolute."""
    schema = "array<struct<" + ",".join(f"`{f}`:string" for f in SHOP_REWARD_FIELDS) + ">>"
    base = as_column(base)

    def number(col: Column) -> Column:
        return F.coalesce(U.number_or_null(col), U.parse_int(col))

    def typed(r: Column) -> Column:
        return _struct_of({
            "id": r["id"], "title": r["title"], "description": r["description"],
            "imageUrl": U.normalize_url(r["photo"], base), "amount": number(r["amount"]),
            "limit": number(r["limit"]), "backingsCount": number(r["backings_count"]),
            "estimatedDelivery": U.clean_ws(r["estimated_delivery"]), "delivery": U.clean_ws(r["delivery"]),
            "isDeliverable": r["is_deliverable"].try_cast("boolean"),
            "isPopular": r["is_popular"].try_cast("boolean"),
            "isSoldOut": r["is_sold_out"].try_cast("boolean"),
            "isActive": r["is_active"].try_cast("boolean"),
            "rewardPath": U.normalize_url(r["reward_path"], base),
        })

    return F.coalesce(F.transform(F.from_json(as_column(json), schema), typed), F.array())


# --------------------------------------------------------------------------
# Records
# --------------------------------------------------------------------------
def _no_nulls(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda u: u.isNotNull())


def _union(*arrays: Column) -> Column:
    """Distinct union of arrays in order, null arrays as empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(a, empty) for a in arrays]))


def _joined(rewards: Column, field: str) -> Column:
    return F.array_join(F.transform(rewards, lambda r: F.coalesce(r[field], F.lit(""))), "\n")


def _links_of_lists(lists: dict[str, Column], base: Column, **kinds) -> Column:
    """Lists of links as written to a struct of classified lists, by one expression."""
    empty = F.array().cast("array<string>")
    done = F.transform(
        F.array(*[F.coalesce(c, empty) for c in lists.values()]),
        lambda urls: U.classify_urls(U.normalize_all(urls, base), **kinds))
    return bind(done, lambda d: _struct_of({n: F.get(d, F.lit(i)) for i, n in enumerate(lists)}))


def _links_of(singles: dict[str, Column], base: Column) -> Column:
    """Single links as written to a struct of normalised links, by one expression."""
    return bind(U.normalize_each(F.array(*singles.values()), base), lambda d: _struct_of(
        {n: F.get(d, F.lit(i)) for i, n in enumerate(singles)}))


def build_records(df: DataFrame, html_col: str, url_col: str, scraped_at: Column | None = None) -> DataFrame:
    """Nested records from pages with an embedded state; pages without a campaign become error rows."""
    base = F.col(url_col)
    staged = page_meta(df.select(html_col, url_col), html_col, url_col)
    staged = staged.withColumn("state", extract_state_json(html_col)).withColumn(
        "b", find_blocks("state")).withColumns({
        "tabs": tab_counts_by_label(html_col),
        "c": F.col("b.campaign"), "d": F.col("b.descriptionBlock"),
        "r": F.col("b.rewardsBlock"), "k": F.col("b.countersBlock"),
    })

    def campaign(field: str) -> Column:
        return F.get_json_object("c", f"$.{field}")

    staged = staged.withColumns({
        "html_text": F.get_json_object("d", "$.description"),
        "items": map_rewards("r", base), "donate": map_donate("r", base),
        "one": _links_of({"img": campaign("imageUrl"), "view": campaign("viewImageUrl"),
                          "vid": campaign("videoUrl"), "og": F.col("meta.ogImage")}, base),
        "link_map": F.from_json(campaign("links"), "map<string,string>"),
    }).withColumn("many", _links_of_lists({
        "own": F.map_values("link_map"), "text": U.find_links("html_text"),
        "rewards": U.find_links(_joined(F.col("items"), "descriptionHtml")),
        "state": U.find_json_links(F.concat_ws("\n", F.col("c"), F.col("r"), F.col("d"))),
    }, base))
    images = _union(
        _no_nulls(F.col("one.img"), F.col("one.view"), F.col("one.og")),
        F.filter(F.transform("items", lambda i: i["imageUrl"]), lambda u: u.isNotNull()),
        F.col("many.text.imageUrls"), F.col("many.rewards.imageUrls"), F.col("many.state.imageUrls"), F.col("domImages"))
    videos = _union(
        _no_nulls(F.col("one.vid")), F.col("many.text.videoUrls"), F.col("many.rewards.videoUrls"),
        F.col("many.state.videoUrls"), F.col("domVideos"))
    own = _union(F.col("many.own.imageUrls"), F.col("many.own.videoUrls"), F.col("many.own.otherUrls"))
    links = _union(own, F.col("many.text.otherUrls"), F.col("many.rewards.otherUrls"), F.col("many.state.otherUrls"))
    staged = staged.withColumns({"imageUrls": images, "videoUrls": videos}).withColumn(
        "externalLinks", F.array_except(F.array_except(links, F.col("imageUrls")), F.col("videoUrls")))

    def amount(field: str) -> Column:
        return F.struct(U.number_or_null(F.get_json_object("c", f"$.{field}.value")).alias("value"))

    card = {"campaignId": campaign("campaignId").try_cast("bigint")}
    card |= {n: campaign(f) for n, f in CARD_TEXT_FIELDS.items()}
    card |= {f: U.number_or_null(campaign(f)) for f in CARD_NUMBER_FIELDS}
    card |= {
        "collectedAmount": amount("collectedAmount"), "targetAmount": amount("targetAmount"),
        "mainCategory": F.struct(campaign("mainCategory.tagName").alias("tagName")),
        "imageUrl": F.col("one.img"), "viewImageUrl": F.col("one.view"), "videoUrl": F.col("one.vid"),
        "author": F.struct(campaign("author.id").alias("id"),
                           campaign("author.campaignsAmount").try_cast("int").alias("campaignsAmount")),
        "links": F.col("link_map"),
    }

    def total(field: str, tab: str) -> Column:
        return F.coalesce(U.number_or_null(F.get_json_object("k", f"$.total.{field}")), F.col(f"tabs.{tab}"))

    counts = {
        "newsCount": total("newsCount", "news"), "commentsCount": total("commentsCount", "comments"),
        "participantsCount": total("backersCount", "participants"),
        "purchasesCount": U.number_or_null(campaign("purchaseCount")),
    }
    found = F.col("c").isNotNull()
    return staged.select(
        F.when(found, "ok").otherwise("error").alias("status"),
        base.alias("sourceUrl"), F.when(found, base).alias("finalUrl"),
        (F.current_timestamp() if scraped_at is None else scraped_at).cast("string").alias("scrapedAt"),
        F.when(~found, "no campaign in the embedded state").alias("error"),
        "pageTitle", "canonicalUrl", "meta", _struct_of(card).alias("card"),
        _struct_of({"version": F.get_json_object("d", "$.version"), "html": F.col("html_text"),
                    "text": U.strip_html("html_text")}).alias("description"),
        _struct_of(counts).alias("counts"),
        _struct_of({"donate": F.col("donate"), "totalRewards": F.size("items"), "items": F.col("items")}).alias("rewards"),
        _struct_of({n: F.col(n) for n in ("imageUrls", "videoUrls", "externalLinks")}).alias("media"),
        _struct_of({"campaign": F.col("c"), "descriptionBlock": F.col("d"), "rewardsBlock": F.col("r"),
                    "countersBlock": F.col("k")}).alias("raw"))


def build_shop_records(
    df: DataFrame, html_col: str, url_col: str, host: str | None = None,
    description_classes: tuple[str, ...] = ("description",), scraped_at: Column | None = None,
) -> DataFrame:
    """Nested records from pages of the second family; pages without a title become error rows."""
    shown = ELEMENT_FIELDS | {"creatorProjectsInfo": ["creator", "achivements-v2"]}
    plain = {"attributes": ["href", "src", "poster", "data-src"], "protocol_relative": False}
    staged = page_meta(df.select(html_col, url_col), html_col, url_col, wide=True)
    own = F.col(url_col) if host is None else F.coalesce(U.normalize_item_url(url_col, host), F.col(url_col))
    staged = staged.withColumns({
        "base": F.regexp_replace(own, F.lit(r"/+$"), F.lit("")),
        "tabs": tab_counts_by_link(html_col),
        "html_text": _or_null(element_html(html_col, list(description_classes))),
        "project": F.regexp_extract(F.col(html_col), r"(?s)gon\.Project\s*=\s*(\{.*)$", 1),
        "reward_json": F.regexp_extract(F.col(html_col), r"(?s)gon\.Rewards\s*=\s*(\[.*?\])\s*(?:;|</script)", 1),
        "texts": F.transform(F.array(*[
            element_html(html_col, classes, "h1" if name == "title" else r"[a-z0-9]+")
            for name, classes in shown.items()]), _inner_text),
    }).withColumns({name: F.get("texts", F.lit(i)) for i, name in enumerate(shown)})
    base = F.col("base")

    def inner_image(classes: list[str]) -> Column:
        block = element_html(html_col, classes)
        return _or_null(F.regexp_extract(block, r'(?is)<img\b[^>]*\ssrc\s*=\s*["\']([^"\']+)', 1))

    staged = staged.withColumns({
        "items": map_shop_rewards("reward_json", base),
        "one": _links_of({
            "main": inner_image(["video-wrapper"]), "avatar": inner_image(["creator", "avatar"]),
            "og": F.col("meta.ogImage"), "player": F.col("meta.twitterPlayer"),
            "stream": F.col("meta.twitterPlayerStream")}, base),
    }).withColumn("many", _links_of_lists({
        "text": U.find_links("html_text", **plain),
        "rewards": U.find_links(_joined(F.col("items"), "description"), **plain),
    }, base, encoded=False, extra_hosts=["twitter:player"])).withColumns({
        "imageUrls": _union(
            _no_nulls(F.col("one.main"), F.col("one.og")),
            F.filter(F.transform("items", lambda i: i["imageUrl"]), lambda u: u.isNotNull()),
            F.col("many.text.imageUrls"), F.col("domImages")),
        "videoUrls": _union(
            _no_nulls(F.col("one.player"), F.col("one.stream")), F.col("many.text.videoUrls"), F.col("domVideos")),
    })
    links = _union(F.col("anchorLinks"), F.col("many.text.otherUrls"), F.col("many.rewards.otherUrls"))
    fragments = F.array_distinct(F.concat(U.date_like_strings("timerText"), U.date_like_strings("timeLeftText")))
    card = {
        "projectId": F.get_json_object("project", "$.id"), "creatorId": F.get_json_object("project", "$.creator_id"),
        "projectType": F.get_json_object("project", "$.type"),
        **{n: F.col(n) for n in ("title", "subtitle", "location", "category", "creatorName")},
        "creatorAvatar": F.col("one.avatar"), "creatorProjectsInfo": F.col("creatorProjectsInfo"),
        "fundedNow": U.parse_int("fundedNowText"),
        "fundedTarget": F.get(U.parse_all_ints("fundedTargetText"), F.lit(0)),
        "fundedNowText": F.col("fundedNowText"), "fundedTargetText": F.col("fundedTargetText"),
        "progressPercent": U.parse_percent("progressPercentText"),
        **{n: F.col(n) for n in ("progressPercentText", "backersText", "timeLeftText", "timerText")},
        "dateLikeStrings": fragments, "mainImageUrl": F.col("one.main"),
    }
    counts = {
        "newsCount": F.col("tabs.newsCount"), "commentsCount": F.col("tabs.commentsCount"),
        "participantsCount": F.coalesce("tabs.backersCount", U.parse_int("backersText")),
    }
    found = F.col("title").isNotNull()
    return staged.select(
        F.when(found, "ok").otherwise("error").alias("status"),
        F.col(url_col).alias("sourceUrl"), F.when(found, base).alias("finalUrl"),
        (F.current_timestamp() if scraped_at is None else scraped_at).cast("string").alias("scrapedAt"),
        F.when(~found, "no title element").alias("error"),
        "pageTitle", "canonicalUrl", "meta", _struct_of(card).alias("card"),
        _struct_of({"html": F.col("html_text"), "text": U.strip_html("html_text")}).alias("description"),
        _struct_of(counts).alias("counts"),
        _struct_of({"totalRewards": F.size("items"), "items": F.col("items")}).alias("rewards"),
        _struct_of({"imageUrls": F.col("imageUrls"), "videoUrls": F.col("videoUrls"),
                    "externalLinks": F.array_except(F.array_except(links, F.col("imageUrls")), F.col("videoUrls")),
                    }).alias("media"),
        _struct_of({"gonProject": F.col("project"), "gonRewards": F.col("reward_json")}).alias("raw"))


def reward_table(records: DataFrame) -> DataFrame:
    """One row per reward with its page; pages without rewards keep one empty row."""
    return records.select("sourceUrl", F.explode_outer("rewards.items").alias("reward")).select("sourceUrl", "reward.*")


# --------------------------------------------------------------------------
# Listing states
# --------------------------------------------------------------------------
def merge_link_states(links: DataFrame, url_col: str = "url", state_col: str = "state") -> DataFrame:
    """Per link the sorted set of listing states it was found under."""
    return links.where(F.col(url_col).isNotNull()).groupBy(url_col).agg(
        F.sort_array(F.collect_set(state_col)).alias("states"))


def state_totals(links: DataFrame, url_col: str = "url", state_col: str = "state") -> DataFrame:
    """Per state its number of distinct links."""
    return links.where(F.col(url_col).isNotNull()).select(state_col, url_col).distinct().groupBy(state_col).agg(
        F.count(F.lit(1)).alias("totalProjects"))


def attach_states(records: DataFrame, states: DataFrame, url_col: str = "sourceUrl") -> DataFrame:
    """Add ``discoveredStates`` by link; links never listed get an empty array."""
    side = states.select(F.col("url").alias(url_col), F.col("states").alias("discoveredStates"))
    joined = lookup_join(records, side, [url_col], "left")
    return joined.withColumn("discoveredStates", F.coalesce("discoveredStates", F.array().cast("array<string>")))
