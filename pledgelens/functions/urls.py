"""URL, HTML and number-in-text expressions for page extraction, all row-local.

White space here follows browser rules, which add the byte-order mark to the
Unicode spaces. URLs are resolved by regular expressions: scheme and host are
lower-cased, default ports dropped, dot segments folded and unsafe characters
percent-encoded. International host names are kept as written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, bind, regex_replace

#: Inside of a character class: white space by browser rules.
PAGE_SPACE = (
    r"\t-\r\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)

# ---------------------------------------------------------------------------
# Attribute names, file extensions and hosts that decide what a
# URL is.
# ---------------------------------------------------------------------------
URL_ATTRIBUTES = ["src", "href", "poster", "image", "data-src"]
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "gif", "bmp", "svg", "avif"]
VIDEO_EXTENSIONS = ["mp4", "webm", "mov", "m3u8"]
VIDEO_HOSTS = [r"youtube\.com", r"youtu\.be", r"vimeo\.com", r"rutube\.ru", "vkvideo", "/video/"]
# ---------------------------------------------------------------------------


_PAGE_SPACE_CHARS = "".join(map(chr, [
    *range(0x9, 0xE), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def page_trim(col) -> Column:
    return F.btrim(as_column(col), F.lit(_PAGE_SPACE_CHARS))


def squeeze_page(col) -> Column:
    return F.trim(regex_replace(
        col, f"(?![!-~])(?:[{PAGE_SPACE}&&[^ ]][{PAGE_SPACE}]*+| [{PAGE_SPACE}]++)", " "))


def clean_ws(col) -> Column:
    """Collapse white space, strip, and turn an empty text into null."""
    return F.nullif(squeeze_page(col), F.lit(""))


def strip_html(col) -> Column:
    """Visible text: styles, scripts and tags out, six entities decoded in order."""
    text = regex_replace(col, r"(?is)<style.*?</style>", " ")
    text = regex_replace(text, r"(?is)<script.*?</script>", " ")
    text = regex_replace(text, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = regex_replace(text, f"(?i){entity}", char)
    return clean_ws(text)


# --------------------------------------------------------------------------
# URL normalisation
# --------------------------------------------------------------------------
def _percent_encode(text: Column) -> Column:
    """Encode blanks, quotes, angle brackets and non-ASCII characters in a path or query."""
    unsafe = r'[^!-~]|["<>`{}]'
    pieces = F.regexp_extract_all(text, F.lit(r'(?:[!-~&&[^"<>`{}]])+|(?:[^!-~]|["<>`{}])+'), F.lit(0))
    encoded = F.array_join(F.transform(
        pieces, lambda p: F.when(p.rlike(unsafe), F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))).otherwise(p)), "")
    return F.when(text.rlike(unsafe), encoded).otherwise(text)


def _fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(path, "/", -1)
    body = F.slice(parts, F.lit(2), F.size(parts))
    kept = F.aggregate(
        body, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(p == ".", acc).otherwise(F.array_append(acc, p)))
    last = F.element_at(parts, -1)
    tail = F.when(last.isin(".", ".."), "/").otherwise("")
    folded = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, tail).otherwise(""))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), folded).otherwise(path)


_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
_WEB = r"^[a-zA-Z]+:[/\\]*([^/?#\\]*)([^?#]*)((?s).*)$"


def _resolve(url: Column, base: Column | None) -> Column:
    """A trimmed link with its scheme, host and path filled in from the base."""
    dropped = (url == "") | url.startswith("javascript:") | url.startswith("data:")
    relative = F.lit(None).cast("string")
    if base is not None:
        origin = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
        path = F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
        folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/((?:[^/]*/)*)", 1))
        relative = F.when(
            origin != "",
            F.when(url.startswith("/"), F.concat(origin, url))
            .when(url.startswith("?"), F.concat(origin, path, url))
            .when(url.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), url))
            .otherwise(F.concat(origin, folder, url)))
    return (
        F.when(dropped, None)
        .when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .when(url.rlike(_SCHEME), url)
        .otherwise(relative)
    )


def _split_url(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    return F.struct(
        url.alias("url"), scheme.alias("scheme"), F.lower(F.regexp_extract(url, _WEB, 1)).alias("host"),
        F.regexp_extract(url, _WEB, 2).alias("path"), F.regexp_extract(url, _WEB, 3).alias("query"))


def _join_url(u: Column) -> Column:
    scheme = u["scheme"]
    host = F.when(scheme == "https", regex_replace(u["host"], ":443$", "")).when(
        scheme == "http", regex_replace(u["host"], ":80$", "")).otherwise(u["host"])
    valid = (u["host"] != "") & ~u["host"].rlike(r"[\s<>^|%]") & ~u["host"].startswith(":")
    return (
        F.when(scheme.isin("http", "https", "ws", "wss", "ftp"),
               F.when(valid, F.concat(scheme, F.lit("://"), host, u["path"], u["query"])))
        .when(scheme != "", F.concat(scheme, F.substring(u["url"], F.length(scheme) + 1, F.length(u["url"]))))
    )


#: Links that are their own normal form: no upper case or port in the host, no dot segments, nothing to encode.
_TIDY = (r'^https?://[a-z0-9_-]+(?:\.[a-z0-9_-]+)*+(?:/(?!\.)[!-~&&[^"<>`{}?#/\\]]*+)++'
         r'(?:[?#][!-~&&[^"<>`{}]]*+)?\z')


def _tidied(url: Column) -> Column:
    """The normal form of a resolved link."""
    made = bind(bind(bind(url, _split_url), _tidy_path), _join_url)
    return F.when(url.rlike(_TIDY), url).otherwise(made)


def _tidy_path(u: Column) -> Column:
    path = F.when(u["path"].startswith("/"), u["path"]).otherwise(F.concat(F.lit("/"), u["path"]))
    return u.withField("path", _percent_encode(_fold_dots(path))).withField("query", _percent_encode(u["query"]))


def _normalize_array(urls: Column, base: Column | None) -> Column:
    # Each stage binds its input once, so no sub-expression is evaluated twice.
    trimmed = F.transform(urls, lambda u: F.replace(page_trim(u), F.lit("&amp;"), F.lit("&")))
    return F.transform(F.transform(trimmed, lambda u: _resolve(u, base)), _tidied)


def normalize_url(col, base=None) -> Column:
    """Absolute form of a link, or null for empty, script and data links.

    Relative links need ``base``; without it they give null.
    """
    return F.get(_normalize_array(F.array(as_column(col)), None if base is None else as_column(base)), F.lit(0))


def normalize_each(urls: Column, base=None) -> Column:
    """Every member of an array of links normalised in place; bad links become null."""
    return _normalize_array(urls, None if base is None else as_column(base))


def normalize_all(urls, base=None) -> Column:
    """Normalised, distinct, non-null members of an array of links, order kept."""
    urls = F.array_distinct(as_column(urls))
    done = _normalize_array(urls, None if base is None else as_column(base))
    return F.array_distinct(F.filter(done, lambda u: u.isNotNull()))


def find_links(text, attributes: list[str] = URL_ATTRIBUTES, protocol_relative: bool = True) -> Column:
    """Links as written: in attributes, bare, and, optionally, as ``//host``."""
    stop = f"[^{PAGE_SPACE}\"'<>]"
    # A look at the first letter keeps the scan cheap where no attribute starts.
    first = "".join(sorted({c for a in attributes for c in (a[0].lower(), a[0].upper())}))
    in_tags = rf"(?=[{first}])(?i:{'|'.join(attributes)})[{PAGE_SPACE}]*=[{PAGE_SPACE}]*[\"']([^\"']+)[\"']"

    def find(t: Column) -> Column:
        found = [
            F.regexp_extract_all(t, F.lit(in_tags), F.lit(1)),
            F.regexp_extract_all(t, F.lit(rf"(?=[hH])\b(?i:https?)://{stop}+"), F.lit(0)),
        ]
        if protocol_relative:
            found.append(F.regexp_extract_all(t, F.lit(rf"//(?<=[\"'{PAGE_SPACE}(]//){stop}+"), F.lit(0)))
        return F.concat(*found)

    return bind(F.coalesce(as_column(text), F.lit("")), find)


def extract_urls(text, base=None, attributes: list[str] = URL_ATTRIBUTES, protocol_relative: bool = True) -> Column:
    """The links of :func:`find_links`, normalised and distinct."""
    return normalize_all(find_links(text, attributes, protocol_relative), base)


def is_image_url(url: Column, encoded: bool = True) -> Column:
    """Image file by extension, or as an encoded ``url=`` query value."""
    kinds = "|".join(IMAGE_EXTENSIONS)
    plain = url.rlike(rf"(?i)\.(?:{kinds})(?:$|[?#])")
    return plain | url.rlike(rf"(?i)[?&]url=https?%3A%2F%2F[^&]+?\.(?:{kinds})") if encoded else plain


def is_video_url(url: Column, extra_hosts: list[str] = ()) -> Column:
    return url.rlike(rf"(?i)\.(?:{'|'.join(VIDEO_EXTENSIONS)})(?:$|[?#])") | url.rlike(
        "(?i)(?:" + "|".join([*VIDEO_HOSTS, *extra_hosts]) + ")")


def classify_urls(urls, encoded: bool = True, extra_hosts: list[str] = ()) -> Column:
    """``struct<imageUrls, videoUrls, otherUrls>``; the first kind that fits wins."""

    names = ["imageUrls", "videoUrls", "otherUrls"]

    def kind(u: Column) -> Column:
        # A null link is of no kind.
        of = F.when(is_image_url(u, encoded), 0).when(is_video_url(u, extra_hosts), 1).when(u.isNotNull(), 2)
        return F.struct(u.alias("url"), of.alias("kind"))

    def of_kind(found: Column, i: int) -> Column:
        return F.transform(F.filter(found, lambda u: u["kind"] == i), lambda u: u["url"])

    def kinds(found: Column) -> Column:
        return F.struct(*[of_kind(found, i).alias(n) for i, n in enumerate(names)])

    return bind(F.transform(F.array_distinct(as_column(urls)), kind), kinds)


def collect_url_strings(json, base=None) -> Column:
    """Links among the string values of a JSON text.

    A value counts as a link when it has a web scheme or starts with ``//`` or
    ``/``; free text is not resolved into a link.
    """
    return normalize_all(find_json_links(json), base)


def find_json_links(json) -> Column:
    """Link-like string values of a JSON text, as written."""
    text = F.coalesce(as_column(json), F.lit(""))
    return F.regexp_extract_all(text, F.lit(r'"((?:https?:)?//[^"\\]+|/[^"\\]+)"(?!\s*:)'), F.lit(1))


def normalize_item_url(col, host: str, base=None, section: str = "projects", min_parts: int = 3) -> Column:
    """Canonical item link on ``host``: query, hash and closing slashes dropped, else null."""
    url = normalize_url(col, base)
    name = regex_replace(F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1), r":\d+$", "")
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    parts = F.filter(F.split(path, "/", -1), lambda p: p != "")
    fits = name.endswith(host) & (F.get(parts, F.lit(0)) == section) & (F.size(parts) >= min_parts)
    return F.when(fits, regex_replace(regex_replace(url, r"[?#](?s).*$", ""), r"/+$", ""))


# --------------------------------------------------------------------------
# Numbers and dates in text
# --------------------------------------------------------------------------
def number_or_null(col) -> Column:
    """Finite number of a text or number; empty text stays null."""
    value = as_column(col).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


_DIGIT_RUN = rf"[0-9][0-9{PAGE_SPACE}]*"


def parse_int(col) -> Column:
    """The first run of digits, inner blanks removed."""
    run = F.regexp_extract(clean_ws(col), f"({_DIGIT_RUN})", 1)
    return F.nullif(F.replace(run, F.lit(" "), F.lit("")), F.lit("")).try_cast("double")


def parse_all_ints(col) -> Column:
    runs = F.regexp_extract_all(F.coalesce(clean_ws(col), F.lit("")), F.lit(_DIGIT_RUN), F.lit(0))
    return F.transform(runs, lambda r: F.replace(r, F.lit(" "), F.lit("")).try_cast("double"))


def parse_percent(col) -> Column:
    """``12,5 %`` as 12.5; null without a per-cent sign after a number."""
    number = F.regexp_extract(clean_ws(col), rf"([0-9]+(?:[.,][0-9]+)?)[{PAGE_SPACE}]*%", 1)
    return F.nullif(F.replace(number, F.lit(","), F.lit(".")), F.lit("")).try_cast("double")


#: Letters of month names in date fragments.
MONTH_LETTERS = "а-яё"


def date_like_strings(col, letters: str = MONTH_LETTERS) -> Column:
    """Distinct ``day month [year]`` fragments."""
    pattern = rf"(?iu)[0-9]{{1,2}}[{PAGE_SPACE}]+[{letters}]+(?:[{PAGE_SPACE}]+[0-9]{{4}})?"
    return F.array_distinct(F.regexp_extract_all(F.coalesce(as_column(col), F.lit("")), F.lit(pattern), F.lit(0)))
