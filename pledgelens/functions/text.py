"""Text cleaning, tokens, sentences and counts as native Column expressions.

Everything here is row-local and stays inside the JVM. Character classes are
spelled out with ``\\p{..}`` and explicit code points because ``\\w``, ``\\s``
and ``\\b`` differ between regex engines.
"""

from __future__ import annotations

import html.entities
import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import RUSSIAN, LanguagePack

#: Inside of a character class: Unicode white space as text tools see it.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
#: Inside of a character class: letters, numbers and the underscore.
WORD = r"\p{L}\p{N}_"


def as_column(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(col: Column, fn) -> Column:
    """``fn(col)`` with ``col`` evaluated once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(col), fn), F.lit(0))


def regex_replace(col, pattern: str, replacement: str) -> Column:
    """``regexp_replace`` with a literal pattern and replacement."""
    return F.regexp_replace(as_column(col), F.lit(pattern), F.lit(replacement))


def squeeze(col, space: str = SPACE) -> Column:
    """Collapse runs of white space to one blank and strip both ends.

    Single blanks are left alone, and printable ASCII is passed over early.
    """
    return F.trim(regex_replace(col, f"(?![!-~])(?:[{space}&&[^ ]][{space}]*+| [{space}]++)", " "))


# --------------------------------------------------------------------------
# HTML entities
# --------------------------------------------------------------------------
_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32}+;?)"
_HOT_ENTITIES = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;")


def _named_entity_map(legacy: bool = False) -> Column:
    """Entity names to characters; ``legacy`` keeps those valid without a semicolon."""
    names = {n: c for n, c in html.entities.html5.items() if not (legacy and n.endswith(";"))}
    return F.from_json(F.lit(json.dumps(names, ensure_ascii=False)), "map<string,string>")


def _legacy_prefix_pattern() -> str:
    legacy = [name for name in html.entities.html5 if not name.endswith(";")]
    legacy.sort(key=len, reverse=True)
    return "^(" + "|".join(legacy) + ")"


def _code_point_text(code: Column) -> Column:
    """The character of a code point, by the HTML5 rules for bad references."""
    # Windows-1252 stands in for the C1 range; bytes it leaves open keep their value.
    c1 = {}
    for byte in range(0x80, 0xA0):
        try:
            c1[byte] = bytes([byte]).decode("cp1252")
        except UnicodeDecodeError:
            c1[byte] = chr(byte)
    c1_text = "".join(c1[b] for b in sorted(c1))
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    dropped = (
        code.between(0x1, 0x8) | code.between(0xE, 0x1F) | (code == 0xB) | (code == 0x7F)
        | code.between(0xFDD0, 0xFDEF) | (F.pmod(code, F.lit(0x10000)) >= 0xFFFE)
    )
    return (
        F.when(code == 0, "�")
        .when(code == 0xD, "\r")
        .when(code.between(0x80, 0x9F), F.substring(F.lit(c1_text), code.cast("int") - 0x7F, F.lit(1)))
        .when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "�")
        .when(dropped, "")
        .otherwise(plain)
    )


def _decode_entity(entity: Column) -> Column:
    body = F.substring(entity, F.lit(2), F.length(entity))
    digits = F.rtrim(body, F.lit(";"))
    hex_digits = F.ltrim(F.substring(digits, F.lit(3), F.length(digits)), F.lit("0"))
    dec_digits = F.ltrim(F.substring(digits, F.lit(2), F.length(digits)), F.lit("0"))
    # Longer digit strings are beyond the last code point anyway.
    hex_code = F.when(F.length(hex_digits) > 8, F.lit(0x7FFFFFFF)).otherwise(
        F.conv(F.when(hex_digits == "", "0").otherwise(hex_digits), 16, 10).cast("bigint"))
    dec_code = F.when(F.length(dec_digits) > 9, F.lit(0x7FFFFFFF)).otherwise(
        F.when(dec_digits == "", "0").otherwise(dec_digits).try_cast("bigint"))
    hot = reduce(
        lambda acc, name: acc.when(body == name, html.entities.html5[name]),
        _HOT_ENTITIES[1:],
        F.when(body == _HOT_ENTITIES[0], "&"),
    )
    prefix = F.regexp_extract(body, _legacy_prefix_pattern(), 1)
    by_prefix = F.when(
        prefix != "",
        F.concat(F.try_element_at(_named_entity_map(True), prefix), F.substring(body, F.length(prefix) + 1, F.length(body))),
    )
    named = F.coalesce(hot, F.try_element_at(_named_entity_map(), body), by_prefix, entity)
    return (
        F.when(body.rlike("^#[xX]"), _code_point_text(hex_code))
        .when(body.startswith("#"), _code_point_text(dec_code))
        .otherwise(named)
    )


def html_unescape(col) -> Column:
    """Decode named and numeric HTML references once, left to right."""

    def decode(text: Column) -> Column:
        pieces = F.split(text, _ENTITY, -1)
        entities = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
        joined = F.array_join(
            F.zip_with(pieces, entities, lambda p, e: F.concat(p, F.coalesce(_decode_entity(e), F.lit("")))), "")
        return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)

    return bind(as_column(col), decode)


# --------------------------------------------------------------------------
# Cleaning
# --------------------------------------------------------------------------
def strip_tags(col) -> Column:
    return regex_replace(col, "<[^>]+>", " ")


def clean_readable(col) -> Column:
    """Decode references, drop tags, tidy white space; keep the punctuation."""
    return squeeze(strip_tags(html_unescape(F.coalesce(as_column(col), F.lit("")))))


def clean_model_text(col) -> Column:
    """Text handed to a scorer: the same light cleaning as :func:`clean_readable`."""
    return clean_readable(col)


def keep_only(col, letters: str) -> Column:
    """Everything but the given characters becomes a single blank between words."""
    return F.trim(regex_replace(col, f"(?![a-zA-Z])(?:[^{letters} ][^{letters}]*+| [^{letters}]++)", " "))


def words_only(col) -> Column:
    """Letters, numbers and underscores of tag-free text, single blanks between words."""
    return keep_only(col, WORD)


def clean_words(col) -> Column:
    """Cleaning for lexicon work: word characters only; null gives ``''``."""
    return words_only(strip_tags(html_unescape(F.coalesce(as_column(col), F.lit("")))))


def clean_topics(col, letters: str = RUSSIAN.letters) -> Column:
    """Cleaning for topic models: letters only, digits dropped. The set must hold a-z."""
    return keep_only(strip_tags(html_unescape(F.coalesce(as_column(col), F.lit("")))), letters)


# --------------------------------------------------------------------------
# Tokens, sentences, counts
# --------------------------------------------------------------------------
def tokenize(col, pattern: str = RUSSIAN.token_pattern) -> Column:
    """All runs of token letters, case kept; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(as_column(col), F.lit("")), F.lit(pattern), F.lit(0))


def count_matches(col, pattern: str) -> Column:
    """Number of non-overlapping matches; null counts as no text."""
    return F.regexp_count(F.coalesce(as_column(col), F.lit("")), F.lit(pattern))


def count_tokens(col, pack: LanguagePack = RUSSIAN) -> Column:
    return count_matches(col, f"[{pack.letters}]++")


def count_long_tokens(col, pack: LanguagePack = RUSSIAN, longer_than: int = 6) -> Column:
    return count_matches(col, f"[{pack.letters}]{{{longer_than + 1},}}+")


def count_complex_tokens(col, pack: LanguagePack = RUSSIAN, syllables: int = 3) -> Column:
    """Tokens with at least ``syllables`` vowels, without building the tokens."""
    vowels = pack.both_case_vowels
    step = f"[{pack.letters}&&[^{vowels}]]*+[{vowels}]"
    return count_matches(col, f"(?:{step}){{{syllables}}}[{pack.letters}]*+")


def count_syllables(col, vowels: str = RUSSIAN.both_case_vowels) -> Column:
    """Vowel letters in a word or text; other scripts count nothing."""
    text = F.coalesce(as_column(col), F.lit(""))
    return F.length(text) - F.length(F.translate(text, vowels, ""))


def split_sentences(col) -> Column:
    """Parts between runs of ``.``, ``!`` and ``?``, blank parts dropped."""
    parts = F.split(F.coalesce(as_column(col), F.lit("")), "[.!?]+", -1)
    return F.filter(parts, lambda part: part.rlike(f"[^{SPACE}]"))


def count_sentences(col) -> Column:
    """As ``size(split_sentences(col))``, without building the parts."""
    return count_matches(col, f"[^.!?{SPACE}][^.!?]*+")


def any_pattern(patterns: list[str]) -> str:
    """Alternation in list order; ``\\w`` and case folding cover every alphabet.

    When every pattern starts with a letter, a look at the next character
    skips the places where none can match.
    """
    body = "(?iu:" + "|".join(p.replace(r"\w", f"[{WORD}]") for p in patterns) + ")"
    first = {p[0].lower() for p in patterns}
    if not all(c.isalpha() for c in first):
        return body
    folds = {"s": "\u017f", "k": "\u212a"}
    letters = sorted(first | {c.upper() for c in first} | {folds[c] for c in first if c in folds})
    return f"(?=[{''.join(letters)}]){body}"


def money_pattern(currency: list[str]) -> str:
    """Digits, then blanks or separators, then a currency word.

    The possessive run gives the same matches as plain backtracking, since no
    currency word starts with a digit, blank or separator, in linear time.
    """
    return rf"(?iu)(?<![\p{{Nd}}])\p{{Nd}}[\p{{Nd}}{SPACE},.]*+(?:" + "|".join(currency) + ")"


NUMBER_PATTERN = rf"(?<![{WORD}])\p{{Nd}}+(?:[.,]\p{{Nd}}+)?(?![{WORD}])"
