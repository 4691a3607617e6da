"""URL filters with a bit-parallel wildcard automaton.

All glob rules stand side by side in the bits of a few 64-bit words. One Shift-And step per character moves every
rule of every URL of a batch at once: a bit moves on if its next symbol fits, and stays where a wildcard may still
eat the character. ``*`` eats anything but ``/``, ``**`` eats anything, ``?`` one character but ``/``.

Rules see a canonical URL: ``.``, the host in lower case, and the path; no scheme, query or fragment. Host rules
begin with ``*.``, so they fit the host and its subdomains and never reach into the path.

Defined cases: a null URL, or one without ``://``, has an empty host and path, which no site rule fits. Among the
site rules that fit the longest wins; of equally long ones a block wins, then the smaller text. Repeated rows give a
row each. Very long URLs are walked one at a time with whole numbers instead of arrays. Input columns that bear an
output's name are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, schema_with, strings


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


# The site rules of the query.
SITE_RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)
#: Globs that block a URL which no site rule fits.
BLOCK_GLOBS = (
    "*spam*/**", "*.casino*/**", "*.xxx/**", "**/wp-login*", "**/xmlrpc.php", "**/cgi-bin/**", "**/*.exe", "**/*.zip",
    "**/calendar/????/??/**",
)

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Cells (URLs x characters) of a batch that is walked at once.
CELLS = 1 << 22
#: Fewer URLs than this are walked one at a time.
FEW = 8


class Masks:
    """The packed rules: which bits a symbol lets through, and where a wildcard keeps a bit."""

    def __init__(self, globs: tuple[str, ...]):
        parts = [self._parse(g) for g in globs]
        total = sum(len(p) + 1 for p in parts)
        self.words = -(-total // 64)
        letters = sorted({s for p in parts for kind, s in p if kind == "one" and len(s) == 1} | {"/"})
        self.symbol = {c: i + 1 for i, c in enumerate(letters)}  # 0: any other character
        n = len(letters) + 1
        step, stay = [0] * n, [0] * n
        self.first = self.empty = 0
        self.last: list[int] = []
        at = 0
        for part in parts:
            # Bit `at` is the rule's start; bit `at + i` says that its first i parts have been read.
            self.first |= 1 << at
            for i, (kind, s) in enumerate(part, at + 1):
                fits = [k for k in range(n) if self._fits(s, letters, k)]
                for k in fits:
                    step[k] |= 1 << i
                    if kind == "many":
                        stay[k] |= 1 << i
                if kind == "many":
                    self.empty |= 1 << i
            at += len(part)
            self.last.append(at)
            at += 1
        self.step, self.stay = step, stay
        self._arrays()

    @staticmethod
    def _parse(glob: str) -> list[tuple[str, str]]:
        out, i = [], 0
        while i < len(glob):
            if glob.startswith("**", i):
                out.append(("many", "any"))
                i += 2
            else:
                c = glob[i]
                out.append(("many", "not/") if c == "*" else ("one", "not/") if c == "?" else ("one", c))
                i += 1
        return out

    @staticmethod
    def _fits(s: str, letters: list[str], k: int) -> bool:
        c = letters[k - 1] if k else None
        return c == s if len(s) == 1 else s == "any" or c != "/"

    def closed(self, bits: int) -> int:
        """With the wildcards that may read nothing passed over."""
        while (more := bits | bits << 1 & self.empty) != bits:
            bits = more
        return bits

    def one(self, text: str) -> int:
        """The bits after a whole text."""
        bits, symbol = self.closed(self.first), self.symbol
        for c in text:
            k = symbol.get(c, 0)
            bits = self.closed(bits << 1 & self.step[k] | bits & self.stay[k])
        return bits

    def _arrays(self) -> None:
        word = lambda x: [x >> 64 * w & 0xFFFFFFFFFFFFFFFF for w in range(self.words)]
        self.a_step = np.array([word(x) for x in self.step], np.uint64)
        self.a_stay = np.array([word(x) for x in self.stay], np.uint64)
        self.a_empty = np.array(word(self.empty), np.uint64)
        self.a_first = np.array(word(self.closed(self.first)), np.uint64)
        self.points = np.array([ord(c) for c in self.symbol], np.uint32)

    def _shifted(self, bits: np.ndarray) -> np.ndarray:
        out = bits << np.uint64(1)
        out[:, 1:] |= bits[:, :-1] >> np.uint64(63)
        return out

    def _closed(self, bits: np.ndarray) -> np.ndarray:
        while True:
            more = bits | self._shifted(bits) & self.a_empty
            if np.array_equal(more, bits):
                return bits
            bits = more

    def many(self, texts: list[str]) -> np.ndarray:
        """The bits after each text, a row of words each; all texts move together."""
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        places = np.clip(np.searchsorted(self.points, flat), 0, len(self.points) - 1)
        codes = np.where(self.points[places] == flat, places + 1, 0).astype(np.uint8 if len(self.points) < 255 else np.int32)
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1][order]
        bits = np.repeat(self.a_first[None, :], len(texts), axis=0)
        left = sizes[order]
        for j in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-left, -j, side="left"))  # texts of more than j characters come first
            k = codes[starts[:live] + j]
            now = bits[:live]
            bits[:live] = self._closed(self._shifted(now) & self.a_step[k] | now & self.a_stay[k])
        out = np.empty_like(bits)
        out[order] = bits
        return out

    def fitting(self, texts: list[str]) -> np.ndarray:
        """A row of truth values per text: which rules fit it."""
        out = np.zeros((len(texts), len(self.last)), bool)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        while order:
            # Texts of like length share a batch of bounded size.
            size = max(1, CELLS // max(1, len(texts[order[-1]])))
            batch, order = order[-size:], order[:-size]
            if len(batch) < FEW:
                for i in batch:
                    bits = self.one(texts[i])
                    out[i] = [bits >> b & 1 for b in self.last]
            else:
                bits = self.many([texts[i] for i in batch])
                for r, b in enumerate(self.last):
                    out[batch, r] = bits[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)
        return out


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), *_LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(
    pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = SITE_RULES, block_globs: tuple[str, ...] = BLOCK_GLOBS,
) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` and ``glob`` (of the block globs)."""
    # The first rule of this order that fits is the one that wins.
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict == "allow", r.name))
    globs = tuple(r.glob for r in ranked) + tuple(block_globs)
    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    types = {"rule": "string", "verdict": "string", "glob": "string"}

    def judged(batches):
        masks = Masks(globs)
        for batch in batches:
            texts = [f".{h}{p}" for h, p in zip(strings(batch.column("host")), strings(batch.column("path")))]
            fits = masks.fitting(texts)
            site, other = fits[:, :len(ranked)], fits[:, len(ranked):]
            rule, verdict, glob = [], [], []
            for has_rule, r, has_glob, g in zip(
                site.any(axis=1), site.argmax(axis=1) if len(ranked) else np.zeros(len(texts), int),
                other.any(axis=1), other.argmax(axis=1) if len(block_globs) else np.zeros(len(texts), int),
            ):
                rule.append(ranked[r].name if has_rule else None)
                glob.append(block_globs[g] if has_glob else None)
                verdict.append(ranked[r].verdict if has_rule else "block" if has_glob else "allow")
            made = {"rule": rule, "verdict": verdict, "glob": glob}
            yield extended(batch, **{n: pa.array(v, pa.string()) for n, v in made.items()})

    return parts.mapInArrow(judged, schema_with(parts, **types))
