"""Quality rules from tokeniser fertility.

Public vocabularies measure every whole text: characters per token and token entropy under a byte-level
vocabulary, and the share of characters that a piece vocabulary has no piece for (it falls back to bytes).
A text is rejected when a measure leaves its language's band, or its script's where the language is unknown,
or when one of the base rules fails.

Base rules over words (runs of anything but space and U+0009 to U+000D): fewer than ``MIN_WORDS`` words, or more
than ``MAX_REPEATED`` per cent of the words inside a 5-word window that occurs twice or more.

Defined cases: null and empty texts have no words, fail the base rule and have null measures; a null or unknown
language takes the band of the text's script; repeated rows give a row each. Input columns that bear an output's
name are replaced. Everything is row-local: no shuffle, memory of one Arrow batch.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from . import bpe
from .common import extended, schema_with, slices, strings, unwrapped, wrapped

MIN_WORDS = 10
MAX_REPEATED = 20
WINDOW = 5
_SYMBOLS = list(b"#*$%&|<>")
_SPACES = [32, *range(9, 14)]


class Band(NamedTuple):
    """Limits of a text that is kept. Entropy is measured against the most that so many tokens can have."""

    chars_low: float
    chars_high: float
    fallback_high: float
    entropy_low: float


#: From so many tokens on the limits hold as they are; they are wider for fewer tokens, whose measures vary more.
FULL_TOKENS = 64
#: Characters of the parts that longer texts are encoded in.
PART = 1 << 16
#: Bands per language and, for other languages, per script. The lower limits of the four languages lie just below
#: the lowest values of labelled documents of good quality; pass ``bands`` for another corpus.
BANDS: dict[str, Band] = {
    "en": Band(2.30, 8.0, 0.10, 0.50),
    "de": Band(2.15, 8.0, 0.10, 0.48),
    "fr": Band(1.98, 8.0, 0.10, 0.46),
    "es": Band(1.94, 8.0, 0.10, 0.48),
    "latin": Band(1.2, 10.0, 0.20, 0.35),
    "other": Band(0.25, 10.0, 1.00, 0.35),
}


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_PIECES: dict[str, set[str]] = {}


def piece_letters(model: str) -> set[str]:
    """The characters that a piece vocabulary has a piece for."""
    if model not in _PIECES:
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i)))
        _PIECES[model] = {p for p in pieces if len(p) == 1}
    return _PIECES[model]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of so many words that occurs twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    # Windows are numbered by doubling: (number of the first part, number of the rest) is numbered anew.
    run, size = ids, 1
    while size < window:
        step = min(size, window - size)
        pairs = run[:n - size - step + 1] * (int(run.max()) + 1) + run[step:n - size + 1]
        run, size = np.unique(pairs, return_inverse=True)[1].astype(np.int64), size + step
    often = np.bincount(run)[run] > 1
    edges = np.zeros(n + 1, np.int64)
    edges[:len(often)] += often
    edges[window:window + len(often)] -= often
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def entropy(ids: np.ndarray) -> float:
    """Bits of the token distribution against the most that so many tokens can have (1: all differ)."""
    counts = np.unique(ids, return_counts=True)[1]
    share = counts / len(ids)
    return float(-(share * np.log2(share)).sum() / np.log2(len(ids)))


_LATIN = re.compile("[A-Za-zÀ-ɏ]")


def script(text: str) -> str:
    """``latin`` if at least half of the characters outside ASCII punctuation and spaces are Latin letters."""
    letters = sum(map(str.isalpha, text))
    return "latin" if 2 * len(_LATIN.findall(text)) >= letters else "other"


def limits_at(band: Band, n_tokens: int) -> Band:
    """The band for a text of so many tokens: wider by the root of what it lacks."""
    wide = max(1.0, math.sqrt(FULL_TOKENS / max(n_tokens, 1)))
    return Band(band.chars_low / wide, band.chars_high * wide, band.fallback_high * wide, band.entropy_low / wide)


def token_ids(vocabulary: bpe.ByteBpe, text: str) -> np.ndarray:
    """The ids of a whole text; a long one, whose runs of one kind the encoder may not hold, goes part by part."""
    if len(text) <= PART:
        return vocabulary.core.encode_to_numpy(text)
    ids: list[np.ndarray] = []
    for run, parts in itertools.groupby(bpe.cut(vocabulary, text, PART), key=lambda p: p[0]):
        if run:
            ids.append(np.array(vocabulary.tree([vocabulary.leaf(data) for _, data in parts]), np.uint32))
        else:
            ids += [vocabulary.core.encode_to_numpy(data.decode()) for _, data in parts]
    return np.concatenate(ids)


def without_piece(text: str, letters: set[str]) -> int:
    """Characters of words that the piece vocabulary has no piece for."""
    missing = {c for c in set(text) - letters if not c.isspace()}
    if len(missing) <= 8:
        return sum(map(text.count, missing))
    return sum(n for c, n in Counter(text).items() if c in missing)


TYPES = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
    "n_repeat_words": "bigint", "n_tokens": "bigint", "chars_per_token": "double", "fallback_share": "double",
    "token_entropy": "double", "base_failed": "boolean", "kept": "boolean",
}


def measure(vocabulary: bpe.ByteBpe, letters: set[str], text: str, lang: str | None, bands: Mapping[str, Band]) -> tuple:
    """The values of ``TYPES`` for one text."""
    data = text.encode()
    words = data.split()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    word_chars = int(counts[:0x80].sum() + counts[0xC0:].sum() - counts[_SPACES].sum())
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED * len(words)
    base = (len(words), word_chars, int(counts[_SYMBOLS].sum()), repeated_lines(data), repeated)
    if not words:
        return (*base, 0, None, None, None, failed, False)
    ids = token_ids(vocabulary, text)
    chars = len(text) / len(ids)
    unknown = without_piece(text, letters) / word_chars
    spread = entropy(ids) if len(ids) > 1 else 1.0
    kept = not failed
    if kept:
        band = limits_at(bands.get(lang) or bands[script(text)], len(ids))
        kept = (
            band.chars_low <= chars <= band.chars_high and unknown <= band.fallback_high and spread >= band.entropy_low
        )
    return (*base, len(ids), chars, unknown, spread, failed, kept)


def quality_rules(
    docs: DataFrame, text: str = "text", lang: str = "lang", bands: Mapping[str, Band] | None = None,
    vocabulary: str | None = None, pieces: str | None = None, keep_text: bool = True,
) -> DataFrame:
    """The documents with the columns of ``TYPES``; ``kept`` is the verdict."""
    path, model = vocabulary or bpe.default_vocabulary(), pieces or default_pieces()
    limits = dict(bands or BANDS)
    drop = () if keep_text else (text,)

    def measured(batches):
        words, letters = bpe.loaded(path), piece_letters(model)
        for batch in slices(batches):
            rows = [
                measure(words, letters, t, g, limits)
                for t, g in zip(strings(batch.column(text)), batch.column(lang).to_pylist())
            ]
            kinds = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
            columns = zip(*rows) if rows else [()] * len(TYPES)
            made = {n: pa.array(c, kinds[k]) for (n, k), c in zip(TYPES.items(), columns)}
            yield extended(batch, drop, **made)

    return docs.mapInArrow(measured, schema_with(docs, drop, **TYPES))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    passed = quality_rules(wrapped(docs, "text", "lang")).where("kept")
    return unwrapped(passed, docs.columns, "text", "lang")
