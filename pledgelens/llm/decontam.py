"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are cut into blocks of bounded size. Each block becomes one generalised suffix automaton
over word numbers, which every task gets; tasks stream the words of whole documents through it and track the
longest suffix that occurs in an item. A suffix of at least ``window`` words marks its last ``window`` words as
hit; an item with fewer words is a window as a whole. Words outside the block's vocabulary end every match, so only
runs of known words are walked.

Documents are cleaned by length and coverage: hit spans are cut out, and a document whose hit words exceed
``max_coverage`` of its words is dropped.

Defined cases: null and empty texts have no words and no hits; an item without a word has no window; items that
repeat an id count once; a null item id is written ``null``; an empty benchmark hits nothing. Repeated documents
give a row each. Columns of the input that bear an output's name are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, schema_with, slices, unwrapped, utf8, wrapped, written

WINDOW = 10
#: Words of one automaton: what a task holds in memory and a broadcast may carry.
BLOCK_WORDS = 100_000

# A-Z become a-z, other letters, digits and every byte above ASCII stay, the rest ends a word.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    """The normalised words of a text in UTF-8."""
    return data.translate(_FOLD).split()


class Automaton:
    """All substrings of the items of a block, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        numbered = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for name, ws in items if ws]
        for _, ids in numbered:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.shortest = min((min(len(ids), window) for _, ids in numbered), default=window)
        self._mark(numbered)

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the strings of q that are no longer than those of p with w."""
        clone = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int) -> int:
        """The state of the item so far with the word w behind it."""
        q = self.step[last].get(w)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, w, q)
        new = len(self.step)
        self.step.append({})
        self.link.append(0)
        self.size.append(self.size[last] + 1)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
        return new

    def _mark(self, numbered: list[tuple[str, list[int]]]) -> None:
        """Which items a state's window belongs to, and which whole short items end in it."""
        order = sorted(range(1, len(self.step)), key=self.size.__getitem__)
        self.at_window = list(range(len(self.step)))
        for v in order:
            if self.size[self.link[v]] >= self.window:
                self.at_window[v] = self.at_window[self.link[v]]
        self.owners: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for name, ids in numbered:
            v = n = 0
            for w in ids:
                v, n = self.step[v][w], n + 1
                if n >= self.window:
                    self.owners.setdefault(self.at_window[v], set()).add(name)
            if n < self.window:
                self.short.setdefault(v, {}).setdefault(n, set()).add(name)
        # The nearest state on the way to the root, itself included, in which a short item ends.
        self.short_at = [0] * len(self.step)
        for v in order:
            self.short_at[v] = v if v in self.short else self.short_at[self.link[v]]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint spans of hit words, in order, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if len(words) < self.shortest:
            return spans, found
        known = self.vocabulary.get
        ids = np.array([known(w, -1) for w in words], np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= self.shortest:
                self._walk(ids[a:b].tolist(), a, spans, found)
        return merged(spans), found

    def _walk(self, ids: list[int], at: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        step, link, size, window, short_at = self.step, self.link, self.size, self.window, self.short_at
        v = n = 0
        for i, w in enumerate(ids, at + 1):
            while (q := step[v].get(w)) is None and v:
                v = link[v]
                n = size[v]
            if q is None:
                n = 0
                continue
            v, n = q, n + 1
            if n >= window:
                spans.append((i - window, i))
                found |= self.owners[self.at_window[v]]
            s = short_at[v]
            while s:
                for k, names in self.short[s].items():
                    if k <= n:
                        spans.append((i - k, i))
                        found |= names
                s = short_at[link[s]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between those words."""
    inside = np.frombuffer(data.translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:starts[a]])
        at = ends[b - 1]
    return b"".join([*kept, data[at:]])


def item_pieces(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> DataFrame:
    """(item, words) rows of at most half a block; longer items are cut with ``window - 1`` words in common."""
    most = max(block_words // 2, 2 * window)

    def pieces(batches):
        for batch in batches:
            names, rows = [], []
            for name, data in zip(batch.column("item").to_pylist(), utf8(batch.column("text"))):
                words = words_of(data)
                for at in range(0, max(1, len(words) - window + 1) if words else 0, most - window + 1):
                    names.append(name)
                    rows.append(b" ".join(words[at:at + most]).decode())
            yield pa.RecordBatch.from_pydict({"item": pa.array(names, pa.string()), "words": pa.array(rows, pa.string())})

    named = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    return named.mapInArrow(pieces, "item string, words string").distinct()


def automata(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int):
    """The automata of the blocks, one at a time; a block holds ``block_words`` words at most."""
    pieces = item_pieces(benchmark, item_id, text, window, block_words)
    pieces = written(pieces.sort("item", "words"), "benchmark-pieces")
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in pieces.toLocalIterator():
        words = row.words.encode().split(b" ")
        if held and size + len(words) > block_words:
            yield Automaton(held, window)
            held, size = [], 0
        held.append((row.item, words))
        size += len(words)
    if held:
        yield Automaton(held, window)


_SPANS = "array<struct<first:int,end:int>>"


def scan(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS, cleaned: str | None = None,
) -> DataFrame:
    """The documents with ``n_words``, ``hit_spans`` (word places, end exclusive) and ``hit_items`` (ids as text).

    ``cleaned`` names a column for the text without its hits; it may be the text column itself.
    """
    types = {"n_words": "bigint", "hit_spans": _SPANS, "hit_items": "array<string>"}
    out, first = docs, True
    blocks = automata(benchmark, item_id, item_text, window, block_words)
    automaton = next(blocks, None) or Automaton([], window)
    while automaton is not None:
        following = next(blocks, None)
        out = _scanned(out, text, automaton, types, first, None if following else cleaned)
        if following is not None:  # one automaton at a time in the tasks' memory
            out = written(out, "decontamination")
        automaton, first = following, False
    return out


def _scanned(
    docs: DataFrame, text: str, automaton: Automaton, types: dict[str, str], first: bool, last: str | None = None,
) -> DataFrame:
    """One block's pass; the last one may leave the text without its hits in the column ``last``."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    kinds = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def scanned(batches):
        for batch in slices(batches):
            counts, spans, items = [], [], []
            before = [([], ())] * batch.num_rows if first else zip(
                [[(s["first"], s["end"]) for s in x] for x in batch.column("hit_spans").to_pylist()],
                batch.column("hit_items").to_pylist(),
            )
            for data, (old, names) in zip(utf8(batch.column(text)), before):
                words = words_of(data)
                hit, found = shared.value.hits(words)
                counts.append(len(words))
                spans.append([{"first": a, "end": b} for a, b in (merged(old + hit) if old else hit)])
                items.append(sorted({*names, *found}))
            made = {
                "n_words": pa.array(counts, pa.int64()), "hit_spans": pa.array(spans, kinds),
                "hit_items": pa.array(items, pa.list_(pa.string())),
            }
            if last is not None:
                made[last] = pa.array(
                    [without(t.encode(), [(s["first"], s["end"]) for s in x]).decode() if x else t
                     for t, x in zip(batch.column(text).to_pylist(), spans)], pa.string())
            yield extended(batch, **made)

    return docs.mapInArrow(scanned, schema_with(docs, **types | ({} if last is None else {last: "string"})))


def n_hit(spans: str = "hit_spans"):
    """The number of hit words."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = scan(docs.select("doc_id", "text"), benchmark).drop("text")
    return out.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_items") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_coverage: float = 0.5) -> DataFrame:
    """The documents with hit spans cut out of ``text``; those hit beyond ``max_coverage`` of their words go."""
    found = scan(wrapped(docs, text), benchmark, text, cleaned=text)
    return unwrapped(found.where(n_hit() <= F.col("n_words") * max_coverage), docs.columns, text)
