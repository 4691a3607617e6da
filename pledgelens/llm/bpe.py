"""BPE encoding and decoding by tree concatenation.

A text is cut where no token can reach across: before white space that follows other characters. Short texts
are encoded in place. A long text (over ``piece_chars`` code points) becomes rows of pieces that all tasks
encode in parallel. A single pre-token longer than that ("unsplit text") has no such cut: it is halved until
its leaves fit, the leaves are encoded in parallel, and neighbours are joined pairwise up the tree. Each join
encodes a window round the seam again and doubles it until its first token equals the left side's token there
and its last token the right side's. A sequence of BPE tokens is the encoding of its text exactly when every two
neighbours encode to themselves, so one agreeing token on either side makes the joined sequence exact.

Results: the ids equal the ``tokenizers`` library's with ``add_special_tokens=False``; special tokens that
stand in a text become their ids. Null and empty texts have no ids. Repeated rows and rows without an id give
a row each. Columns of the input that bear an output's name are replaced by it.
"""

from __future__ import annotations

import itertools
import json
import operator
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, schema_with, sha256, slices, strings, written

# Unicode's White_Space characters, and the pre-token pattern of the vocabulary.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Code points above which a text is cut into pieces that are encoded as rows of their own.
PIECE_CHARS = 65_536
_CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_LOADED: dict[str, "ByteBpe"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def taken(values: list, places) -> tuple:
    """The values at the places, in their order."""
    return operator.itemgetter(*places)(values) if len(places) > 1 else tuple(values[i] for i in places)


def byte_letters() -> dict[str, int]:
    """The vocabulary files' printable letter of each byte: itself if visible, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """A byte-level vocabulary: pieces to ids, ids to bytes, and joins of encoded halves."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.core = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        bytes_of = {i: b for b, i in ranks.items()} | {i: w.encode() for w, i in self.special.items()}
        self.bytes_of = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.digits = [str(i) for i in range(len(self.bytes_of))]

    def chunks(self, text: str) -> Iterator[str]:
        """Parts of a text that are encoded independently; special tokens are parts of their own."""
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                yield part
            else:
                yield from _CHUNK.findall(part)

    def encode(self, text: str) -> list[int]:
        if not any(w in text for w in self.special):
            return self.core.encode_ordinary(text)
        parts = self.split_special.split(text)
        return list(itertools.chain.from_iterable(
            [self.special[p]] if p in self.special else self.core.encode_ordinary(p) for p in parts
        ))

    def decode_bytes(self, ids) -> bytes:
        return b"".join(taken(self.bytes_of, ids))

    def leaf(self, data: bytes) -> list[int]:
        """The ids of bytes that lie inside one pre-token."""
        return self.core._encode_single_piece(data)

    def join(self, left: list[int], right: list[int], window: int = 8) -> list[int]:
        """The ids of two neighbouring parts of one pre-token, from the ids of the parts."""
        while True:
            a, b = max(0, len(left) - window), min(len(right), window)
            middle = self.leaf(self.decode_bytes(left[a:] + right[:b]))
            if (a == 0 or middle[:1] == left[a:a + 1]) and (b == len(right) or middle[-1:] == right[b - 1:b]):
                return left[:a] + middle + right[b:]
            window *= 2

    def tree(self, leaves: list[list[int]]) -> list[int]:
        """Neighbours joined pairwise until one sequence is left."""
        while len(leaves) > 1:
            pairs = [self.join(*leaves[i:i + 2]) for i in range(0, len(leaves) - 1, 2)]
            leaves = pairs + leaves[len(leaves) - len(leaves) % 2:]
        return leaves[0] if leaves else []


def loaded(vocabulary: str) -> ByteBpe:
    """The vocabulary, read once for each worker."""
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = ByteBpe(vocabulary)
    return _LOADED[vocabulary]


def halves(data: bytes, most: int) -> list[bytes]:
    """Halves of halves, in order, of at most ``most`` bytes."""
    if len(data) <= most:
        return [data]
    middle = len(data) // 2
    return halves(data[:middle], most) + halves(data[middle:], most)


def cut(bpe: ByteBpe, text: str, most: int) -> Iterator[tuple[int, bytes]]:
    """(run, bytes) of each piece: run 0 for text of whole pre-tokens, else the number of an unsplit pre-token."""
    held: list[str] = []
    size = runs = 0
    for chunk in bpe.chunks(text):
        parts = [chunk] if len(chunk) <= most or chunk in bpe.special else regex.findall(PATTERN, chunk)
        for part in parts:
            # White space apart from the word behind it would be matched anew, so it stays a pre-token of its own.
            alone = part not in bpe.special and (len(part) > most or part is not chunk and part.isspace())
            if held and (alone or size + len(part) > most):
                yield 0, "".join(held).encode()
                held, size = [], 0
            if alone:
                runs += 1
                for leaf in halves(part.encode(), most):
                    yield runs, leaf
            else:
                held.append(part)
                size += len(part)
    if held:
        yield 0, "".join(held).encode()


OUTPUTS = {"n_tokens": "bigint", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}


def _results(bpe: ByteBpe, all_ids: list[list[int]], outputs: tuple[str, ...]) -> dict[str, pa.Array]:
    made: dict[str, pa.Array] = {}
    if "n_tokens" in outputs:
        made["n_tokens"] = pa.array([len(x) for x in all_ids], pa.int64())
    if "ids" in outputs:
        made["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
    if "ids_sha256" in outputs:
        made["ids_sha256"] = pa.array([sha256(",".join(taken(bpe.digits, x)).encode()) for x in all_ids], pa.string())
    if "decoded_sha256" in outputs:
        made["decoded_sha256"] = pa.array([sha256(decoded(bpe, x).encode()) for x in all_ids], pa.string())
    return made


def decoded(bpe: ByteBpe, ids) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    return bpe.decode_bytes(ids).decode("utf-8", errors="replace")


def encode(
    docs: DataFrame, text: str = "text", vocabulary: str | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids"),
    keep_text: bool = False, piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """The documents with the ``outputs`` (of ``OUTPUTS``) of their whole texts."""
    path = vocabulary or default_vocabulary()
    drop = () if keep_text else (text,)
    outputs = tuple(o for o in OUTPUTS if o in outputs)
    types = {o: OUTPUTS[o] for o in outputs}

    def in_place(batches):
        bpe = loaded(path)
        for batch in slices(batches):
            ids = [bpe.encode(t) for t in strings(batch.column(text))]
            yield extended(batch, drop, **_results(bpe, ids, outputs))

    is_long = F.coalesce(F.length(text), F.lit(0)) > piece_chars
    short = docs.where(~is_long).mapInArrow(in_place, schema_with(docs, drop, **types))
    long = docs.where(is_long).withColumn("__key", F.sha2(F.col(text), 256))
    found = written(_encode_long(long, text, path, outputs, types, piece_chars), "bpe-long")
    kept = long.drop(*drop, *[o for o in outputs if o in long.columns])
    return short.unionByName(kept.join(found, "__key").drop("__key"))


def _encode_long(long: DataFrame, text: str, path: str, outputs, types, most: int) -> DataFrame:
    """Results by text key. Equal texts are encoded once, pieces in all tasks."""

    schema = pa.schema([("__key", pa.string()), ("piece", pa.int32()), ("run", pa.int32()), ("data", pa.binary())])

    def pieces(batches):
        bpe = loaded(path)
        for batch in batches:
            for key, value in zip(batch.column("__key").to_pylist(), strings(batch.column(text))):
                for i, (run, data) in enumerate(cut(bpe, value, most)):
                    yield pa.RecordBatch.from_pydict({"__key": [key], "piece": [i], "run": [run], "data": [data]}, schema)

    def leaves(batches):
        bpe = loaded(path)
        for batch in batches:
            ids = [
                bpe.leaf(d) if r else bpe.encode(d.decode())
                for r, d in zip(batch.column("run").to_pylist(), batch.column("data").to_pylist())
            ]
            yield extended(batch, ("data",), leaf=pa.array(ids, pa.list_(pa.int32())))

    def joined(group):
        bpe = loaded(path)
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("piece", "run", "leaf"))))
        ids: list[int] = []
        for run, part in itertools.groupby(rows, key=lambda r: r[1]):
            part = [r[2] for r in part]
            ids += bpe.tree(part) if run else itertools.chain.from_iterable(part)
        made = _results(bpe, [ids], outputs)
        return pa.Table.from_pydict({"__key": group.column("__key").slice(0, 1)} | made)

    one = long.select("__key", text).dropDuplicates(["__key"])
    cuts = one.mapInArrow(pieces, "__key string, piece int, run int, data binary").repartition("__key", "piece")
    encoded = cuts.mapInArrow(leaves, "__key string, piece int, run int, leaf array<int>")
    return encoded.groupBy("__key").applyInArrow(joined, ", ".join(["__key string", *(f"{o} {t}" for o, t in types.items())]))


def decode(encoded: DataFrame, ids: str = "ids", into: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The rows with the text of their ids in ``into``; null ids give an empty text."""
    path = vocabulary or default_vocabulary()

    def texts(batches):
        bpe = loaded(path)
        for batch in slices(batches):
            made = [decoded(bpe, x or ()) for x in batch.column(ids).to_pylist()]
            yield extended(batch, **{into: pa.array(made, pa.string())})

    return encoded.mapInArrow(texts, schema_with(encoded, **{into: "string"}))


def digests(docs: DataFrame, encoder: Callable[..., DataFrame] = encode) -> DataFrame:
    """Per document: doc_id, n_tokens and the SHA-256 of its ids and of its decoded text."""
    out = encoder(docs.select("doc_id", "text"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
