"""Conversation structure repair by cost DP and prefix-doubling path ranking.

The roles of a conversation shall read ``(s?(ua)+)?``. Rows are kept, given the next role, deleted, or rows are inserted; a
blank or repeated row must go. The layers of the DP are the rows, its four nodes what stands before (nothing, system, user,
assistant). After the costs are known, arcs that lie on a cheapest way are left. Each node has one such arc of an initial at most, so the
nodes are ranked by their least audits of 1, 2, 4, ... letters: a rank of twice the length is the pair of a node's rank and
the rank of the node that its pointer of that length leads to. The ranks pick each node's arc, and the doubled
pointers list the least way from a start without walking it.

Rows equal in conversation, turn, role and text are one row with a number of copies. The rows are sorted once, by ranges of
(conversation, turn, role, text hash), so a conversation of any length lies in pieces of a bounded number of rows; a piece is a row
of arrays from then on. Pieces of one conversation are joined by 4 x 4 matrices of costs: two passes over at most two
pieces a range give each piece the costs behind it and the node before it. Texts travel once, for the hash of a repaired
conversation, which is a chain by its definition: its rows stream through a task in order and are not held.

Defined cases: null roles and texts are one space, null turns come first, null conversations are one conversation;
rows of one turn are ordered by role, then by the SHA-256 of the text; a role with another initial than s, u, a can be kept nowhere;
an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pledgelens.operators.lookup import lookup_join

from .common import slices, utf8, written

#: What stands before: nothing, a system row, a user row, an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled row, and what that row is.
FORWARD = np.array([USER, USER, ASSISTANT, USER])
ROLES = {USER: b"user", ASSISTANT: b"assistant"}
#: The state after a row that is kept, by its initial (s, u, a, other) and the state before; -1 where it cannot stand.
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
INITIALS = "sua"

DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = "DIKR"
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 4, 3, 3, 3
FORCED = 8
NEVER = 1 << 60
#: Rows of a range of the sorted table, and of pieces that are ranked together.
RANGE_ROWS = 100_000
BATCH_ROWS = 20_000
SPACE = " \t\n\x0b\x0c\r"

CONVERSATION = ["cn", "c"]
PLACE = ["tn", "t", "role", "body"]


# --------------------------------------------------------------------------
# Costs of a layer. A layer is a code: 2 * initial + truncated, or FORCED for rows that must go.
# --------------------------------------------------------------------------
def _keeps(code: int) -> tuple[int, int]:
    """Costs of keeping and of giving a role."""
    more = TRUNCATED_COST * (code % 2)
    return (NEVER, NEVER) if code == FORCED else (more, REROLE_COST + more)


def _heads(code: int) -> np.ndarray:
    return KEPT[3] if code == FORCED else KEPT[code // 2]


#: Costs by code, and heads of kept rows by code and state.
KEEP_COST, ROLE_COST = (np.array(x, np.int64) for x in zip(*map(_keeps, range(FORCED + 1))))
KEEP_HEAD = np.array([_heads(c) for c in range(FORCED + 1)])
#: Costs at the end of a conversation, where a started pair is closed by inserted rows.
AT_END = np.array([0, 2 * INSERT_COST, INSERT_COST, 0], np.int64)
CLOSING = {SYSTEM, USER}


def before(code: int, many: int, after: list[int]) -> list[int]:
    """Costs before a layer, from those after it."""
    keep, role, gone = int(KEEP_COST[code]), int(ROLE_COST[code]), DELETE_COST * many
    row = [
        min(gone + after[s], role + after[FORWARD[s]], keep + after[h] if (h := KEEP_HEAD[code, s]) >= 0 else NEVER) for s in range(4)
    ]
    # Rows may be inserted first; a third one leads back.
    return [min(row[s], INSERT_COST + row[f := FORWARD[s]], 2 * INSERT_COST + row[FORWARD[f]]) for s in range(4)]


def matrix(codes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Least costs from each state before the layers to each state after them."""
    columns = [[0 if s == e else NEVER for s in range(4)] for e in range(4)]
    for code, n in zip(codes[::-1].tolist(), many[::-1].tolist()):
        columns = [[min(x, NEVER) for x in before(code, n, c)] for c in columns]
    return np.array(columns, np.int64).T


def costs(codes: np.ndarray, many: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs to the end at each layer and behind the last one."""
    out, now = np.empty((len(codes) + 1, 4), np.int64), after.tolist()
    out[-1] = now
    for i in range(len(codes) - 1, -1, -1):
        now = before(int(codes[i]), int(many[i]), now)
        out[i] = now
    return out


# --------------------------------------------------------------------------
# Ranks and doubled pointers
# --------------------------------------------------------------------------
class Ranked:
    """Least audits from every node of some pieces: ``pieces`` are (codes, many, costs behind, is the last of its conversation)."""

    def __init__(self, pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]):
        sizes = np.array([len(p[0]) + 1 for p in pieces])
        self.first = np.cumsum(sizes) - sizes
        cost = np.concatenate([costs(c, m, a) for c, m, a, _ in pieces])
        n = len(cost)
        code, many, end = np.full(n, FORCED), np.zeros(n, np.int64), np.zeros(n, bool)
        closes = np.zeros(n, bool)
        for at, (c, m, _, last) in zip(self.first.tolist(), pieces):
            code[at:at + len(c)], many[at:at + len(c)] = c, m
            end[at + len(c)], closes[at + len(c)] = True, last
        self.cost, self.many = cost, many
        layer, state = np.divmod(np.arange(4 * n), 4)
        flat = np.append(cost.ravel(), NEVER)
        nowhere = 4 * n
        below = np.where(end[layer], nowhere, 4 * (layer + 1))
        kept = KEEP_HEAD[code[layer], state]
        heads = np.stack([
            np.where(end[layer], nowhere, below + state),
            np.where(end[layer] & ~(closes[layer] & np.isin(state, list(CLOSING))), nowhere, 4 * layer + FORWARD[state]),
            np.where(end[layer] | (kept < 0), nowhere, below + kept),
            np.where(end[layer] | (code[layer] == FORCED), nowhere, below + FORWARD[state]),
        ], 1)
        price = np.stack([DELETE_COST * many[layer], np.full(4 * n, INSERT_COST), KEEP_COST[code[layer]], ROLE_COST[code[layer]]], 1)
        optimal = (heads < nowhere) & (price + flat[heads] == flat[:-1, None])
        self._rank(heads, optimal)

    def _rank(self, heads: np.ndarray, optimal: np.ndarray) -> None:
        nodes = np.arange(len(heads))
        stops = ~optimal.any(axis=1)
        # Of the optimal arcs that with the least initial; no two have the same.
        letter = np.where(stops, 0, optimal.argmax(axis=1) + 1)
        jump = np.where(stops, nodes, heads[nodes, letter - 1]).astype(np.int32)
        self.letter, self.jumps, self.length = letter, [jump], (~stops).astype(np.int64)
        rank = letter.astype(np.int64)
        while not stops[jump].all():
            rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
            self.length = self.length + self.length[jump]
            jump = jump[jump]
            self.jumps.append(jump)
        self.rank = rank

    def path(self, pieces: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which start, layer, letter) of each step of the least ways from a state before each of the pieces, in order."""
        start = 4 * self.first[pieces] + entries
        length = self.length[start]
        which = np.repeat(np.arange(len(start)), length)
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        node = start[which]
        for k, jump in enumerate(self.jumps):
            node = np.where(step >> k & 1, jump[node], node)
        return which, node // 4, self.letter[node] - 1

    def exits(self) -> np.ndarray:
        """Per piece and state before it the state behind it."""
        return self.jumps[-1].reshape(-1, 4)[self.first] % 4


# --------------------------------------------------------------------------
# Rows
# --------------------------------------------------------------------------
def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text)`` with made faults, by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it the user's.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_id, turn, role, text)]
    roll = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    kept = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), named[2].alias("role"), named[3].alias("text"), roll.alias("roll"))
    return kept.where(F.col("roll") != 0).select(
        "conv_id", "turn", F.when(F.col("roll") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("roll") == 1, F.lit("")).when(F.col("roll") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("roll") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _without_null(column: Column, kind: str) -> Column:
    return F.coalesce(column, F.lit(0).cast(kind))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with keys that hold no nulls; ``text`` stays."""
    kinds = dict(rows.dtypes)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        F.col("conv_id").isNull().alias("cn"), _without_null(F.col("conv_id"), kinds["conv_id"]).alias("c"),
        F.col("turn").isNotNull().alias("tn"), _without_null(F.col("turn"), kinds["turn"]).alias("t"),
        role.alias("role"), F.unhex(F.sha2(text, 256)).alias("body"), text.alias("text"))


def _faults(placed: DataFrame) -> DataFrame:
    """Distinct rows with their number of ``copies``, ``initial`` and first ``fault``: blank, duplicate, truncated or null."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    seen = placed.select(*CONVERSATION, *PLACE, (F.length(trimmed) == 0).alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"))
    once = seen.groupBy(*CONVERSATION, *PLACE).agg(F.count(F.lit(1)).alias("copies"), F.first("blank").alias("blank"), F.first("open").alias("open"))
    once = written(once, "conversation-rows")
    firsts = once.groupBy(*CONVERSATION, "role", "body").agg(F.min(F.struct("tn", "t")).alias("at"))
    firsts = firsts.select(*CONVERSATION, F.col("at.tn").alias("tn"), F.col("at.t").alias("t"), "role", "body", F.lit(True).alias("is_first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(F.col("open"), "truncated")
    initial = F.instr(F.lit(INITIALS), F.left("role", F.lit(1)))
    initial = F.when((initial == 0) | (F.length("role") == 0), 3).otherwise(initial - 1)
    judged = once.join(firsts, [*CONVERSATION, *PLACE], "left")
    return judged.select(*CONVERSATION, *PLACE, "copies", initial.cast("int").alias("initial"), fault.alias("fault"))


def _illegal(initials: np.ndarray, copies: np.ndarray) -> int:
    """Neighbours that are not system and user or user and assistant in turn; a copy follows its like."""
    good = (initials[:-1] == 0) & (initials[1:] == 1) | (initials[:-1] == 1) & (initials[1:] == 2) | (initials[:-1] == 2) & (initials[1:] == 1)
    return int((~good).sum() + (copies - 1).sum())


def _layers(initials: np.ndarray, faults: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, how many, row) of the layers: a row and, behind it, its further copies."""
    forced = faults == 1
    extra = np.where(forced, 0, copies - 1)
    both = np.stack([np.where(forced, FORCED, 2 * initials + (faults == 2)), np.full(len(initials), FORCED)], 1).ravel()
    many = np.stack([np.where(forced, copies, 1), extra], 1).ravel()
    row = np.repeat(np.arange(len(initials)), 2)
    some = many > 0
    return both[some], many[some], row[some]


def _pieces(judged: DataFrame, range_rows: int) -> DataFrame:
    """A row of arrays for each run of a conversation's rows in a range; ``edge`` ones may go on in the next range."""
    spark = judged.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(judged.count() / range_rows))
    order = [*CONVERSATION, *PLACE]
    ranged = judged.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        *order, "copies", "initial", F.when(F.col("fault") == "truncated", 2).when(F.col("fault").isNotNull(), 1).otherwise(0).alias("fault"),
        F.spark_partition_id().alias("part"))
    kinds = dict(ranged.dtypes)
    lists = ["tn", "t", "role", "body", "copies", "initial", "fault"]

    def packed(pieces, kind):
        out = {"cn": [], "c": [], "part": [], "edge": [], "illegal": [], "ends": [], "costs": [], **{c: [] for c in lists}}
        for key, part, edge, rows in pieces:
            initials, copies = np.array(rows["initial"]), np.array(rows["copies"])
            codes, many, _ = _layers(initials, np.array(rows["fault"]), copies)
            out["cn"].append(key[0])
            out["c"].append(key[1])
            out["part"].append(part)
            out["edge"].append(edge)
            out["illegal"].append(_illegal(initials, copies))
            out["ends"].append([int(initials[0]), int(initials[-1])])
            out["costs"].append(matrix(codes, many).ravel().tolist() if edge else None)
            for c in lists:
                out[c].append(rows[c])
        types = {"cn": pa.bool_(), "c": kind["c"], "part": pa.int32(), "edge": pa.bool_(), "illegal": pa.int64(), "ends": pa.list_(pa.int32()),
                 "costs": pa.list_(pa.int64()), **{c: pa.list_(kind[c]) for c in lists}}
        return pa.RecordBatch.from_pydict(out, schema=pa.schema(list(types.items())))

    def gathered(batches):
        ready, held, key, part, kind, first, size = [], None, None, None, None, True, 0
        for batch in batches:
            kind = {n: batch.schema.field(n).type for n in batch.schema.names}
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for i, now in enumerate(zip(columns["cn"], columns["c"])):
                if now != key:
                    if held is not None:
                        ready.append((key, part, first, held))
                        first = False
                    if size >= BATCH_ROWS:
                        yield packed(ready, kind)
                        ready, size = [], 0
                    key, held = now, {c: [] for c in lists}
                part = columns["part"][i]
                for c in lists:
                    held[c].append(columns[c][i])
                size += 1
        if held is not None:
            yield packed([*ready, (key, part, True, held)], kind)

    arrays = ", ".join(f"{c} array<{kinds[c]}>" for c in lists)
    made = ranged.mapInArrow(gathered, f"cn boolean, c {kinds['c']}, part int, edge boolean, illegal bigint, ends array<int>, costs array<bigint>, {arrays}")
    return written(made, "conversation-pieces")


PIECE = [*CONVERSATION, "part"]


def _chained(pieces: DataFrame) -> DataFrame:
    """``(cn, c, part, behind, last, joint)`` for pieces of conversations that lie in several: costs behind and an illegal joint before."""
    kind = dict(pieces.dtypes)["c"]

    def behind(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part").reset_index(drop=True)
        if len(group) == 1:
            return pd.DataFrame(columns=[*PIECE, "behind", "last", "joint"], dtype=object)
        now, found = AT_END, []
        for costs_of in group["costs"][::-1]:
            found.append(now.tolist())
            now = (np.array(costs_of).reshape(4, 4) + now[None, :]).min(axis=1)
        ends = group["ends"].tolist()
        joint = [0] + [_illegal(np.array([a[1], b[0]]), np.array([1, 1])) for a, b in zip(ends, ends[1:])]
        last = [False] * (len(group) - 1) + [True]
        return pd.DataFrame({"cn": group["cn"], "c": group["c"], "part": group["part"], "behind": found[::-1], "last": last, "joint": joint})

    edges = pieces.where("edge").select(*PIECE, "ends", "costs")
    return edges.groupBy(*CONVERSATION).applyInPandas(
        behind, f"cn boolean, c {kind}, part int, behind array<bigint>, last boolean, joint bigint")


def _loaded(batch: pa.RecordBatch) -> list[tuple]:
    """(initials, faults, copies) of each piece of a batch."""
    flat = lambda c: [v.values.to_numpy(zero_copy_only=False) for v in batch.column(c)]
    return list(zip(flat("initial"), flat("fault"), flat("copies")))


def _batches(batch: pa.RecordBatch):
    """The batch in parts of a bounded number of rows of conversations."""
    sizes = np.cumsum([len(v.values) for v in batch.column("initial")])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_ROWS)))
        yield batch.slice(at, end - at)
        at = end


def _entered(pieces: DataFrame, chained: DataFrame) -> DataFrame:
    """``(cn, c, part, entry, behind, last, joint)``: the state before each piece on the least way."""
    kind = dict(pieces.dtypes)["c"]
    asked = lookup_join(pieces.where("edge").select(*PIECE, "initial", "fault", "copies"), chained, PIECE, "inner")

    def left(batches):
        for batch in batches:
            for part in _batches(batch):
                layers = [_layers(*p)[:2] for p in _loaded(part)]
                ranked = Ranked([(c, m, np.array(b), e) for (c, m), b, e in zip(layers, part.column("behind").to_pylist(), part.column("last").to_pylist())])
                yield pa.RecordBatch.from_arrays(
                    [part.column("cn"), part.column("c"), part.column("part"), pa.array(ranked.exits().tolist(), pa.list_(pa.int32()))],
                    names=["cn", "c", "part", "exits"])

    def entries(group: pd.DataFrame) -> pd.DataFrame:
        group, now, found = group.sort_values("part").reset_index(drop=True), NOTHING, []
        for exits in group["exits"]:
            found.append(now)
            now = int(exits[now])
        return pd.DataFrame({"cn": group["cn"], "c": group["c"], "part": group["part"], "entry": found})

    exits = asked.mapInArrow(left, f"cn boolean, c {kind}, part int, exits array<int>")
    found = exits.groupBy(*CONVERSATION).applyInPandas(entries, f"cn boolean, c {kind}, part int, entry int")
    return chained.join(found, PIECE)


def _solved(pieces: DataFrame, known: DataFrame) -> DataFrame:
    """Per piece its ``audit``, the ``edits`` of each row, and the ``cost`` from its first row on (null but in the first piece)."""
    kinds = dict(pieces.dtypes)
    joined = lookup_join(pieces.drop("costs", "ends", "edge"), known, PIECE)

    def solved(batches):
        for batch in batches:
            for part in _batches(batch):
                rows = _loaded(part)
                layers = [_layers(*p) for p in rows]
                behind = [AT_END if b is None else np.array(b) for b in part.column("behind").to_pylist()]
                last = [True if x is None else x for x in part.column("last").to_pylist()]
                entry = np.array([NOTHING if x is None else x for x in part.column("entry").to_pylist()])
                ranked = Ranked([(c, m, b, e) for (c, m, _), b, e in zip(layers, behind, last)])
                which, layer, letter = ranked.path(np.arange(len(rows)), entry)
                edits, audits = [[""] * len(p[0]) for p in rows], [[] for _ in rows]
                for p, at, x in zip(which.tolist(), (layer - ranked.first[which]).tolist(), letter.tolist()):
                    _, many, row = layers[p]
                    edits[p][row[min(at, len(row) - 1)]] += LETTERS[x]
                    audits[p].append(LETTERS[x] * int(many[at]) if x == DELETE else LETTERS[x])
                cost = ranked.cost[ranked.first, NOTHING].tolist()
                keep = [part.column(c) for c in ("cn", "c", "part", "illegal", "joint", "tn", "t", "role", "body")]
                yield pa.RecordBatch.from_arrays(
                    [*keep, pa.array(edits, pa.list_(pa.string())), pa.array(["".join(a) for a in audits], pa.string()), pa.array(cost, pa.int64())],
                    names=["cn", "c", "part", "illegal", "joint", "tn", "t", "role", "body", "edits", "audit", "cost"])

    arrays = ", ".join(f"{c} {kinds[c]}" for c in ("tn", "t", "role", "body"))
    return written(joined.mapInArrow(
        solved, f"cn boolean, c {kinds['c']}, part int, illegal bigint, joint bigint, {arrays}, edits array<string>, audit string, cost bigint"), "conversation-solved")


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    return to_arrow_type(df.schema[name].dataType)


def _repaired_rows(batches):
    """(conversation, role, text) of the rows after repair, from edits and rows in order."""
    key, state, edit = None, NOTHING, None
    for batch in slices(batches, 1024):
        names = [*CONVERSATION, "tag", "edit", "role"]
        for cn, c, tag, change, role, text in zip(*[batch.column(n).to_pylist() for n in names], utf8(batch.column("text"))):
            if (cn, c) != key:
                key, state, edit = (cn, c), NOTHING, None
                yield key, None, None
            if tag == 0:
                edit = change
                continue
            for letter in edit or "":
                if letter in "IR":
                    state = int(FORWARD[state])
                    yield key, ROLES[state], b"" if letter == "I" else text
                elif letter == "K":
                    state = int(KEPT[INITIALS.index(role[0]), state])
                    yield key, role.encode(), text
            # Further copies of the row are gone.
            edit = None


def _in_order(placed: DataFrame, solved: DataFrame) -> DataFrame:
    """Edits, each before its row, in the order of the conversations."""
    changes = solved.select(*CONVERSATION, F.explode(F.arrays_zip("tn", "t", "role", "body", "edits")).alias("z")).select(
        *CONVERSATION, *[F.col(f"z.{c}").alias(c) for c in PLACE], F.col("z.edits").alias("edit"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("tag"))
    rows = placed.select(*CONVERSATION, *PLACE, F.lit(None).cast("string").alias("edit"), "text", F.lit(1).alias("tag"))
    return changes.unionByName(rows).repartition(*CONVERSATION).sortWithinPartitions(*CONVERSATION, *PLACE, "tag")


def _hashes(placed: DataFrame, solved: DataFrame) -> DataFrame:
    """``(cn, c, repaired_sha256)``: the hash of each conversation's repaired rows, row by row."""
    kind, arrow = dict(placed.dtypes)["c"], _arrow_type(placed, "c")

    def hashed(batches):
        out, key, digest, started = {"cn": [], "c": [], "h": []}, None, None, False

        def close():
            out["cn"].append(key[0])
            out["c"].append(key[1])
            out["h"].append(digest.hexdigest())

        def flushed():
            made = [pa.array(out["cn"], pa.bool_()), pa.array(out["c"], arrow), pa.array(out["h"], pa.string())]
            return pa.RecordBatch.from_arrays(made, names=["cn", "c", "repaired_sha256"])

        for now, role, text in _repaired_rows(batches):
            if role is None:
                if key is not None:
                    close()
                if len(out["c"]) >= 8192:
                    yield flushed()
                    out = {"cn": [], "c": [], "h": []}
                key, digest, started = now, hashlib.sha256(), False
                continue
            digest.update((b"\n" if started else b"") + role + b":")
            digest.update(text)
            started = True
        if key is not None:
            close()
            yield flushed()

    return _in_order(placed, solved).mapInArrow(hashed, f"cn boolean, c {kind}, repaired_sha256 string")


def _solution(rows: DataFrame, range_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with keys, distinct rows with faults, solved pieces)."""
    placed = _placed(rows)
    judged = written(_faults(placed), "conversation-faults")
    pieces = _pieces(judged, range_rows)
    chained = written(_chained(pieces), "conversation-chain")
    known = written(_entered(pieces, chained), "conversation-entries")
    return placed, judged, _solved(pieces, known)


def repaired(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(conv_id, place, role, text)``: the repaired conversations' rows, numbered from 0 in their order."""
    named = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    placed, _, solved = _solution(named, range_rows)
    kind, arrow = dict(placed.dtypes)["c"], _arrow_type(placed, "c")

    def listed(batches):
        def made(held):
            cn, c, place, roles, texts = zip(*held)
            arrays = [pa.array(cn, pa.bool_()), pa.array(c, arrow), pa.array(place, pa.int64())]
            arrays += [pa.array(x, pa.binary()).cast(pa.string()) for x in (roles, texts)]
            return pa.RecordBatch.from_arrays(arrays, names=["cn", "c", "place", "role", "text"])

        held, at = [], 0
        for key, name, body in _repaired_rows(batches):
            if name is None:
                at = 0
                continue
            held.append((*key, at, name, body))
            at += 1
            if len(held) >= 256:
                yield made(held)
                held = []
        if held:
            yield made(held)

    out = _in_order(placed, solved).mapInArrow(listed, f"cn boolean, c {kind}, place bigint, role string, text string")
    return out.select(F.when(~F.col("cn"), F.col("c")).alias(conv_id), "place", "role", "text")


def repair(
    rows: DataFrame, original: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Per conversation of ``original`` (or ``rows``): faults, least ``cost``, least ``audit`` of the cheapest edits and the hash of the result."""
    named = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    placed, judged, solved = _solution(named, range_rows)
    turns = judged.groupBy(*CONVERSATION, "tn", "t").agg(*[
        F.sum(F.when(F.col("fault") == name, 1 if name != "blank" else F.col("copies")).otherwise(0)).alias(name) for name in ("blank", "truncated")],
        F.sum(F.when(F.col("fault") == "blank", 0).when(F.col("fault") == "duplicate", F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicate"))
    known_turn = F.when(F.col("tn"), F.col("t"))
    span = F.max(known_turn) - F.min(known_turn) + 1 - F.count_if("tn")
    counts = turns.groupBy(*CONVERSATION).agg(
        F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"), *[F.sum(c).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated")])
    joined = solved.groupBy(*CONVERSATION).agg(
        F.sum(F.col("illegal") + F.coalesce("joint", F.lit(0))).alias("illegal"), F.min_by("cost", "part").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    found = counts.join(joined, CONVERSATION).join(_hashes(placed, solved), CONVERSATION)
    wanted = named if original is None else original.select(F.col(conv_id).alias("conv_id"))
    kind = dict(wanted.dtypes)["conv_id"]
    ids = wanted.select(F.col("conv_id").isNull().alias("cn"), _without_null(F.col("conv_id"), kind).alias("c")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(found, CONVERSATION, "left").select(
        F.when(~F.col("cn"), F.col("c")).alias(conv_id), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
