import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pledgelens.llm import conversations as cv

AFTER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}


def brute(rows):
    """(cost, audit, lines) of rows of (role, text, forced, open), by plain comparison of whole audits from the end."""
    best = {0: (0, "", ()), 1: (6, "II", ("user:", "assistant:")), 2: (3, "I", ("assistant:",)), 3: (0, "", ())}
    for role, text, forced, is_open in reversed(rows):
        row = {}
        for s in range(4):
            c, a, t = best[s]
            found = [(c + 4, "D" + a, t)]
            if not forced:
                h, name = NEXT[s]
                c, a, t = best[h]
                found.append((c + 3 + 3 * is_open, "R" + a, (f"{name}:{text}", *t)))
                if role[:1] in AFTER[s]:
                    c, a, t = best[AFTER[s][role[:1]]]
                    found.append((c + 3 * is_open, "K" + a, (f"{role}:{text}", *t)))
            row[s] = min(found)
        best = {}
        for s in range(4):
            h, name = NEXT[s]
            g, more = NEXT[h]
            once = (row[h][0] + 3, "I" + row[h][1], (f"{name}:", *row[h][2]))
            twice = (row[g][0] + 6, "II" + row[g][1], (f"{name}:", f"{more}:", *row[g][2]))
            best[s] = min(row[s], once, twice)
    return best[0]


def expected(rows):
    """Per conversation the result of the contract; ``rows`` of (conv_id, turn, role, text) as damaged."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(
            ((t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv),
            key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, layers, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            body = text.strip(cv.SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            layers.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = brute(layers)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def check(spark, rows, range_rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string")
    want = expected(rows)
    got = {r.conv_id: tuple(r)[1:] for r in cv.repair(df, range_rows=range_rows).collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    for v in want.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in v[-1]))
    return df, want


def random_rows(rng, conv, n):
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["Yes.", "No", " \t", "", "Why?", "ok!  ", "é", None, "a. b"]
    return [
        (conv, rng.randrange(n) if rng.random() < 0.3 else i, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(9)}{rng.choice('.!?x')}")
        for i in range(n)
    ]


def test_pieces_of_long_conversations_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [r for conv, n in enumerate([1, 2, 3, 5, 8, 13, 90, 1, 40]) for r in random_rows(rng, conv, n)]
    rows += [(None, None, "user", "Hi."), (None, None, "user", "Hi."), (None, 3, None, None), (77, None, "system", "S."), (77, None, "assistant", "A.")]
    rows += [(5, 2, "user", "again.")] * 25 + [(78, 1, "user", "")] * 9
    df, want = check(spark, rows, 4)
    got = {}
    for r in cv.repaired(df, range_rows=4).collect():
        got.setdefault(r.conv_id, {})[r.place] = f"{r.role}:{r.text}"
    for conv, (*_, lines) in want.items():
        assert [got.get(conv, {}).get(i) for i in range(len(lines))] == list(lines) and len(got.get(conv, {})) == len(lines)


def test_small_ranges_and_one_range_agree(spark):
    rng = random.Random(8)
    rows = [r for conv in range(30) for r in random_rows(rng, conv, rng.randrange(1, 7))]
    check(spark, rows, 100_000)


def test_every_original_conversation_and_empty_tables(spark):
    kind = "conv_id bigint, turn bigint, role string, text string"
    original = spark.createDataFrame([(1, 0, "user", "x."), (2, 0, "user", "y."), (None, None, None, None)], kind)
    got = {r.conv_id: tuple(r)[1:] for r in cv.repair(original.where("conv_id = 2"), original).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1] == got[None] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[2][:-1] == (0, 0, 0, 0, 0, 3, "KI")
    assert cv.repair(original.limit(0)).collect() == [] and cv.repaired(original.limit(0)).collect() == []


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", f"A.{c}!? b") for c in range(12) for t in range(12)] + [(None, 4, None, None), (5, None, "user", "u.")]
    want = []
    for c, t, role, text in rows:
        name = f"{' ' if c is None else c}:{' ' if t is None else t}"
        roll = zlib.crc32(name.encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if roll == 4 else role, "" if roll == 1 else re.sub("[.!?]", "", text) if roll == 2 else text)
        want += [row] * (0 if roll == 0 else 2 if roll == 3 else 1)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, cv.damaged(df).collect()), key=key) == sorted(want, key=key)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(1, 3)), min_size=1, max_size=9), min_size=1, max_size=4))
def test_ranked_paths(conversations):
    """Letters, costs and matrices of the least paths, against whole audits."""
    names, pieces, layers = ["system", "user", "assistant", "x"], [], []
    for rows in conversations:
        initials, faults, copies = (np.array(x) for x in zip(*rows))
        codes, many, row = cv._layers(initials, faults, copies)
        pieces.append((codes, many, cv.AT_END, True))
        layers.append([(names[i], "t", k > 0 or f == 1, f == 2) for i, f, c in rows for k in range(c)])
    ranked = cv.Ranked(pieces)
    which, layer, letter = ranked.path(np.arange(len(pieces)), np.zeros(len(pieces), int))
    for p, rows in enumerate(layers):
        cost, audit, _ = brute(rows)
        steps = [(cv.LETTERS[x], x == cv.DELETE and ranked.many[y] or 1) for y, x in zip(layer[which == p], letter[which == p])]
        assert "".join(a * int(n) for a, n in steps) == audit
        assert ranked.cost[ranked.first[p], cv.NOTHING] == cost
        codes, many, end, _ = pieces[p]
        assert (cv.matrix(codes, many) + end[None]).min(axis=1)[cv.NOTHING] == cost
    # Ranks order the nodes as their whole audits do.
    audits = {}
    for node in range(len(ranked.rank)):
        word, at = "", node
        while ranked.letter[at]:
            word, at = word + cv.LETTERS[ranked.letter[at] - 1], int(ranked.jumps[0][at])
        audits[node] = word
    order = sorted(audits, key=audits.get)
    assert all((ranked.rank[a] < ranked.rank[b]) == (audits[a] < audits[b]) for a, b in zip(order, order[1:]))
