"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vellum.llm import conversation_repair as C

SHAPE = re.compile("(s?(ua)+)?")


def kind(conv, turn):
    return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20


def harmed(rows):
    for conv, turn, role, text in rows:
        role, text, k = " " if role is None else role, " " if text is None else text, kind(conv, turn)
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        if k:
            yield from [(conv, turn, role, text)] * (2 if k == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(roles, bad):
    """Cost and audit of the first legal end in a search in order of cost and audit, one edit at a time."""
    following = lambda s: "a" if s[-1:] == "u" else "u"
    found, heap = [], {}
    queue = [(0, "", 0, "")]
    while queue:
        cost, audit, i, made = heapq.heappop(queue)
        key = (i, made)
        if key in heap and heap[key] <= (cost, audit):
            continue
        heap[key] = (cost, audit)
        if i == len(roles) and made in ("", "a"):
            found.append((cost, audit))
        if len(audit) < len(roles) + 6:
            heapq.heappush(queue, (cost + 3, audit + "I", i, following(made)))
        if i < len(roles):
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, made))
            if bad[i] not in ("blank", "duplicate"):
                more = 3 if bad[i] == "truncated" else 0
                heapq.heappush(queue, (cost + 3 + more, audit + "R", i + 1, following(made)))
                c = roles[i][:1]
                if c == "s" and made == "" or c == following(made) and c in "ua" and c:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, c))
    return min(found)


def replayed(rows, audit):
    out, rows = [], iter(rows)
    for e in audit:
        row = None if e == "I" else next(rows)
        if e == "D":
            continue
        if e == "K":
            out.append((row[2], row[3]))
        else:
            out.append(("assistant" if out and out[-1][0][0] == "u" else "user", "" if e == "I" else row[3]))
    assert SHAPE.fullmatch("".join(r[:1] for r, _ in out))
    return out


def plain(conv, rows):
    rows = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
    bad = faults(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit = cheapest([r[2] for r in rows], bad)
    text = "\n".join(f"{r}:{t}" for r, t in replayed(rows, audit))
    return (conv, gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def conversations(seed, n=60, most=9):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        conv = None if c == 7 else c
        for t in sorted(rng.sample(range(40), rng.randrange(1, most))):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            out.append((conv, None if c % 9 == 0 and not any(r[0] == conv for r in out) else t, role, rng.choice(["Yes.", "No!", "half of", "", " \n", None, "ok? ", "é…", "Yes.", f"own {t}."])))
    return out


def answer(spark, rows, harm=True, parts=2):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    left = C.damaged(frame) if harm else frame
    found = C.audits(left)
    got = C.report(frame, found, C.digests(C.replay(left, found)))
    return {r.conv_id: tuple(r) for r in got.collect()}


@pytest.mark.parametrize("seed,piece", [(1, 400), (2, 2), (3, 1)])
def test_equals_a_search_over_all_edits(spark, monkeypatch, seed, piece):
    monkeypatch.setattr(C, "PIECE", piece)
    rows = conversations(seed)
    left = list(harmed(rows))
    got = answer(spark, rows)
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        assert got[conv] == plain(conv, left)


def test_long_conversations_are_solved_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 7)
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", f"c{t}.", ""])) for t in range(300)] + [(2, 0, "user", "x.")]
    got = answer(spark, rows, harm=False, parts=5)
    assert got[1] == plain(1, rows) and got[2] == plain(2, rows) and got[2][7] == "KI"


def test_solver_equals_the_search(monkeypatch):
    solve = C.solver()
    letters = "suaoxSUA"
    for n in range(5):
        for s in itertools.product(letters, repeat=n):
            roles = [{"o": "tool", "x": "user"}.get(c.lower(), c.lower()) for c in s]
            bad = ["blank" if c == "x" else "truncated" if c.isupper() else "" for c in s]
            assert solve("".join(s), C.NOTHING, None) == cheapest(roles, bad)


def test_rows_of_one_turn_copies_and_dropped_conversations(spark):
    gone = next(t for t in range(1000) if kind(5, t) == 0)
    whole = next(t for t in range(1000) if kind(6, t) > 4)
    rows = [(5, gone, "user", "Hi."), *[(6, whole, "user", "Same.")] * 5, (6, whole, "assistant", "Other."), (None, None, None, None)]
    got = answer(spark, rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert got[5] == (5, 0, 0, 0, 0, 0, 0, "", empty)
    assert got[6][1:8] == (0, 0, 4, 0, 4, 22, "IKKDDDDI") and len(got) == 3  # the assistant's row comes first
    assert got[None][1:3] == (0, 1 if kind(None, None) else 0)


def test_replay_gives_rows_in_order_and_tables_may_be_empty(spark):
    rows = spark.createDataFrame([(1, 3, "user", "Q.", 9), (1, 5, "user", "More.", 9), (1, 4, "assistant", "A.", 9)], "conv_id long, turn long, role string, text string, audit int")
    found = C.audits(rows)
    assert [tuple(r)[1:] for r in C.replay(rows, found).orderBy("n").collect()] == [(0, "K", "user", "Q."), (1, "K", "assistant", "A."), (2, "K", "user", "More."), (3, "I", "assistant", "")]
    none = rows.limit(0)
    assert C.audits(none).count() == 0 and C.report(none, C.audits(none), C.digests(C.replay(none, C.audits(none)))).count() == 0
    assert C.damaged(rows.withColumn("kind", F.lit("x"))).columns == ["conv_id", "turn", "role", "text"]


def test_a_long_text_and_many_turns(spark):
    text = "word " * 200_000 + "."
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} {text}" if t < 2 else f"{t}.") for t in range(1200)]
    got = answer(spark, rows, harm=False)
    assert got[1][:8] == (1, 0, 0, 0, 0, 0, 0, "K" * 1200)
    assert got[1][8] == hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x in rows).encode()).hexdigest()
