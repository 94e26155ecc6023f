"""Repair of the structure of conversations, solved once for each distinct signature.

A conversation's rows are taken by turn, nulls first; rows of one turn by role and then by a hash of the text.  The first fault
that a row has counts: blank (nothing but ``[\\x20\\x09-\\x0D]``), duplicate (role and text came before), truncated (the last other character is
not one of ``.!?``).  Edits keep a row (K, costs 0), give it the role user or assistant (R, 3), delete it (D, 4; blank and
duplicate rows must go) or insert a user or assistant row without text anywhere (I, 3); a truncated row that stays costs 3 more.
The cheapest edits whose roles' initials are ``(s?(ua)+)?`` win, the ASCII-least sequence among equals.

1. Equal rows become one with a count, and a row is a duplicate if its role and text have an earlier turn: two aggregations,
   of hashes instead of texts.
2. Signatures: rows are dealt out by ranges of conversation and turn, so a long conversation is spread over
   tasks.  Each becomes a string with a letter a row: the initial of its role, in upper case if
   truncated, ``x`` if it must go.  Longer ones are pieces of `PIECE` rows.
3. Distinct signatures alone are solved, by recursion over their endings with memory.  A piece gets its cheapest edits from
   each state that may come before to each that may come after; edits of equal cost never begin with one another, as
   insertions stand before a row, so the least sequence of pieces is one of least pieces.
4. Results are joined back by signature, and a conversation's pieces put together from the last to the first.
5. `replay` reads the texts in order beside the edits, and `digests` hashes what it gives.

A conversation's audit is one string, and a hash over its text is sequential, so one task reads the texts of
a conversation, in batches; it holds no more than its audit.

Cases: null roles and texts are one space; a null conversation is one of its own; null turns come first and do not count in gaps; equal rows
are duplicates; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import batched, hot_join, hot_keys, written

#: Rows of a piece; the recursion goes as deep.
PIECE = 400
#: States: nothing yet, behind a system row, behind a user's, behind an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a row that is made to fit, and behind a kept row where it fits.
FITTED = (USER, USER, ASSISTANT, USER)
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
#: What is left to insert at the end.
LAST = ((0, ""), (6, "II"), (3, "I"), (0, ""))
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
MOST_INSERTS = 2  # a third in a row leads back to a state that the first one reached
SPACE = " \t\n\x0b\x0c\r"

Edits = tuple[int, str]


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after damage by the remainder of crc32(`conv_id:turn`) by 20: 0 goes, 1 loses its text, 2 its ``.!?``, 3 comes twice, 4 is a user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with two hashes of their text, which order rows of one turn and role."""
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumns({"h": F.xxhash64("text"), "g": F.crc32(F.col("text").cast("binary"))})


def _beside(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    other = more.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in more.columns if c not in keys))
    return rows.join(other, functools.reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left").drop(*(f"_{k}" for k in keys))


def graded(rows: DataFrame) -> DataFrame:
    """Distinct rows without texts: conv_id, turn, role, h, g, how often they come, and fault (blank, duplicate, truncated or null)."""
    end = F.rtrim("text", F.lit(SPACE))
    fault = F.when(end == "", "blank").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    each = rows.groupBy("conv_id", "turn", "role", "h", "g").agg(F.count(F.lit(1)).alias("copies"), F.max(fault).alias("own"))
    each = written(each, "distinct-rows")
    turns = each.groupBy("conv_id", "role", "h", "g").agg(F.min(F.struct("turn")).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = F.col("earliest").isNotNull() & ~F.col("earliest.turn").eqNullSafe(F.col("turn"))
    fault = F.when(F.col("own") == "blank", "blank").when(again, "duplicate").otherwise(F.col("own"))
    return _beside(each, turns, ["conv_id", "role", "h", "g"]).select("conv_id", "turn", "role", "h", "g", "copies", fault.alias("fault"))


PIECES = "conv_id long, part long, k long, signature string, open boolean, initials string, illegal long, blank long, duplicate long, truncated long, low long, high long, turns long"


def signatures(rows: DataFrame) -> DataFrame:
    """PIECES of conversations in order (part, k) from graded rows; `open` unless the piece is surely a whole conversation."""
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    codes = rows.select("conv_id", "turn", "role", "h", "g", "copies", "fault", F.ascii(initial).alias("initial"), F.ascii(letter).alias("letter"))
    order = ["conv_id", "turn", "role", "h", "g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            copies = get("copies")
            row = np.repeat(np.arange(batch.num_rows), copies)
            first = np.concatenate([[True], row[1:] != row[:-1]])
            letter = np.where(first, get("letter")[row], ord("x")).astype(np.uint8)
            initial = get("initial")[row].astype(np.uint8)
            fault = np.array(batch.column("fault").fill_null("").to_pylist())
            conv, none = get("conv_id"), batch.column("conv_id").is_null().to_numpy(zero_copy_only=False)
            new_row = np.concatenate([[True], (conv[1:] != conv[:-1]) | (none[1:] != none[:-1])])
            group = (np.cumsum(new_row) - 1)[row]
            at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            size = np.diff(np.append(at, len(row)))
            parts = -(-size // PIECE)
            begin = np.repeat(at, parts) + PIECE * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
            end = np.append(begin[1:], len(row))
            whole = np.repeat(parts == 1, parts)
            whole[0] = whole[-1] = False  # may go on in another batch
            pair = np.zeros(len(row), bool)
            pair[1:] = ~np.isin(initial[:-1].astype(np.int32) * 256 + initial[1:], [ord(x) * 256 + ord(y) for x, y in ("su", "ua", "au")])
            pair[begin] = False
            turn, dated = get("turn"), ~batch.column("turn").is_null().to_numpy(zero_copy_only=False)
            turn, dated = turn[row], dated[row]
            change = dated.copy()
            change[1:] &= (turn[1:] != turn[:-1]) | ~dated[:-1]
            change[begin] = dated[begin]
            add = lambda x: np.add.reduceat(x.astype(np.int64), begin)  # noqa: B023, E731
            blank, truncated = fault[row] == "blank", (fault[row] == "truncated") & first
            repeated = (letter == ord("x")) & ~blank
            some = dated[end - 1]
            early = np.iinfo(np.int64).max
            text, marks = letter.tobytes().decode(), initial.tobytes().decode()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id").take(pa.array(row[begin])), pa.array(np.full(len(begin), part, np.int64)), pa.array(np.arange(k, k + len(begin))),
                    pa.array([text[a:b] for a, b in zip(begin, end, strict=True)]), pa.array(~whole), pa.array([marks[a] + marks[b - 1] for a, b in zip(begin, end, strict=True)]),
                    *(pa.array(add(x)) for x in (pair, blank, repeated, truncated)),
                    pa.array(np.minimum.reduceat(np.where(dated, turn, early), begin), mask=~some), pa.array(turn[end - 1].astype(np.int64), mask=~some), pa.array(add(change)),
                ],
                names=[x.split()[0] for x in PIECES.split(", ")],
            )
            k += len(begin)

    return batched(codes.repartitionByRange(*order).sortWithinPartitions(*order).drop("role", "h", "g"), run, PIECES)


def solver() -> Callable[[str, int, int | None], Edits | None]:
    """A function from a signature, the state before it and the state wanted after it (None: a legal end) to the cheapest edits."""
    memory: dict = {}

    def best(rest: str, state: int, goal: int | None) -> Edits | None:
        if not rest:
            return LAST[state] if goal is None else (0, "") if state == goal else None
        key = (rest, state, goal)
        if key in memory:
            return memory[key]
        letter, tail, options = rest[0], rest[1:], []
        extra = TRUNCATED if letter.isupper() else 0
        for inserts in range(MOST_INSERTS + 1):
            ways = [(DELETE, "D", state)]
            if letter != "x":
                ways.append((REROLE + extra, "R", FITTED[state]))
                if state in KEPT[letter.lower()]:
                    ways.append((extra, "K", KEPT[letter.lower()][state]))
            for cost, edit, after in ways:
                if then := best(tail, after, goal):
                    options.append((INSERT * inserts + cost + then[0], "I" * inserts + edit + then[1]))
            state = FITTED[state]
        memory[key] = min(options, default=None)
        return memory[key]

    def solve(signature: str, state: int, goal: int | None) -> Edits | None:
        if len(memory) > 1 << 17:
            memory.clear()
        return best(signature, state, goal)

    return solve


def solved(distinct: DataFrame) -> DataFrame:
    """For each distinct signature (signature, open) the costs and edits: from nothing to a legal end, and if open from each state to a legal end and to each state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = solver()
        for batch in batches:
            found = []
            for signature, is_open in zip(batch.column("signature").to_pylist(), batch.column("open").to_pylist(), strict=True):
                wanted = [(s, g) for g in (None, *range(4)) for s in range(4)] if is_open else [(NOTHING, None)]
                found.append([solve(signature, s, g) or (None, None) for s, g in wanted])
            costs, edits = ([[x[i] for x in one] for one in found] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("signature"), batch.column("open"), pa.array(costs, pa.list_(pa.int64())), pa.array(edits, pa.list_(pa.string()))], names=["signature", "open", "costs", "edits"])

    return batched(distinct, run, "signature string, open boolean, costs array<long>, edits array<string>")


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """AUDITS of pieces that come by conversation, the last piece first."""
    names = [x.split()[0] for x in AUDITS.split(", ")]
    now, paths, sums, low, high, turns, after = None, None, None, None, None, 0, ""

    def done() -> tuple:
        cost, chain = paths[NOTHING]
        edits = []
        while chain:
            edits.append(chain[0])
            chain = chain[1]
        return (now[0], 0 if low is None else high - low + 1 - turns, *sums, cost, "".join(edits))

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now != (r["conv_id"],):
                if now:
                    out.append(done())
                now, sums, low, high, turns, after = (r["conv_id"],), [0, 0, 0, 0], None, None, 0, ""
                paths = [None if e is None else (c, (e, None)) for c, e in zip(r["costs"][:4], r["edits"][:4], strict=True)]
            else:
                to = lambda s, e: r["edits"][4 + 4 * e + s]  # noqa: B023, E731
                ways = [[(r["costs"][4 + 4 * e + s] + paths[e][0], to(s, e), e) for e in range(4) if to(s, e) is not None and paths[e]] for s in range(4)]
                paths = [(best[0], (best[1], paths[best[2]][1])) if (best := min(w, default=None)) else None for w in ways]
            sums = [a + r[k] for a, k in zip(sums, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
            sums[3] += bool(after) and r["initials"][1] + after not in ("su", "ua", "au")
            after = r["initials"][0]
            if r["low"] is not None:
                turns += r["turns"] - (low is not None and r["high"] == low)
                low, high = r["low"], r["high"] if high is None else high
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string() if n == "audit" else pa.int64()) for i, n in enumerate(names)], names=names)
        out = []
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if n == "audit" else pa.int64()) for x, n in zip(done(), names, strict=True)], names=names)


def audits(rows: DataFrame) -> DataFrame:
    """AUDITS of all conversations that have rows (conv_id, turn, role, text)."""
    pieces = written(signatures(graded(_ordered(rows))), "signatures")
    counted = written(pieces.groupBy("signature", "open").agg(F.count(F.lit(1)).alias("n")), "distinct-signatures")
    answers = written(solved(counted.select("signature", "open")), "solved-signatures")
    full = hot_join(pieces, answers, ["signature", "open"], hot_keys(counted, ["signature", "open"]))
    order = [F.col("conv_id"), F.desc("part"), F.desc("k")]
    return written(batched(full.repartition("conv_id").sortWithinPartitions(*order).drop("signature", "open", "part", "k"), _put_together, AUDITS), "audits")


REPAIRED = "conv_id long, n long, edit string, role string, text string"


def replay(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired rows in order (n from 0) of rows and their AUDITS; a task has a conversation's rows together and in order."""
    names = [x.split()[0] for x in REPAIRED.split(", ")]
    texts = _ordered(rows).withColumn("audit", F.lit(None).cast("string"))
    first = found.select("conv_id", "audit")
    both = texts.unionByName(first, allowMissingColumns=True).withColumn("row", F.col("audit").isNull())
    order = ["conv_id", "row", "turn", "role", "h", "g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, last, n, state = None, "", 0, 0, 0, NOTHING
        for batch in batches:
            out: list[tuple] = []
            for c, a, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "audit", "role", "text")), strict=True):
                if a is not None:
                    conv, audit, at, last, n, state = c, a, 0, len(a.rstrip("I")), 0, NOTHING
                    continue
                while True:
                    edit, at = audit[at], at + 1
                    if edit in "IR":
                        state = FITTED[state]
                        out.append((conv, n, edit, "user" if state == USER else "assistant", "" if edit == "I" else text))
                        n += 1
                    elif edit == "K":
                        state = KEPT[role[0]][state]
                        out.append((conv, n, edit, role, text))
                        n += 1
                    if at >= len(audit) or (edit != "I" and at < last):
                        break
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return batched(both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text"), run, REPAIRED)


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's `role:text` lines, of rows as `replay` deals them; conversations without rows are not there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, hashed = None, None
        for batch in batches:
            out = []
            for c, n, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "n", "role", "text")), strict=True):
                if not n:
                    if hashed:
                        out.append((conv, hashed.hexdigest()))
                    conv, hashed = c, hashlib.sha256()
                hashed.update(f"{chr(10) if n else ''}{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])], names=["conv_id", "repaired_sha256"])
        if hashed:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([hashed.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return repaired.mapInArrow(run, "conv_id long, repaired_sha256 string")


def report(ids: DataFrame, found: DataFrame, hashes: DataFrame) -> DataFrame:
    """AUDITS and digests of all conversations named in `ids`; those without rows have zeros, no edits and the hash of nothing."""
    ids = ids.select(F.col("conv_id").cast("long")).distinct()
    out = _beside(_beside(ids, found, ["conv_id"]), hashes, ["conv_id"])
    longs = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
