"""Live sessions on Structured Streaming: clock, late and delayed delivery, batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAX_LAG, HISTORY, BATCH = 30.0, 500, 20


def gap_sessions(events: DataFrame, by: str, at: Column, gap: float) -> DataFrame:
    """Batch sessions: a row begins one when it is more than `gap` seconds after the one before."""
    w = Window.partitionBy(by).orderBy("_at")
    rows = events.withColumn("_at", at)
    new = F.coalesce((F.col("_at") - F.lag("_at").over(w) > gap).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_at")


# --- clock ---------------------------------------------------------------------------


def anchors(reads: DataFrame, rate: int, limit: float = 1.0) -> DataFrame:
    """Anchor in force after each read (session, seq, received, wall, caught_up), in order of seq.

    The first read anchors; a reader without backlog anchors anew when the
    stream's time and the wall differ by more than the limit.  Between two anchors all reads of a batch are compared at once.
    """
    kind = dict(reads.dtypes)["session"]
    typed = reads.select("session", F.col("seq").cast("long").alias("seq"), F.col("received").cast("long").alias("received"), F.col("wall").cast("double").alias("wall"), "caught_up")

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, sample, at = object(), 0, 0.0
        for batch in (b for b in batches if len(b)):
            name, received, wall, free = batch["session"], batch["received"].to_numpy(), batch["wall"].to_numpy(), batch["caught_up"].to_numpy(bool)
            samples, walls, drifts = np.empty(len(batch), np.int64), np.empty(len(batch)), np.full(len(batch), np.nan)
            cuts = np.flatnonzero((name != name.shift())[1:]) + 1
            for first, end in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if name.iloc[first] != session:
                    session, sample, at = name.iloc[first], int(received[first]), float(wall[first])
                width = 64
                while first < end:
                    some = slice(first, min(end, first + width))
                    off = wall[some] - (at + (received[some] - sample) / rate)
                    far = np.flatnonzero(free[some] & (np.abs(off) > limit))
                    to = first + int(far[0]) if len(far) else some.stop
                    samples[first:to], walls[first:to] = sample, at
                    width *= 2
                    if len(far):
                        sample, at, width = int(received[to]), float(wall[to]), 64
                        samples[to], walls[to], drifts[to] = sample, at, off[to - first]
                        to += 1
                    first = to
            yield pd.DataFrame({"session": name, "seq": batch["seq"], "anchor_sample": samples, "anchor_wall": walls, "drift": pd.Series(drifts).astype("Float64")})

    ordered = typed.repartition("session").sortWithinPartitions("session", "seq")
    return ordered.mapInPandas(follow, f"session {kind}, seq long, anchor_sample long, anchor_wall double, drift double")


# --- delivery ------------------------------------------------------------------------


def late(queued: Column, now: Column, limit: float = MAX_LAG) -> Column:
    """Whether a segment waited too long to be worth transcribing."""
    return now - queued > limit


def numbered(rows: DataFrame) -> DataFrame:
    """Sequence numbers of the transcripts that are sent: those with text, in order."""
    w = Window.partitionBy("session").orderBy("start")
    return rows.where(F.trim("text") != "").withColumn("sequence", F.row_number().over(w))


def released(rows: DataFrame, delay: float) -> DataFrame:
    """When each transcript may be released: not before its end plus the delay, nor before an earlier one."""
    w = Window.partitionBy("session").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("release_at", F.max(F.col("wall_end") + F.lit(float(delay))).over(w))


def due(rows: DataFrame, now: Column, delay: float) -> DataFrame:
    return released(rows, delay).where(F.col("release_at") <= now)


def hold_back(rows: DataFrame, delay: float, clock: Callable[[], float] = time.time) -> DataFrame:
    """Streaming form: transcripts (session, sequence, wall_end, text) wait in state until they are due, in order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = [tuple(x) for x in state.get[0]] if state.exists else []
        if not state.hasTimedOut:
            for batch in batches:
                waiting += list(batch[["sequence", "wall_end", "text"]].itertuples(index=False, name=None))
        waiting.sort()
        now, go = clock(), 0
        while go < len(waiting) and waiting[go][1] + delay <= now:
            go += 1
        out, left = waiting[:go], waiting[go:]
        state.update(([tuple(x) for x in left],))
        if left:
            state.setTimeoutDuration(max(1, int((left[0][1] + delay - now) * 1000)))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["session", "sequence", "wall_end", "text"])

    return rows.groupBy("session").applyInPandasWithState(step, "session string, sequence long, wall_end double, text string", "waiting array<struct<sequence:bigint,wall_end:double,text:string>>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def resumed(events: DataFrame, last_id: int | None, history: int = HISTORY) -> DataFrame:
    """Events after an id, of the newest `history` of each session."""
    w = Window.partitionBy("session").orderBy(F.desc("id"))
    kept = events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= history).drop("_n")
    return kept if last_id is None else kept.where(F.col("id") > last_id)


# --- push delivery -----------------------------------------------------------------------


def push_batches(events: DataFrame, size: int = BATCH) -> DataFrame:
    """Ordered batches of at most `size` events of each session (session, id, payload)."""
    w = Window.partitionBy("session").orderBy("id")
    rows = events.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
    return rows.groupBy("session", "batch").agg(F.sort_array(F.collect_list(F.struct("id", "payload"))).alias("items"))


def outcome(status: int | None) -> str:
    """What an HTTP status (None: no answer) means for a batch: sent, retry or drop."""
    if status is not None and 200 <= status < 300:
        return "sent"
    return "retry" if status is None or status >= 500 or status in (401, 403, 429) else "drop"


class DeliveryFailed(RuntimeError):
    """A receiver did not take a batch after all tries; the stream stops and replays it when it starts again."""


def push(events: DataFrame, send: Callable[[str, list[dict]], int | None], checkpoint: str, size: int = BATCH, linger: str = "1 second", tries: int = 5, wait: Callable[[float], None] = time.sleep, dropped=None):
    """Deliver streamed events in ordered batches; a failing batch is tried again with growing waits, up to 5 s.

    One partition sends one session's batches in order.  A batch that the receiver refuses for good is dropped
    (`dropped`, an accumulator of whole numbers, counts its events); one that still fails after all tries raises DeliveryFailed,
    so nothing behind it is sent and the batch is replayed from the checkpoint.
    """

    def deliver(rows) -> None:
        for row in rows:
            pause, items = 0.5, [x.asDict() for x in row["items"]]
            for _ in range(tries):
                result = outcome(send(row["session"], items))
                if result != "retry":
                    break
                wait(pause)
                pause = min(5.0, pause * 2)
            else:
                raise DeliveryFailed(f"a batch of {len(items)} events of session {row['session']} was not taken after {tries} tries")
            if result == "drop" and dropped is not None:
                dropped.add(len(items))

    def each(batch: DataFrame, _: int) -> None:
        push_batches(batch, size).repartition("session").sortWithinPartitions("session", "batch").foreachPartition(deliver)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=linger)


def delivery_error(mode: Column, url: Column, token: Column, hosts: list[str], longest: int = 2000) -> Column:
    """Why a delivery request is not valid, or null; neither URL nor token is repeated."""
    from vellum.functions.text import host_allowed

    return (
        F.when(~F.coalesce(mode, F.lit("sse")).isin("sse", "push"), "unknown mode")
        .when(F.coalesce(mode, F.lit("sse")) == "sse", F.when(url.isNotNull() | token.isNotNull(), "url and token are for push only"))
        .when(F.lit(not hosts), "push is not enabled")
        .when(F.coalesce(F.length(url), F.lit(0)) == 0, "url is missing")
        .when(F.length(url) > longest, "url is too long")
        .when(token.isNotNull() & ((token == "") | (F.length(token) > longest) | (F.trim(token) != token) | token.rlike("\\p{Cntrl}")), "token is not valid")
        .when(~host_allowed(url, hosts), "url is not allowed")
    )


def publish(transcripts: DataFrame, path: str, checkpoint: str):
    """Append streamed events to files of lines, which readers follow by id."""
    return transcripts.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
