"""The delay of captions that follows measured skew: runs of reports at a time, in whole milliseconds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a report can be, and the reason that it leaves behind.
ASKED, WITHIN, EARLY, LATE = range(4)
REASONS = ("explicit_request", "within_tolerance", "caption_early", "caption_late")
STEPPED = "stable_step_down"


@dataclass(frozen=True)
class Delay:
    """Settings and state of the delay of one session, in seconds."""

    target: float = 0.0
    stable: int = 0
    reason: str = "initial"
    lowest: float = 0.0
    highest: float = 120.0
    step: float = 0.5
    stable_reports: int = 20
    step_down: float = 0.25

    def report(self, mismatch_ms: float, tolerance_ms: float = 250.0) -> Delay:
        """After a measured skew; positive means that captions are late."""
        return self.after([mismatch_ms], [tolerance_ms], [np.nan])[0]

    def request(self, seconds: float) -> Delay:
        return self.after([0.0], [0.0], [seconds])[0]

    def after(self, mismatch_ms, tolerance_ms, request_seconds) -> tuple[Delay, np.ndarray, np.ndarray, np.ndarray]:
        """The state behind some reports (a request that is not missing counts as one), and target, stable and reason behind each.

        Reports of one kind in a row are a run.  In a run within tolerance the target falls by a step for every `stable_reports` since the last other
        report; early ones change nothing; late ones raise it by what is missing, by a step at least and by a step
        more than it has risen at most, until it is at its highest; requests set it.
        """
        skew, tolerance, asked = (np.asarray(x, np.float64) for x in (mismatch_ms, tolerance_ms, request_seconds))
        named = ~np.isnan(asked)
        if (tolerance[~named] < 0).any():
            raise ValueError("a tolerance is below zero")
        if ((asked[named] < self.lowest) | (asked[named] > self.highest)).any():
            raise ValueError(f"only delays from {self.lowest:g} to {self.highest:g} seconds can be asked for")
        kind = np.select([named, np.abs(skew) <= tolerance, skew < 0], [ASKED, WITHIN, EARLY], LATE)
        low, high, step, fall = (round(1000 * x) for x in (self.lowest, self.highest, self.step, self.step_down))
        target, stable = np.empty(len(kind), np.int64), np.zeros(len(kind), np.int64)
        reason = np.asarray(REASONS, object)[kind]
        now, calm = round(1000 * self.target), self.stable
        cuts = np.flatnonzero(np.diff(kind)) + 1
        for at, to in zip([0, *cuts], [*cuts, len(kind)], strict=True) if len(kind) else ():
            own = slice(at, to)
            if kind[at] == WITHIN:
                count = calm + 1 + np.arange(to - at)
                falls = count // self.stable_reports
                target[own], stable[own] = np.where(falls > 0, np.maximum(low, now - fall * falls), now), count % self.stable_reports
                reason[own][stable[own] == 0] = STEPPED
            elif kind[at] == EARLY:
                target[own] = now
            elif kind[at] == ASKED:
                target[own] = np.rint(1000 * asked[own])
            else:
                target[own] = high
                level = float(now)
                for i in range(at, to):
                    level = round(level + min(max(skew[i], step), level - low + step))
                    if level >= high:
                        break  # and stays there
                    target[i] = level
            now, calm = int(target[to - 1]), int(stable[to - 1])
        end = replace(self, target=now / 1000, stable=calm, reason=str(reason[-1]) if len(kind) else self.reason)
        return end, target / 1000, stable, reason


DELAYS = "session string, seq long, target double, stable int, reason string"
_STATE = "target double, stable int, reason string"


def _behind(state: Delay, rows: pd.DataFrame) -> tuple[Delay, pd.DataFrame]:
    state, target, stable, reason = state.after(rows["mismatch_ms"], rows["tolerance_ms"], rows["request_seconds"])
    return state, pd.DataFrame({"session": rows["session"].to_numpy(), "seq": rows["seq"].to_numpy(), "target": target, "stable": stable.astype(np.int32), "reason": reason})


def delays(reports: DataFrame, start: Delay | None = None) -> DataFrame:
    """The delay after each report (session, seq, mismatch_ms, tolerance_ms[, request_seconds]); batch or streaming input.

    Reports are read in order by sorted partitions, of which a task holds one Arrow batch and one state; in a
    stream the state is carried from batch to batch.
    """
    start = start or Delay()
    asked = F.col("request_seconds").cast("double") if "request_seconds" in reports.columns else F.lit(None).cast("double")
    rows = reports.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), F.col("mismatch_ms").cast("double").alias("mismatch_ms"), F.col("tolerance_ms").cast("double").alias("tolerance_ms"), asked.alias("request_seconds"))
    if reports.isStreaming:

        def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            now = replace(start, **dict(zip(("target", "stable", "reason"), state.get, strict=True))) if state.exists else start
            now, out = _behind(now, pd.concat(list(batches)).sort_values("seq"))
            state.update((now.target, now.stable, now.reason))
            yield out

        return rows.groupBy("session").applyInPandasWithState(step, DELAYS, _STATE, "append", GroupStateTimeout.NoTimeout)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, now = object(), start
        for batch in batches:
            name = batch["session"]
            for own in np.split(np.arange(len(batch)), np.flatnonzero((name != name.shift())[1:]) + 1):
                if len(own):
                    if name.iloc[own[0]] != session:
                        session, now = name.iloc[own[0]], start
                    now, out = _behind(now, batch.iloc[own])
                    yield out

    return rows.repartition("session").sortWithinPartitions("session", "seq").mapInPandas(follow, DELAYS)


def snapshot(d: Delay) -> dict:
    return asdict(d)
