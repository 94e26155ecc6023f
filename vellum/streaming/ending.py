"""State that ends: sessions and jobs are forgotten some time after they ended, by timers on the stream's own clock."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that an ended session is kept, and statuses of jobs that are over with their hours.
KEEP_SESSION = {"ended": 300.0}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEPT = "id string, status string, ms long, kind string"


def keep_jobs(hours: dict[str, float]) -> dict[str, float]:
    """Seconds by status from hours by status; statuses with no hours above zero are kept for good."""
    return {status: 3600.0 * h for status, h in hours.items() if h > 0}


class Ending(StatefulProcessor):
    """Newest status of each id; a status named in `keep` starts a timer, any other stops it."""

    def __init__(self, keep: dict[str, float]):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.now.get()
        status, ms = (held[0], held[1]) if held else (None, None)
        for row in sorted(rows, key=lambda r: r.ms):
            if status in self.keep and row.ms >= self._due(status, ms):  # it was over before these news, whether or not its timer has run
                yield Row(id=key[0], status=status, ms=self._due(status, ms), kind="forgotten")
                status = ms = None
            if ms is None or row.ms >= ms:  # late news of an older status changes nothing
                if row.status != status:
                    yield Row(id=key[0], status=row.status, ms=row.ms, kind="status")
                status, ms = row.status, row.ms
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.now.update((status, ms))
        if status in self.keep:
            self.handle.registerTimer(self._due(status, ms))

    def _due(self, status: str, ms: int) -> int:
        return ms + int(1000 * self.keep[status])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status = self.now.get()[0]
        self.now.clear()
        yield Row(id=key[0], status=status, ms=expiredTimerInfo.getExpiryTimeInMs(), kind="forgotten")

    def close(self) -> None:
        pass


def kept(news: DataFrame, keep: dict[str, float] | None = None, lateness: str = "10 seconds") -> DataFrame:
    """Rows (id, status, at, kind) of streamed news (id, status, at timestamp): kind `status` when it changes, `forgotten` when the state of an id goes.

    The clock is the stream's watermark, `lateness` behind the latest news of any id; an id is forgotten when that passes the time of
    its ending and what `keep` (seconds by status) allows, so a quiet stream forgets at its next news.  News
    of a later time than that are of a new id, in whatever batches they come.  The session must use the RocksDB state store (`ROCKS`).
    """
    rows = news.select(F.col("id").cast("string").alias("id"), "status", "at", F.unix_millis("at").alias("ms")).withWatermark("at", lateness)
    found = rows.groupBy("id").transformWithState(Ending(KEEP_SESSION if keep is None else keep), _KEPT, "Append", "EventTime")
    return found.select("id", "status", F.timestamp_millis("ms").alias("at"), "kind")
