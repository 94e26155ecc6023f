"""Delivery of events to a receiver: bounded waiting, ordered batches, retries by timer and a short time to finish after the end."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .live import BATCH, outcome

# Events that may wait, seconds between tries (doubling), and seconds to finish after the end.
MOST_WAITING, FIRST_PAUSE, LONGEST_PAUSE, CLOSE_SECONDS = 200, 0.5, 5.0, 3.0

#: Takes a session and its events, returns the HTTP status, null if there was no answer.
Send = Callable[[str, list[dict]], int | None]
Event = tuple[int, str]

COUNTS = "session string, pushed long, failed long, dropped long, waiting long"
_STATE = "flight array<struct<id:bigint,payload:string>>, queue array<struct<id:bigint,payload:string>>, failures int, deadline double"


class Outbox:
    """Events of one session on their way: a batch being tried, those behind it, and until when there is time."""

    def __init__(self, flight: list[Event] = (), queue: list[Event] = (), failures: int = 0, deadline: float | None = None):
        self.flight, self.queue, self.failures, self.deadline = list(flight), list(queue), failures, deadline
        self.pushed = self.failed = self.dropped = 0

    def take(self, events: list[Event], most: int = MOST_WAITING) -> None:
        """More events; of too many the oldest are dropped.  After the end none are taken."""
        if self.deadline is None:
            self.queue += events
            surplus = max(0, len(self.queue) - most)
            self.dropped, self.queue = self.dropped + surplus, self.queue[surplus:]

    def end(self, now: float, seconds: float = CLOSE_SECONDS) -> None:
        if self.deadline is None:
            self.deadline = now + seconds

    def work(self, send: Callable[[list[Event]], int | None], clock: Callable[[], float], size: int = BATCH) -> float | None:
        """Send what can be sent; returns the seconds to wait before the next try, null when nothing waits.

        A batch that the receiver refuses for good has failed, and so has everything that is left when time is up.
        """
        while self.flight or self.queue:
            if not self.flight:
                self.flight, self.queue = self.queue[:size], self.queue[size:]
            said = outcome(send(self.flight))
            if said == "retry":
                left = None if self.deadline is None else self.deadline - clock()
                if left is not None and left <= 0:
                    self.failed += len(self.flight) + len(self.queue)
                    self.flight, self.queue = [], []
                    break
                pause = min(LONGEST_PAUSE, FIRST_PAUSE * 2**self.failures)
                self.failures += 1
                return pause if left is None else min(pause, left)
            if said == "sent":
                self.pushed += len(self.flight)
            else:
                self.failed += len(self.flight)
            self.flight, self.failures = [], 0
        return None


def deliver(events: DataFrame, send: Send, most_waiting: int = MOST_WAITING, size: int = BATCH, close_seconds: float = CLOSE_SECONDS, clock: Callable[[], float] = time.time) -> DataFrame:
    """COUNTS of each step of streamed events (session, id, payload, last boolean): how many were pushed, failed and dropped in it, and how many wait.

    A row marked `last` ends its session and is no event itself unless it has a payload.  A session's events go in order of their ids, in
    batches, from one task; a batch that is to be tried again waits in the state, and a timer tries it after 0.5 to 5 seconds without
    holding the task.  Start the query with a trigger of a second, so that batches fill.  Events may
    arrive twice after a failure of the job, with the same ids.  `observe` on the result sums the counts.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        box = Outbox(*([tuple(x) for x in state.get[0]], [tuple(x) for x in state.get[1]], *state.get[2:])) if state.exists else Outbox()
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("id", kind="stable")
            box.take([(int(r.id), r.payload) for r in rows.itertuples() if r.payload is not None], most_waiting)
            if rows["last"].any():
                box.end(clock(), close_seconds)
        wait = box.work(lambda batch: send(key[0], [{"id": i, "payload": p} for i, p in batch]), clock, size)
        state.update((box.flight, box.queue, box.failures, box.deadline))
        if wait is not None:
            state.setTimeoutDuration(max(1, int(wait * 1000)))
        yield pd.DataFrame([(key[0], box.pushed, box.failed, box.dropped, len(box.flight) + len(box.queue))], columns=[x.split()[0] for x in COUNTS.split(", ")])

    return events.groupBy("session").applyInPandasWithState(step, COUNTS, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
