"""Running streams: heartbeats of what they have done, and stops that leave nothing half done."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators import reads as R
from ..operators import state as S


def store_counts(store: S.Store) -> dict[str, int]:
    """Boards, those backfilled, articles and pushes."""
    t = store.tables()
    row = R.table_counts(t).first()
    return {"boards": row.boards, "backfilled": t["boards"].where("backfill_complete").count(), "articles": row.articles, "pushes": row.pushes}


class Heartbeat(StreamingQueryListener):
    """Records, every ``interval`` seconds at most, the counts of the store and the rows that streams have read.

    ``write`` gets each record as a line of JSON, for a health check to look at its age. A count or a write that
    fails is recorded as missing and doesn't stop the stream.
    """

    def __init__(self, counts: Callable[[], dict[str, int]], write: Callable[[str], None], interval: float = 60.0, clock: Callable[[], float] = time.time):
        self.counts, self.write, self.interval, self.clock = counts, write, interval, clock
        self.rows, self.batches, self.last = 0, 0, None
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        self.beat()

    def onQueryProgress(self, event) -> None:
        self.saw(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self.beat()

    def onQueryTerminated(self, event) -> None:
        pass

    def saw(self, rows: int) -> None:
        with self.lock:
            self.rows += rows
            self.batches += 1
        self.beat()

    def beat(self) -> None:
        now = self.clock()
        with self.lock:
            if self.last is not None and now - self.last < self.interval:
                return
            self.last = now
            record = {"at": int(now), "rows": self.rows, "batches": self.batches}
        try:
            self.write(json.dumps(record | self.counts()))
        except Exception as e:  # a health check sees that the heart has stopped; the stream goes on
            self.failed = str(e)


class Stopped(RuntimeError):
    """The stream was asked to stop."""


class GracefulStop:
    """Wraps a foreachBatch function so that a stop waits for the batch in hand and starts no other.

    The batch that isn't started any more isn't committed, so the next start of the stream begins with it.
    """

    def __init__(self, apply: Callable[[DataFrame, int], None]):
        self.apply = apply
        self.asked = threading.Event()
        self.busy = threading.Lock()

    def __call__(self, batch: DataFrame, number: int) -> None:
        with self.busy:
            if self.asked.is_set():
                raise Stopped(f"batch {number} is left for the next start")
            self.apply(batch, number)

    def stop(self, query, store: S.Store | None = None, now: int = 0, wait: float = 60.0) -> int:
        """Ends the stream after the batch in hand; then frees the claims of boards. Returns how many there were."""
        self.asked.set()
        with self.busy:  # the batch in hand has been applied
            pass
        until = time.monotonic() + wait
        while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
            time.sleep(0.05)  # it is being committed, or the next one ends itself
        query.stop()
        return release_orphans(store, now) if store is not None else 0


def release_orphans(store: S.Store, now: int) -> int:
    """Frees claims that no running driver holds, at a stop and at the next start; returns how many."""

    def apply(change: S.Change) -> int:
        held = change.read("boards").where("backfill_claimed_at is not null").select("name")
        n = held.count()
        if n:
            change.update("boards", held, lambda old: S.release_claims(old, now)[0])
        return n

    return store.retry(apply)
