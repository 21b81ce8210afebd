"""Status machine per document."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# fixed values: allowed moves between statuses; every live status may fail, failed rows may be queued again
MOVES = {
    None: ["pending"],
    "pending": ["needs_pdf", "needs_chunking", "failed"],
    "needs_pdf": ["needs_chunking", "failed"],
    "needs_chunking": ["needs_extraction", "failed"],
    "needs_extraction": ["complete", "needs_deep_extraction", "needs_review", "failed"],
    "needs_deep_extraction": ["complete", "needs_review", "failed"],
    "needs_review": ["complete", "needs_extraction", "failed"],
    "complete": ["needs_deep_extraction"],
    "failed": ["pending"],
}
OUTPUT = "id long, ts timestamp, old_status string, new_status string, outcome string"


def walk(status: str | None, rows: pd.DataFrame) -> tuple[str | None, list[tuple]]:
    """Moves of one document in time order from its current status."""
    out = []
    for ts, new in zip(rows["ts"], rows["status"]):
        ok = new in MOVES.get(status, [])
        out.append((ts, status, new, "moved" if ok else "rejected"))
        status = new if ok else status
    return status, out


class StatusMachine(StatefulProcessor):
    """Keeps one status per document; a document stuck for ``stuck_ms`` is failed by a timer."""

    def __init__(self, stuck_ms: int = 3_600_000):
        self.stuck_ms = stuck_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "status string, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Arrow batches are walked one after the other, each in time order; only the status is held between them."""
        status, last = self.state.get()[0] if self.state.exists() else None, None
        for batch in rows:
            batch = batch.sort_values("ts", kind="stable")
            status, moves = walk(status, batch)
            last = batch["ts"].iloc[-1] if last is None else max(last, batch["ts"].iloc[-1])
            yield pd.DataFrame([(key[0], *m) for m in moves], columns=["id", "ts", "old_status", "new_status", "outcome"])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if status is not None and last is not None:
            due = int(pd.Timestamp(last).timestamp() * 1000) + self.stuck_ms
            self.state.update((status, due))
            if status not in ("complete", "failed"):
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status = self.state.get()[0]
        self.state.update(("failed", 0))
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], at, status, "failed", "timed_out")], columns=["id", "ts", "old_status", "new_status", "outcome"])

    def close(self) -> None:
        pass


def status_stream(events: DataFrame, *, late: str = "1 hour", stuck_ms: int = 3_600_000) -> DataFrame:
    """Transitions of a stream of (id, ts, status); invalid ones come out as rejected."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy("id").transformWithStateInPandas(StatusMachine(stuck_ms), OUTPUT, "Append", "EventTime")


def status_batch(events: DataFrame) -> DataFrame:
    """The same walk over stored events (id, ts, event_id, status).

    Events are sorted by document and time inside hash partitions and walked batch by
    batch; only the current document's status is carried on, so a document of any size
    streams through.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, status = None, None
        for b in batches:
            parts = []
            for key, rows in b.groupby("id", sort=False):
                status, moves = walk(status if key == doc else None, rows)
                doc = key
                parts += [(key, *m) for m in moves]
            yield pd.DataFrame(parts, columns=["id", "ts", "old_status", "new_status", "outcome"])

    rows = events.select("id", "ts", "event_id", "status").repartition("id").sortWithinPartitions("id", "ts", "event_id")
    return rows.mapInPandas(run, OUTPUT)
