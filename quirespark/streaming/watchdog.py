"""The queue with a watchdog: a document whose flight takes too long fails, and can be admitted again.

A flight begins with the pending event that is admitted and ends with the first `done` or `fail` within LIMIT seconds, else LIMIT seconds
after it began, with a failure of the watchdog's. Pending events within a flight are left out. Both forms give a row for each admission and each such
failure: (id, event_id, ts, status); a failure has no event_id.

guarded() is the batch form, guarded_stream() the stream's: the start of the flight is its state, and the end of the limit a
timer of event time, so a document that is never heard of again fails when the watermark passes. Both are the same
walk over a document's events in order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: Fixed value: seconds that a document may take.
LIMIT = 1800
OUT = "id long, event_id long, ts timestamp, status string"
#: What stores the state of guarded_stream().
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Row = tuple[int | None, datetime, str]


def walk(start: datetime | None, events: Iterable[Row], limit: timedelta) -> tuple[list[Row], datetime | None]:
    """What comes of events (event_id, ts, status) in order for a document whose flight began at `start` (null: none), and when its flight began then."""
    out: list[Row] = []
    for event_id, ts, status in events:
        if start is not None and ts > start + limit:
            out.append((None, start + limit, "fail"))
            start = None
        if status == "pending" and start is None:
            out.append((event_id, ts, "pending"))
            start = ts
        elif status in ("done", "fail"):
            start = None
    return out, start


def rows(key: int, found: list[Row]) -> pd.DataFrame:
    event_id, ts, status = zip(*found, strict=True) if found else ((), (), ())
    return pd.DataFrame({"id": pd.Series([key] * len(found), dtype="int64"), "event_id": pd.array(event_id, dtype="Int64"), "ts": pd.Series(ts, dtype="datetime64[us]"), "status": pd.Series(status, dtype=object)})


def guarded(events: DataFrame, limit: int = LIMIT, delay: int = 0) -> DataFrame:
    """Of events (id, ts, event_id, status), in order of ts and event_id. Limits that end up to `delay` seconds before the last event of all have passed.

    Documents are dealt by id and their events come sorted, so a task holds the state of one document and no list of events.
    """
    last = events.agg(F.max("ts")).first()[0]
    until = last - timedelta(seconds=delay) if last else datetime.min
    most = timedelta(seconds=limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start = None, None

        def passed() -> list[Row]:
            return [(None, start + most, "fail")] if start is not None and start + most <= until else []

        for pdf in batches:
            out = []
            for one, own in pdf.groupby("id", sort=False):
                if one != key:
                    out.append(rows(key or 0, passed()))
                    key, start = one, None
                found, start = walk(start, zip(own["event_id"], own["ts"].tolist(), own["status"], strict=True), most)
                out.append(rows(key, found))
            yield pd.concat(out) if out else rows(0, [])
        yield rows(key or 0, passed())

    own = events.where("id is not null and ts is not null").select("id", "event_id", "ts", "status")
    return own.repartition("id").sortWithinPartitions("id", "ts", "event_id").mapInPandas(run, OUT)


class Watchdog(StatefulProcessor):
    """The start of a document's flight, and a timer for its limit."""

    def __init__(self, limit: int):
        self.limit = timedelta(seconds=limit)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flight = handle.getValueState("flight", "start timestamp")

    def started(self) -> datetime | None:
        return self.flight.get()[0] if self.flight.exists() else None

    def timer(self, start: datetime) -> int:
        """The millisecond at which the limit is over, rounded up."""
        return int(-(-(pd.Timestamp(start + self.limit).tz_localize("UTC").value) // 1_000_000))

    def becomes(self, before: datetime | None, start: datetime | None) -> None:
        if before != start:
            if before is not None:
                self.handle.deleteTimer(self.timer(before))
            if start is not None:
                self.handle.registerTimer(self.timer(start))
                self.flight.update((start,))
            else:
                self.flight.clear()

    def handleInputRows(self, key, batches, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        before = self.started()
        found, start = walk(before, zip(own["event_id"], own["ts"].tolist(), own["status"], strict=True), self.limit)
        self.becomes(before, start)
        yield rows(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = self.started()
        if start is not None and self.timer(start) <= expiredTimerInfo.getExpiryTimeInMs():
            self.flight.clear()
            yield rows(key[0], [(None, start + self.limit, "fail")])

    def close(self) -> None:
        pass


def guarded_stream(events: DataFrame, limit: int = LIMIT, delay: int = 0) -> DataFrame:
    """guarded() of a stream. Its session needs PROVIDER as spark.sql.streaming.stateStore.providerClass. Events over `delay` seconds older than the newest of earlier batches are dropped."""
    own = events.where("id is not null and ts is not null").select("id", "event_id", "ts", "status").withWatermark("ts", f"{delay} seconds")
    return own.groupBy("id").transformWithStateInPandas(Watchdog(limit), OUT, "Append", "EventTime")


def run_guarded(events: DataFrame, path: str, checkpoint: str, limit: int = LIMIT, delay: int = 0, every: str | None = None) -> StreamingQuery:
    """Starts guarded_stream() into Parquet files in `path`, every so often or once for all that is there; a restart goes on from the checkpoint."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return guarded_stream(events, limit, delay).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
