"""The task queue and the status of documents, as batch queries and as streams over the same events.

An event (id, ts, event_id, status[, progress]) reports one change. A document is admitted
to the queue when a `pending` event finds it not in flight; `done` and `fail` end its flight.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.labels import lookup

#: What the events table stands for.
STATUS = {"signup": "pending", "view": "running", "click": "running", "purchase": "done", "error": "fail"}
ADMITTED = "id long, event_id long, ts timestamp"


def status_events(events: DataFrame) -> DataFrame:
    """The events table as status events; times become timestamps, which watermarks need."""
    return events.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", lookup(F.col("event_type"), STATUS, None).alias("status"), F.col("value").alias("progress")).where("status is not null")


#: Fixed value: what the queue says of a document that waits; a restart says it again.
WAITING = "Oczekuje w kolejce"


def latest_status(events: DataFrame) -> DataFrame:
    """The newest state of every document, and how many events it has: a fold by partial aggregates, for batches and streams alike.

    Events may have progress, info, current_page, total_pages and confidence. What an event leaves
    out (null) keeps its value, pages count only together and with a progress, and a pending
    event, the first or a restart, sets the progress to 0 and the info to WAITING.
    """
    order = F.struct("ts", "event_id")
    waits = F.col("status") == "pending"
    have = [c for c in ("info", "current_page", "total_pages", "confidence") if c in events.columns]
    own = events.withColumn("progress", F.when(waits, 0.0).otherwise(F.col("progress")))
    if "info" in have:
        own = own.withColumn("info", F.when(waits, WAITING).otherwise(F.col("info")))
    if "current_page" in have and "total_pages" in have:
        whole = F.col("progress").isNotNull() & F.col("current_page").isNotNull() & F.col("total_pages").isNotNull()
        own = own.withColumns({c: F.when(whole, F.col(c)) for c in ("current_page", "total_pages")})
    return own.groupBy("id").agg(
        F.max_by("status", order).alias("status"),
        *(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("progress", *have)),
        F.max("ts").alias("ts"),
        F.count(F.lit(1)).alias("events"),
    )


def admitted(events: DataFrame) -> DataFrame:
    """(id, event_id, ts) of the pending events that enter the queue: of each document the first after a flight's end."""
    per = W.partitionBy("id").orderBy("ts", "event_id")
    ends = F.sum(F.col("status").isin("done", "fail").cast("int")).over(per.rowsBetween(W.unboundedPreceding, W.currentRow))
    waiting = events.withColumn("_flight", ends).where("status = 'pending'")
    return waiting.withColumn("_n", F.row_number().over(W.partitionBy("id", "_flight").orderBy("ts", "event_id"))).where("_n = 1").select("id", "event_id", "ts")


def admitted_stream(events: DataFrame) -> DataFrame:
    """admitted() of a stream: per document one flag says whether it is in flight; it survives restarts in the checkpoint."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flying = state.get[0] if state.exists else False
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        taken = []
        for i, status in enumerate(rows["status"]):
            if status == "pending" and not flying:
                taken.append(i)
                flying = True
            elif status in ("done", "fail"):
                flying = False
        if flying:
            state.update((True,))
        elif state.exists:
            state.remove()
        yield rows.iloc[taken][["event_id", "ts"]].assign(id=key[0])[["id", "event_id", "ts"]]

    return events.groupBy("id").applyInPandasWithState(step, ADMITTED, "flying boolean", "append", GroupStateTimeout.NoTimeout)


def run_queue(events: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts the queue: what admitted_stream() takes in is appended to Parquet files in `path`, every so often, or once for all that is there.

    The checkpoint holds the flights and what has been read, so a restart goes on where the last run ended.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return admitted_stream(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def once_within(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events of a stream without those repeated (same id and status) within the delay: expiry by time, not by a flight's end."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id", "status"])


def activity(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events by window of time and status; in a stream, windows close when the watermark has passed."""
    own = events.withWatermark("ts", delay) if events.isStreaming else events
    grouped = own.groupBy(F.window("ts", width).alias("w"), "status").agg(F.count(F.lit(1)).alias("events"))
    return grouped.select(F.col("w.start").alias("start"), "status", "events")


def rerun(ids: DataFrame, at: str, first_event: int) -> DataFrame:
    """Pending events for ids (id): running documents again."""
    return ids.select("id", F.lit(at).cast("timestamp").alias("ts"), (F.lit(first_event) + F.monotonically_increasing_id()).alias("event_id"), F.lit("pending").alias("status"), F.lit(0.0).alias("progress"))


#: Columns of the document table by those of latest_status().
FOLDED = {"status": "ocr_status", "progress": "ocr_progress", "info": "ocr_progress_info", "current_page": "ocr_current_page", "total_pages": "ocr_total_pages", "confidence": "ocr_confidence"}


def apply_status(df: DataFrame, latest: DataFrame) -> DataFrame:
    """The document table with the states of latest_status(); what they leave out (null) keeps its value."""
    have = {c: name for c, name in FOLDED.items() if c in latest.columns and name in df.columns}
    met = df.join(latest.select("id", *(F.col(c).alias(f"_{c}") for c in have)), "id", "left")
    return met.withColumns({name: F.coalesce(F.col(f"_{c}"), F.col(name)) for c, name in have.items()}).select(*df.columns)


def stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Event files that arrive in a folder, as a stream of status events."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return status_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path))
