"""The progress of cases as a stream: two stateful steps, one behind the other.

The first keeps the newest state of each document, as tasks.latest_status() does, and gives for each change what it takes from
its case and what it adds. The second keeps the sums of each case, beginning with those of the document table, and gives the
case's row whenever a sum changes. The last row of a case (by `change`) is rollup.ocr_progress() after tasks.apply_status() on the
same events. Events of documents that count for no case are left out; cases without events have no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.labels import progress
from ..sources.schema import OCR_TEXT

STATES = ("pending", "running", "done", "fail", "none")
SUMS = ("total", *STATES, "parts")
DELTA = "case_id long, " + ", ".join(f"{s} long" for s in SUMS[:-1]) + ", parts double"
OUT = "case_id long, change long, total long, pending long, running long, done long, failed long, progress double, ocr_done boolean"


def part(status: str, value: float | None) -> float:
    """A document's part in the progress of its case."""
    return 1.0 if status == "done" else (value or 0.0) if status in ("pending", "running") else 0.0


class Documents(StatefulProcessor):
    """The newest status and progress of a document, with the places of their events in the order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "status string, s_ts timestamp, s_event long, value double, v_ts timestamp, v_event long")

    def handleInputRows(self, key, batches, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        case, known = int(rows["case_id"].iloc[0]), self.state.exists()
        at = lambda i: (first if pd.isna(old[i + 1]) else pd.Timestamp(old[i + 1]), old[i + 2] or 0)
        first = pd.Timestamp.min
        base = rows[["base_status", "base_value"]].iloc[0]
        old = tuple(self.state.get()) if known else (base["base_status"], None, None, None if pd.isna(base["base_value"]) else float(base["base_value"]), None, None)
        status, value, s_at, v_at = old[0], old[3], at(0), at(3)
        for ts, event, new, number in zip(rows["ts"], rows["event_id"], rows["status"], rows["progress"], strict=True):
            here = (pd.Timestamp(ts), int(event))
            number = 0.0 if new == "pending" else None if pd.isna(number) else float(number)
            if here > s_at:
                status, s_at = new, here
            if number is not None and here > v_at:
                value, v_at = number, here
        self.state.update((status, *self.stamp(s_at), value, *self.stamp(v_at)))
        if (status, part(status, value)) != (old[0], part(old[0], old[3])):
            delta = dict.fromkeys(SUMS, 0) | {"case_id": case, "parts": part(status, value) - part(old[0], old[3])}
            for s, n in ((old[0], -1), (status, 1)):
                delta[s] += n
            yield pd.DataFrame([delta])[[c.split()[0] for c in DELTA.split(", ")]]

    @staticmethod
    def stamp(at: tuple) -> tuple:
        return (None, None) if at[0] == pd.Timestamp.min else (at[0].to_pydatetime(), at[1])

    def close(self) -> None:
        pass


class Cases(StatefulProcessor):
    """The sums of a case."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", "change long, " + DELTA.split(", ", 1)[1])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        own = initialState.iloc[0]
        self.state.update((0, *(int(own[s]) for s in SUMS[:-1]), float(own["parts"])))

    def handleInputRows(self, key, batches, timerValues) -> Iterator[pd.DataFrame]:
        added = pd.concat(list(batches))[list(SUMS)].sum()
        change, *sums = self.state.get() if self.state.exists() else (0, *[0] * len(SUMS))
        now = {s: v + added[s] for s, v in zip(SUMS, sums, strict=True)}
        self.state.update((change + 1, *(int(now[s]) for s in SUMS[:-1]), float(now["parts"])))
        total = int(now["total"])
        done = total == 0 or (now["pending"] + now["running"] == 0 and now["done"] > 0)
        row = (key[0], change + 1, total, *(int(now[s]) for s in STATES[:4]), float(now["parts"]) / total if total else 1.0, bool(done))
        yield pd.DataFrame([row], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def case_progress_stream(events: DataFrame, documents: DataFrame) -> DataFrame:
    """OUT of a stream of events (id, ts, event_id, status, progress) over the document table. Its session needs watchdog.PROVIDER."""
    own = documents.where(F.col("parent_id").isNotNull() & (F.col("doc_type") != OCR_TEXT))
    children = own.select("id", F.col("parent_id").alias("case_id"), F.col("ocr_status").alias("base_status"), F.col("ocr_progress").alias("base_value"))
    counts = [F.count_if(F.col("base_status") == s).alias(s) for s in STATES]
    base = children.groupBy("case_id").agg(F.count(F.lit(1)).alias("total"), *counts, F.sum(progress(F.col("base_status"), F.col("base_value"))).alias("parts"))
    changes = events.join(children, "id").groupBy("id").transformWithStateInPandas(Documents(), DELTA, "Append", "None")
    return changes.groupBy("case_id").transformWithStateInPandas(Cases(), OUT, "Append", "None", base.groupBy("case_id"))
