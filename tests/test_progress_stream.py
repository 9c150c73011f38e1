import datetime as dt
import random

import pytest

from quirespark.operators import rollup
from quirespark.sources.schema import document
from quirespark.streaming import progress, tasks, watchdog

EVENTS = "id long, ts timestamp, event_id long, status string, progress double"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", watchdog.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_the_stream_is_the_roll_up_after_each_batch(spark, sf, tmp_path, rocks):
    docs = document(spark, sf).where("id < 60").drop("text").cache()
    rng = random.Random(5)
    rows = [(rng.randrange(70), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(500)), k, rng.choice(progress.STATES[:4]), rng.choice([None, rng.random()])) for k in range(150)]
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    seen = []
    for part in (rows[:70], rows[70:75], rows[75:]):
        seen += part
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = progress.case_progress_stream(spark.readStream.schema(EVENTS).parquet(source), docs)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(120)
        want = {r.case_id: r for r in rollup.ocr_progress(tasks.apply_status(docs, tasks.latest_status(spark.createDataFrame(seen, EVENTS)))).collect()}
        last = {}
        for r in sorted(spark.read.parquet(out).collect(), key=lambda r: r.change):
            last[r.case_id] = r
        assert last
        for case, r in last.items():
            w = want[case]
            assert (r.total, r.pending, r.running, r.done, r.failed, r.ocr_done) == (w.total, w.pending, w.running, w.done, w.failed, w.ocr_done)
            assert r.progress == pytest.approx(w.progress, abs=1e-6)
