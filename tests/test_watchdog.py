import datetime as dt
import random

import pytest

from quirespark.streaming import watchdog

T0 = dt.datetime(2024, 1, 1)
EVENTS = "id long, ts timestamp, event_id long, status string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def got(df):
    return sorted((r.id, r.event_id is None, r.event_id or 0, r.ts, r.status) for r in df.collect())


def test_flights_and_failures(spark):
    rows = [
        (1, at(0), 1, "pending"), (1, at(5), 2, "pending"), (1, at(30), 3, "done"), (1, at(31), 4, "pending"),
        (2, at(0), 5, "pending"), (2, at(31), 6, "done"), (2, at(32), 7, "pending"), (2, at(80), 8, "running"),
        (3, at(70), 9, "pending"), (3, at(71), 10, "fail"), (4, at(90), 11, "done"), (5, at(89), 12, "pending"),
    ]
    out = watchdog.guarded(spark.createDataFrame([*rows, (None, at(95), 13, "pending")], EVENTS).repartition(3))
    want = [(1, 1, at(0), "pending"), (1, 4, at(31), "pending"), (1, None, at(61), "fail"), (2, 5, at(0), "pending"), (2, None, at(30), "fail"), (2, 7, at(32), "pending"), (2, None, at(62), "fail"), (3, 9, at(70), "pending"), (5, 12, at(89), "pending")]
    assert got(out) == sorted((i, e is None, e or 0, t, s) for i, e, t, s in want)
    assert got(watchdog.guarded(spark.createDataFrame(rows, EVENTS), delay=3600)) == sorted((i, e is None, e or 0, t, s) for i, e, t, s in want if (i, t) != (1, at(61)))
    assert watchdog.guarded(spark.createDataFrame([], EVENTS)).collect() == []


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", watchdog.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_the_stream_is_the_batch_over_a_restart(spark, tmp_path, rocks):
    rng = random.Random(4)
    rows = [(rng.randrange(6), at(k * 4 + rng.random()), k, rng.choice(["pending", "pending", "running", "done", "fail"])) for k in range(120)]
    rows.append((99, at(600), 1000, "running"))
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def arrive(part):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)

    for part in (rows[:50], rows[50:80], rows[80:]):
        arrive(part)
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        watchdog.run_guarded(stream, out, check, delay=60).awaitTermination(120)
    assert got(spark.read.parquet(out)) == got(watchdog.guarded(spark.createDataFrame(rows, EVENTS), delay=60))
