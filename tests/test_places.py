import pytest
from pyspark.sql import functions as F

from quirespark.operators import listing
from quirespark.plans.shared import placed


@pytest.fixture
def ranges(spark):
    """Small ranges stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_times_are_spread_over_partitions(spark, ranges):
    same = spark.range(5000).select("id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("upload_time"))
    df = same.union(spark.range(5000, 5010).select("id", F.lit(None).cast("timestamp_ntz")))
    got = listing.numbered(df)
    assert [r.position for r in listing.newest_first(got).collect()] == list(range(1, 5011))
    used = got.select(F.spark_partition_id().alias("p"), "id").groupBy("p").count().collect()
    assert len(used) > 1 and max(r["count"] for r in used) < 4000


def test_places_within_keys_null_keys_and_repeated_rows(spark):
    rows = [(k, v) for k in ("a", "b", None) for v in (3, 1, 2, None, 2)]
    got = placed(spark.createDataFrame(rows, "k string, v int").repartition(3), ["k"], [F.asc_nulls_first("v")]).collect()
    for k in ("a", "b", None):
        own = sorted((r.place, r.v) for r in got if r.k == k)
        assert own == [(0, None), (1, 1), (2, 2), (3, 2), (4, 3)]


def test_one_key_over_many_ranges(spark, ranges):
    df = spark.range(3000).select((F.col("id") % 2 * 0).alias("k"), F.col("id").alias("v"))
    got = placed(df, ["k"], [F.col("v")])
    assert got.where("place <> v").isEmpty() and got.count() == 3000


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, v int")
    assert placed(df, ["k"], [F.col("v")]).collect() == [] and placed(df, [], [F.col("v")]).collect() == []
