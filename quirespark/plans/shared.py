"""Intermediate tables that outlive the executors that made them, and places in an order that no single task computes."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset: a temporary folder of our own on a single machine, and an error on a cluster."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="quirespark-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def placed(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """df with the place, from 0, of each row in `order` among the rows of equal keys (of all rows if there are none).

    Rows are dealt into ranges of (keys, order) and numbered where they lie; what a key has in
    earlier ranges is added from one count for each key and range. A key may thus be
    spread over any number of tasks, and so may rows alike in all but the last column of the order. Rows alike in
    all of it come in any order. Null keys are a key.
    """
    by = [*(F.col(k) for k in keys), *order]
    spread = kept(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_row", 33))
    runs = spread.groupBy("_range", *keys).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(earlier.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = runs.select("_range", *(F.col(k).alias(f"_k_{k}") for k in keys), (before - F.col("_first")).alias("_shift")).withColumnRenamed("_range", "_of")
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return spread.join(shift if keys else F.broadcast(shift), same).select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_row") + F.col("_shift")).alias(name))
