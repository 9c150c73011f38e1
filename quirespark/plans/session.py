"""Session helper for local runs and tests; a cluster supplies its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local[cpus] session with UTC time, AQE and Arrow on; further settings by keyword (dots as __)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quirespark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
