"""Files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.images import image_size, mime_of_content
from ..functions.labels import allowed
from ..operators.contents import decoded

BINARY = "path string, modificationTime timestamp, length long, content binary"


def blobs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content and name of every file below a folder; without the content column nothing is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """name and text of the .txt files below a folder."""
    return blobs(spark, path, "*.txt").select("name", decoded("content").alias("text"))


def landing(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files that arrive in a folder and whose type is known."""
    files = spark.readStream.format("binaryFile").schema(BINARY).load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return files.where(allowed(F.col("name")))


def within_limits(files: DataFrame, each: int = 50 << 20, together: int = 200 << 20) -> DataFrame:
    """(files, bytes, ok): whether an upload of files (length) keeps to the limits."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), (F.coalesce(F.max("length"), F.lit(0)) <= each).alias("_each")).select("files", "bytes", (F.col("_each") & (F.col("bytes") <= together)).alias("ok"))


def image_sizes(files: DataFrame) -> DataFrame:
    """(name, width, height) of files (name, content); null where a file is no image or its header is cut off."""
    return files.select("name", image_size(F.col("content")).alias("_s")).select("name", "_s.width", "_s.height")


def typed(files: DataFrame) -> DataFrame:
    """files (name, content) with mime_type: by content first, then by name."""
    return files.withColumn("mime_type", mime_of_content(F.col("content"), F.col("name")))
