"""The newest of each key, version histories and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.schema import HISTORY, OCR_TEXT


def newest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by `order`, then by the largest id."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order, F.desc("id")))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def ocr_texts(df: DataFrame) -> DataFrame:
    return df.where(F.col("ocr_parent_id").isNotNull() & (F.col("doc_type") == OCR_TEXT))


def latest_ocr(df: DataFrame) -> DataFrame:
    """The newest recognized text of every source."""
    return newest(ocr_texts(df), "ocr_parent_id", F.desc("upload_time"))


def with_latest_ocr(df: DataFrame, only_done: bool = False) -> DataFrame:
    """Every document with the id (and text, if there is one) of its newest recognized text."""
    texts = [F.col("text").alias("ocr_text")] if "text" in df.columns else []
    latest = latest_ocr(df).select(F.col("ocr_parent_id").alias("_src"), F.col("id").alias("ocr_id"), *texts)
    on = F.col("id") == F.col("_src")
    return df.join(latest, on & (F.col("ocr_status") == "done") if only_done else on, "left").drop("_src")


def has_ocr(df: DataFrame) -> DataFrame:
    return df.join(ocr_texts(df).select(F.col("ocr_parent_id").alias("_src")), F.col("id") == F.col("_src"), "left_semi")


def without_ocr(df: DataFrame) -> DataFrame:
    return df.join(ocr_texts(df).select(F.col("ocr_parent_id").alias("_src")), F.col("id") == F.col("_src"), "left_anti")


def history(df: DataFrame) -> DataFrame:
    """Archived versions of every document, newest first (`version` 1), and how many there are."""
    own = df.where(F.col("parent_id").isNotNull() & (F.col("doc_type") == HISTORY))
    per = W.partitionBy("parent_id")
    return own.withColumns({"version": F.row_number().over(per.orderBy(F.desc("upload_time"), F.desc("id"))), "versions": F.count(F.lit(1)).over(per)})


def family(df: DataFrame) -> DataFrame:
    """Every main document and its children, by `family_id`, the last modified first (`place` 1), unmodified ones last."""
    own = df.withColumn("family_id", F.when(F.col("is_main"), F.col("id")).otherwise(F.col("parent_id"))).where("family_id is not null")
    return own.withColumn("place", F.row_number().over(W.partitionBy("family_id").orderBy(F.desc_nulls_last("last_modified"), F.desc("id"))))


def available(df: DataFrame, files: DataFrame) -> DataFrame:
    """For every family the first in order of family() whose file is among files (path): what a download falls back to."""
    name = F.element_at(F.split("stored_filename", "/"), -1)
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("_file")).distinct()
    found = family(df).join(there, name == F.col("_file"), "left_semi")
    return found.withColumn("_n", F.row_number().over(W.partitionBy("family_id").orderBy("place"))).where("_n = 1").drop("_n")


def updatable(df: DataFrame) -> DataFrame:
    """Empty cases and Word documents."""
    empty = F.endswith("stored_filename", F.lit(".empty")) & F.col("is_main")
    return df.where(empty | F.coalesce(F.contains("mime_type", F.lit("word")), F.lit(False)))
