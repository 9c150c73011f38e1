"""Parents and children: roll-ups of all cases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources.schema import OCR_TEXT


def with_parent(df: DataFrame, columns: tuple[str, ...] = ("sygnatura", "step")) -> DataFrame:
    """Every document with columns of its parent, null without one."""
    parents = df.select(F.col("id").alias("_pid"), *(F.col(c).alias(f"parent_{c}") for c in columns))
    return df.join(parents, F.col("parent_id") == F.col("_pid"), "left").drop("_pid")


def _counts() -> list[Column]:
    def n(status: str) -> Column:
        return F.count_if(F.col("ocr_status") == status)

    return [F.count(F.lit(1)).alias("total"), n("pending").alias("pending"), n("running").alias("running"), n("done").alias("done"), n("fail").alias("failed")]


def _of_cases(df: DataFrame, grouped: DataFrame, zero: list[str]) -> DataFrame:
    roots = df.where("is_main").select(F.col("id").alias("case_id"))
    return roots.join(grouped.withColumnRenamed("parent_id", "case_id"), "case_id", "left").fillna(0, zero)


def status_counts(df: DataFrame) -> DataFrame:
    """Children of every case by OCR status; `none` counts in the total only."""
    grouped = df.where("parent_id is not null").groupBy("parent_id").agg(*_counts())
    out = _of_cases(df, grouped, ["total", "pending", "running", "done", "failed"])
    return out.withColumn("has_active_ocr", (F.col("pending") > 0) | (F.col("running") > 0))


def groups_by_type(df: DataFrame) -> DataFrame:
    """Children of every case by kind: how many, the newest, and the group's place (the group with the newest child comes first)."""
    kind = F.coalesce(L.filled(F.col("doc_type")), F.lit("Inne"))
    own = df.where("parent_id is not null").groupBy(F.col("parent_id").alias("case_id"), kind.alias("kind"))
    newest = F.max(F.struct("upload_time", "id"))
    grouped = own.agg(F.count(F.lit(1)).alias("documents"), newest.alias("_newest"))
    return grouped.select(
        "case_id",
        "kind",
        "documents",
        F.col("_newest.id").alias("newest_id"),
        F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("_newest"))).cast("long").alias("place"),
    )


def ocr_progress(df: DataFrame) -> DataFrame:
    """OCR progress of every case over its children but recognized texts (and those without kind).

    Done once nothing waits or runs and something is complete; a case without children is
    done, and its number of failures is null.
    """
    own = df.where(F.col("parent_id").isNotNull() & (F.col("doc_type") != OCR_TEXT))
    grouped = own.groupBy("parent_id").agg(*_counts(), F.avg(L.progress(F.col("ocr_status"), F.col("ocr_progress"))).alias("progress"))
    out = _of_cases(df, grouped, ["total", "pending", "running", "done"])
    empty = F.col("total") == 0
    return out.select(
        "case_id",
        "total",
        "pending",
        "running",
        "done",
        "failed",
        F.round(F.when(empty, 1.0).otherwise(F.col("progress")), 6).alias("progress"),
        (empty | ((F.col("pending") == 0) & (F.col("running") == 0) & (F.col("done") > 0))).alias("ocr_done"),
    )


def footer_counts(df: DataFrame) -> DataFrame:
    """Counters below the list of a case's documents. No MIME type equals `image/`, so images are always 0."""
    grouped = df.where("parent_id is not null").groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("ocr_status") == "done").alias("ocr_done"),
        F.count_if(F.col("ocr_status") == "running").alias("ocr_running"),
        F.count_if(F.col("mime_type") == "application/pdf").alias("pdfs"),
        F.count_if(F.col("mime_type") == "image/").alias("images"),
        F.max("upload_time").alias("last_upload"),
        (F.count("last_modified") > 0).alias("any_modified"),
    )
    return _of_cases(df, grouped, ["documents", "ocr_done", "ocr_running", "pdfs", "images"]).fillna(False, ["any_modified"])


def list_counters(df: DataFrame) -> DataFrame:
    """Counters below the list of all documents, in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if("is_main").alias("cases"),
        F.count_if(F.col("ocr_status") == "done").alias("ocr_done"),
        F.count_if(F.col("mime_type") == "application/pdf").alias("pdfs"),
        F.count_if(F.col("mime_type") == "image/").alias("images"),
    )
