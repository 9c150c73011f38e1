"""Python table functions: the pages of a file by lateral join, and batches of pages by partitions; and an idempotent sink for changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Buckets of ids in which a table of changes is kept.
BUCKETS = 64


def pages_of(files: DataFrame, render: Callable[[bytes], Iterator[bytes]]) -> DataFrame:
    """files (doc_id, content) joined with a row for each page: (doc_id, page, image). render, given by the caller, yields the images one by one, and so are they handed on."""

    @udtf(returnType="page int, image binary")
    class Pages:
        def eval(self, content: bytes):
            if content is not None:
                yield from enumerate(render(bytes(content)), 1)

    return files.select("doc_id", "content").lateralJoin(Pages(F.col("content").outer())).select("doc_id", "page", "image")


def recognized_in_batches(pages: DataFrame, load: Callable[[], Callable[[list[bytes]], list[str]]], size: int = 5) -> DataFrame:
    """(doc_id, page, text, failed) of pages (doc_id, page, image), recognized `size` pages of a document at a time.

    A batch is a partition of the table function, so one batch is held at a time. load gives, once a batch, what takes its images in order; if that fails, all its pages have failed.
    """

    @udtf(returnType="doc_id long, page int, text string, failed boolean")
    class Batches:
        def __init__(self):
            self.held = []

        def eval(self, row):
            self.held.append((row["doc_id"], row["page"], bytes(row["image"])))

        def terminate(self):
            try:
                texts = [(t, False) for t in load()([image for *_, image in self.held])]
            except Exception as e:  # a batch's failure is a result
                texts = [(f"[Błąd OCR dla strony {page}: {e}]", True) for _, page, _ in self.held]
            for (doc_id, page, _), (text, failed) in zip(self.held, texts, strict=True):
                yield doc_id, page, text, failed

    own = pages.select("doc_id", "page", "image", F.floor((F.col("page") - 1) / size).cast("int").alias("batch"))
    return Batches(own.asTable().partitionBy("doc_id", "batch").orderBy("page"))


def keep(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes a table (id, version, ...) for upsert(): in folders by bucket of the id."""
    _bucketed(df, buckets).write.mode("overwrite").partitionBy("bucket").parquet(path)


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).repartition("bucket")


def upsert(path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that puts changed rows (all columns of the table; `deleted` removes) into a table written by keep().

    Of the rows of an id that with the largest version stays, whatever the order in which they come, so a batch may be repeated. Only
    the folders of touched buckets are written anew, beside the old ones, which they replace when all is written: a run that fails before that leaves
    the table as it was. A removed row stays as its mark, so that older changes do not bring it back; table() leaves marks out.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch.persist()
        touched = [r.bucket for r in _bucketed(batch, buckets).select("bucket").distinct().collect()]  # `buckets` at most
        if touched:
            old = spark.read.parquet(path)
            columns = [c for c in old.columns if c != "bucket"]
            both = old.where(F.col("bucket").isin(*touched)).select(*columns).unionByName(batch.select(*columns))
            newest = both.groupBy("id").agg(F.max(F.struct("version", F.struct(*columns).alias("row"))).alias("m")).select("m.row.*")
            _bucketed(newest, buckets).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        batch.unpersist()

    return write


def table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table kept by upsert(), without removed ones."""
    return spark.read.parquet(path).where("not coalesce(deleted, false)").drop("bucket", "deleted")
