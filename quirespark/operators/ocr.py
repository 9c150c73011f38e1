"""Recognition of pages: explode, recognize, clean and score, and put together again in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_ocr_text, confidence

PAGES = "doc_id long, page int, image binary"


def text_pages(df: DataFrame, key: str = "id") -> DataFrame:
    """Lines of texts as pages (doc_id, page from 1, text): pages without images."""
    return df.where("text is not null").select(F.col(key).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("_p", "text")).select("doc_id", (F.col("_p") + 1).alias("page"), "text")


def pdf_pages(files: DataFrame, render: Callable[[bytes], Iterator[bytes]]) -> DataFrame:
    """A row for each page of files (doc_id, content). render, given by the caller, yields a PDF's page images one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                for page, image in enumerate(render(content), 1):
                    yield pd.DataFrame({"doc_id": [doc_id], "page": [page], "image": [image]})

    return files.select("doc_id", "content").mapInPandas(run, PAGES)


def batches_of(pages: DataFrame, size: int = 5) -> DataFrame:
    """pages with the number of their batch."""
    return pages.withColumn("batch", F.floor((F.col("page") - 1) / size).cast("int"))


def recognize(pages: DataFrame, load: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """(doc_id, page, text, failed) of pages (doc_id, page, image).

    load is called once in each Python worker and gives the recognizer; an exception of it
    becomes the page's text, the page has failed, and the document goes on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = load()
        for pdf in batches:
            out = []
            for page, image in zip(pdf["page"], pdf["image"], strict=True):
                try:
                    out.append((read(bytes(image)), False))
                except Exception as e:  # one page's failure is a result
                    out.append((f"[Błąd OCR dla strony {page}: {e}]", True))
            yield pdf[["doc_id", "page"]].assign(text=[t for t, _ in out], failed=[f for _, f in out])

    return pages.mapInPandas(run, "doc_id long, page int, text string, failed boolean")


def scored(pages: DataFrame) -> DataFrame:
    """Recognized pages (doc_id, page, text[, failed]) cleaned, with their confidence; failed ones stay as they are, at 0."""
    failed = F.col("failed") if "failed" in pages.columns else F.lit(False)
    out = pages.withColumn("_clean", clean_ocr_text("text"))
    return out.select("doc_id", "page", F.when(failed, F.col("text")).otherwise(F.col("_clean")).alias("text"), F.when(failed, F.lit(0.0)).otherwise(confidence(F.col("_clean"))).alias("confidence"))


def assemble(pages: DataFrame) -> DataFrame:
    """(doc_id, text, confidence, pages) of pages (doc_id, page, text, confidence): pages in order under headings, mean confidence."""
    own = F.array_sort(F.collect_list(F.struct("page", "text")))
    parts = F.transform("_p", lambda p: F.concat(F.lit("=== Strona "), p["page"].cast("string"), F.lit(" ===\n\n"), p["text"]))
    grouped = pages.groupBy("doc_id").agg(own.alias("_p"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
    text = F.regexp_replace(F.array_join(parts, "\n\n"), r"(?U)^\s+|\s+$", "")
    return grouped.select("doc_id", text.alias("text"), "confidence", F.size("_p").cast("long").alias("pages"))


def region(requests: DataFrame, documents: DataFrame, load: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """(request_id, text) of requests (request_id, doc_id, page, image, whole): a whole page gives the stored text of the document, if there is one."""
    from .versions import latest_ocr

    stored = latest_ocr(documents).select(F.col("ocr_parent_id").alias("doc_id"), F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("_stored"))
    met = requests.join(stored, "doc_id", "left").withColumn("_known", F.col("whole") & F.coalesce(F.col("_stored") != "", F.lit(False)))
    known = met.where("_known").select("request_id", F.col("_stored").alias("text"))
    rest = met.where("not _known").select(F.col("request_id").alias("doc_id"), "page", "image")
    return known.unionByName(recognize(rest, load).select(F.col("doc_id").alias("request_id"), "text"))
