"""The text of documents: decoding, extraction by kind, and what recognition adds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from .versions import latest_ocr

#: Fixed values.
OCR_MARK = "\n\n=== OCR RESULTS ===\n"
SHORTENED = "...\n[Skrócone - pobierz pełny tekst, aby zobaczyć więcej]"


def decoded(content: Column | str) -> Column:
    """Bytes as UTF-8, else as Latin-1, which takes any byte; line ends become \\n."""
    content = F.col(content) if isinstance(content, str) else content
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def extracted(files: DataFrame, parsers: list[Callable[[bytes], str]], failure: str = "") -> DataFrame:
    """(id, text) of files (id, content): the first parser that gives a text, else `failure`. Parsers are the caller's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for content in pdf["content"]:
                for parse in parsers:
                    try:
                        text = parse(bytes(content))
                    except Exception:  # the next parser is the fallback
                        continue
                    if text:
                        out.append(text.strip())
                        break
                else:
                    out.append(failure)
            yield pdf[["id"]].assign(text=out)

    return files.select("id", "content").mapInPandas(run, "id long, text string")


def with_ocr(df: DataFrame) -> DataFrame:
    """(id, content) of documents with a text column: PDF files and images have their newest recognized text after their own.

    A document without a file (null text) has the empty content, recognized or not.
    """
    latest = latest_ocr(df).select(F.col("ocr_parent_id").alias("_src"), F.col("text").alias("_ocr"))
    met = df.join(latest, F.col("id") == F.col("_src"), "left")
    kind = F.col("mime_type")
    textual = (kind == "application/pdf") | L.is_word(kind) | (kind == "text/plain") | (F.col("doc_type") == "OCR TXT")
    own = F.when(F.coalesce(textual, F.lit(False)), F.col("text")).otherwise("")
    adds = (L.is_image(kind) | F.coalesce(kind == "application/pdf", F.lit(False))) & F.coalesce(F.col("_ocr").rlike(r"\S"), F.lit(False))
    content = F.when(F.col("text").isNull(), "").when(adds, strip(F.concat(own, F.lit(OCR_MARK), F.col("_ocr")))).otherwise(own)
    return met.select("id", content.alias("content"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def preview(text: Column, most: int | None = None) -> Column:
    return L.truncate_at(text, most, SHORTENED) if most else text


def summaries(df: DataFrame, load: Callable[[], Callable[[str], str]], instruction: str) -> DataFrame:
    """(id, summary, error) of documents (id, content). load gives, once a worker, the caller's client of a language model."""
    asked = df.select("id", L.prompt(F.col("content"), instruction).alias("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = load()
        for pdf in batches:
            out = []
            for p in pdf["prompt"]:
                try:
                    out.append((ask(p), None))
                except Exception as e:  # one request's failure is a result
                    out.append((None, str(e)))
            yield pdf[["id"]].assign(summary=[s for s, _ in out], error=[e for _, e in out])

    return asked.mapInPandas(run, "id long, summary string, error string")
