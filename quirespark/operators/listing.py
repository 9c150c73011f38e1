"""Filtered, searched and ordered listings of documents, their facets and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..plans.shared import placed
from .fuzzy import fuzzy as fuzzy_column

#: What a first visit of the list of cases shows.
DEFAULT_STEPS = ("k1", "k2", "k3")


def by_steps(df: DataFrame, steps: list[str] | tuple[str, ...]) -> DataFrame:
    """Rows of the steps named; no step named means all rows."""
    return df.where(F.col("step").isin(*steps)) if steps else df


def cases(df: DataFrame, steps: list[str] | tuple[str, ...] | None = None, search: str | None = None) -> DataFrame:
    """Cases (main documents) of the steps named.

    Nothing given means DEFAULT_STEPS. Once anything is given, no step named means no row.
    """
    main = df.where("is_main")
    if steps is None and search is None:
        return by_steps(main, DEFAULT_STEPS)
    return by_steps(main, steps) if steps else main.where(F.lit(False))


def by_type(df: DataFrame, doc_type: str | None) -> DataFrame:
    return df.where(F.col("doc_type") == doc_type) if doc_type else df


def metadata() -> Column:
    """File name, person and kind in one line, empty ones left out."""
    return F.lower(F.concat_ws(" ", L.filled(F.col("original_filename")), L.filled(F.col("sygnatura")), L.filled(F.col("doc_type"))))


def search(df: DataFrame, term: str | None, content: bool = False, fuzzy: bool = False) -> DataFrame:
    """Rows that match a term, with `matches`: how. A blank term keeps all rows, with no matches.

    Metadata come first, then the text if `content`; a fuzzy match counts where the exact one fails.
    """
    if not (term or "").strip():
        return df.withColumn("matches", F.array().cast("array<string>"))
    low = term.lower()
    meta = F.contains(metadata(), F.lit(low))
    text = F.coalesce(F.contains(F.lower("text"), F.lit(low)), F.lit(False)) if content else F.lit(False)
    near_meta = fuzzy_column(F.when(~meta, metadata()), term) if fuzzy else F.lit(False)
    near_text = fuzzy_column(F.when(~text, F.col("text")), term) if fuzzy and content else F.lit(False)
    tagged = df.withColumns({"_meta": meta, "_text": text, "_near_meta": near_meta, "_near_text": near_text})
    matches = F.array_compact(
        F.array(
            F.when(F.col("_meta"), "metadata").when(F.col("_near_meta"), "fuzzy_metadata"),
            F.when(F.col("_text"), "content").when(F.col("_near_text"), "fuzzy_content"),
        )
    )
    return tagged.withColumn("matches", matches).where(F.size("matches") > 0).select(*df.columns, "matches")


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("upload_time"), F.desc("id"))


def numbered(df: DataFrame) -> DataFrame:
    """df with `position`, its place in newest_first() from 1; equal times are told apart by id and may lie in several tasks.

    All columns of df are written once to the shared folder: leave out texts and what else is not shown before.
    """
    return placed(df, [], [F.desc("upload_time"), F.desc("id")], "position").withColumn("position", F.col("position") + 1)


def facets(df: DataFrame) -> DataFrame:
    """The kinds there are, of all rows."""
    return df.where(L.filled(F.col("doc_type")).isNotNull()).select("doc_type").distinct().orderBy("doc_type")


def export(df: DataFrame) -> DataFrame:
    """The nine columns of the CSV export, under its headings."""
    c = F.col
    return df.select(
        c("id").alias("ID"),
        L.kind_label(c("is_main"), c("mime_type"), c("doc_type")).alias("Typ"),
        F.coalesce("sygnatura", F.lit("")).alias("Dotyczy"),
        F.coalesce("doc_type", F.lit("")).alias("Rodzaj dokumentu"),
        c("original_filename").alias("Nazwa pliku"),
        c("step").alias("Status"),
        L.ocr_label(c("ocr_status")).alias("OCR"),
        L.minute(c("upload_time")).alias("Data dodania"),
        L.minute(c("last_modified")).alias("Ostatnia modyfikacja"),
    )


def by_id(df: DataFrame, key: int) -> DataFrame:
    """The row of an id; LookupError if there is none."""
    found = df.where(F.col("id") == key)
    if found.isEmpty():
        raise LookupError(f"no document {key}")
    return found
