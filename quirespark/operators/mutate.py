"""Changes of the document table: each takes the table and gives the new one. On plain Parquet a writer then swaps the two.

Where changes are given by id, an id may come once. If it may come several times, `order` names the column of the changes that
says which one counts: the last, and of those alike in it the largest. Without it a repeated id is an error. Null ids change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as L
from ..sources.schema import HISTORY, OCR_TEXT, conform


#: The case of documents without a case, the name of a case without a file, and marks of archived versions.
CONTAINER, UNNAMED, BACKUP, VERSION = "Dokumenty niezwiązane z opiniami", "Nowa opinia", "_backup_{}", " (wersja z {})"


def blank_to_null(c: Column) -> Column:
    """Stripped, and null if nothing is left."""
    return L.filled(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def one_each(changes: DataFrame, key: str, order: str | None, columns: list[str]) -> DataFrame:
    """(key, columns) of changes with one row for each key."""
    packed = F.struct(*columns)
    if order:
        one = F.max(F.struct(F.col(order).alias("_order"), packed.alias("_c")))["_c"]
    else:
        repeated = F.raise_error(F.concat(F.lit(f"several changes of {key} "), F.first(key).cast("string")))
        one = F.when(F.count(F.lit(1)) > 1, repeated.cast(_struct(changes, columns))).otherwise(F.first(packed))
    return changes.where(F.col(key).isNotNull()).groupBy(key).agg(one.alias("_c")).select(key, "_c.*")


def _struct(df: DataFrame, columns: list[str]) -> T.StructType:
    return T.StructType([df.schema[c] for c in columns])


def append(df: DataFrame, new: DataFrame) -> DataFrame:
    return df.unionByName(new.select(*(c for c in df.columns if c in new.columns)), allowMissingColumns=True)


#: Why an upload is refused.
NOT_ALLOWED, NOT_WORD = "Niedozwolony typ pliku", "Opinie muszą być w formacie Word (.doc, .docx)"


def refusal(filename: Column) -> Column:
    """Why a file is not taken as a case; null if it is."""
    return F.when(~F.coalesce(L.allowed(filename), F.lit(False)), NOT_ALLOWED).when(~L.extension(filename).isin(".doc", ".docx"), NOT_WORD)


def taken(uploads: DataFrame, order: str = "id") -> DataFrame:
    """uploads with `error`: files are taken one by one in `order`, up to the first that is refused; of it and of those behind it none is.

    error is null for what is taken, the reason for the one refused, and that reason too for those behind it.
    """
    bad = uploads.where(refusal(F.col("original_filename")).isNotNull()).agg(F.min(F.struct(F.col(order).alias("at"), refusal(F.col("original_filename")).alias("why"))).alias("_first"))
    met = uploads.crossJoin(F.broadcast(bad))  # one row
    return met.withColumn("error", F.when(F.col(order) >= F.col("_first.at"), F.col("_first.why"))).drop("_first")


def new_cases(uploads: DataFrame, partial: bool = False, order: str = "id") -> DataFrame:
    """Rows for uploaded cases (id, original_filename, stored_filename, upload_time[, mime_type]).

    An upload that is no Word file is an error; if partial, those before it are taken, and taken() says what became of the others. A type read from the content is kept.
    """
    if partial:
        uploads = taken(uploads, order).where("error is null").drop("error")
    name = F.col("original_filename")
    ok = F.when(refusal(name).isNull(), name).otherwise(F.raise_error(F.concat(F.lit("not a Word file: "), name)).cast("string"))
    mime = F.coalesce("mime_type", L.mime_of(name)) if "mime_type" in uploads.columns else L.mime_of(name)
    return conform(uploads.withColumns({"mime_type": mime, "original_filename": ok, "is_main": F.lit(True), "step": F.lit("k1"), "ocr_status": F.lit("none"), "content_type": F.lit("opinion"), "doc_type": F.lit("Opinia")}))


def empty_cases(new: DataFrame) -> DataFrame:
    """Rows for cases without a file, new (id, sygnatura, doc_type, step, note, upload_time); the note is stripped."""
    stripped = F.regexp_replace("note", r"(?U)^\s+|\s+$", "")
    own = {"original_filename": F.lit(UNNAMED), "stored_filename": F.concat(F.col("id").cast("string"), F.lit(".empty")), "note": F.when(F.col("note") != "", stripped)}
    return conform(new.withColumns(own | {"is_main": F.lit(True), "ocr_status": F.lit("none"), "content_type": F.lit("opinion")}))


def new_children(df: DataFrame, uploads: DataFrame, run_ocr: bool = True) -> DataFrame:
    """Rows for uploads (id, case_id, doc_type, original_filename, stored_filename, upload_time) to cases; they inherit person and step.

    A Word file of kind Opinia is a case of its own. Files of other types than the known are left out.
    """
    cases = df.select(F.col("id").alias("case_id"), F.col("sygnatura"), F.col("step").alias("_step"))
    kind = L.content_type(L.mime_of(F.col("original_filename")))
    met = uploads.where(L.allowed(F.col("original_filename"))).join(cases, "case_id").withColumns({"mime_type": L.mime_of(F.col("original_filename")), "content_type": kind})
    main = (F.col("content_type") == "opinion") & F.coalesce(F.col("doc_type") == "Opinia", F.lit(False))
    rows = met.withColumns(
        {
            "is_main": main,
            "parent_id": F.when(~main, F.col("case_id")),
            "step": F.when(main, "k1").otherwise(F.col("_step")),
            "ocr_status": F.when(F.lit(run_ocr) & (F.col("content_type") != "opinion"), "pending").otherwise("none"),
        }
    )
    return conform(rows.drop("case_id", "_step"))


def quick_uploads(uploads: DataFrame, container: int) -> DataFrame:
    """Rows for uploads without case, under the container; Word files are skipped."""
    own = uploads.where(L.allowed(F.col("original_filename")) & ~L.extension(F.col("original_filename")).isin(".doc", ".docx"))
    mime = L.mime_of(F.col("original_filename"))
    return conform(own.withColumns({"mime_type": mime, "content_type": L.content_type(mime), "is_main": F.lit(False), "parent_id": F.lit(container).cast("long"), "step": F.lit("k1"), "ocr_status": F.lit("pending")}))


def with_container(df: DataFrame, container: DataFrame) -> DataFrame:
    """df, and the row of `container` (a case of kind CONTAINER) unless df has such a case."""
    there = df.where(F.col("is_main") & (F.col("doc_type") == CONTAINER)).select(F.col("doc_type").alias("_t")).distinct()
    return append(df, container.join(there, container["doc_type"] == F.col("_t"), "left_anti"))


def update_metadata(df: DataFrame, changes: DataFrame, columns: tuple[str, ...] = ("step", "doc_type", "sygnatura"), order: str | None = None) -> DataFrame:
    """df with columns of changes (id, columns) put in; the empty string becomes null, but for the step."""
    met = df.join(one_each(changes, "id", order, list(columns)).select("id", F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns)), "id", "left")
    new = {c: F.when(F.col("_hit"), F.col(f"_{c}") if c == "step" else L.filled(F.col(f"_{c}"))).otherwise(F.col(c)) for c in columns}
    return met.withColumns(new).select(*df.columns)


def update_note(df: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """df with the notes of changes (id, note); blank ones become null."""
    met = df.join(one_each(changes, "id", order, ["note"]).select("id", F.lit(True).alias("_hit"), F.col("note").alias("_note")), "id", "left")
    return met.withColumn("note", F.when(F.col("_hit"), blank_to_null(F.col("_note"))).otherwise(F.col("note"))).select(*df.columns)


def delete(df: DataFrame, ids: DataFrame) -> DataFrame:
    """df without ids (id) and their children, one level deep; recognized texts of what is gone stay."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    left = df.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    return left.join(gone, F.col("parent_id") == F.col("_gone"), "left_anti")


def deleted_counts(df: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, rows): how many rows each deletion removes."""
    children = df.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    return ids.select("id").join(df.select("id"), "id", "left_semi").join(children, "id", "left").select("id", (F.coalesce("_n", F.lit(0)) + 1).alias("rows"))


def orphans(df: DataFrame) -> DataFrame:
    """Recognized texts whose source is gone."""
    return df.where("ocr_parent_id is not null").join(df.select(F.col("id").alias("_id")), F.col("ocr_parent_id") == F.col("_id"), "left_anti")


def replace_ocr(df: DataFrame, results: DataFrame) -> DataFrame:
    """df with recognized texts replaced by results (id, ocr_parent_id, text, ocr_confidence, upload_time): old ones of the same source go."""
    sources = results.select(F.col("ocr_parent_id").alias("_src")).distinct()
    stale = F.coalesce(F.col("doc_type") == OCR_TEXT, F.lit(False))
    kept = df.where(~stale).unionByName(df.where(stale).join(sources, F.col("ocr_parent_id") == F.col("_src"), "left_anti"))
    own = df.select(F.col("id").alias("ocr_parent_id"), "sygnatura", "step", F.col("original_filename").alias("_name"))
    rows = results.join(own, "ocr_parent_id").withColumns(
        {
            "doc_type": F.lit(OCR_TEXT),
            "original_filename": L.stem_with(F.col("_name"), ".txt"),
            "stored_filename": F.concat(F.col("id").cast("string"), F.lit(".txt")),
            "ocr_status": F.lit("done"),
            "mime_type": F.lit("text/plain"),
            "content_type": F.lit("document"),
            "is_main": F.lit(False),
            "last_modified": F.col("upload_time"),
        }
    )
    return append(kept, rows)


def save_manual_text(df: DataFrame, edits: DataFrame, at: str, confidence: float = 0.8, order: str | None = None) -> DataFrame:
    """df with texts typed in, edits (id, source_id, text), one for a source: its text is changed or, under the id given, made; its status none becomes done."""
    edits = one_each(edits, "source_id", order, ["id", "text"])
    time = F.lit(at).cast("timestamp_ntz")
    known = df.where(F.coalesce(F.col("doc_type") == OCR_TEXT, F.lit(False)) & F.col("ocr_parent_id").isNotNull()).groupBy("ocr_parent_id").agg(F.max_by("id", F.struct("upload_time", "id")).alias("_of"))
    met = edits.join(known, edits["source_id"] == known["ocr_parent_id"], "left")
    changes = met.where("_of is not null").select(F.col("_of"), F.col("text").alias("_text"))
    out = df.join(changes, F.col("id") == F.col("_of"), "left")
    out = out.withColumns({"last_modified": F.when(F.col("_of").isNotNull(), time).otherwise(F.col("last_modified")), "text": F.when(F.col("_of").isNotNull(), F.col("_text")).otherwise(F.col("text"))}).select(*df.columns)
    new = met.where("_of is null").select("id", F.col("source_id").alias("_src"), "text")
    touched = new.select(F.col("_src").alias("_hit"))
    out = out.join(touched, F.col("id") == F.col("_hit"), "left")
    was_none = F.col("_hit").isNotNull() & (F.col("ocr_status") == "none")
    out = out.withColumns({"ocr_confidence": F.when(was_none, F.lit(confidence)).otherwise(F.col("ocr_confidence")), "ocr_status": F.when(was_none, "done").otherwise(F.col("ocr_status"))}).select(*df.columns)
    own = df.select(F.col("id").alias("_src"), "sygnatura", "step", F.col("original_filename").alias("_name"))
    rows = new.join(own, "_src").withColumns(
        {
            "ocr_parent_id": F.col("_src"),
            "doc_type": F.lit(OCR_TEXT),
            "original_filename": L.stem_with(F.col("_name"), "_manual_ocr.txt"),
            "stored_filename": F.concat(F.col("id").cast("string"), F.lit(".txt")),
            "ocr_status": F.lit("done"),
            "ocr_confidence": F.lit(confidence),
            "mime_type": F.lit("text/plain"),
            "content_type": F.lit("document"),
            "is_main": F.lit(False),
            "upload_time": time,
        }
    )
    return append(out, rows)


def replace_file(df: DataFrame, updates: DataFrame, at: str, stamp: str, order: str | None = None) -> DataFrame:
    """df after new files, updates (id, original_filename, stored_filename, history_id, comments): the old state of each becomes an archived version.

    An empty case has no old state; it becomes an opinion. The archived version carries the time of the state it holds.
    """
    columns = ["original_filename", "stored_filename", "history_id", "comments"]
    u = one_each(updates, "id", order, columns).select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in columns))
    met = df.join(u, F.col("id") == F.col("_id"), "left")
    hit, empty = F.col("_id").isNotNull(), F.endswith("stored_filename", F.lit(".empty"))
    old = met.where(hit & ~empty).withColumns(
        {
            "upload_time": F.coalesce("last_modified", "upload_time"),
            "stored_filename": F.concat(F.lit("history/"), F.col("id").cast("string"), F.lit(BACKUP.format(stamp)), F.regexp_extract("stored_filename", r"(\.[^./]+)$", 1)),
            "original_filename": F.concat("original_filename", F.lit(VERSION.format(stamp))),
            "parent_id": F.col("id"),
            "id": F.col("_history_id"),
            "doc_type": F.lit(HISTORY),
            "ocr_status": F.lit("none"),
            "is_main": F.lit(False),
            **{c: F.lit(None).cast(dict(df.dtypes)[c]) for c in ("last_modified", "note", "ocr_confidence", "ocr_progress", "ocr_parent_id") if c in df.columns},
        }
    )
    fresh = met.withColumns(
        {
            "original_filename": F.when(hit, F.col("_original_filename")).otherwise(F.col("original_filename")),
            "stored_filename": F.when(hit, F.col("_stored_filename")).otherwise(F.col("stored_filename")),
            "content_type": F.when(hit & empty, "opinion").otherwise(F.col("content_type")),
            "last_modified": F.when(hit, F.lit(at).cast("timestamp_ntz")).otherwise(F.col("last_modified")),
            "note": F.when(hit & (L.filled(F.col("_comments")).isNotNull()), F.concat(F.coalesce("note", F.lit("")), F.lit(L.UPDATE_MARK.format(at[:16])), F.col("_comments"))).otherwise(F.col("note")),
        }
    )
    return fresh.select(*df.columns).unionByName(old.select(*df.columns))


def save_summaries(df: DataFrame, found: DataFrame, at: str, mode: str = "append", order: str | None = None) -> DataFrame:
    """df with the summaries of found (id, summary) in the notes."""
    met = df.join(one_each(found.where("summary is not null"), "id", order, ["summary"]).select("id", F.col("summary").alias("_s")), "id", "left")
    return met.withColumn("note", F.when(F.col("_s").isNotNull(), L.note_with_summary(F.col("note"), F.col("_s"), at, mode)).otherwise(F.col("note"))).select(*df.columns)
