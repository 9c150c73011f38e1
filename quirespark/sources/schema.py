"""The document table: its schema, and its rows made of the `documents` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("sygnatura", T.StringType()),
        T.StructField("doc_type", T.StringType()),
        T.StructField("original_filename", T.StringType(), False),
        T.StructField("stored_filename", T.StringType(), False),
        T.StructField("step", T.StringType(), False),
        T.StructField("ocr_status", T.StringType(), False),
        T.StructField("ocr_parent_id", T.LongType()),
        T.StructField("upload_time", T.TimestampNTZType(), False),
        T.StructField("content_type", T.StringType(), False),
        T.StructField("mime_type", T.StringType()),
        T.StructField("ocr_confidence", T.DoubleType()),
        T.StructField("is_main", T.BooleanType(), False),
        T.StructField("parent_id", T.LongType()),
        T.StructField("creator", T.StringType()),
        T.StructField("last_modified_by", T.StringType()),
        T.StructField("last_modified", T.TimestampNTZType()),
        T.StructField("comments", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("ocr_progress", T.DoubleType()),
        T.StructField("ocr_progress_info", T.StringType()),
        T.StructField("ocr_total_pages", T.IntegerType()),
        T.StructField("ocr_current_page", T.IntegerType()),
    ]
)

STATUSES = ("none", "pending", "running", "done", "fail")
STEPS = ("k1", "k2", "k3", "k4")
OCR_TEXT, HISTORY = "OCR TXT", "Archiwalna wersja"
WORD_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def conform(df: DataFrame) -> DataFrame:
    """df with all columns of DOCUMENT, missing ones null, and columns beyond it last: additive schema evolution."""
    have = set(df.columns)
    own = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in DOCUMENT]
    return df.select(*own, *(c for c in df.columns if c not in DOCUMENT.fieldNames()))


def missing_columns(df: DataFrame) -> list[str]:
    return [f.name for f in DOCUMENT if f.name not in df.columns]


#: Expressions of the columns over `documents`; {minutes} adds minutes to a time, {s} is the string type.
_COLUMNS = """
    doc_id as id,
    case when doc_id % 7 = 3 then null else source end as sygnatura,
    case doc_id % 10 when 0 then 'Opinia' when 1 then 'OCR TXT' when 2 then 'OCR TXT' when 3 then 'Akta' when 4 then '' when 5 then null when 6 then 'Archiwalna wersja' else 'Inne' end as doc_type,
    concat('plik_', cast(doc_id as {s}), case when doc_id % 10 = 0 then '.docx' when doc_id % 3 = 0 then '.pdf' when doc_id % 3 = 1 then '.PNG' else '.txt' end) as original_filename,
    concat(case when doc_id % 10 = 6 then 'history/' else '' end, cast(doc_id as {s}), case when doc_id % 50 = 0 then '.empty' else '.bin' end) as stored_filename,
    concat('k', cast(doc_id % 4 + 1 as {s})) as step,
    case doc_id % 5 when 0 then 'none' when 1 then 'pending' when 2 then 'running' when 3 then 'done' else 'fail' end as ocr_status,
    case doc_id % 10 when 1 then doc_id + 2 when 2 then doc_id + 1 end as ocr_parent_id,
    {upload} as upload_time,
    case when doc_id % 10 = 0 then 'opinion' when doc_id % 3 = 1 then 'image' else 'document' end as content_type,
    case when doc_id % 10 = 0 then '{word}' when doc_id % 3 = 0 then 'application/pdf' when doc_id % 3 = 1 then 'image/png' else 'text/plain' end as mime_type,
    case when doc_id % 5 = 3 then (doc_id % 11) / 10e0 end as ocr_confidence,
    doc_id % 10 = 0 as is_main,
    case when doc_id % 10 = 0 then null else doc_id - doc_id % 10 end as parent_id,
    case when doc_id % 3 = 1 then null else {modified} end as last_modified,
    case doc_id % 6 when 0 then null when 1 then '' when 2 then '  ' else concat('Nota ', cast(doc_id as {s}), ', do sprawdzenia przed wysłaniem akt do sądu i zwrotem') end as note,
    case when doc_id % 5 in (1, 2) and doc_id % 20 <> 1 then (doc_id % 100) / 100e0 end as ocr_progress,
    text
"""

SPARK_ROWS = _COLUMNS.format(
    s="string",
    word=WORD_MIME,
    upload="timestampadd(MINUTE, cast((doc_id * 7919) % 100000 as int), TIMESTAMP_NTZ '2024-01-01 00:00:00')",
    modified="timestampadd(MINUTE, cast((doc_id * 7919) % 100000 + doc_id % 5000 as int), TIMESTAMP_NTZ '2024-01-01 00:00:00')",
)
DUCKDB_ROWS = _COLUMNS.format(
    s="varchar",
    word=WORD_MIME,
    upload="TIMESTAMP '2024-01-01 00:00:00' + to_minutes(cast((doc_id * 7919) % 100000 as bigint))",
    modified="TIMESTAMP '2024-01-01 00:00:00' + to_minutes(cast((doc_id * 7919) % 100000 + doc_id % 5000 as bigint))",
)


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as a document table with a text column; lazily, so unused columns (the text) are not read."""
    rows = [x.strip() for x in SPARK_ROWS.strip().split(",\n")]
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*rows)
