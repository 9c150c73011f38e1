"""Exports as text lines, written by Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE

BOM = "\ufeff"


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def minimal(value: Column) -> Column:
    """Quoted where a comma, a quote or a line end asks for it."""
    return F.when(value.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def always(value: Column) -> Column:
    """White space of all kinds trimmed and collapsed, always quoted."""
    return F.concat(F.lit('"'), F.replace(F.trim(F.regexp_replace(value, f"{WHITE}+", " ")), F.lit('"'), F.lit('""')), F.lit('"'))


def never(value: Column) -> Column:
    """Never quoted: white space of all kinds trimmed, line ends within become spaces, commas semicolons."""
    return F.replace(F.regexp_replace(F.regexp_replace(value, f"^{WHITE}+|{WHITE}+$", ""), "[\r\n]+", " "), F.lit(","), F.lit(";"))


def heading(df: DataFrame, field: Callable[[Column], Column]) -> Column:
    return F.array_join(F.array(*(field(F.lit(c)) for c in df.columns)), ",")


def body(df: DataFrame, field: Callable[[Column], Column]) -> DataFrame:
    """df as lines (value) without heading."""
    return df.select(F.array_join(F.array(*(field(_text(c)) for c in df.columns)), ",").alias("value"))


def lines(df: DataFrame, field: Callable[[Column], Column]) -> DataFrame:
    """df as lines (value), each partition's first one after a heading; an empty df is the heading alone."""
    if df.isEmpty():
        return df.sparkSession.range(1).select(heading(df, field).alias("value"))
    line = F.array_join(F.array(*(field(_text(c)) for c in df.columns)), ",")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return df.select(F.explode(F.when(first, F.array(heading(df, field), line)).otherwise(F.array(line))).alias("value"))


def in_files(df: DataFrame, files: int | None) -> DataFrame:
    """df in at most so many partitions, each a file; None leaves it as it is."""
    return df if files is None else df.coalesce(files)


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """UTF-8 with a byte order mark, lines ending in CR LF, fields quoted where needed. df keeps its order; every file has the heading."""
    marked = df.withColumnRenamed(df.columns[0], f"{BOM}{df.columns[0]}")
    lines(in_files(marked, files), minimal).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_quoted(df: DataFrame, path: str, files: int | None = None) -> None:
    lines(in_files(df, files), always).write.mode("overwrite").text(path)


def write_plain(df: DataFrame, path: str, files: int | None = None) -> None:
    lines(in_files(df, files), never).write.mode("overwrite").text(path)


def write_texts(df: DataFrame, path: str) -> None:
    """Texts (id, text) as Parquet, dealt by id, for reading single ones."""
    df.select("id", "text").repartition("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("value"))
