"""What the operators of this subpackage share: input, the shared folder, cutting lineage, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes as text, that a join side may have before it is dealt by key instead of broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
#: UTF-8 bytes of text that one Python step holds at a time, besides the longest single text.
STEP_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, on a single machine, a temporary one of our own, and on a cluster an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="quirespark-")
        sc.setCheckpointDir(where)
    return (where or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so a lost executor loses nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is measured to have at most so many rows and bytes of text; else as it is, to be shuffled."""
    few = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length(F.to_json(F.struct("*")))).alias("size")).first()
    return F.broadcast(df) if few.rows <= rows and (few.size or 0) <= size else df


def without(df: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """df without the rows whose key is in gone; rows with a null key stay."""
    side = cut(gone.where(F.col(key).isNotNull()).select(key).distinct())
    return df.join(bounded(side), key, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))


def id_bucket(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def steps(sizes: list[int], most: int = STEP_BYTES) -> Iterator[slice]:
    """Slices of rows whose sizes add up to at most `most`; a larger row comes alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def text_steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `most` bytes of text, so that few texts are Python objects at a time."""
    for s in steps(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), most):
        yield batch.slice(s.start, s.stop - s.start)


def keep_rows(docs: DataFrame, judge: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """docs without the rows whose text is judged False. judge() is called once a task; what it gives takes texts (null: '') and says which stay.

    The rows themselves pass through the step, so each is judged by its own text, whatever its id or other columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps = judge()
        for b in (s for batch in batches for s in text_steps(batch)):
            yield b.filter(pa.array(keeps([t or "" for t in b.column("text").to_pylist()])))

    return docs.mapInArrow(run, docs.schema)


def hash_sample(df: DataFrame, keys: tuple[str, ...], strata: str, rows: dict, seed: str, most: int) -> DataFrame:
    """Of the rows of each stratum in rows {stratum: (rows there are, rows wanted)}, those whose hashed keys fall in the wanted share.

    Where repeated rows would make these more than `most`, the ones that come first by their hashes stay.
    """
    share = F.lit(0.0)
    for value, (n, want) in rows.items():
        share = F.when(F.col(strata) == F.lit(value), F.lit(min(1.0, want / max(1, n)))).otherwise(share)
    mixed = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30))
    return df.where(mixed < share * float(1 << 30)).orderBy(mixed, *keys).limit(most)
