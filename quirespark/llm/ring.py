"""Operator 2: consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions.

A ring has `cells` positions. Each shard stands at `vnodes` of them, by hash; a key
goes to the first shard at or clockwise of its own position that is not yet full.
Keys come in ring order, so where each one lands follows from the number of keys at
every position: these counts (at most cells * SUBS rows, however large the input)
are walked once on the driver, which gives for each position the ranges of ranks and
the shard that takes them. The rows themselves are counted, ranked within their
position and joined with those ranges by Spark.

With slack 0 the capacities add up to the number of rows and differ by at most one.
With slack s each shard takes at most ceil((1 + s) * rows / shards); when a shard is
added only keys that the new shard takes, and overflow, move.

Defined cases: a null key has a position like any other; a null text has size 16 and
CRC 0; rows alike in key and text are separate rows with slots of their own; an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Parts of a position, by a hash of the whole row: splits the rows of one very frequent key.
SUBS = 8


def position(key: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(cells)).cast("int")


def ring(spark: SparkSession, shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in ring order: shards * vnodes rows."""
    nodes = spark.range(shards * vnodes).select(
        F.pmod(F.xxhash64(F.lit("node"), F.col("id") % vnodes, F.floor(F.col("id") / vnodes)), F.lit(cells)).alias("pos"),
        F.floor(F.col("id") / vnodes).alias("shard"),
    )
    return sorted((r.pos, r.shard) for r in nodes.collect())


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: list[tuple[int, int, int]], nodes: list[tuple[int, int]], caps: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(position, part, first rank, rank after the last, shard, first slot) for counts (position, part, rows) in ring order."""
    after = list(range(1, len(nodes) + 1)) + [0]  # where to look on from a node; a full shard's nodes are skipped

    def open_from(i: int) -> int:
        seen = []
        while i < len(nodes) and used[nodes[i][1]] >= caps[nodes[i][1]]:
            seen.append(i)
            i = jump[i]
        for x in seen:
            jump[x] = i
        return i

    used, jump, out, first = [0] * len(caps), after[: len(nodes)], [], 0
    for pos, part, n in sorted(counts):
        while first < len(nodes) and nodes[first][0] < pos:
            first += 1
        rank = 0
        while rank < n:
            i = open_from(first)
            if i == len(nodes):
                i = open_from(0)
            s = nodes[i][1]
            take = min(n - rank, caps[s] - used[s])
            out.append((pos, part, rank, rank + take, s, used[s]))
            used[s] += take
            rank += take
    return out


def assign(df: DataFrame, key: str, shards: int, slack: float = 0.0, vnodes: int = 64, cells: int = 16384, order: list[str] | None = None) -> DataFrame:
    """df with shard and slot, in place of columns of these names. order: further columns that tell rows of one key apart."""
    spark, order = df.sparkSession, [key, *(order or [])]
    placed = df.withColumns({"_pos": position(F.col(key), cells), "_part": F.pmod(F.xxhash64(*order), F.lit(SUBS)).cast("int")})
    counts = [(r["_pos"], r["_part"], r["count"]) for r in placed.groupBy("_pos", "_part").count().collect()]  # cells * SUBS rows at most
    ranges = walk(counts, ring(spark, shards, vnodes, cells), capacities(sum(c[2] for c in counts), shards, slack))
    ranges = spark.createDataFrame(ranges, "_pos int, _part int, _from long, _to long, shard int, _slot long")
    ranked = placed.withColumn("_rank", F.row_number().over(W.partitionBy("_pos", "_part").orderBy(*order)).cast("long") - 1)
    same = (F.col("r._pos") == F.col("d._pos")) & (F.col("r._part") == F.col("d._part"))
    within = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    # a row for each position and part, and one more for each time a shard fills up: cells * SUBS + shards at most
    return ranked.alias("d").join(F.broadcast(ranges).alias("r"), same & within).select(*(F.col(f"d.`{c}`") for c in df.columns if c not in ("shard", "slot")), F.col("r.shard").alias("shard"), (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"))


def op2_bounded_ring(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    text = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return assign(docs, "doc_id", shards, order=["text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
