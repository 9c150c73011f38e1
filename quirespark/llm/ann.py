"""Operator 7: nearest neighbours by collision counting over query-centred windows.

A shard of at most SHARD vectors is projected on PROJECTIONS random directions; for each
it keeps one sorted array of its vectors. A query's window of half-width w on such an
array is a range around the query's own projection, and a vector collides there if it
lies in it. Widening w is virtual rehashing: the arrays stay as they are. Windows for a
radius R are R * WINDOW wide, where a vector at distance R collides with probability
erf(WINDOW / sqrt(2)); one that collides on MARGIN standard deviations less than the
mean number of projections or more is verified by its exact inner product. A query's
radius grows by GROWTH until the k-th best verified vector is within it: whatever is
nearer than that has had its windows. In the shards after a query's first, the radius is
the distance of its k-th best so far, so these windows open once, and the more vectors a
query has met the narrower they are.

To count collisions, a projection's array is cut at CUTS places and holds a bit map of the
vectors before each cut; a window, widened to the nearest cuts, is the difference of two of
them, and bit-sliced adders count for all vectors of a shard at once.

Inner products become distances by one more component, which makes all stored vectors
as long as the longest one, and queries unit vectors: nearest is then largest inner product.

Vectors are dealt into cells and queries into blocks, both by hash; a task has one block
(at most QUERIES queries), and the vectors of one cell stream past it, a shard at a
time in order of hash. Results therefore do not depend on the partitions of the input, a
task holds a block and one shard whatever the sizes, and the driver holds two counts. Each
query is copied to every cell, each vector to every block; a copied query costs 256 bytes
and about a millisecond of work in every shard of the cell, so the copies are not what
takes the time. All rows are indexed and none is a sample.

Defined cases: null, empty and zero vectors and those with a null or non-finite component
take no part; so do vectors of another length than the most frequent one (of several, the
longest); equal scores go to the smaller id; a row with the query's id is not its
candidate; rows with null ids take no part; of rows that share an id the one with the
smallest vector (by its components in order) asks, and the best score counts as a
candidate's; rows alike in id and vector count once; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

PROJECTIONS = 511
WINDOW = 1.0
MARGIN = 0.3
GROWTH = 1.06
#: The first radius is this share of the distance to the nearest of PILOT vectors of the shard.
START, PILOT = 0.85, 64
#: Cuts of a sorted array.
CUTS = 128
#: Vectors of a shard; vectors of a cell; queries of a block at most and, where cores are idle, at least.
SHARD = 8_192
CELL = 131_072
QUERIES = 16_384
FEWEST = 256
#: Queries that a shard answers at once.
TOGETHER = 128

_HIT = math.erf(WINDOW / math.sqrt(2))
#: Collisions from which a vector is verified.
LEAST = int(PROJECTIONS * _HIT - MARGIN * math.sqrt(PROJECTIONS * _HIT * (1 - _HIT)))


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((dim, PROJECTIONS)).astype(np.float32)


class Shard:
    """The sorted arrays of some vectors (float64) with the bit maps before each cut."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float):
        self.ids, self.x, self.n = ids, x, len(ids)
        rest = np.sqrt(np.maximum(0, longest**2 - (x**2).sum(1)))
        p = np.c_[x / longest, rest / longest].astype(np.float32) @ directions(x.shape[1] + 1)
        order = np.argsort(p, axis=0)
        self.sorted = np.ascontiguousarray(np.take_along_axis(p, order, 0).T)
        self.step = max(1, -(-self.n // CUTS))
        cuts = -(-self.n // self.step)
        self.maps = np.zeros((PROJECTIONS, cuts + 1, -(-self.n // 64)), np.uint64)
        bit = np.uint64(1) << (np.arange(self.n) & 63).astype(np.uint64)
        for j in range(PROJECTIONS):
            o = order[:, j]
            np.bitwise_or.at(self.maps[j], (np.arange(self.n) // self.step + 1, o >> 6), bit[o])
        np.bitwise_or.accumulate(self.maps, axis=1, out=self.maps)

    def count(self, q: np.ndarray, width: np.ndarray) -> list[np.ndarray]:
        """Collisions of every vector with each of the projected queries in windows of their own widths, as bit slices, lowest first."""
        slices: list[list[np.ndarray]] = []
        for j in range(PROJECTIONS):
            lo = np.searchsorted(self.sorted[j], q[:, j] - width) // self.step
            hi = -(-np.searchsorted(self.sorted[j], q[:, j] + width, side="right") // self.step)
            add(slices, 0, self.maps[j][hi] ^ self.maps[j][lo])
        return finish(slices)

    def colliding(self, q: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each projected query, which vectors collide often enough in the windows of its radius; from 2 on, which no distance exceeds, all do."""
        bits = at_least(self.count(q, (radius * WINDOW).astype(np.float32)), LEAST)
        hit = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, : self.n].astype(bool)
        return hit | (radius >= 2)[:, None]


class Block:
    """Queries, and the k best that each has met."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.scale = np.linalg.norm(q, axis=1)
        self.projected = np.c_[q / self.scale[:, None], np.zeros(len(q))].astype(np.float32) @ directions(q.shape[1] + 1)
        self.best = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
        self.verified = 0

    def distance(self, score: np.ndarray, i: np.ndarray, longest: float) -> np.ndarray:
        """Distances that inner products with the queries i become."""
        return np.sqrt(np.maximum(0, 2 - 2 * score / (self.scale[i] * longest)))

    def worst(self, i: np.ndarray) -> np.ndarray:
        """Scores of the k-th best; -inf for queries that have met fewer."""
        return np.array([self.best[n][1][-1] if len(self.best[n][1]) == self.k else -np.inf for n in i])

    def verify(self, i: int, shard: Shard, at: np.ndarray) -> None:
        """Takes up those of the vectors `at` that are among the k best by the exact inner product."""
        at = at[shard.ids[at] != self.ids[i]]
        self.verified += len(at)
        s = (shard.x[at] * self.q[i]).sum(1)
        ids, scores = self.best[i]
        if len(ids) == self.k:
            good = s >= scores[-1]
            at, s = at[good], s[good]
        ids, scores = np.r_[ids, shard.ids[at]], np.r_[scores, s]
        by = np.lexsort((-scores, ids))
        by = by[np.r_[True, np.diff(ids[by]) != 0][: len(by)]]  # the best score of each id
        by = by[np.lexsort((ids[by], -scores[by]))[: self.k]]
        self.best[i] = ids[by], scores[by]

    def meet(self, shard: Shard, longest: float) -> None:
        for start in range(0, len(self.ids), TOGETHER):
            part = np.arange(start, min(start + TOGETHER, len(self.ids)))
            few = np.isinf(self.worst(part))
            radius = np.empty(len(part))
            radius[~few] = self.distance(self.worst(part[~few]), part[~few], longest)
            if few.any():
                some = self.q[part[few]] @ shard.x[:PILOT].T
                some[self.ids[part[few]][:, None] == shard.ids[:PILOT]] = -np.inf
                near = some.max(1)
                radius[few] = START * np.where(np.isinf(near), 2 / START, self.distance(np.where(np.isinf(near), 0, near), part[few], longest))
            radius = np.maximum(radius * (1 + 1e-6), 1e-3)
            seen = np.zeros((len(part), shard.n), bool)
            while part.size:
                hit = shard.colliding(self.projected[part], radius)
                for i, row in zip(part, hit & ~seen, strict=True):
                    self.verify(i, shard, np.nonzero(row)[0])
                seen |= hit
                worst = self.worst(part)
                open_ = (radius < 2) & (np.isinf(worst) | (self.distance(np.where(np.isinf(worst), 0, worst), part, longest) > radius))
                part, radius, seen = part[open_], radius[open_] * GROWTH, seen[open_]


def add(slices: list, level: int, bits: np.ndarray) -> None:
    """Adds a number of weight 2 ** level: at each level two wait for a third, and three become one and a carry."""
    while True:
        if len(slices) <= level:
            slices.append([])
        slices[level].append(bits)
        if len(slices[level]) < 3:
            return
        a, b, c = slices[level]
        x = a ^ b
        slices[level] = [x ^ c]
        bits, level = (a & b) | (x & c), level + 1


def finish(slices: list) -> list[np.ndarray]:
    level = 0
    while level < len(slices):
        if len(slices[level]) == 2:
            a, b = slices[level]
            slices[level] = [a ^ b]
            add(slices, level + 1, a & b)
        level += 1
    return [s[0] for s in slices]


def at_least(slices: list[np.ndarray], least: int) -> np.ndarray:
    """The bits whose number is at least `least`."""
    more, same = np.zeros_like(slices[0]), np.full_like(slices[0], np.uint64(2**64 - 1))
    for level in range(max(len(slices), least.bit_length()) - 1, -1, -1):
        s = slices[level] if level < len(slices) else np.zeros_like(slices[0])
        if least >> level & 1:
            same = same & s
        else:
            more = more | (same & s)
            same = same & ~s
    return more | same


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where("vec_id is not null and embedding is not null").where(sound if dim is None else sound & (F.size(v) == dim)).select("vec_id", "embedding")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of vectors for each of queries, both (vec_id, embedding)."""
    spark = vectors.sparkSession
    sizes = usable(vectors).groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("longest"))
    most = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    asked = None if most is None else cut(usable(queries, most.dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    count = 0 if asked is None else asked.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, longest = most.dim, float(most.longest) ** 0.5
    cells = -(-most.n // CELL)
    idle = -(-spark.sparkContext.defaultParallelism // cells)
    blocks = max(-(-count // QUERIES), min(-(-count // FEWEST), idle))
    mixed = F.xxhash64("vec_id", "embedding")
    kept = ("vec_id", "embedding")
    rows = usable(vectors, dim).distinct().select(F.pmod(mixed, F.lit(cells)).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), mixed.alias("place"), *kept)
    asks = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), F.xxhash64("vec_id").alias("place"), *kept)
    pair = (F.col("cell") * blocks + F.col("block")).cast("int")
    met = rows.unionByName(asks).withColumn("pair", pair).repartitionById(cells * blocks, F.col("pair")).sortWithinPartitions("pair", "kind", "place", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, block, held, size = [], None, [], 0
        for b in batches:
            kind, ids = b.column("kind").to_numpy(), b.column("vec_id").to_numpy()
            x = b.column("embedding").flatten().to_numpy().astype(np.float64).reshape(-1, dim)
            asking.append((ids[kind == 0], x[kind == 0]))
            ids, x = ids[kind == 1], x[kind == 1]
            while len(ids):
                room = SHARD - size
                held.append((ids[:room], x[:room]))
                size += len(held[-1][0])
                ids, x = ids[room:], x[room:]
                if size == SHARD:
                    block = block or Block(*map(np.concatenate, zip(*asking, strict=True)), k)
                    block.meet(Shard(*map(np.concatenate, zip(*held, strict=True)), longest), longest)
                    held, size = [], 0
        if size:
            block = block or Block(*map(np.concatenate, zip(*asking, strict=True)), k)
            block.meet(Shard(*map(np.concatenate, zip(*held, strict=True)), longest), longest)
        if block and len(block.ids):
            found = [pa.array(np.concatenate(c)) for c in zip(*block.best, strict=True)]
            of = pa.array(np.repeat(block.ids, [len(v) for v, _ in block.best]), pa.int64())
            yield pa.RecordBatch.from_arrays([of, *found], names=["query_id", "vec_id", "score"])

    found = met.select("kind", "vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double")
    if cells > 1:  # vectors of one id may be in several cells
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
