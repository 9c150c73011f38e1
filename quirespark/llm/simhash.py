"""Operator 6: SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: a text's bytes with A-Z in lower case are split at ASCII white space;
every run of `width` words is hashed with XXH64 and a bit of the fingerprint is set if
it is set in over half of the hashes.

Links: each of the 64 bits gets a vector of RADIUS + 1 bits, and table v (any vector but
zero) compares the bits whose vector has an odd product with v. RADIUS differing bits give
RADIUS equations in RADIUS + 1 unknowns, so some v is orthogonal to all of them: in that
table the two fingerprints are equal. 2 ** (RADIUS + 1) - 1 tables thus miss no pair.

Work is done on distinct fingerprints: copies count once. The rows (table, masked bits,
fingerprint) are dealt by hash and sorted; a task streams over them and compares within
each bucket, keeping of the links found a spanning forest of each bucket, not all pairs.
A bucket of more than BLOCK fingerprints is passed on: it is split into blocks, every two
of which meet in a task of their own. Components come from joins in components.py.

Defined cases: null, empty and blank texts have fingerprint zero and are linked; texts of
fewer than `width` words have one shingle, the whole; rows with equal or null ids are
rows of their own, a null id never being a component's; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .common import bounded, cut, table, text_steps, without
from .components import components

RADIUS = 3
WIDTH = 3
SEED = 42
#: Fingerprints compared with one another in one place at most.
BLOCK = 2048
#: Pairs held at once by a comparison.
PAIRS = 4_000_000


def hashes(text: bytes | None, width: int) -> tuple[int, bytes]:
    """Number of shingles, and their hashes one after the other."""
    w = text.lower().split() if text else []
    if not w:
        return 0, b""
    if len(w) <= width:
        return 1, xxh64_digest(b" ".join(w), SEED)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False))
    return len(w) - width + 1, b"".join(map(xxh64_digest, shingles, repeat(SEED)))


def fingerprint(texts: list[bytes | None], width: int = WIDTH) -> np.ndarray:
    """Signed 64-bit fingerprints."""
    return of_hashes([hashes(t, width) for t in texts])


def of_hashes(found: list[tuple[int, bytes]]) -> np.ndarray:
    """Signed 64-bit fingerprints of what hashes() gives for each text."""
    n = np.array([k for k, _ in found], np.int64)
    out = np.zeros(len(found), np.int64)
    some = np.nonzero(n)[0]
    if some.size:
        bits = np.unpackbits(np.frombuffer(b"".join(h for _, h in found), np.uint8).reshape(-1, 8), axis=1)
        ends = np.cumsum(n[some])
        sums = np.add.reduceat(bits, ends - n[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * sums > n[some, None], axis=1).view(">i8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp long) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in text_steps(batch, "t")):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprint(b.column("t").to_pylist(), width))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """Signed 64-bit masks of the tables. Bit i has vector 1 + i mod (2 ** (radius + 1) - 1), so masks differ little in size."""
    full = 2 ** (radius + 1)
    vectors = [1 + i % (full - 1) for i in range(64)]
    out = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, full)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def forest(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect within each group (rows lie together) what links of at most radius bits connect: (fp, least fp tied to it)."""
    n = len(fp)
    starts = np.nonzero(np.r_[True, group[1:] != group[:-1]])[0] if n else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, n])
    label = np.arange(n)
    at, left, right = np.nonzero(np.repeat(sizes, sizes) > 1)[0], [], []
    end = np.repeat(starts + sizes, sizes)
    bits, d = fp.view(np.uint64), 1
    while at.size:
        at = at[at + d < end[at]]
        near = at[np.bitwise_count(bits[at] ^ bits[at + d]) <= radius]
        left.append(near)
        right.append(near + d)
        d += 1
    a, b = np.concatenate([*left, np.zeros(0, int)]), np.concatenate([*right, np.zeros(0, int)])
    while a.size:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    tied = np.nonzero(label != np.arange(n))[0]
    return fp[tied], fp[label[tied]]


def compare(rows: DataFrame, keys: list[str], radius: int, block: int) -> DataFrame:
    """Links within runs of equal keys; runs of more than `block` rows come out as rows (keys, fp) instead. kind 0: a, b; kind 1: large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns of a run that may go on; empty if none or if it is known to be large
        large = None  # key of a large run that may go on
        for b in batches:
            cols = [np.concatenate([h, b.column(c).to_numpy()]) for h, c in zip(held, (*keys, "fp"), strict=True)] if held else [b.column(c).to_numpy() for c in (*keys, "fp")]
            n = len(cols[0])
            if not n:
                continue
            change = np.zeros(n - 1, bool)
            for c in cols[:-1]:
                change |= c[1:] != c[:-1]
            starts = np.r_[0, np.nonzero(change)[0] + 1]
            sizes = np.diff(np.r_[starts, n])
            if large is not None and tuple(c[0] for c in cols[:-1]) == large:
                sizes[0] += block  # the rest of a large run
            else:
                large = None
            goes_on = sizes[-1] <= block
            if not goes_on:
                large = tuple(c[-1] for c in cols[:-1])
            elif len(starts) > 1:
                large = None
            cutoff = starts[-1] if goes_on else n
            held = [c[cutoff:] for c in cols] if goes_on else []
            yield from finish([c[:cutoff] for c in cols], starts, sizes)
        if held:
            yield from finish(held, np.zeros(1, int), np.array([len(held[0])]))

    def finish(cols: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(cols[0])
        starts, sizes = starts[starts < n], sizes[: (starts < n).sum()]
        true = np.diff(np.r_[starts, n])
        group = np.repeat(np.arange(len(starts)), true)
        big = np.repeat(sizes > block, true)
        if big.any():
            yield batch(1, [c[big] for c in cols[:-1]], cols[-1][big], cols[-1][big])
        small = np.nonzero(np.repeat((sizes > 1) & (sizes <= block), true))[0]
        work = (np.cumsum(true.astype(np.int64) ** 2) // PAIRS)[group[small]]
        for part in np.split(small, np.nonzero(np.diff(work))[0] + 1) if small.size else []:
            a, b = forest(cols[-1][part], group[part], radius)
            if a.size:
                yield batch(0, [c[:0] for c in cols[:-1]], a, b)

    def batch(kind: int, key: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        k = [pa.array(x, pa.int64()) if len(x) else pa.nulls(len(a), pa.int64()) for x in key]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *k, pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", *keys, "a", "b"])

    dealt = rows.select(*(F.col(k).cast("long") for k in keys), "fp").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return dealt.mapInArrow(run, ", ".join(["kind int", *(f"{k} long" for k in keys), "a long", "b long"]))


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct values of fps (fp) that connect whatever lies within the radius."""
    tables = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius)))))
    rows = fps.select("fp", tables.alias("_t")).select(F.col("_t.t").cast("long").alias("t"), "_t.key", "fp")
    first = cut(compare(rows, ["t", "key"], radius, block))
    out = first.where("kind = 0").select("a", "b")
    large = first.where("kind = 1").select("t", "key", F.col("a").alias("fp"))
    if not large.isEmpty():
        half = block // 2
        sizes = large.groupBy("t", "key").agg(F.ceil(F.count(F.lit(1)) * 1.25 / half).cast("int").alias("_n"))
        mine = large.join(sizes, ["t", "key"]).withColumn("_i", F.pmod(F.xxhash64("fp"), F.col("_n")).cast("int"))
        met = mine.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("t", "key", F.least("_i", "_j").cast("long").alias("i"), F.greatest("_i", "_j").cast("long").alias("j"), "fp")
        out = out.union(compare(met, ["t", "key", "i", "j"], radius, 1 << 40).where("kind = 0").select("a", "b"))
    return out.distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text)."""
    fps = cut(fingerprints(docs, width))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = cut(distinct.join(roots, "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = linked.join(least, "root").select("fp", "component_id")
    # a fingerprint of one document that is linked to no other needs no join
    shared = distinct.join(of_linked, "fp", "left").where("n > 1 or component_id is not null").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.lit(True).alias("_shared"))
    met = fps.join(bounded(cut(shared)), "fp", "left")
    return met.select("doc_id", "fp", F.when(F.col("_shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents whose component has a smaller id. Rows that share the kept id are one document; those without id stay."""
    return without(docs, near_duplicates(docs).where("component_id <> doc_id"))


def op6_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
