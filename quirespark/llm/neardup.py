"""Near-duplicate stage of the pipeline: texts whose five-word shingles have a Jaccard similarity of SIMILARITY or more.

Shingles are those of operator 6, WIDTH words wide; a text is the set of their XXH64
hashes. Candidates come from operator 6: texts whose SimHash differs in RADIUS bits at most meet in its
covering tables. A bit differs with probability 0.15 between sets of similarity 0.8
(ten of 64 bits), out of reach of these tables. A text has therefore also TABLES
independent fingerprints, each of the least values of its set under ROWS random
orders: two sets of similarity s have one of them equal with probability
s ** ROWS, so at 0.8 a pair is missed by all with probability 0.0005, above it with less.

Texts with an equal fingerprint are tied to the least of its bucket, those with near SimHashes to one
another, and the components of all these ties are candidate groups. The sets of a group meet in a task, where every pair
that no chain of links connects yet is verified by its exact similarity, so only
true links come out. A group of more than BLOCK hashes is split into blocks, every two
of which meet in a task of their own. Equal sets count once.

Defined cases: null, empty and blank texts are the empty set, alike; a text of fewer than
WIDTH words has one shingle, the whole; groups are what chains of links connect; rows
with null ids take no part in near_duplicates(), and keep_one() says what it does with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bounded, cut, text_steps
from .components import components
from .simhash import SEED, hashes, of_hashes
from .simhash import links as near_prints

WIDTH = 5
SIMILARITY = 0.8
TABLES = 32
ROWS = 7
#: Hashes that one place compares at most, besides a single pair of sets.
BLOCK = 1_000_000

_rng = np.random.default_rng(SEED)
FLIP = _rng.integers(0, 1 << 32, (TABLES * ROWS, 1), np.uint32)
TIMES = _rng.integers(0, 1 << 32, (TABLES * ROWS, 1), np.uint32) | np.uint32(1)
MIX = _rng.integers(0, 1 << 64, (TABLES, ROWS), np.uint64) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The set of a text's shingles: sorted 64-bit hashes."""
    return as_set(hashes(text, WIDTH)[1])


def as_set(hashed: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(hashed, np.uint64))


def set_id(s: np.ndarray) -> int:
    return xxh64_intdigest(s.tobytes(), SEED) - (1 << 63)


def keys(s: np.ndarray) -> np.ndarray:
    """The fingerprints of a set, none of the empty one."""
    if not s.size:
        return np.zeros(0, np.int64)
    low = s.astype(np.uint32)
    least = np.full(TABLES * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(least, ((low[at : at + 1024] ^ FLIP) * TIMES).min(axis=1), out=least)
    return (least.reshape(TABLES, ROWS) * MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, set_id, n distinct shingles, fp, keys) of docs (doc_id, text); text_key is the XXH64 of the text, fp its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in text_steps(batch, "t")):
            hashed = [hashes(t, WIDTH) for t in b.column("t").to_pylist()]
            sets = [as_set(h) for _, h in hashed]
            found = [keys(s) for s in sets]
            offsets = pa.array(np.r_[0, np.cumsum([len(k) for k in found])].astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(of_hashes(hashed)), lists], names=["doc_id", "text_key", "set_id", "n", "fp", "keys"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id long, text_key long, set_id long, n long, fp long, keys array<long>")


def verify(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (places in sets) of a similarity of at least SIMILARITY that connect what all such links connect."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    values, codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts = np.r_[0, np.cumsum(sizes)]
    label, mark, out = np.arange(len(sets)), np.zeros(len(values), bool), []
    done = np.zeros(len(sets), bool)
    while not done.all():
        # a set outside the largest component is compared with all others; inside that one no pair is left to compare
        count = np.bincount(label)
        rest = np.nonzero(~done & (label != count.argmax()))[0] if out else np.nonzero(~done)[0]
        if not rest.size:
            break
        i = rest[0]
        done[i] = True
        lo = np.searchsorted(sizes, SIMILARITY * sizes[i] - 1e-6)
        hi = np.searchsorted(sizes, sizes[i] / SIMILARITY + 1e-6, side="right")
        if hi - lo < 2:
            continue
        mine = codes[starts[i] : starts[i + 1]]
        mark[mine] = True
        both = np.add.reduceat(mark[codes[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
        mark[mine] = False
        alike = both >= SIMILARITY * (sizes[lo:hi] + sizes[i] - both) - 1e-9
        for j in (np.nonzero(alike)[0] + lo).tolist():
            if label[j] != label[i]:
                out.append((order[i], order[j]))
                label[label == label[j]] = label[i]
    return out


def links(docs: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) between the sets of members (root, set_id, least, n), whose texts are those of docs with the id `least`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in text_steps(batch, "t")):
            sets = [shingles(t) for t in b.column("t").to_pylist()]
            # of rows that share an id, those with another text are not meant
            own = pa.array([set_id(s) == i for s, i in zip(sets, b.column("set_id").to_pylist(), strict=True)])
            rows = pa.RecordBatch.from_arrays([*(b.column(c) for c in ("root", "i", "j", "set_id")), pa.array([s.tobytes() for s in sets], pa.binary())], names=["root", "i", "j", "set_id", "hashes"])
            yield rows.filter(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for b in batches:
            for *key, i, h in zip(*(b.column(c).to_pylist() for c in ("root", "i", "j", "set_id")), b.column("hashes"), strict=True):
                if key != now:
                    yield from finish(held)
                    now, held = key, {}
                if i not in held:
                    held[i] = np.frombuffer(h.as_py(), np.uint64)
        yield from finish(held)

    def finish(held: dict) -> Iterator[pa.RecordBatch]:
        found = verify(list(held.values())) if len(held) > 1 else []
        if found:
            ids = np.array(list(held))
            at = np.array(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["a", "b"])

    half = block // 2
    blocks = members.groupBy("root").agg(F.when(F.sum("n") <= block, 1).otherwise(F.ceil(F.sum("n") * 1.25 / half)).cast("int").alias("_n"))
    mine = members.join(blocks, "root").withColumn("_i", F.pmod(F.xxhash64("set_id"), F.col("_n")).cast("int"))
    texts = docs.select(F.col("doc_id").alias("least"), F.col("text").cast("binary").alias("t")).join(bounded(cut(mine)), "least")
    met = texts.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    met = met.select("root", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), "set_id", "t")
    sets = met.mapInArrow(read, "root long, i int, j int, set_id long, hashes binary")
    dealt = sets.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "set_id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_sets(found: DataFrame) -> DataFrame:
    """Ties (a, b) between sets of found (set_id, n, fp) with shingles whose SimHashes are equal or meet in the covering tables of operator 6. Copies, and texts that differ in repeats only, may share a set."""
    prints = cut(found.where("n > 0").select("fp", "set_id").distinct())
    first = cut(prints.groupBy("fp").agg(F.min("set_id").alias("a"), F.count(F.lit(1)).alias("_sets")))
    same = prints.join(bounded(first.where("_sets > 1").select("fp", "a")), "fp").where("set_id <> a").select("a", F.col("set_id").alias("b"))
    met = cut(near_prints(first.select("fp")))
    left, right = (first.select(F.col("fp").alias(side), F.col("a").alias(f"_{side}")) for side in "ab")
    return same.union(met.join(left, "a").join(right, "b").select("_a", "_b")).where("a <> b")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_key, component_id) for every row of docs (doc_id, text) that has an id; component_id is the component's least id."""
    ids = docs.where(F.col("doc_id").isNotNull())
    found = cut(sketches(ids))
    # copies are one set, with one list of keys, before the keys are dealt
    sets = cut(found.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.first("keys").alias("keys")))
    rows = sets.select("set_id", F.explode("keys").alias("key"))
    sets = sets.drop("keys")
    buckets = cut(rows.groupBy("key").agg(F.min("set_id").alias("a"), F.max("set_id").alias("_b")).where("a < _b").select("key", "a"))
    ties = rows.join(bounded(buckets), "key").where("set_id <> a").select("a", F.col("set_id").alias("b"))
    tied = components(ties.union(near_sets(found)))
    members = cut(tied.withColumnRenamed("node", "set_id").join(sets, "set_id").select("root", "set_id", "least", "n"))
    linked = cut(components(links(ids, members, block)).withColumnRenamed("node", "set_id").join(sets, "set_id"))
    of_linked = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set_id", "component_id")
    shared = sets.join(of_linked, "set_id", "left").where("rows > 1 or component_id is not null").select("set_id", F.coalesce("component_id", "least").alias("component_id"))
    return found.select("doc_id", "text_key", "set_id").join(bounded(cut(shared)), "set_id", "left").select("doc_id", "text_key", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows whose component has a smaller id.

    A row is known by its id and the XXH64 of its text, so rows that share an id are judged each by its own
    text. Rows with the kept id in one component are one document; rows without id count as one with the largest id.
    """
    own = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    near = near_duplicates(docs.select(own.alias("doc_id"), "text"))
    gone = cut(near.where("component_id <> doc_id").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
    return docs.join(bounded(gone), (own == F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left_anti")
