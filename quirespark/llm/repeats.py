"""Operator 12: removal of every 400-byte string that the corpus has more than once, by suffix arrays.

Shards. Equal strings must meet in one suffix array, wherever their documents are. In each string of LENGTH bytes the gram of GRAM
bytes with the least hash is its anchor; equal strings have equal anchors at equal places. The strings of a text that follow
one another with one anchor make a stretch. Stretches are dealt by anchor; an anchor that only one stretch has cannot
repeat, and its bytes are not sent. Equal stretches are counted and sent once. So a shard holds different stretches of repeated anchors.

An anchor may have very many different stretches: a passage that is quoted everywhere, each time between other words. Each of these is
cut into finer stretches of neighbouring strings, which are counted and dealt in the same way, by the bytes that all strings of one such part
share. The finest hold one string each, of which equal ones are equal stretches. So no anchor brings more than MOST stretches to a shard.

Of the stretches of an anchor, a shard takes the strings whose neighbourhood is met again: PART neighbouring strings share LENGTH - PART + 1 bytes or more,
and where no other stretch of the anchor has these, at the same distance from it, none of the strings repeats. Most stretches end here.

In a shard the suffix array of what is left is induced and the permuted common prefixes are computed from it (suffixes.py); strings
repeat if they are neighbours in the array and share LENGTH bytes, or if their stretch was counted more than once.

Texts move once: the distinct ones (by 128 bits of SHA-256) are stored in buckets of their key, and what is to be cut out of them, for a
shard or at the end, comes to the buckets. A text that occurs twice goes as a whole, if it is long enough.

Defined cases: a null or empty text has no bytes and keeps the digest of nothing; a text below LENGTH bytes is kept; repeated rows are
documents of their own, so their texts are repeats; ids are not read but handed on, nulls too; other columns are not read. Bytes are removed without
regard to characters, so what is left is binary.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut, fresh_path, table, text_steps
from .suffixes import common_prefixes, suffix_array

LENGTH = 400
#: Bytes of an anchor.
GRAM = 64
#: Different stretches that an anchor may bring to a shard, and strings in the parts of a stretch that is cut finer.
MOST, PARTS = 128, (64, 8, 1)
#: Bytes of a shard, and neighbouring strings of a stretch that are taken into it together.
SHARD, PART = 1 << 20, 32
#: Strings whose anchors are sought at once; less than 2 ** 24.
STARTS = 4 << 20

_FOLD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def text_key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def stored(docs: DataFrame) -> DataFrame:
    """(text_key, text binary, copies) of the distinct texts of LENGTH bytes or more, in buckets by text_key: joins with it by this key move no text."""
    spark, name = docs.sparkSession, f"texts_{uuid.uuid4().hex}"
    long = docs.where(F.octet_length("text") >= LENGTH).select(text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("text"))
    distinct = long.groupBy("text_key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct.write.bucketBy(buckets, "text_key").option("path", fresh_path(spark, "texts")).saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position."""
    h = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)) * _FOLD[0]
    width = 8
    for k in range(int(np.log2(GRAM // 8))):
        h ^= h >> np.uint64(29)
        h = h[:-width] * _FOLD[1 + k % 2] + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= _FOLD[3]
    return h ^ (h >> np.uint64(29))


def least_in_windows(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n = len(v)
    v = np.r_[v, np.full(-n % width, np.iinfo(v.dtype).max, v.dtype)].reshape(-1, width)
    up = np.minimum.accumulate(v, axis=1).ravel()
    down = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: n - width + 1], up[width - 1 : n])


def stretches(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the stretches of strings that begin at valid positions of data begin, their strings, how far behind the first the anchor is, and its hash."""
    out = [np.zeros((3, 0), np.int64)], [np.zeros(0, np.uint64)]
    low = np.uint64(0xFFFFFF)
    for base in range(0, len(data) - LENGTH + 1, STARTS):
        piece = data[base : base + STARTS + LENGTH - 1]
        h = gram_hashes(piece)
        anchor = (least_in_windows((h & ~low) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1) & low).astype(np.int64)
        at = np.nonzero(valid[base : base + len(anchor)])[0]
        if at.size:
            new = np.nonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(anchor[at]) != 0)])[0]
            first = at[new]
            out[0].append(np.stack([first + base, np.diff(np.r_[new, at.size]), anchor[first] - first]))
            out[1].append(h[anchor[first]])
    where = np.concatenate(out[0], axis=1)
    return where[0], where[1], where[2], np.concatenate(out[1])


ROWS = "text_key binary, start int, n int, ahead int, anchor long, stretch long"


def rows_of(keys: pa.Array, start: np.ndarray, n: np.ndarray, ahead: np.ndarray, anchor: np.ndarray, stretch: list[int]) -> pa.RecordBatch:
    numbers = [pa.array(x.astype(np.int32)) for x in (start, n, ahead)]
    hashes = [pa.array(np.asarray(x, np.uint64).view(np.int64)) for x in (anchor, stretch)]
    return pa.RecordBatch.from_arrays([keys, *numbers, *hashes], names=[c.split()[0] for c in ROWS.split(", ")])


def anchored(texts: DataFrame) -> DataFrame:
    """The stretches of texts: a row of ROWS for each. A stretch begins `start` bytes into its text, holds the strings from there and the n - 1 next places; its anchor is `ahead` bytes behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in text_steps(batch)):
            raw = b.column("text").to_pylist()
            size = np.array([len(t) for t in raw])
            base = np.cumsum(size) - size
            whole = b"".join(raw)
            valid = np.zeros(len(whole), bool)
            for i, k in zip(base.tolist(), size.tolist(), strict=True):
                valid[i : i + k - LENGTH + 1] = True
            start, n, ahead, anchor = stretches(np.frombuffer(whole, np.uint8), valid)
            of = np.searchsorted(base, start, side="right") - 1
            view = memoryview(whole)
            digest = [xxh3_64_intdigest(view[i : i + k + LENGTH - 1]) for i, k in zip(start.tolist(), n.tolist(), strict=True)]
            yield rows_of(b.column("text_key").take(pa.array(of)), start - base[of], n, ahead, anchor, digest)

    return texts.select("text_key", "text").mapInArrow(run, ROWS)


def with_text(texts: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """(text_key, text, rows): the columns of rows gathered for each text that has any; not more than a text has strings."""
    mine = rows.groupBy("text_key").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return texts.select("text_key", "text").join(mine, "text_key")


PARTED = f"{ROWS}, of_anchor long, of_stretch long, place int"


def finer(texts: DataFrame, kinds: DataFrame, part: int) -> DataFrame:
    """The stretches of kinds (anchor, stretch, first) in parts of `part` strings at most: rows of ROWS, whose anchor is now a hash of the bytes that all strings of a part share, with the stretch they are parts of and their place in it.

    Parts are counted from the old anchor, so equal strings are in equal places of parts alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in text_steps(batch)):
            keys, start, n, ahead, shared, digest, of = [], [], [], [], [], [], []
            for i, (text, rows_) in enumerate(zip(b.column("text").to_pylist(), b.column("rows").to_pylist(), strict=True)):
                for r in rows_:
                    anchor, end = r["start"] + r["ahead"], r["start"] + r["n"]
                    at = r["start"]
                    while at < end:
                        k = (at - anchor) // part
                        edge = anchor + k * part
                        stop = min(end, edge + part)
                        keys.append(i)
                        start.append(at)
                        n.append(stop - at)
                        ahead.append(anchor - at)
                        shared.append(xxh3_64_intdigest(text[edge + part - 1 : edge + LENGTH], seed=(k << 8) % (1 << 64) + part))
                        digest.append(xxh3_64_intdigest(text[at : stop + LENGTH - 1]))
                        of.append((r["anchor"], r["stretch"], at - r["start"]))
                        at = stop
            rows = rows_of(b.column("text_key").take(pa.array(keys, pa.int64())), *(np.array(x, np.int64) for x in (start, n, ahead)), np.array(shared, np.uint64), digest)
            more = zip(*of, strict=True) if of else ((), (), ())
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x, t) for x, t in zip(more, (pa.int64(), pa.int64(), pa.int32()), strict=True))], names=[c.split()[0] for c in PARTED.split(", ")])

    return with_text(texts, kinds.select("first.*", "anchor", "stretch"), "start", "n", "ahead", "anchor", "stretch").mapInArrow(run, PARTED)


def repeats_in(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The positions of data marked in begins at which a string of LENGTH bytes begins that begins at another of these too."""
    order = suffix_array(data)
    _, length = common_prefixes(data, order)
    string = np.cumsum(length[order] < LENGTH)
    mine = begins[order]
    many = np.bincount(string[mine], minlength=string[-1] + 1) > 1
    return np.sort(order[mine & many[string]])


def ranges(at: np.ndarray) -> np.ndarray:
    """First, last, first, last ... of the runs of ascending numbers."""
    new = np.nonzero(np.diff(at) > 1)[0]
    return np.stack([at[np.r_[0, new + 1]], at[np.r_[new, len(at) - 1]]], axis=1).ravel() if len(at) else np.zeros(0, np.int64)


def met_again(held: list[tuple]) -> list[tuple[int, int, int]]:
    """Of the stretches of an anchor (.., n, ahead, bytes), the runs of strings that may be in another one too: index of the stretch, first and end.

    Parts are counted from the anchor. Whatever strings of a part a stretch has, they hold the bytes from the last place of the part to LENGTH behind the first.
    """
    parts, seen = [], Counter()
    for i, (*_, n, ahead, data) in enumerate(held):
        at = 0
        while at < n:
            k = (ahead - at) // PART
            end = min(n, ahead - k * PART + 1)
            part = k, xxh3_64_intdigest(data[ahead - k * PART : ahead - min(k * PART + PART - 1, LENGTH - GRAM) + LENGTH])
            parts.append((i, at, end, part))
            seen[part] += 1
            at = end
    out = []
    for i, at, end, part in parts:
        if seen[part] > 1:
            grows = out and out[-1][0] == i and out[-1][2] == at
            out[-1:] = [(i, out[-1][1], end)] if grows else [*out[-1:], (i, at, end)]
    return out


FOUND = "anchor long, stretch long, found array<int>"
STRETCHED = "anchor long, stretch long, copies long, n int, ahead int, bytes binary"


def shard_repeats(stretched: DataFrame) -> DataFrame:
    """FOUND of those of STRETCHED that were counted once: which strings of a stretch repeat, as ranges of places in it; in one row or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, same in groupby(rows, itemgetter(0)):
            same = list(same)
            for i, first, end in met_again(same):
                anchor, stretch, copies, *_, data = same[i]
                held.append((anchor, stretch, copies, first, end - first, data[first : end + LENGTH - 1]))
                size += len(held[-1][-1]) + 1
            if size >= SHARD:
                yield done(held)
                held, size = [], 0
        if held:
            yield done(held)

    def done(held: list[tuple]) -> pa.RecordBatch:
        size = np.array([len(r[5]) + 1 for r in held])
        base = np.cumsum(size) - size
        begins = np.zeros(size.sum(), np.int8)
        begins[base], begins[base + [r[4] for r in held]] = 1, -1
        at = repeats_in(np.frombuffer(b"\0".join(r[5] for r in held), np.uint8), np.cumsum(begins[:-1], dtype=np.int8) > 0)
        edge = np.searchsorted(at, np.stack([base, base + [r[4] for r in held]])).T.tolist()
        some = [(r, at[i:j] - k + r[3]) for r, (i, j), k in zip(held, edge, base.tolist(), strict=True) if i < j and r[2] == 1]
        columns = [[r[0] for r, _ in some], [r[1] for r, _ in some], [ranges(x).tolist() for _, x in some]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["anchor", "stretch", "found"])

    return stretched.repartition("anchor").sortWithinPartitions("anchor", "stretch").mapInArrow(run, FOUND)


def stretch_bytes(texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """STRETCHED of kinds (anchor, stretch, copies, first)."""
    rows = kinds.select("first.text_key", "first.start", "first.n", "first.ahead", "anchor", "stretch", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in text_steps(batch)):
            out = []
            for text, rows_ in zip(b.column("text").to_pylist(), b.column("rows").to_pylist(), strict=True):
                out += [(r["anchor"], r["stretch"], r["copies"], r["n"], r["ahead"], text[r["start"] : r["start"] + r["n"] + LENGTH - 1]) for r in rows_]
            columns = zip(*out, strict=True) if out else [()] * 6
            types = (pa.int64(),) * 3 + (pa.int32(),) * 2 + (pa.binary(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in STRETCHED.split(", ")])

    return with_text(texts, rows, "start", "n", "ahead", "anchor", "stretch", "copies").mapInArrow(run, STRETCHED)


def kinds_of(rows: DataFrame) -> DataFrame:
    """(anchor, stretch, copies, first): equal stretches counted, and where one of them is."""
    return rows.groupBy("anchor", "stretch").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("text_key", "start", "n", "ahead")).alias("first"))


def found_among(texts: DataFrame, kinds: DataFrame, most: int, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """FOUND of kinds. Those counted more than once repeat as a whole; the others meet the kinds of their anchor, if it has more than `most` by way of their parts."""
    counted = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("_kinds"), F.min("copies").alias("_least"))
    anchors = cut(counted.where("_kinds > 1 and _least = 1").drop("_least"))
    twice = kinds.where("copies > 1").select("anchor", "stretch", F.array(F.lit(0), F.col("first.n") - 1).alias("found"))
    few = kinds.join(anchors.where(F.col("_kinds") <= most), "anchor", "left_semi")
    found = cut(shard_repeats(stretch_bytes(texts, few)).unionByName(twice))
    many = anchors.where(F.col("_kinds") > most)
    if not parts or many.isEmpty():
        return found
    crowded = cut(kinds.join(many, "anchor", "left_semi"))
    pieces = cut(finer(texts, crowded, parts[0]))
    inner = found_among(texts, cut(kinds_of(pieces)), most, parts[1:])
    once = crowded.where("copies = 1").select(F.col("anchor").alias("of_anchor"), F.col("stretch").alias("of_stretch"))
    moved = pieces.join(inner, ["anchor", "stretch"]).select("of_anchor", "of_stretch", F.transform("found", lambda x: x + F.col("place")).alias("found"))
    merged = moved.join(once, ["of_anchor", "of_stretch"], "left_semi").groupBy("of_anchor", "of_stretch").agg(F.flatten(F.collect_list("found")).alias("found"))
    return cut(found.unionByName(merged.toDF("anchor", "stretch", "found")))


def repeated(texts: DataFrame, most: int = MOST) -> DataFrame:
    """(text_key, first, last) of stored texts: runs of places at which a string begins that begins elsewhere too, in this text or another."""
    rows = cut(anchored(texts))
    met = rows.join(found_among(texts, cut(kinds_of(rows)), most), ["anchor", "stretch"])
    place = F.explode(F.sequence(F.lit(0), F.size("found") - 2, F.lit(2))).alias("_i")
    met = met.select("text_key", "start", "found", place)
    return met.select("text_key", *((F.col("start") + F.get("found", F.col("_i") + k)).alias(name) for k, name in enumerate(("first", "last"))))


def remove(text: bytes, spans: np.ndarray) -> bytes:
    """text without the spans (start, end)."""
    edges = np.r_[0, spans.ravel(), len(text)].tolist()
    return b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))


def removals(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(text_key, n_removed, n_spans, kept_sha256, spans) of each text of docs (text) of which something is to be removed; spans: start, end, start, end ... in bytes."""
    texts = stored(docs)
    schema = "text_key binary, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
    runs = repeated(texts, most).groupBy("text_key").agg(F.collect_list(F.struct("first", "last")).alias("rows"))
    marked = texts.join(runs, "text_key", "left").where("copies > 1 or rows is not null").select("text_key", "text", "copies", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in text_steps(batch)):
            out = []
            for key, text, copies, rows in zip(*(b.column(c).to_pylist() for c in ("text_key", "text", "copies", "rows")), strict=True):
                cover = np.zeros(len(text) + 1, np.int32)
                if copies > 1:
                    spans = np.array([[0, len(text)]])
                else:
                    np.add.at(cover, [r["first"] for r in rows], 1)
                    np.add.at(cover, [r["last"] + LENGTH for r in rows], -1)
                    edge = np.diff(np.r_[0, (np.cumsum(cover[:-1]) > 0).astype(np.int8), 0])
                    spans = np.stack([np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]], axis=1)
                out.append((key, int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(remove(text, spans)).hexdigest(), spans.ravel().tolist()))
            columns = zip(*out, strict=True) if out else [()] * 5
            types = pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return marked.mapInArrow(run, schema)


def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = removals(docs).drop("spans").withColumnRenamed("text_key", "_key")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha")
    mine = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), sha)
    met = mine.join(found, F.unhex(F.substring("_sha", 1, 32)) == F.col("_key"), "left")
    return met.select("doc_id", "n_bytes", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")), F.coalesce("kept_sha256", "_sha").alias("kept_sha256"))


#: DuckDB SQL for op12_repeated_bytes, on texts in hexadecimal: every string of every text is counted.
SQL = f"""
with doc as (select row_number() over () as r, doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
place as (select r, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) as m from (select r, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) as i from doc)),
repeat as (select m from place group by m having count(*) > 1),
start as (select r, i, i - lag(i) over (partition by r order by i) as gap from place semi join repeat using (m)),
run as (select r, min(i) as a, max(i) + {LENGTH} as b from (select r, i, sum(case when gap <= {LENGTH} then 0 else 1 end) over (partition by r order by i) as k from start) group by r, k),
kept as (
    select r, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as k
    from (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as was from run) join doc using (r) group by r
)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from doc left join kept using (r)
"""
