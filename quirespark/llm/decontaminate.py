"""Operator 10: benchmark decontamination with an FM-index per shard of the corpus.

build() gathers the documents of a task into shards and indexes each one whole, all words of all
texts (fmindex.py): one row for each shard, which is written once to the shared folder and serves any
benchmark. search() streams the stored shards past the windows of a benchmark: all of
them are searched backwards at once through the wavelet matrix, the rows found are
located by the sampled positions, and overlapping and adjoining hits of a document are
merged into spans of word positions. Texts are read once, to be indexed.

The items are cut to pieces of at most PIECE words that overlap by a window less one, so no item is too
large for a task. A benchmark measured to have at most BLOCK_WORDS words is sent to all tasks;
a larger one is dealt into blocks of about that size, each block meets the shards in tasks of
its own, and the spans of a document are merged. The driver holds at most one block.

clean() takes what is found out of the texts of contaminated documents.

Defined cases: a null text has no words; words are runs of ASCII letters and digits and
of all characters beyond ASCII, A-Z in lower case; items without words or without id have
no window; an id that comes several times is one item with the windows of all its rows;
repeated documents are rows of their own; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, cut, fresh_path, table, text_steps
from .fmindex import Index

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Words of a shard, besides the last document.
SHARD_WORDS = 250_000
#: Words of the benchmark in a block, and in a piece of an item.
BLOCK_WORDS, PIECE = 1_000_000, 10_000
#: Occurrences located at once.
ROWS = 500_000
#: Groups of shards that a block meets, where there are several blocks.
GROUPS = 64

_WORD = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_CLEAN = bytes(ord(chr(c).lower()) if c < 0x80 and c in _WORD else c if c in _WORD else 0x20 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_CLEAN).split() if text else []


class Phrases:
    """The windows of pieces of items (item, words): words by id from 0, and by length the distinct windows with their items."""

    def __init__(self, pieces: list[tuple[int, bytes]], window: int):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, text in pieces:
            w = [self.ids.setdefault(x, len(self.ids)) for x in text.split()]
            for i in range(max(1, len(w) - window + 1)):
                found.setdefault(tuple(w[i : i + window]), set()).add(item)
        self.by_length = {}
        for n in sorted({len(p) for p in found}):
            own = [p for p in found if len(p) == n]
            of = [sorted(found[p]) for p in own]
            self.by_length[n] = (np.array(own, np.int64), np.repeat(np.arange(len(own)), [len(x) for x in of]), np.array([x for y in of for x in y], np.int64))


def index_of(docs: list[list[bytes]]) -> tuple[bytes, Index]:
    """The distinct words of documents, one a line, and the index of their ids."""
    ids: dict[bytes, int] = {}
    text = np.zeros(sum(len(d) + 1 for d in docs), np.int64)
    at = 0
    for d in docs:
        new = set(d).difference(ids)
        ids.update(zip(new, range(len(ids) + 1, len(ids) + 1 + len(new)), strict=True))
        text[at : at + len(d)] = np.fromiter(map(ids.__getitem__, d), np.int64, len(d))
        at += len(d) + 1
    return b"\n".join(ids), Index.of(text, len(ids))


def shard_hits(sizes: np.ndarray, words: bytes, index: Index, p: Phrases) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each document of a shard (of so many words) its spans (start, end) merged, and its items."""
    ends = np.cumsum(sizes + 1)  # behind the separators
    spans, items = [np.zeros((0, 2), np.int64)] * len(sizes), [np.zeros(0, np.int64)] * len(sizes)
    own = np.zeros(len(p.ids) + 1, np.int64)  # ids in this shard of the phrases' words
    for k, w in enumerate(words.split(b"\n") if words else (), 1):
        n = p.ids.get(w)
        if n is not None:
            own[n] = k
    edge, pairs = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64), []
    for length, (phrases, owner, item) in p.by_length.items():
        mine = own[phrases]
        there = np.nonzero((mine > 0).all(axis=1))[0]
        which, lo, hi = index.search(mine[there])
        which, count = there[which], hi - lo
        first = np.searchsorted(owner, np.arange(len(phrases) + 1))
        for part in np.split(np.arange(len(which)), np.nonzero(np.diff(np.cumsum(count) // ROWS))[0] + 1) if len(which) else []:
            total = count[part]
            for begin in range(0, int(total.sum()), ROWS):  # one phrase may itself have very many
                k = np.arange(begin, min(begin + ROWS, int(total.sum())))
                of = np.searchsorted(np.cumsum(total), k, side="right")
                where = index.locate(lo[part][of] + k - np.r_[0, np.cumsum(total)[:-1]][of])
                np.add.at(edge, where, 1)
                np.add.at(edge, where + length, -1)
                seen = np.unique(np.stack([np.searchsorted(ends, where, side="right"), which[part][of]]), axis=1)
                some = first[seen[1] + 1] - first[seen[1]]
                each = np.repeat(first[seen[1]] - np.r_[0, np.cumsum(some)[:-1]], some) + np.arange(some.sum())
                pairs.append(np.unique(np.stack([np.repeat(seen[0], some), item[each]]), axis=1))
    cover = np.diff(np.r_[0, (np.cumsum(edge[:-1]) > 0).astype(np.int8), 0])
    a, b = np.nonzero(cover == 1)[0], np.nonzero(cover == -1)[0]
    doc = np.searchsorted(ends, a, side="right")
    base = ends - sizes - 1
    for d, part in zip(*grouped(doc), strict=True):
        spans[d] = np.stack([a[part], b[part]], axis=1) - base[d]
    both = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
    for d, part in zip(*grouped(both[0]), strict=True):
        items[d] = both[1][part]
    return spans, items


def grouped(sorted_: np.ndarray) -> tuple[list[int], list[slice]]:
    """The distinct values of a sorted array, and where each is."""
    starts = np.nonzero(np.r_[True, np.diff(sorted_) != 0])[0] if len(sorted_) else np.zeros(0, np.int64)
    return sorted_[starts].tolist(), [slice(i, j) for i, j in zip(starts, np.r_[starts[1:], len(sorted_)], strict=False)]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of two lists of spans."""
    s = np.concatenate([a, b])
    s = s[np.argsort(s[:, 0], kind="stable")]
    if not len(s):
        return s
    reach = np.maximum.accumulate(s[:, 1])
    new = np.r_[True, s[1:, 0] > reach[:-1]]
    return np.stack([s[new, 0], reach[np.r_[np.nonzero(new)[0][1:] - 1, len(s) - 1]]], axis=1)


INDEX = "doc_id array<long>, text_key array<long>, sizes array<int>, words binary, index binary"


def build(docs: DataFrame) -> DataFrame:
    """The shards of docs (doc_id, text): a row for each, of INDEX; text_key is the XXH64 of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in (s for batch in batches for s in text_steps(batch, "t")):
            for i, key, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "t")), strict=True):
                held.append((i, key, words(t)))
                size += len(held[-1][2])
                if size >= SHARD_WORDS:
                    yield done(held)
                    held, size = [], 0
        if held:
            yield done(held)

    def done(held: list) -> pa.RecordBatch:
        ids, keys, texts = zip(*held, strict=True)
        vocabulary, index = index_of(list(texts))
        arrays = [pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(keys)], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([vocabulary], pa.binary()), pa.array([index.dump()], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "sizes", "words", "index"])

    return docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("t")).mapInArrow(run, INDEX)


def stored(docs: DataFrame) -> DataFrame:
    """build(), written once to the shared folder and read from there."""
    path = fresh_path(docs.sparkSession, "fmindex")
    build(docs).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, piece, words, n) of benchmark (item_id, text): n words, one space between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in text_steps(batch, "t")):
            out = []
            for item, t in zip(b.column("item_id").to_pylist(), b.column("t").to_pylist(), strict=True):
                w = words(t)
                for k, start in enumerate(range(0, max(1, len(w) - window + 1) if w else 0, PIECE)):
                    own = w[start : start + PIECE + window - 1]
                    out.append((item, k, b" ".join(own), len(own)))
            i, k, w, n = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.int32()), pa.array(w, pa.binary()), pa.array(n, pa.int32())], names=["item_id", "piece", "words", "n"])

    rows = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("binary").alias("t")).distinct()
    return rows.mapInArrow(run, "item_id long, piece int, words binary, n int")


FOUND = "doc_id long, text_key long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>, spans array<long>"


def results(ids: list, keys: list, sizes: list[int], spans: list[np.ndarray], items: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of FOUND."""
    n, hit = np.array(sizes, np.int64), np.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], np.int64)
    text = [",".join(sorted(map(str, i.tolist()))) for i in items]
    arrays = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(n), pa.array(hit), pa.array([len(i) for i in items], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in text], pa.string())]
    arrays += [pa.array((hit > 0) & (SHARE * hit >= n)), pa.array([i.tolist() for i in items], pa.list_(pa.int64())), pa.array([s.ravel().tolist() for s in spans], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in FOUND.split(", ")])


def hits(row: dict, p: Phrases) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Sizes, spans and items of the documents of a stored shard."""
    return row["sizes"], *shard_hits(np.array(row["sizes"], np.int64), row["words"], Index.load(row["index"]), p)


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row of FOUND for each document of an index that build() made, against benchmark (item_id, text).

    items: ids of the items found; spans: start, end, start, end ... of the words to remove, in order, ends exclusive.
    """
    own = cut(pieces(benchmark, window))
    blocks = max(1, -(-(own.agg(F.sum("n")).first()[0] or 0) // block_words))
    if blocks > 1:
        return searched_in_blocks(index, own, blocks, window)
    sent = index.sparkSession.sparkContext.broadcast(Phrases([(r.item_id, bytes(r.words)) for r in own.collect()], window))  # block_words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                yield results(row["doc_id"], row["text_key"], *hits(row, sent.value))

    return index.mapInArrow(run, FOUND)


def searched_in_blocks(index: DataFrame, own: DataFrame, blocks: int, window: int) -> DataFrame:
    """search() with the pieces in blocks: each task has one block and the shards of one of GROUPS groups, one at a time."""
    shards = index.withColumn("shard", F.xxhash64("doc_id", "text_key", "sizes"))
    group = F.pmod(F.col("shard"), F.lit(GROUPS)).cast("int")
    nothing = {"item_id": "long", "item": "binary"}
    left = shards.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), group.alias("group"), F.lit(1).alias("kind"), "shard", "doc_id", "text_key", "sizes", "words", "index", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    block = F.pmod(F.xxhash64("item_id", "piece"), F.lit(blocks)).cast("int")
    right = own.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("group"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("shard"), *(F.lit(None).cast(shards.schema[c].dataType).alias(c) for c in ("doc_id", "text_key", "sizes", "words", "index")), "item_id", F.col("words").alias("item"))
    met = left.unionByName(right).withColumn("pair", F.col("block") * GROUPS + F.col("group")).repartitionById(blocks * GROUPS, F.col("pair")).sortWithinPartitions("pair", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, phrases, first = [], None, False
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                if row["kind"] == 0:
                    asked.append((row["item_id"], row["item"]))
                    continue
                if phrases is None:
                    phrases, first = Phrases(asked, window), row["block"] == 0
                sizes, spans, items = hits(row, phrases)
                # a document is in the first block's rows always, in the others' if they have found something
                some = [d for d in range(len(sizes)) if first or len(items[d])]
                values = [[row[c][d] for d in some] for c in ("doc_id", "text_key", "sizes")]
                arrays = [pa.array([row["shard"]] * len(some), pa.int64()), pa.array(some, pa.int32()), *(pa.array(v, pa.int64()) for v in values), pa.array([spans[d].tobytes() for d in some], pa.binary()), pa.array([items[d].tobytes() for d in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "place", "doc_id", "text_key", "n", "spans", "items"])

    found = met.mapInArrow(run, "shard long, place int, doc_id long, text_key long, n long, spans binary, items binary")
    # by shard and place, which are the same for shards alike in every document: their rows are counted
    gathered = found.groupBy("shard", "place", "doc_id", "text_key", "n").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    copies = shards.groupBy("shard").agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    gathered = gathered.join(copies, "shard").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("doc_id", "text_key", "n", "spans", "items")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {c: b.column(c).to_pylist() for c in b.schema.names}
            spans, items = [], []
            for s, i in zip(rows["spans"], rows["items"], strict=True):
                spans.append(merge(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in s]), np.zeros((0, 2), np.int64)))
                items.append(np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in i])))
            yield results(rows["doc_id"], rows["text_key"], rows["n"], spans, items)

    return gathered.mapInArrow(finish, FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """search() in a new index of docs (doc_id, text)."""
    return search(stored(docs), benchmark, window, block_words)


def cut_spans(text: str, spans: list[int]) -> str:
    """text without the words of the spans and what lies between them."""
    raw = text.encode()
    clean = raw.translate(_CLEAN)
    at, n, edges = 0, 0, []
    for w in clean.split():
        at = clean.index(w, at)
        edges.append((at, at + len(w)))
        at += len(w)
        n += 1
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[last : edges[a][0]])
        last = edges[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


@F.pandas_udf(T.StringType())
def without_spans(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else cut_spans(t, list(s)) for t, s in zip(text, spans, strict=True)], dtype=object)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the spans found cut out of the contaminated texts, and without those of which no word is left; a column n_chars counts what is left.

    A row is known by its id and the XXH64 of its text; what is found depends on the text alone.
    """
    bad = decontaminate(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.when(F.col("n_hit") < F.col("n_words"), F.col("spans")).alias("_spans")).distinct()
    met = docs.join(bounded(cut(bad)), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left")
    left = met.where("_key is null or _spans is not null")
    text = F.when(F.col("_spans").isNotNull(), without_spans("text", "_spans")).otherwise(F.col("text"))
    changed = {"text": text} | ({"n_chars": F.when(F.col("_spans").isNotNull(), F.length("_text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return left.withColumn("_text", text).withColumns(changed | {"text": F.col("_text")}).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ends = F.transform(F.sequence(F.lit(0), F.shiftright(F.size("spans"), 1) - 1), lambda i: F.concat(F.get("spans", 2 * i).cast("string"), F.lit("-"), F.get("spans", 2 * i + 1).cast("string")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.when(F.size("spans") > 0, F.array_join(ends, ",")).otherwise("").alias("spans"))


#: DuckDB SQL for op10_fm_index: every window of every document joined with those of the items.
SQL = f"""
with doc as (
    select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), item as (
    select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where item_id is not null and text is not null
), pane as (
    select distinct item_id, least(len(w), {WINDOW}) as n, w[i : i + least(len(w), {WINDOW}) - 1] as p
    from (select item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) as i from item where len(w) > 0)
), size as (select distinct n from pane), place as (
    select r, n, i, w[i : i + n - 1] as p from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, size where len(w) >= n)
), hit as (select r, n, i, item_id from place join pane using (n, p)),
word as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from (select distinct r, n, i from hit)) group by r),
found as (select r, count(distinct item_id) as n_items, sha256(string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar))) as h from hit group by r),
flag as (select r, k, k - row_number() over (partition by r order by k) as g from (select distinct r, k from (select r, unnest(range(i, i + n)) as k from (select distinct r, n, i from hit)))),
span as (select r, min(k) - 1 as a, max(k) as b from flag group by r, g)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(h, sha256('')) as items_sha256,
    coalesce(n_hit, 0) > 0 and {SHARE} * coalesce(n_hit, 0) >= len(w) as contaminated,
    coalesce((select string_agg(a || '-' || b, ',' order by a) from span where span.r = doc.r), '') as spans
from doc left join word using (r) left join found using (r)
"""
