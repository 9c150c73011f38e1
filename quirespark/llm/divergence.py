"""Operator 11: how the sources of a language differ in their words, by run-length columns.

The vocabulary of a language is put in an order that brings terms of equal counts together: by the first source that has the
term, its count there, and a digest of its counts everywhere. It is cut into blocks of some thousand terms. In
each block a source is a column of counts, kept as runs of equal counts; a source that has none of the terms is one run.

For each pair of sources and each block the boundaries of the two columns' runs are intersected; between two boundaries both
counts are constant, so f is computed once and multiplied by the length. The sums of the blocks add up to the pair's. A task
holds TILE + TILE columns of one block, so neither many terms nor many sources make it larger.

p = 1 + floor(1,000,000,000 (count + 1) / (N + V)) and f(p, q) = floor((p - q) ** 2 / q) are computed in whole numbers. The
p of a source and a run's length times f stay below 2 ** 63, since the p add up to 10 ** 9 + V at most.

Defined cases: null text, lang and source are empty; a text without letters still gives its source a row for each pair; a language without
kept terms has the value 0 for all pairs and no terms; repeated rows are documents of their own; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, cut, table, text_steps

#: Documents of a language that a term must be in to be kept.
LEAST = 3
UNIT = 1_000_000_000
#: Ranks of terms that are given for a source.
TOP = 200
#: Columns on each side of a comparison.
TILE = 64
#: Terms counted by a task before it hands counts on.
HELD = 500_000

_LETTER = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_CLEAN = bytes((c | 0x20 if c < 0x80 else c) if c in _LETTER else 0x20 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each source; term null: only that the source occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in (s for batch in batches for s in text_steps(batch, "t")):
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "t")), strict=True):
                n, docs_ = held.setdefault((lang, source), (Counter(), Counter()))
                words = Counter(text.translate(_CLEAN).split())
                n.update(words)
                docs_.update(words.keys())
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from done(held)
                held = {}
        yield from done(held)

    def done(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs_) in held.items():
            terms = [None, *n]
            counts = [pa.array([0, *x.values()], pa.int64()) for x in (n, docs_)]
            same = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(terms, pa.binary()), *counts], names=["lang", "source", "term", "n", "docs"])

    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    counted = texts.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, whole: Column) -> Column:
    """p of a count, whole being N + V."""
    return F.expr("1").cast("long") + F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), whole.cast("decimal(20,0)"))


def shares(n: np.ndarray, whole: int) -> np.ndarray:
    """p of counts, one division for each distinct one."""
    distinct, back = np.unique(n, return_inverse=True)
    return np.array([1 + UNIT * (x + 1) // whole for x in distinct.tolist()], np.int64)[back]


RUNS = "lang string, block long, terms long, place int, ends binary, counts binary"


def run_columns(terms: DataFrame) -> DataFrame:
    """Rows of RUNS of terms (lang, term, first, first_n, mix, entries (place, n)): in each block of terms, for each source that has some of them, where its runs end and their counts."""
    order = ["lang", "first", "first_n", "mix", "term"]
    dealt = terms.repartitionByRange(*order).sortWithinPartitions(*order)
    block = F.col("lang"), F.col("entries.place").alias("places"), F.col("entries.n").alias("n"), F.spark_partition_id().alias("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)
            edges = [0, *(np.nonzero(np.diff(code))[0] + 1).tolist(), b.num_rows] if b.num_rows else []
            for i, j in zip(edges, edges[1:], strict=False):
                part = b.slice(i, j - i)
                yield block_runs(part, langs.dictionary[int(code[i])].as_py(), (part.column("part")[0].as_py() << 32) + k)
                k += 1

    return dealt.select(*block).mapInArrow(run, RUNS)


def block_runs(terms: pa.RecordBatch, lang: str, block: int) -> pa.RecordBatch:
    places, counts = terms.column("places"), terms.column("n")
    size = terms.num_rows
    row = np.repeat(np.arange(size), np.diff(places.offsets.to_numpy()))
    place, n = (x.flatten().to_numpy(zero_copy_only=False) for x in (places, counts))
    by = np.lexsort((row, place))
    own, starts = np.unique(place[by], return_index=True)
    ends, values = [], []
    for part in np.split(by, starts[1:]):
        column = np.zeros(size, np.int64)
        column[row[part]] = n[part]
        last = np.r_[np.nonzero(np.diff(column))[0], size - 1]
        ends.append((last + 1).astype(np.int64).tobytes())
        values.append(column[last].tobytes())
    same = [pa.array([lang] * len(own), pa.string()), *(pa.array([x] * len(own), pa.int64()) for x in (block, size))]
    return pa.RecordBatch.from_arrays([*same, pa.array(own, pa.int32()), pa.array(ends, pa.binary()), pa.array(values, pa.binary())], names=["lang", "block", "terms", "place", "ends", "counts"])


def pair_sums(columns: pa.Table) -> pa.Table:
    """Both ways, the summed f of each pair of a left and a right column (or of two left ones, if left and right tile are one) of one block."""
    rows = columns.sort_by("place").to_pylist()
    left_tile, right_tile = rows[0]["left"], rows[0]["right"]
    for r in rows:
        r["ends"] = np.frombuffer(r["ends"], np.int64) if r["ends"] is not None else np.array([r["terms"]])
        r["p"] = shares(np.frombuffer(r["counts"], np.int64) if r["counts"] is not None else np.zeros(1, np.int64), r["whole"])
    left, right = ([r for r in rows if r["tile"] == t] for t in (left_tile, right_tile))
    out: dict[str, list] = {"place": [], "other": [], "value": []}
    for i, a in enumerate(left):
        for b in right[i + 1 :] if left_tile == right_tile else right:
            ends = np.union1d(a["ends"], b["ends"])
            length = np.diff(ends, prepend=0)
            p, q = (x["p"][np.searchsorted(x["ends"], ends)] for x in (a, b))
            square = (p - q) ** 2
            for x, y, divisor in ((a, b, q), (b, a, p)):
                out["place"].append(x["place"])
                out["other"].append(y["place"])
                out["value"].append(int((square // divisor * length).sum()))
    lang = pa.array([rows[0]["lang"]] * len(out["place"]), pa.string())
    return pa.table([lang, pa.array(out["place"], pa.int32()), pa.array(out["other"], pa.int32()), pa.array(out["value"], pa.int64())], names=["lang", "place", "other", "value"])


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language the others by divergence (part pair) and the `top` terms it is marked by (part term)."""
    counted = cut(term_counts(docs))
    sources = counted.where("term is null").select("lang", "source")
    kept = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("_docs")).where(F.col("_docs") >= least).select("lang", "term", "all_n")
    words = cut(counted.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    sizes = words.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = words.groupBy("lang", "term").agg(F.first("all_n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count(F.lit(1)).alias("v"))
    # the sources of a language by size, the largest first, with N + V of each and of the language
    known = sources.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("size"), "source"))
    whole = {"whole": F.col("size") + F.col("v"), "lang_whole": F.col("lang_size") + F.col("v")}
    known = cut(known.withColumn("place", place).withColumns(whole).select("lang", "source", "place", "v", *whole))
    one = bounded(known)

    of_term = words.join(one, ["lang", "source"])
    entry = F.struct("place", "n")
    mix = F.bit_xor(F.xxhash64("place", "n"))
    terms = of_term.groupBy("lang", "term").agg(F.min(entry).alias("_first"), mix.alias("mix"), F.collect_list(entry).alias("entries"))
    runs = cut(run_columns(terms.select("lang", "term", F.col("_first.place").alias("first"), F.col("_first.n").alias("first_n"), "mix", "entries")))
    in_block = runs.select("lang", "block", "terms").distinct().join(one.select("lang", "place", "whole"), "lang")
    columns = in_block.join(runs.drop("terms"), ["lang", "block", "place"], "left").withColumn("tile", F.expr(f"place div {TILE}").cast("int"))
    tiles = one.groupBy("lang").agg(F.expr(f"max(place) div {TILE}").cast("int").alias("_tiles"))
    met = columns.join(bounded(tiles), "lang").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles"))))
    met = met.withColumns({"left": F.least("tile", "_other"), "right": F.greatest("tile", "_other")}).drop("_tiles", "_other")
    summed = met.groupBy("lang", "block", "left", "right").applyInArrow(pair_sums, "lang string, place int, other int, value long").groupBy("lang", "place", "other").agg(F.sum("value").alias("value"))
    names = [one.select("lang", F.col("place").alias(key), F.col("source").alias(name)) for key, name in (("place", "source"), ("other", "item"))]
    pairs = summed.join(names[0], ["lang", "place"]).join(names[1], ["lang", "other"]).select("lang", "source", "item", "value")
    bare = known.where("v = 0").select("lang", "source")
    pairs = pairs.unionByName(bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long")))

    p, q = share(F.col("n"), F.col("whole")), share(F.col("all_n"), F.col("lang_whole"))
    marked = of_term.withColumns({"p": p, "q": q}).where("p > q")
    f = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    marked = marked.select("lang", "source", F.col("term").cast("string").alias("item"), f.alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    shown = ("lang", "source", "part", "item", "value", "rank")
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", rank).select(*shown)
    return pairs.unionByName(marked.withColumn("part", F.lit("term")).withColumn("rank", rank).where(F.col("rank") <= top).select(*shown))


def op11_run_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


#: DuckDB SQL for op11_run_columns: every pair of sources meets in every kept term.
SQL = f"""
with doc as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents
), word as (select r, lang, source, unnest(w) as term from doc),
kept as (select lang, term, count(*)::hugeint as all_n from word group by all having count(distinct r) >= {LEAST}),
src as (select distinct lang, source from doc),
lang_size as (select lang, sum(all_n)::hugeint as size, count(*)::hugeint as v from kept group by lang),
n as (select lang, source, term, count(*)::hugeint as n from word join kept using (lang, term) group by all),
src_size as (select lang, source, sum(n)::hugeint as size from n group by all),
grid as (
    select s.lang, s.source, k.term, coalesce(n.n, 0) as n, 1 + {UNIT}::hugeint * (coalesce(n.n, 0) + 1) // (coalesce(z.size, 0) + l.v) as p, 1 + {UNIT}::hugeint * (k.all_n + 1) // (l.size + l.v) as q
    from src s join kept k using (lang) join lang_size l using (lang) left join src_size z using (lang, source) left join n on n.lang = s.lang and n.source = s.source and n.term = k.term
), pair as (
    select s.lang, s.source, o.source as item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0)::bigint as value
    from src s join src o on o.lang = s.lang and o.source <> s.source left join grid a on a.lang = s.lang and a.source = s.source left join grid b on b.lang = o.lang and b.source = o.source and b.term = a.term group by all
), term as (select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from grid where n > 0 and p > q),
ranked as (
    select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::integer as rank from pair
    union all
    select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::integer as rank from term) where rank <= {TOP}
) select * from ranked
"""
