"""Fuzzy search of many terms over a stored vocabulary: each distinct word is compared once, however often it stands in the texts.

build() writes an inverted index: a row for each word and block of documents. Blocks are dealt by the hash of the id, so a word that is in
every document is as many rows as there are blocks. Rows are dealt by the hash of word and block and lie by length of word in each file, so that the
bounds of a search reach the scan as filters on `length`.

search() compares terms with the vocabulary. Lengths and letters in common bound the ratio from above; both bounds
are built-in expressions. The words that are left meet the terms in Python, without documents or texts; those that match
are joined with their blocks. A term of several words can also be like a run of as many words, which a vocabulary
does not hold: such runs are taken from the texts by built-in expressions and bounded in the same way, where the texts lie.

The result is that of fuzzy.fuzzy_match() for every term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.text import fragments, normalize, normalized, words
from .fuzzy import THRESHOLD, similar_to

#: Documents in a block of the index.
BLOCK = 100_000
#: Least tasks that gather the index, for each block.
TASKS = 10
#: Words or runs that a task remembers for each term.
REMEMBERED = 20_000


def build(df: DataFrame, key: str, text: str, path: str, blocks: int | None = None) -> DataFrame:
    """Writes the index (word, length, block, ids) of df (key, text) and returns it. A text that is not empty also has the empty word.

    blocks: as many as make BLOCK documents each, if not given. Null ids are left out.
    """
    texts = df.where(F.col(key).isNotNull() & F.coalesce(F.col(text) != "", F.lit(False))).select(F.col(key).alias("id"), F.col(text).alias("text"))
    n = blocks or max(1, -(-texts.count() // BLOCK))
    word = F.explode(F.array_append(F.array_distinct(words(normalize(F.col("text")))), F.lit(""))).alias("word")
    rows = texts.select("id", word).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    # most words are rare, so ids are gathered where a word's block is, not before; ranges of length would put the common words, which are short, into one task
    dealt = rows.repartition(max(TASKS * n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "word", "block")
    index = dealt.groupBy("word", "block").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("length", F.length("word"))
    index.sortWithinPartitions("length", "word", "block").select("word", "length", "block", "ids").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def pairs(vocabulary: DataFrame, terms: list[str], threshold: float) -> DataFrame:
    """vocabulary (word, length, more) with the normalized terms that the bounds let each word meet, and whether it holds them.

    All words hold the empty term; as every text that is not empty has the empty word, that one stands for them.
    """
    least = threshold / (2 - threshold)
    asked = [(t, len(t), -(-len(t) * 7 // 10), list(Counter(t).items())) for t in terms]
    shortest = min(min(n for _, n, *_ in asked), min(int(n * least - 1e-9) for _, n, *_ in asked)) if asked else 0
    schema = "array<struct<term:string,n:int,short:int,letters:array<struct<c:string,k:int>>>>"
    table = vocabulary.sparkSession.createDataFrame([(asked,)], f"asked {schema}")
    met = vocabulary.where(F.col("length") >= shortest).crossJoin(F.broadcast(table)).select(*vocabulary.columns, F.explode("asked").alias("t"))
    common = F.aggregate("t.letters", F.lit(0), lambda s, x: s + F.least(x["k"], F.col("length") - F.length(F.replace(F.col("word"), x["c"], F.lit("")))))
    needed = threshold * (F.col("t.n") + F.col("length")) / 2 - 1e-9
    holds = F.contains(F.col("word"), F.col("t.term")) & ((F.col("t.n") > 0) | (F.col("length") == 0))
    long = F.col("length") >= F.col("t.short")
    near = (F.col("t.n") > 2) & long & (F.least("t.n", "length") >= needed) & (common >= needed)
    return met.where(holds | near).select("t.term", *vocabulary.columns, holds.alias("holds"))


def like(term: Column, word: Column, holds: Column, threshold: float) -> Column:
    """Whether a word holds a term or the ratio of the two reaches the threshold; each term's letters are counted once a task."""

    @pandas_udf(T.BooleanType())
    def similar(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tests = {}
        for terms, words_, holds_ in batches:
            tests |= {t: similar_to(t, threshold, REMEMBERED) for t in terms.unique() if t not in tests}
            yield pd.Series([h or tests[t](w) for t, w, h in zip(terms, words_, holds_, strict=True)], dtype=bool)

    return similar(term, word, holds)


def matching(found: DataFrame, threshold: float) -> DataFrame:
    """The rows of pairs() that match."""
    return found.where(like(F.col("term"), F.col("word"), F.col("holds"), threshold)).drop("holds")


def search(index: DataFrame, terms: list[str], texts: DataFrame | None = None, key: str = "id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(term, id) of all documents of an index that match a term (as given; empty ones match nothing).

    texts (key, text), the documents that the index was built of, are needed for terms of several words only.
    """
    spark = index.sparkSession
    own = {t: normalized(t) for t in terms if t}
    several = sorted({n for n in own.values() if " " in n})
    if several and texts is None:
        raise ValueError(f"terms of several words need the texts: {several}")
    if not own:
        return spark.createDataFrame([], f"term string, id {dict(index.select(F.explode('ids').alias('i')).dtypes)['i']}")
    vocabulary = index.select("word", "length").distinct()
    hit = matching(pairs(vocabulary, sorted(set(own.values())), threshold), threshold).select("term", "word")
    found = hit.join(index, "word").select("term", F.explode("ids").alias("id"))
    for size in sorted({n.count(" ") + 1 for n in several}):
        found = found.unionByName(of_runs(texts.select(F.col(key).alias("id"), F.col(text).alias("text")), [n for n in several if n.count(" ") + 1 == size], size, threshold))
    found = found.distinct()
    names = spark.createDataFrame(list(own.items()), "asked string, term string")
    return found.join(F.broadcast(names), "term").select(F.col("asked").alias("term"), "id")


def of_runs(texts: DataFrame, terms: list[str], size: int, threshold: float) -> DataFrame:
    """(term, id) of texts (id, text) with a run of `size` words that holds a normalized term of `size` words or is like it.

    A text that holds a term holds it within such a run. A run that occurs again in its text is met again, as most are told apart before any are compared.
    """
    # as an element of an array each text is normalized once
    of_text = F.transform(F.array(normalize(F.col("text"))), lambda n: fragments(n, size))[0]
    runs = texts.where("text <> '' and id is not null").select("id", F.explode(of_text).alias("word")).withColumn("length", F.length("word"))
    return matching(pairs(runs, terms, threshold).distinct(), threshold).select("term", "id")
