import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quirespark.llm import neardup

from .conftest import DOCUMENTS


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_pairs(texts, least=0.8):
    sets = {i: plain_set(t) for i, t in texts.items()}
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 5 * least * len(a | b):
                yield i, j


def plain_components(texts):
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in plain_pairs(texts):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in texts}


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.getrandbits(30)}"
    return words


def corpus(seed, groups):
    rng, texts = random.Random(seed), {}
    for _ in range(groups):
        n = rng.choice([12, 64, 100, 300])
        base = [f"word{rng.randrange(5000)}" for _ in range(n)]
        for k in (0, 0, 1, max(1, n // 60), n // 45, n // 20):
            texts[len(texts)] = " ".join(edited(rng, base, k))
    return texts


def test_stage_against_brute_force_jaccard(spark, small):
    texts = corpus(1, 40) | {900: "Solo text", 901: "solo  TEXT", 902: "", 903: None, 904: "solo text too"}
    where = small(documents=([(i, t, "en", "s", 0) for i, t in texts.items()], DOCUMENTS))
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, where).collect()}
    want = plain_components(texts)
    assert sum(plain_set(texts[i]) != plain_set(texts[j]) for i, j in plain_pairs(texts)) > 100
    assert kept == {i for i, r in want.items() if i == r}


def test_blocks_give_the_same_components(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    texts = {i: " ".join(edited(rng, base, rng.choice([1, 2, 4, 8]))) for i in range(60)}
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), block=3000).collect()
    assert {r.doc_id: r.component_id for r in got} == plain_components(texts)


def test_recall_of_the_fingerprints_at_the_threshold():
    rng, met, n = np.random.default_rng(3), 0, 400
    for _ in range(n):
        s = rng.integers(0, 1 << 64, 1000, np.uint64)
        a, b = np.sort(s[:900]), np.sort(s[100:])  # 800 of 1,000
        met += bool((neardup.keys(a) == neardup.keys(b)).any())
    assert met / n >= 0.99


def test_rows_are_judged_by_their_own_text(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long, "a"), (2, long, "b"), (2, "something else", "c"), (3, "something else", "d"), (None, long, "e"), (None, "only this", "f"), (None, "only this", "g"), (4, None, "h"), (5, "", "i")]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, component_id string"))
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted(r.component_id for r in kept.collect()) == ["a", "c", "f", "g", "h"]


def test_one_text_very_often(spark):
    """A hundred thousand copies are one set before its keys are dealt."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).union(spark.createDataFrame([(200_000, text + " more"), (200_001, "something else entirely of its own")], "doc_id long, text string"))
    kept = neardup.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 200_001]


def test_candidates_come_from_the_covering_tables_too(spark):
    """Sets tied by SimHashes of three differing bits at most, whatever their other fingerprints are; the empty set by none."""
    bits = 0x0123456789ABCDEF
    rows = [(1, 9, bits), (2, 9, bits ^ 0x8001), (3, 9, bits ^ 0xF0), (4, 9, bits), (2, 9, bits ^ 0x8000), (5, 9, -bits), (6, 0, 0), (7, 9, 1), (8, 9, 1)]
    ties = neardup.near_sets(spark.createDataFrame(rows, "set_id long, n long, fp long"))
    assert {(r.node, r.root) for r in neardup.components(ties).collect()} == {(1, 1), (2, 1), (4, 1), (7, 7), (8, 7)}
    found = neardup.sketches(spark.createDataFrame([(1, "a b c d e f a b c d e f g"), (2, None)], "doc_id long, text string")).collect()
    assert [r.fp for r in sorted(found)] == neardup.of_hashes([neardup.hashes(b"a b c d e f a b c d e f g", 5), (0, b"")]).tolist()
