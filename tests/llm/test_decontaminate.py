import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.llm import decontaminate as D
from quirespark.llm.fmindex import Index, suffix_array

from .conftest import DOCUMENTS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(docs, bench, window=13):
    items = {}
    for i, t in bench:
        w = split(t)
        if i is not None and w:
            items.setdefault(i, set()).update(tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1)))
    out = []
    for i, t in docs:
        w = split(t)
        hit, found = set(), []
        for item, windows in items.items():
            seen = False
            for p in windows:
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k : k + len(p)]) == p:
                        hit.update(range(k, k + len(p)))
                        seen = True
            if seen:
                found.append(str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.integers(1, 4), st.integers(0, 10**6))
def test_index_finds_what_a_scan_finds(ids, length, seed):
    text = np.array([*ids, 0], np.int64)
    suffixes = suffix_array(text)
    assert sorted(suffixes.tolist()) == list(range(len(text)))
    index = Index.load(Index.of(text, 4).dump())
    rng = np.random.default_rng(seed)
    phrases = rng.integers(1, 5, (20, length))
    which, lo, hi = index.search(phrases)
    got = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi, strict=True)}
    for i, p in enumerate(phrases):
        want = [k for k in range(len(text) - length + 1) if (text[k : k + length] == p).all()]
        assert got.get(i, []) == want


def data():
    rng = random.Random(5)
    common = [f"w{i}" for i in range(12)]
    bench = [(i, " ".join(rng.choice(common) for _ in range(rng.randint(13, 30)))) for i in range(20)]
    bench += [(100, "Only Three Words"), (101, "été"), (102, None), (103, "..."), (None, "w1 w2"), (2, "another row of item two with the same id and its own thirteen words here"), (10, bench[3][1])]
    docs = []
    for i in range(60):
        w = [rng.choice([*common, "zzz"]) for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            w[10:10] = bench[i % 20][1].split()
        if i % 7 == 0:
            w += ["only", "THREE", "words"]
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "été,été"), (203, "x\n" * 5000 + bench[0][1]), (203, "x\n" * 5000 + bench[0][1]), (None, bench[1][1])]
    return docs, bench


@pytest.mark.parametrize("block", [D.BLOCK_WORDS, 30])
def test_against_brute_force(spark, block):
    docs, bench = data()
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), block_words=block).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got))) == sorted(map(str, plain(docs, bench)))
    texts = dict(docs)
    for r in got:
        if r.doc_id is not None and texts[r.doc_id]:
            assert split(D.cut_spans(texts[r.doc_id], r.spans)) == [w for k, w in enumerate(split(texts[r.doc_id])) if not any(a <= k < b for a, b in zip(r.spans[::2], r.spans[1::2], strict=True))]


def test_one_index_for_any_benchmark(spark, tmp_path):
    """A stored index answers benchmarks that it was not built for; a large item is cut to pieces."""
    docs, bench = data()
    D.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    other = [(7, "zzz"), (8, " ".join(docs[5][1].split()[:40])), (9, docs[8][1]), (9, docs[8][1])]
    for items in (bench, other, []):
        got = D.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert sorted(map(str, ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got))) == sorted(map(str, plain(docs, items)))


def test_pieces_hold_every_window(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 7)
    w = [f"w{i}" for i in range(50)]
    got = D.pieces(spark.createDataFrame([(1, " ".join(w)), (1, " ".join(w)), (2, "a b"), (3, "."), (4, " ".join(w[:13]))], "item_id long, text string"), 13).collect()
    windows = {(r.item_id, tuple(p[i : i + 13])) for r in got for p in [bytes(r.words).split()] for i in range(max(1, len(p) - 12))}
    assert windows == {(1, tuple(x.encode() for x in w[i : i + 13])) for i in range(38)} | {(2, (b"a", b"b")), (4, tuple(x.encode() for x in w[:13]))}
    assert all(r.n <= 19 and r.n == len(bytes(r.words).split()) for r in got) and len(got) == 6 + 2


def test_clean(spark):
    docs, bench = data()
    rows = [(i, t, len(t or ""), "x", k) for k, (i, t) in enumerate(docs)] + [(300, bench[0][1], 1, "x", 900), (None, "fine", 4, "x", 901), (300, "fine too", 8, "x", 902)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans string, row int")
    out = D.clean(df, spark.createDataFrame(bench, "item_id long, text string"))
    assert out.dtypes == df.dtypes
    got = {r.row: r for r in out.collect()}
    for (i, t, n, _, row), (*_, hit, _, _, bad), words in zip(rows, plain([r[:2] for r in rows], bench), (split(r[1]) for r in rows), strict=True):
        if bad and hit == len(words):
            assert row not in got
        elif bad:
            assert len(split(got[row].text)) == len(words) - hit and got[row].n_chars == len(got[row].text)
        else:
            assert (got[row].doc_id, got[row].text, got[row].n_chars) == (i, t, n)


def test_query_and_empty_tables(spark, small):
    docs, bench = data()
    rows = [(i, t, "en", "s", 0) for i, t in docs]
    where = small(documents=(rows, DOCUMENTS), benchmark=(bench, "item_id long, text string"))
    got = D.op10_fm_index(spark, where)
    assert sorted(str(tuple(r)[:6]) for r in got.collect()) == sorted(map(str, plain(docs, bench)))
    sql = D.SQL.replace("from documents", f"from '{where}/documents.parquet/*.parquet'").replace("from benchmark", f"from '{where}/benchmark.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, duckdb.sql(sql).fetchall()))
    where = small(documents=([], DOCUMENTS), benchmark=(bench, "item_id long, text string"))
    assert D.op10_fm_index(spark, where).count() == 0
    where = small(documents=(rows, DOCUMENTS), benchmark=([], "item_id long, text string"))
    assert {r.n_hit for r in D.op10_fm_index(spark, where).collect()} == {0}
