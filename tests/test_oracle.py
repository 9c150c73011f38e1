"""Every query with SQL against DuckDB on the same tables, row by row."""

import math
import re
from collections import Counter
from difflib import SequenceMatcher
from functools import cache
from hashlib import md5
from pathlib import Path

import duckdb
import pytest

from quirespark.functions import text as X
from quirespark.operators.fuzzy import fuzzy_match
from quirespark.plans.catalog import ORACLE, QUERIES
from quirespark.sources.schema import document

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = Counter(tuple(norm(v) for v in r) for r in got.select(*(f"`{c}`" for c in columns)).collect())
    assert rows == Counter(tuple(norm(v) for v in r) for r in want.fetchall())


def texts_of(spark):
    return {r.id: r for r in document(spark, SF).select("id", "text", "original_filename", "sygnatura", "doc_type").collect()}


def normal(t):
    return " ".join(re.sub(r"[^\w\s]", " ", (t or "").lower().translate(str.maketrans(X.FOLDED, X.PLAIN))).split())


def test_fuzzy_search_is_its_definition(spark):
    """Exact tests first, then any word that is not too short and has a ratio of 0.7 to the term."""
    ratio = cache(lambda w: SequenceMatcher(None, "pathetc", w).ratio() >= 0.7)
    near = lambda t: bool(t) and ("pathetc" in normal(t) or any(len(w) >= 0.7 * 7 and ratio(w) for w in set(normal(t).split())))
    want = {}
    for i, r in texts_of(spark).items():
        meta = " ".join(x for x in (r.original_filename, r.sygnatura, r.doc_type) if x).lower()
        tags = ["metadata" if "pathetc" in meta else "fuzzy_metadata" if near(meta) else None, "content" if "pathetc" in r.text.lower() else "fuzzy_content" if near(r.text) else None]
        if any(tags):
            want[i] = ",".join(filter(None, tags))
    assert want and {r.id: r.matches for r in QUERIES["doc_search_fuzzy"](spark, SF).collect()} == want


def test_vocabulary_search_is_the_fuzzy_search_of_each_term(spark):
    docs = document(spark, SF)
    got = {}
    for r in QUERIES["vocabulary_search"](spark, SF).collect():
        got.setdefault(r.term, set()).add(r.id)
    for term in ("pathetc", "Theory!", "understnad", "et", "verfahren", "les", "zzzzzz", "of teh", "!!"):
        assert got.get(term, set()) == {r.id for r in fuzzy_match(docs, "id", "text", term).where("matched").collect()}, term


def score(t):
    words = t.split()
    if len(t) < 10:
        return 0.0
    mean = sum(map(len, words)) / len(words) if words else None
    return max(0.0, 0.9 - min(0.3, sum(t.count(c) for c in "?\ufffd") / len(t) * 5) - (0.1 if mean is not None and (mean < 2 or mean > 15) else 0) - (0.2 if len(t) < 100 else 0))


def test_recognized_documents_are_their_pages_in_order(spark):
    got = {r.doc_id: r for r in QUERIES["recognized_documents"](spark, SF).collect()}
    texts = texts_of(spark)
    assert set(got) == set(texts)
    for i, r in texts.items():
        pages = [X.clean(p) for p in r.text.split("\n")]
        whole = "\n\n".join(f"=== Strona {n} ===\n\n{p}" for n, p in enumerate(pages, 1)).strip()
        assert got[i].text_md5 == md5(whole.encode()).hexdigest() and got[i].pages == len(pages)
        assert abs(got[i].confidence - sum(map(score, pages)) / len(pages)) < 1e-5


def test_clean_texts_keep_their_words(spark):
    """Folding lines moves white space only, but for the spacing of articles; a clean text stays as it is."""
    texts = texts_of(spark)
    for r in QUERIES["clean_ocr_text"](spark, SF).collect():
        assert r.clean == X.clean(texts[r.id].text) == X.clean(r.clean)
        assert r.clean.split() == re.sub(r"§\s+(\d+)", r"§ \1", re.sub(r"([aA])rt\s+(\d+)", r"\1rt. \2", texts[r.id].text)).split()


def test_every_query_has_sql_or_a_test_here():
    assert set(QUERIES) - set(ORACLE) == {"doc_search_fuzzy", "vocabulary_search", "recognized_documents", "clean_ocr_text"}
