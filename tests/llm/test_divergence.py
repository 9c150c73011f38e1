import re
from collections import Counter

import numpy as np
import pytest

from quirespark.llm import divergence

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, term string, place int, size long"


def expected(rows, top=divergence.TOP):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))) for _, text, lang, source, *_ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= 3)
        count = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= 3) for s in {d[1] for d in own}}
        count[None] = sum(count.values(), Counter())
        v = len(kept)
        p = {s: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + v) for t in kept} for s, c in count.items()}
        for s in count.keys() - {None}:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in count.keys() - {None, s}]
            terms = [(-((p[s][t] - p[None][t]) ** 2 // p[None][t]), t.encode()) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)}
    return out


def found(spark, small, rows):
    folder = small(documents=([(*r, 1, "x", 2, 3) for r in rows], DOCUMENTS))
    df = divergence.op11_run_columns(spark, folder)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(df.dtypes)["value"] == "bigint"
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus():
    rng = np.random.default_rng(1)
    words = ["Wort", "été", "b", "ß", "the", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8))]
    rows = [(i, " ".join(rng.choice(words[: 5 + 9 * (i % 7)], rng.integers(0, 30))) + " 12,_x", "ab"[i % 2], f"s{i % 11}") for i in range(150)]
    return rows + [(900, None, "a", None), (901, "", None, "s1"), (902, "12 34", None, "s2"), (None, "lone words", "c", "s1"), (904, "lone", "c", ""), rows[3], rows[3]]


def test_equals_the_definition(spark, small):
    rows = corpus()
    assert found(spark, small, rows) == expected(rows)


def test_more_sources_than_a_tile_and_terms_than_a_block(spark, small, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = corpus()
        assert found(spark, small, rows) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ties_of_values_go_by_the_bytes_of_the_item(spark, small):
    rows = [(i, "same words here", "a", s) for i, s in enumerate(["z", "B", "a", "é", ""] * 3)]
    got = found(spark, small, rows)
    assert got == expected(rows)
    assert [r[3] for r in sorted(got, key=lambda r: r[5]) if r[1] == "z" and r[2] == "pair"] == ["", "B", "a", "é"]


def test_no_documents(spark, small):
    assert found(spark, small, []) == set()


def test_terms_are_given_to_a_rank(spark, small):
    rows = [(i, " ".join(f"t{chr(97 + k)}{chr(97 + j)}" for k in range(9) for j in range(26)) if i % 2 else "other", "a", f"s{i % 2}") for i in range(8)]
    got = found(spark, small, rows)
    assert got == expected(rows) and max(r[5] for r in got if r[2] == "term") == 200


@pytest.mark.parametrize("whole", [10**12 + 7, 10**13])
def test_shares_of_counts_beyond_64_bits(whole):
    n = np.array([0, 5, 10**12, 5])
    assert divergence.shares(n, whole).tolist() == [1 + 10**9 * (int(x) + 1) // whole for x in n]
