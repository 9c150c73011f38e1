import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.llm import toxicity as T
from quirespark.llm.common import table

from .conftest import DOCUMENTS


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


TERMS = [("abcab", True), ("bcabca", True), ("cab", True), ("aacc", False), ("ccccc", True), ("abcabc", True), ("bbaabb", False), ("ab", True)]


def plain_match(word, terms=TERMS):
    """By definition: fewest edits, then whole words, then the longest, then the first."""
    found = []
    for k, (t, whole) in enumerate(terms):
        for e in {distance(word, t)} if whole else {distance(word[:n], t) for n in range(1, len(word) + 1)}:
            if e == 0 or (e <= T.EDITS and len(t) >= T.FUZZY[not whole]):
                found.append((e, not whole, -len(t), k))
    return (min(found)[3], min(found)[0]) if found else None


@settings(max_examples=500, deadline=None)
@given(st.text("abc", max_size=9))
def test_automaton_is_the_edit_distance(word):
    assert T.Automaton(TERMS).match(word) == plain_match(word)


def plain_features(text, m):
    """The features by definition, without automaton, trie or cache."""
    tokens, inside, opened = T._TOKEN.findall(text.lower()), set(), None
    for i, t in enumerate(tokens):
        if t == "\n":
            opened = None
        elif opened is not None and t in T._CLOSES[tokens[opened]]:
            inside |= set(range(opened, i))
            opened = None
        elif opened is None and t in T._CLOSES:
            opened = i
    words = [(i, t) for i, t in enumerate(tokens) if t not in T._MARKS]
    abuse = quoted = strongest = 0.0
    for n, (i, t) in enumerate(words):
        hit = plain_match(t, m.terms)
        if hit:
            cues = {"<" + w for _, w in words[max(0, n - T.CONTEXT) : n]} | {">" + w for _, w in words[n + 1 : n + 1 + T.CONTEXT]} | ({T.QUOTED} if i in inside else set())
            w = m.weights[hit[0]][hit[1] > 0]
            quoted += w if i in inside else 0
            w *= 2 / (1 + np.exp(-sum(m.cues.get(c, 0.0) for c in cues)))
            abuse, strongest = abuse + w, max(strongest, w)
    return [np.log1p(abuse), np.log1p(quoted), np.log1p(100 * abuse / max(1, len(words))), strongest]


def test_query_against_brute_force(spark, small):
    """Every score of the query is that of the definition, given the model that it learns."""
    rng = random.Random(6)
    words = ["the", "of", "and", "tree", "house", "river", "he", "said", "you", "\n", '"', "'", "«", "»"]
    bad = ["scoundrel", "rotter", "rotten", "rott", "scoundrell", "knave", "knav", "you"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60))) + (f" {rng.choice(bad)} " if i % 3 == 0 else " ") + " ".join(rng.choice(words) for _ in range(20)), "en", "s", 0) for i in range(300)] + [(900, None, "en", "s", 0)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(0, 300, 2)]
    folder = small(documents=(rows, DOCUMENTS), labels=(labels, "doc_id long, quality int, toxic int"))
    m = T.learn(table(spark, folder, "documents"), table(spark, folder, "labels"))
    assert m.terms and m.cues
    out = {r.doc_id: r for r in T.op8_levenshtein_trie(spark, folder).collect()}
    for i, text, *_ in rows:
        x = np.array(plain_features(text or "", m))
        want = 1 / (1 + np.exp(-(x @ m.coef + m.bias)))
        assert abs(out[i].score - want) < 1e-9 and out[i].predicted == (want >= 0.5) and out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_quotation_is_not_abuse():
    r = T.Reader(T.Model([("idiot", True)], [(4.0, 2.0)], dict(T.PRIORS)))
    names = dict(zip(T.FEATURES, range(9), strict=False))
    abuse = r.features("you are an idiot and nothing else")
    quote = r.features('he wrote "such an idiot" in his letter')
    single = r.features("he wrote 'such an idiot' in his letter")
    between = r.features('"Hello," she said. You are an idiot. "Bye," he said.')
    open_ = r.features('he is 6\'2" tall and an idiot\nand "more" besides')
    typo = r.features("what an idiiot, don't you think")
    assert abuse[names["abuse"]] > 2 * quote[names["abuse"]] and abuse[names["quoted"]] == 0
    assert quote == single and quote[names["quoted"]] > 0
    assert between[names["quoted"]] == open_[names["quoted"]] == 0
    assert 0 < typo[names["abuse"]] < abuse[names["abuse"]]
    assert r.features("") == r.features("   ") == [0.0] * len(T.FEATURES)


def test_short_terms_match_misspelled_and_harmless_neighbours_weigh_little(spark, small):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [rng.choice(["the", "of", "and", "tree", "skin", "river"]) for _ in range(20)]
        rows.append((i, " ".join([*words, *(["scum", "skim"] if toxic else [])]), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    folder = small(documents=(rows, DOCUMENTS), labels=(labels, "doc_id long, quality int, toxic int"))
    m = T.learn(table(spark, folder, "documents"), table(spark, folder, "labels"))
    worth = {t: w for (t, whole), w in zip(m.terms, m.weights, strict=True) if whole}
    assert T.Automaton(m.terms).match("sccum") is not None
    assert worth["scum"][1] > 0.4 * worth["scum"][0] and worth["skim"][1] < 0.2 * worth["skim"][0]  # skin is near to skim


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    out = T.op8_levenshtein_trie(spark, sf).collect()
    assert len(out) == table(spark, sf, "documents").count()
    held = [r for r in out if r.held_out and r.doc_id in label]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_defined_cases(spark, small):
    rng = random.Random(2)
    words = ["the", "of", "and", "tree", "house", "river"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + (" scoundrel" if i % 4 == 0 else ""), "en", "s", 0) for i in range(200)]
    rows += [(500, None, "en", "s", 0), (501, "", "en", "s", 0), (502, "scoundrel " + "tree " * 30_000, "en", "s", 0), (503, "a scoundrell here", "", "", 0), (503, "a scoundrell here", "", "", 0), (None, "of the river", "", "", 0)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)] + [(501, 1, None), (None, 1, 1), (700, 1, 1)]
    kind = "doc_id long, quality int, toxic int"
    out = T.op8_levenshtein_trie(spark, small(documents=(rows, DOCUMENTS), labels=(labels, kind))).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(200))
    assert got[500].score == got[501].score < 0.5 and got[None].predicted == 0
    assert T.op8_levenshtein_trie(spark, small(documents=([], DOCUMENTS), labels=(labels, kind))).count() == 0
    none = T.op8_levenshtein_trie(spark, small(documents=(rows, DOCUMENTS), labels=([], kind))).collect()
    assert {r.score for r in none} == {0.0}
    docs = spark.createDataFrame([(*r, 0.5) for r in rows] + [(None, "a scoundrel", "", "", 0, 0.5), (3000, "a scoundrel", "", "", 0, 0.5), (3000, "a house", "", "", 0, 0.5)], DOCUMENTS + ", score double")
    kept = T.drop_toxic(docs, spark.createDataFrame(labels, kind))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(200) if i % 4}
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.doc_id in (None, 3000)) == [(0, "of the river"), (3000, "a house")]
