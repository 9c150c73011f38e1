import re

import pytest
from pyspark.sql import functions as F

from quirespark.functions.text import fragments
from quirespark.operators import find, vocabulary
from quirespark.operators.fuzzy import fuzzy_match

TEXTS = [(1, "Wyrok SĄDU, wyrok sądu; aaa aaaa"), (2, "straße STRASSE ſad İstanbul istanbul K k"), (3, ""), (4, None), (5, "sąd sądowy osąd"), (None, "wyrok")]


def plain(c):
    up = c.upper()
    return c if len(up) != 1 or (ord(c) >= 128 and ord(up) < 128) else up


def expected(text, terms):
    """Brute force: every place of every term."""
    fold = "".join(map(plain, text or ""))
    out = []
    for t in terms:
        own, at = "".join(map(plain, t)), 0
        while (at := fold.find(own, at)) >= 0:
            out.append((t, at, at + len(t)))
            at += len(t)
    return sorted(out)


@pytest.mark.parametrize("terms", [["wyrok"], ["sąd", "sądu", "sądowy", "ą"], ["aa", "a", "aaaa"], ["s", "i", "k", "strasse", "ss", "ß"], ["."], []])
def test_places(spark, terms):
    df = spark.createDataFrame(TEXTS, "id long, text string").withColumn("term", F.lit("x"))
    got = {}
    for r in find.places(df, "id", "text", [*terms, " " + "".join(terms).upper()[:0]]).collect():
        got.setdefault(r.id, []).append((r.term, r.start, r.end))
    want = {i: e for i, t in TEXTS if (e := expected(t, terms))}
    assert {k: sorted(v) for k, v in got.items()} == want
    counts = {r.id: r.matches for r in find.marks(df, "id", "text", terms).collect()}
    assert counts == {i: len(expected(t, terms)) for i, t in TEXTS}


def test_marks(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    got = {r.id: r.marked for r in find.marks(df, "id", "text", ["sąd", "Sądu", " WYROK ", "wyrok", "owy"], ("<", ">")).collect()}
    assert got[1] == "<Wyrok> <SĄDU>, <wyrok> <sądu>; aaa aaaa" and got[5] == "<sąd> <sąd><owy> o<sąd>" and got[3] == "" and got[4] is None and got[None] == "<wyrok>"
    one = {r.id: r.marked for r in find.marks(df.where("id = 1"), "id", "text", ["wyrok"]).collect()}
    assert one[1] == re.sub("(?i)wyrok", lambda m: f"{find.MARK[0]}{m[0]}{find.MARK[1]}", TEXTS[0][1])


DOCS = [(i, t) for i, t in enumerate(["Wyrok sądu okręgowego", "wirok w sprawie", "umowa najmu lokalu", "Umowy, najem!", "sad rejonowy w Łodzi", "x", "", None, "...", "postanowienie sadu", "wyrok sadu", "najmu umowa", "a b c", "w w w"])]
TERMS = ["wyrok", "Wyrok!", "umowa najmu", "sądu okręgowego", "w", "", "!!!", "łodzi", "postanowienia", "zzz", "b c", "wyrok  sadu", "xyz abc"]


def test_vocabulary_search_is_the_fuzzy_match(spark, tmp_path):
    df = spark.createDataFrame(DOCS, "id long, text string")
    index = vocabulary.build(df, "id", "text", str(tmp_path / "index"), blocks=3)
    got = {}
    for r in vocabulary.search(index, TERMS, df).collect():
        got.setdefault(r.term, []).append(r.id)
    for t in TERMS:
        want = sorted(r.id for r in fuzzy_match(df, "id", "text", t).where("matched").collect())
        assert sorted(got.get(t, [])) == want, t
    assert vocabulary.search(index, [""]).collect() == [] and vocabulary.search(index, []).collect() == []
    with pytest.raises(ValueError, match="several words"):
        vocabulary.search(index, ["a b"])


def test_vocabulary_hot_words_are_split_and_length_reaches_the_scan(spark, tmp_path):
    df = spark.range(1000).select("id", F.concat(F.lit("często "), (F.col("id") % 7).cast("string")).alias("text"))
    index = vocabulary.build(df, "id", "text", str(tmp_path / "index"), blocks=10)
    sizes = [len(r.ids) for r in index.where("word = 'czesto'").collect()]
    assert len(sizes) == 10 and sum(sizes) == 1000 and max(sizes) < 200
    assert vocabulary.search(index, ["czesta"]).count() == 1000
    plan = vocabulary.pairs(index.select("word", "length").distinct(), ["czesta"], 0.7)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(length" in plan


def test_vocabulary_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "id long, text string")
    index = vocabulary.build(df, "id", "text", str(tmp_path / "index"))
    assert vocabulary.search(index, ["a", "b c"], df).collect() == []


def test_runs_are_made_of_words_split_once(spark):
    runs = spark.createDataFrame([("a b c d",), ("a",), ("",)], "t string").select(fragments(F.col("t"), 3).alias("runs"))
    assert [r.runs for r in runs.collect()] == [["a b c", "b c d"], [], []]
    assert runs._jdf.queryExecution().analyzed().toString().count("split(") == 1


def test_terms_of_several_words_within_words_and_runs(spark, tmp_path):
    df = spark.createDataFrame([(1, "proof tehran"), (2, "of the of the"), (3, "ofteh"), (4, "roof, the"), (5, "of"), (6, "x" * 50 + "of tehx y")], "id long, text string")
    index = vocabulary.build(df, "id", "text", str(tmp_path / "index"))
    for t in ("of teh", "!!", "of the of"):
        want = sorted(r.id for r in fuzzy_match(df, "id", "text", t).where("matched").collect())
        assert sorted(r.id for r in vocabulary.search(index, [t], df).collect()) == want and want, t
    # of all words, which hold the empty term, the empty one is enough
    assert [r.word for r in vocabulary.pairs(index.select("word", "length").distinct(), [""], 0.7).collect()] == [""]


def test_common_words_are_not_in_one_file(spark, tmp_path):
    text = F.concat(F.lit(" ".join(f"{a}{b}" for a in "abcdefgh" for b in "xyzw")), F.lit(" longword"), F.col("id").cast("string"))
    index = vocabulary.build(spark.range(2000).select("id", text.alias("text")), "id", "text", str(tmp_path / "index"))
    sizes = [r[1] for r in index.groupBy(F.input_file_name()).agg(F.sum(F.size("ids"))).collect()]
    assert sum(sizes) == 2000 * 34 and max(sizes) < sum(sizes) / 2
