"""Golden texts and properties of the text functions."""

from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirespark.functions import labels as L
from quirespark.functions import text as X
from quirespark.operators import fuzzy


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, ""), ("", ""), ("Zażółć Gęślą_jaźń—Müller? x-y", "zazolc gesla_jazn müller x y"), ("!?!", ""), ("  a\t\nb c ", "a b c"), ("ÄÉñ ó", "äéñ o")],
)
def test_normalize(spark, text, want):
    assert one(spark, text, X.normalize) == want == X.normalized(text)


@settings(max_examples=100, deadline=None)
@given(st.text("aAąĄżŻ .,-_!\n\tñÉ9", max_size=30))
def test_normalized_is_idempotent(text):
    assert X.normalized(X.normalized(text)) == X.normalized(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a\r\nb", "a\n\nb"),
        ("1.\nTreść punktu tutaj jest długa", "1. Treść punktu tutaj jest długa"),
        ("1.", "1."),
        ("wstęp\nWYROK w imieniu\ndalej", "wstęp\n\nWYROK w imieniu\n\ndalej"),
        ("Tekst pierwszy\n•\nTekst drugi", "Tekst pierwszy\n\n•\n\nTekst drugi"),
        ("Zdanie zaczyna się\ni ciągnie dalej,\n(w nawiasie)", "Zdanie zaczyna się i ciągnie dalej, (w nawiasie)"),
        ("Początek akapitu\nKrótkie zdanie.\nNowy akapit", "Początek akapitu\n\nKrótkie zdanie.\n\nNowy akapit"),
        ("Początek akapitu\nNowe bez końca\nciąg", "Początek akapitu\n\nNowe bez końca ciąg"),
        ("Zgodnie z art 5 i Art  7 oraz §  7", "Zgodnie z art. 5 i Art. 7 oraz § 7"),
        ("lecz start 5", "lecz start. 5"),
        ("§ 5 ustawy\ndalej", "§ 5 ustawy\n\ndalej"),
        (None, ""),
        ("   \n \n", ""),
    ],
)
def test_clean(text, want):
    assert X.clean(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, 0.0), ("a" * 9, 0.0), ("ab cd efgh", 0.7), ("abcde " * 16 + "abc", 0.7), ("abcde " * 17, 0.9), ("abcd?" + " abcde" * 20, 0.9 - 5 / 125), ("?�" * 60, 0.5), ("a " * 60, 0.8), ("x" * 120, 0.8)],
)
def test_confidence(spark, text, want):
    assert one(spark, text, X.confidence) == pytest.approx(want)


def test_law_spacing_and_fragments(spark):
    assert one(spark, "art 5 start 6 §  7", X.law_spacing) == "art. 5 start. 6 § 7"
    assert one(spark, "a b c", lambda c: X.fragments(c, 2)) == ["a b", "b c"]
    assert one(spark, "a", lambda c: X.fragments(c, 2)) == []


def test_snippet(spark):
    text = "x" * 300 + " Wyrok sądu " + "y" * 300
    got = one(spark, text, lambda c: X.snippet(c, "WYROK"))
    assert got.startswith("...x") and got.endswith("y...") and "Wyrok" in got
    assert one(spark, "krótki", lambda c: X.snippet(c, "brak")) == "krótki"
    assert one(spark, "a" * 250, lambda c: X.snippet(c, None)) == "a" * 200 + "..."
    assert one(spark, "", lambda c: X.snippet(c, "a")) == ""


def test_occurrences_are_literal(spark):
    assert one(spark, "a.b A.B axb", lambda c: X.occurrences(c, "a.b")) == 2
    assert one(spark, "Żaba żaba", lambda c: X.occurrences(c, "ŻABA")) == 2


@pytest.mark.parametrize(("n", "want"), [(0, "0 B"), (1, "1.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1280, "1.2 KB"), (1792, "1.8 KB"), (1 << 20, "1.0 MB"), ((1 << 30) - 1, "1024.0 MB"), (1 << 40, "1.0 TB"), (5 << 50, "5120.0 TB")])
def test_file_size(spark, n, want):
    assert one(spark, n, L.file_size, "long") == want


def test_labels(spark):
    assert [one(spark, m, L.content_type) for m in (None, "image/png", "application/msword", "application/pdf")] == ["document", "image", "opinion", "document"]
    assert [one(spark, n, L.extension) for n in ("a.PDF", ".bashrc", "a.b/c", "x.tar.gz", "n")] == [".pdf", "", "", ".gz", ""]
    assert [one(spark, n, lambda c: L.stem_with(c, ".txt")) for n in ("a.pdf", "a.b.c", "plain")] == ["a.txt", "a.b.txt", "plain.txt"]
    assert one(spark, '{"response": null, "text": "x"}', L.first_present) is None
    assert one(spark, '{"text": "x", "completion": "y"}', L.first_present) == "x"
    at = "2024-01-01 10:00"
    new = f"[PODSUMOWANIE AI - {at}]\nS"
    merged = {(note, mode): one(spark, note, lambda c, m=mode: L.note_with_summary(c, F.lit("S"), at, m)) for note in (None, " \n", "N") for mode in ("append", "prepend", "replace", "other")}
    assert all(v == new for (note, mode), v in merged.items() if note != "N" or mode == "replace")
    assert merged["N", "append"] == merged["N", "other"] == f"N\n\n---\n\n{new}" and merged["N", "prepend"] == f"{new}\n\n---\n\nN"


def test_selections(spark):
    row = spark.range(1)
    box = row.select(*(c.alias(n) for n, c in L.crop_box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(800), F.lit(600)).items())).first()
    assert (box.left, box.top, box.right, box.bottom, box.scale) == (0, 0, 800, 600, 1.0)
    box = row.select(*(c.alias(n) for n, c in L.crop_box(F.lit(0.5), F.lit(0.5), F.lit(0.6), F.lit(0.52), F.lit(800), F.lit(600)).items())).first()
    assert (box.left, box.top, box.right, box.bottom) == (395, 295, 485, 317) and box.scale == 300 / 22
    sel = row.select(*(c.alias(n) for n, c in L.selection(F.lit(90.0), F.lit(60.0), F.lit(10.0), F.lit(20.0), F.lit(100), F.lit(100)).items())).first()
    assert (sel.x1, sel.y1, sel.x2, sel.y2) == (0.1, 0.2, 0.9, 0.6)
    assert row.select(L.whole_page(F.lit(0.005), F.lit(0.0), F.lit(0.995), F.lit(1.0)).alias("w")).first().w


def definition(term, text, threshold=0.7):
    if not term or not text:
        return False
    n, t = X.normalized(term), X.normalized(text)
    if len(n) <= 2:
        return n in t
    ws = t.split()
    k = len(n.split())
    runs = [w for w in ws if len(w) >= 0.7 * len(n)] + ([" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] if " " in n else [])
    return n in t or any(SequenceMatcher(None, n, w).ratio() >= threshold for w in runs)


def test_fuzzy_match_is_its_definition(spark):
    texts = [None, "", "!!!", "wyrok sądu", "wyroki sadów", "wirok", "w", "tide diet", "postanowienie sądu okręgowego w sprawie", "sprawa sadu okregowym", "ąę", "abcdefghij" * 30, "wy rok", "krok w bok"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for term in ["", None, "!!!", "w", "ąę", "wyrok", "tide", "diet", "sąd okręgowy", "postanowienia", "bardzo długi termin wielu słów", "abcdefghij"]:
        got = {r.id: r.matched for r in fuzzy.fuzzy_match(df, "id", "text", term).collect()}
        assert got == {i: definition(term, t) for i, t in enumerate(texts)}, term


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=3, max_size=12), st.text("abc", min_size=1, max_size=20))
def test_bounds_drop_no_match(term, word):
    ratio, both = SequenceMatcher(None, term, word).ratio(), len(term) + len(word)
    assert ratio <= 2 * min(len(term), len(word)) / both + 1e-12
    assert ratio <= 2 * sum(min(term.count(c), word.count(c)) for c in set(term)) / both + 1e-12
