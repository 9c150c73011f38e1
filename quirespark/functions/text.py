"""Text functions: folding, normalization, snippets, statistics, OCR clean-up and confidence. Columns in, columns out."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Letters that are folded, and what they become.
FOLDED = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"
PLAIN = "acelnoszzACELNOSZZ"
#: What the pages that count words take for white space.
WHITE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The characters of WHITE but the line end.
SPACES = "\t\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Words of a court document's headings.
HEADINGS = ("WYROK", "POSTANOWIENIE", "UZASADNIENIE", "SYGNATURA", "AKT")


def fold(text: Column) -> Column:
    """Polish letters without their marks; no other letter is changed."""
    return F.translate(text, FOLDED, PLAIN)


def normalize(text: Column) -> Column:
    """Lower case, folded, all but word characters and white space as spaces, these collapsed and trimmed; null becomes ''.

    Punctuation and white space both end up as one space, so one replacement does for both.
    """
    return F.trim(F.regexp_replace(fold(F.lower(F.coalesce(text, F.lit("")))), r"[^a-z0-9_\p{L}\p{N}]+", " "))


def normalized(term: str | None) -> str:
    """normalize() for a term known to the driver."""
    bare = re.sub(r"[^\w\s]", " ", (term or "").lower().translate(str.maketrans(FOLDED, PLAIN)))
    return " ".join(bare.split())


def words(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def fragments(normal: Column, n: int) -> Column:
    """All runs of n words of a normalized text."""

    def runs(w: Column) -> Column:
        all_ = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " "))
        return F.when(F.size(w) >= n, all_).otherwise(F.array().cast("array<string>"))

    # as an element of an array the text is split once, not once for each of its runs
    return F.transform(F.array(words(normal)), runs)[0]


def truncate(text: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def snippet(text: Column, term: str | None, most: int = 200) -> Column:
    """About `most` characters around the first place where the normalized text holds the normalized term, else the beginning.

    The place is scaled from the normalized text to the original one, so it is near the hit, not at it.
    """
    if not term:
        return truncate(text, most)
    size = F.length(text)

    def place(normal: Column) -> Column:
        return F.struct((F.instr(normal, normalized(term)) - 1).alias("found"), F.length(normal).alias("size"))

    def shown(hit: Column) -> Column:
        at = F.floor(F.when(hit["size"] > 0, hit["found"] * size / hit["size"]).otherwise(0)).cast("int")
        start, end = F.greatest(F.lit(0), at - most // 2), F.least(size, at + most // 2)
        around = F.concat(F.when(start > 0, "...").otherwise(""), F.substr(text, start + 1, end - start), F.when(end < size, "...").otherwise(""))
        return F.when((hit["found"] >= 0) & (size > 0), around).otherwise(truncate(text, most))

    # as elements of an array the normalized text and the place are computed once, however often they are used
    return F.transform(F.transform(F.array(normalize(text)), place), shown)[0]


def occurrences(text: Column, term: str) -> Column:
    """How often a literal term stands in the text, whatever its case."""
    quoted = "".join(re.escape(c) if c.isascii() else c for c in term)
    return F.regexp_count(text, F.lit(f"(?iu){quoted}")) if term else F.lit(0)


def stats(text: Column) -> dict[str, Column]:
    """Characters, words, paragraphs, lines, characters but white space, mean word length, words a paragraph, bytes.

    White space is WHITE. Means of nothing are null.
    """

    def measured(t: Column) -> Column:
        # with all white space but line ends as spaces, further patterns match a class of two characters
        bare = F.translate(t, SPACES, " " * len(SPACES))
        words = F.size(F.filter(F.split(bare, "[ \n]+"), lambda w: w != ""))
        paragraphs = F.size(F.filter(F.split(bare, r"\n[ \n]*\n"), lambda p: p.rlike(r"[^ \n]")))
        return F.struct(words.cast("long").alias("words"), paragraphs.cast("long").alias("paragraphs"), F.length(F.translate(bare, " \n", "")).cast("long").alias("solid"))

    # as an element of an array the measures are taken once, however often they are used
    m = F.transform(F.array(text), lambda t: F.when(t.isNotNull(), measured(t)))[0]
    n_words, paragraphs, solid = m["words"], m["paragraphs"], m["solid"]
    return {
        "characters": F.length(text).cast("long"),
        "words": n_words,
        "paragraphs": paragraphs,
        "lines": F.size(F.split(text, "\n")).cast("long"),
        "solid_characters": solid,
        "mean_word_length": F.round(F.try_divide(solid, n_words), 6),
        "words_per_paragraph": F.round(F.try_divide(n_words, paragraphs), 6),
        "bytes": F.octet_length(text).cast("long"),
    }


def confidence(text: Column) -> Column:
    """Heuristic confidence of recognized text, 0 to 1."""

    def measured(t: Column) -> Column:
        n = F.length(t)
        return F.struct(n.alias("n"), (n - F.length(F.translate(t, "?�", ""))).alias("doubtful"), F.regexp_count(t, F.lit(r"(?U)\S+")).alias("words"), F.length(F.regexp_replace(t, r"(?U)\s", "")).alias("solid"))

    def score(m: Column) -> Column:
        mean = F.try_divide(m["solid"], m["words"])
        raw = F.lit(0.9) - F.least(F.lit(0.3), m["doubtful"] / F.greatest(m["n"], F.lit(1)) * 5) - F.when((mean < 2) | (mean > 15), 0.1).otherwise(0.0) - F.when(m["n"] < 100, 0.2).otherwise(0.0)
        return F.when(m["n"] < 10, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))

    # as an element of an array each measure is taken once, however often it is used
    return F.transform(F.transform(F.array(F.coalesce(text, F.lit(""))), measured), score)[0]


def law_spacing(text: Column) -> Column:
    """`art 5` and `§  7` as `art. 5` and `§ 7`."""
    out = F.regexp_replace(text, r"(?U)art\s+(\d+)", "art. $1")
    out = F.regexp_replace(out, r"(?U)Art\s+(\d+)", "Art. $1")
    return F.regexp_replace(out, r"(?U)§\s+(\d+)", "§ $1")


def _alone(line: str) -> bool:
    """Headings, and lines so short that they divide."""
    bare = line.strip()
    heading = (line.isupper() and len(line) > 5) or line[0] == "§" or any(h in line for h in HEADINGS)
    return heading or len(bare) <= 3 or bare in {"-", "–", "—", "*", "•"}


def _paragraphs(text: str) -> list[str]:
    lines = [x.strip() for x in text.replace("\r", "\n").split("\n")]
    for i in range(len(lines) - 1):  # a number alone goes to the line after it
        if re.fullmatch(r"[0-9]+[.)]", lines[i]):
            lines[i], lines[i + 1] = f"{lines[i]} {lines[i + 1]}", ""
    out: list[list[str]] = []
    open_ = False
    for line in lines:
        if not line:
            open_ = False
        elif _alone(line):
            out.append([line])
            open_ = False
        elif not open_:
            out.append([line])
            open_ = True
        elif line[0].islower() or not line[0].isalpha():
            out[-1].append(line)
        else:
            out.append([line])
            open_ = not (line[-1] in ':.,;!?…"' and len(line) < 50)
    return [p for p in map(" ".join, out) if p.strip()]


def clean(text: str | None) -> str:
    """Recognized text with its lines folded into paragraphs; see clean_ocr_text()."""
    if not text:
        return ""
    spaced = (re.sub(r"§\s+(\d+)", r"§ \1", re.sub(r"([aA])rt\s+(\d+)", r"\1rt. \2", p)) for p in _paragraphs(text))
    return "\n\n".join(spaced)


@pandas_udf(T.StringType())
def clean_ocr_text(text: pd.Series) -> pd.Series:
    """Lines folded into paragraphs: whether a line goes on depends on what came before, so each text is read in order."""
    return text.map(clean)
