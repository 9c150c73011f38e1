"""All places where terms stand in texts, and the texts with them marked.

Many terms are looked for in one pass: an automaton over them is built once a task and run over Arrow batches, so the
work grows with the texts and what is found, not with the number of terms.

Matches ignore case as the pages do: a letter counts as its capital if that is one letter, and not if only the capital is ASCII. The
matches of one term do not overlap: from the left, each begins behind the one before. Different terms are found
independently of one another. Marks do not overlap: at the leftmost place the longest match is marked, then what comes behind it.

Terms are trimmed; empty ones and repeats (but for case) are left out. A null text has no matches and stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: What the pages put around a match.
MARK = '<mark style="background-color: #ffeb3b; padding: 1px;">', "</mark>"
#: Bytes of text that a step of a task holds, besides the longest single text.
STEP = 4_000_000


@cache
def capital(c: str) -> str:
    up = c.upper()
    return up if len(up) == 1 and not (ord(c) >= 128 > ord(up)) else c


def folded(text: str) -> str:
    """Of the same length as the text; equal for texts that differ in case."""
    if text.isascii():
        return text.upper()
    up = text.upper()
    if len(up) == len(text) and not any(ord(c) >= 128 > ord(u) for c, u in zip(text, up, strict=True)):
        return up
    return "".join(map(capital, text))


def finder(terms: list[str]) -> Callable[[str], list[tuple[int, int, int]]]:
    """Gives the matches (start, end, term's number) of a text, ordered by start, the longest first."""
    automaton = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        automaton.add_word(folded(t), (i, len(t)))
    if terms:
        automaton.make_automaton()

    def find(text: str) -> list[tuple[int, int, int]]:
        if not terms:
            return []
        last, out = {}, []
        for end, (i, n) in automaton.iter(folded(text)):
            start = end - n + 1
            if start >= last.get(i, 0):  # ends ascend, and so do the starts of one term
                last[i] = end + 1
                out.append((start, end + 1, i))
        return sorted(out, key=lambda m: (m[0], -m[1]))

    return find


def distinct_terms(terms: list[str]) -> list[str]:
    """Trimmed, lower-cased, each once."""
    return list({folded(t): t for t in reversed([x.lower().strip() for x in terms]) if t}.values())[::-1]


def marked(text: str, matches: list[tuple[int, int, int]], mark: tuple[str, str] = MARK) -> str:
    out, at = [], 0
    for start, end, _ in matches:
        if start >= at:
            out += [text[at:start], mark[0], text[start:end], mark[1]]
            at = end
    return "".join([*out, text[at:]])


def parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about STEP bytes of text."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and size + n > STEP:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def places(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, term, start, end) for every match in df: characters from 0, ends exclusive."""
    own = distinct_terms(terms)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(own)
        for b in (p for batch in batches for p in parts(batch, "_text")):
            of, found = [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                if t:
                    m = find(t)
                    of += [i] * len(m)
                    found += m
            start, end, term = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(of, pa.int64())), pa.array([own[i] for i in term], pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=[key, "term", "start", "end"])

    return df.select(key, df[text].alias("_text")).mapInArrow(run, f"`{key}` {kind}, term string, start int, end int")


def marks(df: DataFrame, key: str, text: str, terms: list[str], mark: tuple[str, str] = MARK) -> DataFrame:
    """(key, matches, marked) for every row of df: how many matches its text has, and the text with marks around them."""
    own = distinct_terms(terms)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(own)
        for b in (p for batch in batches for p in parts(batch, "_text")):
            n, out = [], []
            for t in b.column("_text").to_pylist():
                m = find(t) if t else []
                n.append(len(m))
                out.append(marked(t, m, mark) if m else t)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n, pa.int32()), pa.array(out, pa.string())], names=[key, "matches", "marked"])

    return df.select(key, df[text].alias("_text")).mapInArrow(run, f"`{key}` {kind}, matches int, marked string")
