"""Fuzzy matching of a term in a text column, as a column expression: no join, no shuffle.

A text matches if its normalized form holds the normalized term, or if one of its words,
or for a term of several words one of its runs of as many words, has a Ratcliff-Obershelp
ratio to the term of at least the threshold. Ratios are not symmetric: the term comes first.

Texts are normalized by built-in expressions and go to Python in Arrow batches. There each
distinct word is tried once and remembered, and most fail two upper bounds of the ratio, by
length and by letters in common, before it is computed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.text import normalize, normalized

THRESHOLD = 0.7
#: Words that a task remembers.
CACHE = 200_000


def similar_to(term: str, threshold: float, cache: int = CACHE) -> Callable[[str], bool]:
    """Whether the ratio of a normalized term to a string reaches the threshold; as many strings are remembered as `cache` says."""
    n, letters = len(term), Counter(term)

    def similar(w: str) -> bool:
        least = threshold * (n + len(w)) / 2 - 1e-9  # matching letters that it takes
        if min(n, len(w)) < least or sum(min(k, w.count(c)) for c, k in letters.items()) < least:
            return False
        return SequenceMatcher(None, term, w).ratio() >= threshold

    return lru_cache(cache)(similar)


def any_similar(term: str, normal: Column, threshold: float) -> Column:
    """Whether a normalized text holds a normalized term, or a word or run of words similar to it."""
    size, n = term.count(" ") + 1, len(term)
    short, long = n * max(0.7, threshold / (2 - threshold)) - 1e-9, n * (2 - threshold) / threshold + 1e-9

    @pandas_udf(T.BooleanType())
    def found(texts: pd.Series) -> pd.Series:
        similar = similar_to(term, threshold)

        def one(text: str | None) -> bool:
            if not text or term in text:
                return bool(text)
            words = text.split()
            if any(similar(w) for w in set(words) if short <= len(w) <= long):
                return True
            return size > 1 and any(similar(" ".join(words[i : i + size])) for i in range(len(words) - size + 1))

        return texts.map(one)

    return found(normal)


def fuzzy(text: Column, term: str | None, threshold: float = THRESHOLD) -> Column:
    """Whether a text matches a term. Nothing matches an empty text or term; a term of one or two characters, normalized, must be in the text as it is."""
    if not term:
        return F.lit(False)
    n = normalized(term)
    if len(n) <= 2:
        return F.coalesce(text != "", F.lit(False)) & F.contains(normalize(text), F.lit(n))
    return any_similar(n, normalize(text), threshold)


def fuzzy_match(df: DataFrame, key: str, text: str, term: str | None, threshold: float = THRESHOLD) -> DataFrame:
    """(key, matched) for every row of df."""
    return df.select(key, fuzzy(F.col(text), term, threshold).alias("matched"))
