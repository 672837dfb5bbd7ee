"""Ratcliff-Obershelp likeness of strings and token lists (T14-T18), as Arrow-batched functions.

The ratio isn't symmetric, so argument order matters; exact pairs and blocks by an
equality are always settled before these functions see a row, and bounds of the ratio, which need only
built-in functions, tell which pairs are worth it.
"""

from __future__ import annotations

from difflib import SequenceMatcher, get_close_matches

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def likeness(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def ro_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio on characters; null if either side is null."""
    return pd.Series([None if x is None or y is None else likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def ro_ratio_tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio on lists of tokens, without the popular-element heuristic."""
    out = [None if x is None or y is None else SequenceMatcher(None, list(x), list(y), autojunk=False).ratio() for x, y in zip(a, b, strict=True)]
    return pd.Series(out, dtype="float64")


def close_match(words: list[str], cutoff: float):
    """A function of a column: the closest of ``words`` at ``cutoff`` or more, else null."""

    @F.pandas_udf(T.StringType())
    def pick(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else next(iter(get_close_matches(x, words, n=1, cutoff=cutoff)), None))

    return pick


def close_words(least: float):
    """A function of two arrays of words: how many of the first are at least so alike to any of the second.

    Pairs whose lengths, or shared letters, rule such a likeness out are never compared.
    """

    def fits(w: str, o: str) -> bool:
        m = SequenceMatcher(None, w, o)
        return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least

    @F.pandas_udf(T.IntegerType())
    def count(words: pd.Series, others: pd.Series) -> pd.Series:
        none = lambda x: x is None or not len(x)
        return pd.Series([0 if none(a) or none(b) else sum(any(fits(w, o) for o in b) for w in a) for a, b in zip(words, others, strict=True)], dtype="int32")

    return count


def runs(c: Column, width: int) -> Column:
    """All runs of ``width`` letters, in order."""
    n = F.length(c) - (width - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(c, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def numbered(every: Column) -> Column:
    """Each element with its number among its equals: what two such arrays share are the elements that two multisets share."""
    return F.transform(every, lambda r, i: F.concat(r, F.size(F.filter(F.slice(every, F.lit(1), i + 1), lambda x: x == r)).cast("string")))


def most_ratio(length: Column, letters: Column, pairs: Column) -> Column:
    """The largest ratio that two texts can have, by the sum of their lengths and the letters and pairs of letters that they share.

    The letters that match are shared letters. They stand in blocks with something else between them in either text, so there is at most
    one block more than letters left over, and each block of n letters has n - 1 shared pairs: 3 times the matches is at most the shared pairs plus the lengths plus one.
    """
    matches = F.least(letters, F.floor((pairs + length + 1) / 3))
    return F.when(length > 0, 2.0 * matches / length).otherwise(1.0)
