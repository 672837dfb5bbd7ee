"""Joins on keys that may be null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_by_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` with the columns of ``right``; null keys meet null keys, as they do in a window or a group."""
    theirs = [f"_key{i}" for i in range(len(keys))]
    renamed = right.withColumnsRenamed(dict(zip(keys, theirs, strict=True)))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(keys, theirs, strict=True)])
    return left.join(renamed, same, how).drop(*theirs)
