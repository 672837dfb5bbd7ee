"""Interval and as-of joins against small dimensions of terms.

A dimension of terms is a bounded table written in code, so it becomes one CASE
expression: no join, no shuffle. :func:`join_terms` is the form for a table of terms
of unknown size; it buckets time so that the join keeps an equality.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Term = tuple[int | str, date, date]


def _day(d: date) -> Column:
    return F.lit(d.isoformat()).cast("date")


def term_of(day: Column, terms: list[Term], closed: bool = True) -> Column:
    """The first term with ``start <= day <= end`` (``< end`` if not closed), else null."""
    out = None
    for name, start, end in terms:
        hit = (day >= _day(start)) & ((day <= _day(end)) if closed else (day < _day(end)))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def last_ended(day: Column, terms: list[Term]) -> Column:
    """The term with the latest end before ``day`` (as-of, backward)."""
    out = None
    for name, _, end in sorted(terms, key=lambda t: t[2], reverse=True):
        hit = day > _day(end)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def term_or_last(day: Column, terms: list[Term]) -> Column:
    """The closed term that holds ``day``, else the last that ended before it."""
    return F.coalesce(term_of(day, terms), last_ended(day, terms))


def join_terms(rows: DataFrame, day: str, terms: DataFrame, start: str, end: str, closed: bool = True, days_per_bucket: int = 366) -> DataFrame:
    """``rows`` left-joined to all terms that hold their day, for term tables of any size.

    Terms are exploded into the buckets of days that they touch, so the join is an
    equality on the bucket with the exact test as its condition.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days_per_bucket)
    spread = terms.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    upper = F.col(day) <= F.col(end) if closed else F.col(day) < F.col(end)
    return rows.withColumn("_at", bucket(F.col(day))).join(spread, (F.col("_at") == F.col("_bucket")) & (F.col(day) >= F.col(start)) & upper, "left").drop("_at", "_bucket")
