"""Ordered first-match rule tables as one CASE expression.

A rule is (label, test, guard): it holds where its test and guard do, and a row
whose guard fails falls through to later rules. The table is data, so a new rule
needs no new code; the expression stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    guard: Column | None = None


def first_match(text: Column, rules: list[Rule], default: Column | str | None = None) -> Column:
    """Label of the first rule whose pattern is found and whose guard holds."""
    out = None
    for rule in rules:
        hit = text.rlike(rule.pattern)
        if rule.guard is not None:
            hit = hit & F.coalesce(rule.guard, F.lit(False))
        out = F.when(hit, F.lit(rule.label)) if out is None else out.when(hit, F.lit(rule.label))
    if default is None:
        return out if out is not None else F.lit(None).cast("string")
    other = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(other) if out is not None else other


def ladder(steps: list[tuple[Column, str]], default: str | None = None) -> Column:
    """First label whose condition holds."""
    out = None
    for test, label in steps:
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(default)) if default is not None else out


def half_open_bins(value: Column, bins: list[tuple[str, float, float]], default: str) -> Column:
    """Name of the bin with ``low <= value < high`` (C11)."""
    return ladder([((value >= a) & (value < b), name) for name, a, b in bins], default)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with ``value`` made once for all the places where ``f`` reads it.

    An expression that is named in several places would be made in each of them, and in chains of such
    expressions so often in each of those. ``f`` may hold no Python function.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))
