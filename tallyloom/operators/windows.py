"""Order-dependent operators (W1-W14, A17): fills, look-backs, ranks, spines, bins.

Windows over a whole table or a hot key would put it into one task. Functions therefore work
in levels: within ranges of the order by a window, and between ranges by a table with one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import join_by_keys

#: Ranges of one level that make a range of the next.
RANGES = 4096


def _around(rows: DataFrame, order: str, ends: tuple[str, str], ranges: Column, levels: int) -> DataFrame:
    """``rows`` with ``_b``, the last non-null first end before each row, and ``_a``, the first non-null second end after it."""
    last, first = ends
    far = Window.unboundedPreceding
    if not levels:  # one row for each RANGES ** levels ranges
        back = F.last(last, ignorenulls=True).over(Window.orderBy(order).rowsBetween(far, -1))
        return rows.withColumns({"_b": back, "_a": F.last(first, ignorenulls=True).over(Window.orderBy(F.desc(order)).rowsBetween(far, -1))})
    rows = rows.withColumn(f"_range{levels}", ranges)
    at = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    edge = rows.groupBy(f"_range{levels}").agg(F.max_by(last, at(last)).alias("_last"), F.min_by(first, at(first)).alias("_first"))
    edge = _around(edge, f"_range{levels}", ("_last", "_first"), F.floor(F.col(f"_range{levels}") / RANGES), levels - 1)
    edge = edge.select(f"_range{levels}", F.col("_b").alias("_before"), F.col("_a").alias("_after"))
    inside = Window.partitionBy(f"_range{levels}")
    back = F.last(last, ignorenulls=True).over(inside.orderBy(order).rowsBetween(far, -1))
    # By the opposite order: a frame that ends at the last row would be gone through anew for each row.
    ahead = F.last(first, ignorenulls=True).over(inside.orderBy(F.desc(order)).rowsBetween(far, -1))
    placed = rows.withColumns({"_b": back, "_a": ahead}).join(edge, f"_range{levels}")
    return placed.withColumns({"_b": F.coalesce("_b", "_before"), "_a": F.coalesce("_a", "_after")}).drop("_before", "_after", f"_range{levels}")


def neighbour_fill(df: DataFrame, order: str, column: str, ranges: Column, levels: int = 2) -> DataFrame:
    """Fill a null where the previous and next non-null values in ``order`` agree.

    ``ranges`` assigns ascending integers to consecutive stretches of ``order``; ``order`` is
    unique and neither is null. Ranges are ranged in turn, ``levels`` times: the one window without
    partitions has a row for each 4096 ranges. Adds ``filled`` and ``fill_source`` (``own``, ``neighbours`` or null).
    """
    rows = _around(df, order, (column, column), ranges, levels)
    agree = F.when(F.col("_b") == F.col("_a"), F.col("_b"))
    own = F.col(column).isNotNull()
    source = F.when(own, F.lit("own")).when(agree.isNotNull(), F.lit("neighbours"))
    return rows.withColumn("filled", F.coalesce(column, agree)).withColumn("fill_source", source).drop("_b", "_a")


# The next four take ``ranges``, an expression that never falls along a key's order (a day, a year).
# With it a key's rows are windowed by range, and a table with one row for each key and range
# carries what is needed from one range to the next, so a key with a third of all rows
# isn't one task. Without it a key's rows are.


def forward_fill(df: DataFrame, keys: list[str], order: list[str], column: str, name: str, ranges: Column | None = None) -> DataFrame:
    """The last non-null value so far, this row's included."""
    far = Window.unboundedPreceding
    if ranges is None:
        return df.withColumn(name, F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(far, 0)))
    rows = df.withColumn("_range", ranges)
    edge = rows.groupBy(*keys, "_range").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(far, -1))
    inside = F.last(column, ignorenulls=True).over(Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(far, 0))
    out = join_by_keys(rows.withColumn("_inside", inside), edge.select(*keys, "_range", before.alias("_before")), [*keys, "_range"])
    return out.withColumn(name, F.coalesce("_inside", "_before")).drop("_range", "_inside", "_before")


def this_or_previous(df: DataFrame, keys: list[str], order: list[str], hit: Column, name: str, ranges: Column | None = None) -> DataFrame:
    """Whether the row or the one before it satisfies ``hit``."""
    rows = df.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    if ranges is None:
        before = F.lag("_hit").over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn(name, F.col("_hit") | F.coalesce(before, F.lit(False))).drop("_hit")
    rows = rows.withColumn("_range", ranges)
    edge = rows.groupBy(*keys, "_range").agg(F.max_by("_hit", F.struct(*order)).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range"))
    inside = F.lag("_hit").over(Window.partitionBy(*keys, "_range").orderBy(*order))
    out = join_by_keys(rows.withColumn("_inside", inside), edge.select(*keys, "_range", before.alias("_before")), [*keys, "_range"])
    return out.withColumn(name, F.col("_hit") | F.coalesce("_inside", "_before", F.lit(False))).drop("_hit", "_range", "_inside", "_before")


def occurrence(df: DataFrame, keys: list[str], order: list[str], name: str, ranges: Column | None = None) -> DataFrame:
    """How many rows of the key came before this one."""
    if ranges is None:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    rows = df.withColumn("_range", ranges)
    edge = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    out = join_by_keys(rows.withColumn("_inside", inside), edge.select(*keys, "_range", before.alias("_before")), [*keys, "_range"])
    return out.withColumn(name, (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_range", "_inside", "_before")


def stack(df: DataFrame, keys: list[str], order: list[str], wide: int, ranges: Column | None = None) -> DataFrame:
    """Rows of a band laid out in columns of a grid ``wide`` cells wide (W9): ``col`` and ``row``."""
    ranked = occurrence(df, keys, order, "_i", ranges)
    return ranked.withColumns({"col": F.col("_i") % wide, "row": F.floor(F.col("_i") / wide)}).drop("_i")


def count_alike(df: DataFrame, column: str, name: str) -> DataFrame:
    """How many rows share the value, this one included; null for null.

    By a grouped count and a join, so a frequent value doesn't gather its rows.
    """
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias(name))
    return df.join(n, F.col(column) == F.col("_v"), "left").drop("_v")


def day_spine(spark, start: str, days: int) -> DataFrame:
    """``days`` dates from ``start`` on."""
    return spark.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("day"))


def running_share(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``share`` of the key's total and the ``offset`` where its bar begins."""
    whole = Window.partitionBy(*keys)
    so_far = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(value).over(whole)
    return df.withColumns({"share": F.col(value) / total, "offset": F.coalesce(F.sum(value).over(so_far), F.lit(0)) / total})


def threshold_bin(value: Column, edges: list[float]) -> Column:
    """Number of edges that the value reaches."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("long")
