"""Which row of a key stays (J4, J5, J26, A9, W1). All by map-side aggregates of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The row of each key that comes first in ``order``, which must end in a unique column."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])).alias("_row"))
    return picked.select(*keys, "_row.*")


def keep_last(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The row of each key that comes last in ``order``, which must end in a unique column."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])).alias("_row"))
    return picked.select(*keys, "_row.*")


def probe_array(df: DataFrame, key: str, values: str, lookup: DataFrame, probe: str) -> DataFrame:
    """For each row the first element of its array that ``lookup`` has, with its place."""
    each = df.select(key, F.posexplode(values).alias("pos", probe))
    return each.join(lookup, probe).groupBy(key).agg(F.min(F.struct("pos", probe)).alias("_hit")).select(key, F.col("_hit.pos").alias("pos"), F.col(f"_hit.{probe}").alias(probe))


def missing_numbers(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Numbers from ``low`` to ``high`` that the column lacks."""
    spine = df.sparkSession.range(low, high + 1).withColumnRenamed("id", column)
    return spine.join(df.select(F.col(column).cast("long").alias(column)).distinct(), column, "left_anti")
