"""Values chosen from several sources, with a record of which source gave them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coalesce_from(choices: list[tuple[str, Column]]) -> Column:
    """struct(value, source): the first non-null value and its source's name; both null if none."""
    value = F.coalesce(*[c for _, c in choices])
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in choices])
    return F.struct(value.alias("value"), source.alias("source"))


def blank_to_null(c: Column) -> Column:
    """Blank strings read as null."""
    return F.when(F.trim(c) != "", c)


def prefer_fresh(fresh: DataFrame, cached: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both, each from ``fresh`` where it has the key, else from ``cached``."""
    a = fresh.select(key, F.struct(*columns).alias("_fresh"))
    b = cached.select(key, F.struct(*columns).alias("_cached"))
    both = a.join(b, key, "full_outer").withColumn("_row", F.coalesce("_fresh", "_cached"))
    return both.select(key, "_row.*", F.when(F.col("_fresh").isNotNull(), "fresh").otherwise("cached").alias("origin"))


def default_only_blank(df: DataFrame, group: str, column: str, telling: str) -> DataFrame:
    """Blank ``column`` in groups where the value ``telling`` never occurs (P10)."""
    seen = df.where(F.col(column) == telling).select(group).distinct().withColumn("_seen", F.lit(True))
    return df.join(seen, group, "left").withColumn(column, F.when(F.col("_seen"), F.col(column))).drop("_seen")
