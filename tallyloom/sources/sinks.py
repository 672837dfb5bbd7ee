"""A table by key that batches are merged into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.provenance import prefer_fresh
from ..operators.scratch import written

#: Keys of a partition of the table.
KEYS = 1000


def upsert(fresh: DataFrame, path: str, key: str, columns: list[str], keys: int = KEYS) -> DataFrame:
    """Merge rows by ``key`` (a number, unique in ``fresh``) into the table at ``path``: fresh rows replace those of their keys, all others stay.

    The table is partitioned by ranges of ``keys`` keys. Only ranges that ``fresh`` has keys of are read, merged, and replaced as a
    whole (dynamic partition overwrite), so the same batch twice leaves the same table, and a batch that failed may be run again. Rows without a key
    aren't taken. Returns the merged rows with their ``origin``.
    """
    spark = fresh.sparkSession
    part = F.floor(F.col(key) / keys).cast("long")
    rows = written(fresh.where(F.col(key).isNotNull()).select(key, *columns))
    touched = rows.select(part.alias("_range")).distinct()
    if exists(spark, path):
        # Ranges are few beside keys; Spark prunes the partitions of the table by those of the batch.
        old = spark.read.schema(f"{fresh.select(key, *columns)._jdf.schema().toDDL()}, _range long").parquet(path).join(touched, "_range", "left_semi").select(key, *columns)
    else:
        old = rows.where("false")
    merged = written(prefer_fresh(rows, old, key, columns).withColumn("_range", part))
    ready = merged.drop("origin").repartition("_range").sortWithinPartitions("_range", key)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_range").parquet(path)
    return merged.drop("_range")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that ``upsert`` keeps, without its ranges."""
    return spark.read.schema(f"{schema}, _range long").parquet(path).drop("_range")
