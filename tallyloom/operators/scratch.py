"""Tables written once, where a plan that ran twice could give other rows."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tallyloom-")


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet below ``spark.checkpoint.dir``, which all executors share, and read again.

    Without that setting the folder given to ``setCheckpointDir``, then, in local mode alone, a folder
    of this machine, and else the warehouse.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base and context.master.startswith("local"):
        base = "file://" + _local_folder()
    path = f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/tallyloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
