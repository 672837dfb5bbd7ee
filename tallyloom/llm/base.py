"""Shared plumbing: session preparation, scratch tables, vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, NumericType

#: Rows of an Arrow batch sent to a Python worker. Texts reach 100 KB, so the
#: usual 10,000 rows could be a gigabyte; 512 keeps a worker's batch small.
ARROW_ROWS = 512

_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and let Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which a cluster shares.

    A session without that setting uses the folder given to ``setCheckpointDir``, or, in
    local mode alone (tests), a temporary folder of this machine; on a cluster, the warehouse.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base and context.master.startswith("local"):
        base = "file://" + _local_folder()
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tallyloom-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tallyloom-")


def save(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared scratch folder and read back."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def open_folder(uri: str):
    """(file system, path) of a location that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def discard(df: DataFrame) -> None:
    """Delete a saved table that nothing reads any more: what was made of it is saved itself."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a side of numbers that may be broadcast, and of one of its rows beside its numbers.
SMALL_BYTES, ROW_BYTES = 32 << 20, 16


def small_side(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """Hint a broadcast if a count shows ``df`` (saved, of fixed-width columns) to be small, else leave it to a shuffle join.

    Counting a saved table reads its footers alone. Other columns have no size that
    a count could show, so they are refused.
    """
    from pyspark.sql import functions as F

    if not all(isinstance(f.dataType, NumericType | BooleanType) for f in df.schema):
        raise TypeError(f"no bound is known for the size of {df.schema.simpleString()}")
    return F.broadcast(df) if df.count() * (8 * len(df.columns) + ROW_BYTES) <= most else df


#: Rows of one key that a task of ``hub_join`` gets.
HUB_ROWS = 1024


def hub_join(rows: DataFrame, side: DataFrame, key: str, spread: str, keys: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` to ``side`` (few rows a key) on ``key``, where a key may have a large share of the rows.

    Rows of a key with more than HUB_ROWS are dealt over several tasks by a hash of
    ``spread``, and the side's rows of that key are copied to each of these. ``keys``
    is a saved table with the rows' keys, if ``rows`` isn't saved itself.
    """
    from pyspark.sql import functions as F

    heavy = (rows if keys is None else keys).groupBy(F.col(key).alias("_hub")).agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("_parts")).where("_parts > 1")
    heavy = save(heavy)
    if heavy.isEmpty():
        return rows.join(side, key)
    heavy = small_side(heavy)
    left = rows.join(heavy, F.col(key) == F.col("_hub"), "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")), F.lit(0)).cast("int"))
    right = side.join(heavy, F.col(key) == F.col("_hub"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return left.drop("_hub", "_parts").join(right.drop("_hub", "_parts"), [key, "_part"]).drop("_part")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished steps."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return freed memory of this process to the system: a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep what is freed
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# --- vectorised word hashing -------------------------------------------------

_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E6C63D0876A9A47 | 1
_INV = pow(_BASE, -1, 1 << 64)
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)
#: The same value for A-Z as for a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[LOWER]
#: Space and \x09-\x0D separate words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _TABLES or len(_TABLES["p"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("p", _BASE), ("i", _INV)):
            out = np.empty(size, dtype=np.uint64)
            out[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                out[done : done + step] = out[:step] * _U(pow(base, done, 1 << 64))
                done += step
            _TABLES[name] = out
    return _TABLES["p"], _TABLES["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), vectorised."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 20):
    """(first, last) rows of runs with at most ``limit`` bytes, or one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def words(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of concatenated texts, A-Z lower-cased; ``space`` marks the bytes between them.

    Returns each word's hash, row, start and end byte; words never span rows.
    """
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    inside = ~space[buf]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_LOWER[buf] * power[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(offsets, start, side="right") - 1
    return h, row, start, end


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``width`` words.

    A row with fewer words gives its whole sequence as one shingle; a row
    without words gives none.
    """
    count = np.bincount(row, minlength=n_rows)
    acc, m = h[: max(0, len(h) - width + 1)].copy(), _U(0xD6E8FEB86659FD93)
    for k in range(1, width):
        acc = acc * m + h[k : k + len(acc)]
    whole = row[: len(acc)] == row[width - 1 : width - 1 + len(acc)]
    out, at = mix(acc[whole]), row[: len(acc)][whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])[short]
        extra = np.empty(len(short), dtype=np.uint64)
        for i, (f, c) in enumerate(zip(first.tolist(), count[short].tolist(), strict=True)):
            x = 0
            for k in range(c):
                x = (x * int(m) + int(h[f + k])) & _MASK
            extra[i] = x ^ (0xA5A5A5A5 + c)
        out, at = np.concatenate([out, mix(extra)]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


def distinct(h: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, ascending; rows must ascend."""
    bounds = np.searchsorted(row, np.arange(n_rows + 1))
    parts, at = [], []
    for i in range(n_rows):
        if bounds[i + 1] > bounds[i]:
            u = np.unique(h[bounds[i] : bounds[i + 1]])
            parts.append(u)
            at.append(np.full(len(u), i))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(at)
