"""Nearest neighbours by inner product with vantage-point trees per shard (operator 8).

Rows are dealt to shards of bounded size by a hash of their id, and each shard's
tree is built once and stored as a row of an index table. Inner product isn't a
metric, so a shard's vectors get one more component, ``sqrt(M^2 - |x|^2)`` with the
shard's largest norm M, and queries get 0 there: then
``|q - x|^2 = |q|^2 + M^2 - 2 q.x``, and the nearest by distance have the largest
inner products. Every inner node halves its vectors by the distance to a vantage
point and keeps both halves' range of distances.

A block of queries searches a shard together. The triangle inequality gives every
(query, leaf) a lower bound, a query visits its leaves by ascending bound, and it
stops when ``factor * bound`` exceeds its distance to the k-th best. Factor 1 is
exact; a larger one prunes more and may lose some.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import prepare, save

SHARD_ROWS = 8192
QUERY_ROWS = 2048
LEAF_ROWS = 96
#: Pairs of vectors that are multiplied at once.
_PAIRS = 1 << 16


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def build(ids: np.ndarray, vectors: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """A shard's tree.

    Equal vectors are one entry with its k + 1 smallest ids: more can't
    be among k results. ``start``/``stop`` are the leaves' entries; ``path`` holds each
    leaf's nodes, ``low``/``high`` the range of distances from the node's vantage
    point to the leaf's side.
    """
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    nth = np.arange(len(ids)) - first[group]
    use = nth <= k
    ids, group, x = ids[use], group[use], vectors[first].astype(np.float64)
    norm = (x * x).sum(axis=1)
    top = norm.max()
    full = np.concatenate([x, np.sqrt(np.maximum(0, top - norm))[:, None]], axis=1)

    vantage: list[int] = []
    leaves: list[tuple[np.ndarray, list[tuple[int, float, float]]]] = []
    rng = np.random.default_rng(len(x))
    stack: list[tuple[np.ndarray, list[tuple[int, float, float]]]] = [(np.arange(len(x)), [])]
    while stack:
        rows, path = stack.pop()
        if len(rows) <= LEAF_ROWS:
            leaves.append((rows, path))
            continue
        tries = rng.choice(rows, 4, replace=False)
        sample = rng.choice(rows, min(64, len(rows)), replace=False)
        v = int(max(tries, key=lambda t: np.linalg.norm(full[sample] - full[t], axis=1).std()))
        d = np.linalg.norm(full[rows] - full[v], axis=1)
        half = len(rows) // 2
        by = np.argpartition(d, half)
        node = len(vantage)
        vantage.append(v)
        for side in (by[:half], by[half:]):
            stack.append((rows[side], [*path, (node, float(d[side].min()), float(d[side].max()))]))
    entry = np.concatenate([rows for rows, _ in leaves])
    sizes = np.array([len(rows) for rows, _ in leaves])
    depth = max([len(p) for _, p in leaves])
    path = np.full((len(leaves), depth), -1, dtype=np.int32)
    low, high = np.zeros((len(leaves), depth)), np.zeros((len(leaves), depth))
    for i, (_, p) in enumerate(leaves):
        for j, (node, a, b) in enumerate(p):
            path[i, j], low[i, j], high[i, j] = node, a, b
    place = np.empty(len(x), dtype=np.int64)
    place[entry] = np.arange(len(x))
    by = np.lexsort((ids, place[group]))
    counts = np.bincount(place[group], minlength=len(x))
    stop = np.cumsum(sizes)
    return {
        "x": x[entry].astype(vectors.dtype), "ids": ids[by], "owner": np.concatenate([[0], np.cumsum(counts)]), "start": stop - sizes, "stop": stop,
        "path": path, "low": low, "high": high, "vantage": full[vantage] if vantage else np.zeros((0, full.shape[1])), "top": np.array([top]),
    }


def _better(tree: dict[str, np.ndarray], who: np.ndarray, at: np.ndarray, exact: np.ndarray, best: np.ndarray, best_at: np.ndarray) -> None:
    """Put candidates (query, entry, score) in their place among each query's best: by score, then the smallest id."""
    rows = np.unique(who)
    held = best.shape[1]
    who = np.concatenate([np.repeat(rows, held), who])
    at = np.concatenate([best_at[rows].ravel(), at])
    exact = np.concatenate([best[rows].ravel(), exact])
    first = np.where(at >= 0, tree["ids"][tree["owner"][np.maximum(at, 0)]], np.iinfo(np.int64).max)
    by = np.lexsort((first, -exact, who))
    start = np.searchsorted(who[by], rows)
    top = by[(start[:, None] + np.arange(held)[None, :]).ravel()]
    best[rows], best_at[rows] = exact[top].reshape(-1, held), at[top].reshape(-1, held)


def search(tree: dict[str, np.ndarray], q_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) of the k best in the shard for each query, ties to smaller ids.

    A leaf's scores come from a matrix product; those within its rounding of the worst
    held are computed anew, one by one, and only these count. A query holds k + 1 entries (one
    may be itself), the ones with the smallest ids among equal scores.
    """
    x = tree["x"].astype(np.float64)
    q = queries.astype(np.float64)
    n_q, held = len(q), k + 1
    q_norm = (q * q).sum(axis=1)
    top = float(tree["top"][0])
    v = tree["vantage"]
    to_vantage = np.sqrt(np.maximum(0, q_norm[:, None] + (v * v).sum(axis=1)[None, :] - 2 * q @ v[:, :-1].T)) if len(v) else np.zeros((n_q, 1))
    bound = np.zeros((n_q, len(tree["start"])))
    for j in range(tree["path"].shape[1]):
        node = tree["path"][:, j]
        d = to_vantage[:, np.maximum(node, 0)]
        gap = np.maximum(d - tree["high"][:, j], tree["low"][:, j] - d)
        np.maximum(bound, np.where(node >= 0, gap, 0), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full((n_q, held), -np.inf)
    best_at = np.full((n_q, held), -1, dtype=np.int64)
    live = np.arange(n_q)
    slack = 1e-7 * (np.sqrt(q_norm) + np.sqrt(top) + 1)
    rounding = 4 * x.shape[1] * np.finfo(np.float64).eps * np.sqrt(q_norm * top)
    for turn in range(order.shape[1]):
        leaf = order[live, turn]
        kth = np.sqrt(np.maximum(0, q_norm[live] + top - 2 * best[live, -1]))
        go = bound[live, leaf] * factor <= kth + slack[live]
        live, leaf = live[go], leaf[go]
        if not len(live):
            break
        by = np.argsort(leaf, kind="stable")
        edges = np.flatnonzero(np.diff(leaf[by])) + 1
        for rows in np.split(by, edges):
            a, b = int(tree["start"][leaf[rows[0]]]), int(tree["stop"][leaf[rows[0]]])
            who = live[rows]
            row, at = np.nonzero(q[who] @ x[a:b].T >= (best[who, -1] - rounding[who])[:, None])
            if len(row):
                row, at = who[row], at + a
                exact = np.concatenate([(x[at[i : i + _PAIRS]] * q[row[i : i + _PAIRS]]).sum(axis=1) for i in range(0, len(row), _PAIRS)])
                _better(tree, row, at, exact, best, best_at)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    owner, ids = tree["owner"], tree["ids"]
    for i in range(n_q):
        at = best_at[i][best_at[i] >= 0]
        if not len(at):
            continue
        n = owner[at + 1] - owner[at]
        vec = np.concatenate([ids[owner[t] : owner[t + 1]] for t in at])
        score = np.repeat(best[i][: len(at)], n)
        other = vec != q_ids[i]
        vec, score = vec[other], score[other]
        first = np.lexsort((vec, -score))[:k]
        out.append((np.full(len(first), q_ids[i]), vec[first], score[first]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``v``, ``dim`` of rows with an id and a finite, non-zero vector without nulls."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good).withColumn("dim", F.size("v"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def build_index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``dim``, ``shard``, ``tree``: a stored tree a shard of about ``shard_rows`` rows."""
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).withColumn("shards", F.ceil(F.col("n") / shard_rows)).drop("n")
    dealt = rows.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))

    def make(key, table):
        dim, shard, shards = (x.as_py() for x in key)
        tree = build(table["vec_id"].to_numpy(), _matrix(table["v"], dim), k)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "shards": pa.array([shards], pa.int64()), "tree": pa.array([_pack(**tree)], pa.binary())})

    return dealt.groupBy("dim", "shard", "shards").applyInArrow(make, "dim int, shard int, shards long, tree binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Each query's k nearest by inner product: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``queries`` has the columns of ``vectors``; a query's own id is no
    candidate. Scores are in double precision on the vectors as given; ties go
    to the smaller id. Vectors null, zero, or with null or non-finite components
    take no part on either side, nor do null ids; vectors of another length
    are never candidates. A repeated query id is searched once, and a
    repeated candidate id is found once, with its best score. Empty tables
    give no rows; other columns are not read.
    """
    prepare(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    index = save(build_index(rows, k, shard_rows))
    asked = usable(queries, id_col, vector_col).dropDuplicates(["vec_id"])
    blocks = max(1, -(-asked.count() // QUERY_ROWS))

    def block(key, table):
        dim, number = (x.as_py() for x in key)
        data = _pack(ids=table["vec_id"].to_numpy(), v=_matrix(table["v"], dim))
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([number], pa.int32()), "asked": pa.array([data], pa.binary())})

    dealt = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(blocks)).cast("int"))
    packed = dealt.groupBy("dim", "block").applyInArrow(block, "dim int, block int, asked binary")
    shards = index.select("dim", F.col("shards")).distinct()
    packed = save(packed.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), (F.col("shards") - 1).cast("int")))).drop("shards"))
    tasks = packed.join(index.drop("shards"), ["dim", "shard"])

    def find(table):
        parts = []
        for tree, data in zip(table["tree"].to_pylist(), table["asked"].to_pylist(), strict=True):
            q = _unpack(data)
            parts.append(search(_unpack(tree), q["ids"], q["v"], k, factor))
        a, b, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    found = tasks.groupBy("dim", "shard", "block").applyInArrow(find, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
