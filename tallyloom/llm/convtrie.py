"""Conversation prefix trie by sorting, adjacent common prefixes and a stack sweep (operator 11).

1. Turns become 16-byte digests of (role, text) and conversations arrays of these, joined
   into one binary key with the code points of each turn beside it. Texts go no further.
2. Conversations are sorted globally by (key, conv_id): ranges of both, so that equal
   conversations, however many, are dealt over several ranges.
3. A sweep over each range takes the common prefix of each row with the one before
   (LCP) and keeps the stack of open nodes. A node that the next row doesn't share is
   closed: its counts are added to its parent's and it is a row of the result. Nodes on the
   path of the range's first or last row may go on in other ranges; they stay open
   and leave the sweep as two paths with what each open node has gathered.
4. Open stacks are stitched by the same sweep over these paths, in the order of the ranges, some
   hundreds at a time, until one stack is left.
5. The parent's ``conv_id`` is known once the parent is closed: within one pop at once, else by a join of one row a pop.

Conversations that end at an open node are hashed after the sweep, in order, from chunks of their joined
ids, streamed; a SHA-256 has no other way.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import free_shuffles, hub_join, prepare, save

#: Bytes of a turn's digest, most turns that a conversation takes from its base, and conversations that share one.
DIGEST, HEAD, SHARING = 16, 5, 100
#: Rows of a range, ranges whose open stacks are stitched by one task, ids of a chunk of ends.
RANGE_ROWS, STITCH, CHUNK = 200_000, 256, 50_000
_EMPTY = hashlib.sha256().hexdigest()
_STATS = ("n", "least", "children", "leaves", "saved", "ended")
_OUT = (
    "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node_a long, node_b long, up_a long, up_b long, "
    "part long, side int, key binary, lens array<int>, first long, n array<long>, least array<long>, children array<long>, leaves array<long>, saved array<long>, ended array<long>, ids string"
)
_FIELDS = [f.strip().split(" ") for f in _OUT.split(",")]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in _FIELDS])
NODE, PATH, ENDS = 0, 1, 2


def turn_arrays(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id`` and ``turns``, an array of (digest ``d``, code points ``n``) in order of turn, null first.

    Equal turns stand in order of role and then of the digest, so repeated rows are repeated turns. Null roles and
    texts are empty. Rows without a conv_id belong to no conversation.
    """
    who, what = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, what)))
    row = F.struct(F.col(turn).isNotNull().alias("k"), F.col(turn).alias("t"), who.alias("r"), digest.alias("d"), F.length(what).alias("n"))
    rows = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), row.alias("row"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("row")), lambda x: F.struct(x["d"].alias("d"), x["n"].alias("n"))).alias("turns"))


def rebuilt(arrays: DataFrame) -> DataFrame:
    """Conversations with their first turns taken from the base conversation, ``conv_id - conv_id % 100``.

    ``h`` is the CRC-32 of the decimal conv_id modulo 6: the base's first h turns (fewer if it has fewer, none if it
    is absent), then the conversation's own turns after its first h.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    heads = arrays.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, HEAD).alias("_head"))
    own = arrays.withColumn("_base", F.col("conv_id") - F.col("conv_id") % SHARING).withColumn("_h", h)
    both = own.join(heads, "_base", "left")
    none = F.slice("turns", 1, 0)
    first = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), none)
    return both.select("conv_id", F.concat(first, F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))).alias("turns"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their start."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[: high * DIGEST] == b[: high * DIGEST]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * DIGEST : mid * DIGEST] == b[low * DIGEST : mid * DIGEST]:
            low = mid
        else:
            high = mid
    return low


class _Node:
    """An open node and what it has gathered from closed ones below it and from rows that end at it."""

    __slots__ = ("n", "least", "children", "leaves", "saved", "ended", "ids", "name")

    def __init__(self):
        self.n = self.children = self.leaves = self.saved = self.ended = 0
        self.least, self.ids, self.name = None, None, None

    def add(self, n, least, children, leaves, saved, ended) -> None:
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved
        self.ended += ended
        if least is not None and (self.least is None or least < self.least):
            self.least = least


class Sweep:
    """Sweep over rows in order of key; ``last`` closes every node at the end, else both outer paths stay open.

    ``add`` takes a row's key, the code points of its turns, and what nodes from depth ``first`` on
    have gathered; ``end`` is the conv_id of a conversation that ends at the key. Rows of the result are in ``out``.
    """

    def __init__(self, part: int, last: bool = False, stitching: bool = False):
        self.part, self.last, self.stitching, self.out = part, last, stitching, []
        self.stack: list[_Node] = []
        self.key: bytes | None = None
        self.lens: list[int] = []
        self.path: tuple[bytes, list[int], list] | None = None  # of the first row: what its open nodes have gathered
        self.spine = -1  # depth down to which the stack is on the first row's path

    def _name(self, depth: int, node: _Node) -> tuple[int, int]:
        if node.name is None:
            d = hashlib.blake2b(self.key[: depth * DIGEST], digest_size=16, person=b"depth" + depth.to_bytes(8, "little")).digest()
            node.name = int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
        return node.name

    def _stats(self, node: _Node) -> tuple:
        return tuple(getattr(node, s) for s in _STATS)

    def _ends(self, depth: int, node: _Node) -> None:
        """Ids that end at an open node, in chunks for the hash that follows the sweep."""
        if node.ids:
            a, b = self._name(depth, node)
            for i in range(0, len(node.ids), CHUNK):
                self.out.append({"kind": ENDS, "node_a": a, "node_b": b, "part": self.part, "side": i // CHUNK, "ids": ",".join(map(str, node.ids[i : i + CHUNK]))})
            node.ids = None

    def _pop(self, depth: int) -> None:
        """Close nodes deeper than ``depth``."""
        waiting = None
        for d in range(len(self.stack) - 1, depth, -1):
            node = self.stack.pop()
            if d <= self.spine:  # it may go on in other ranges
                self._ends(d, node)
                self.path[2][d] = self._stats(node)
                if waiting is not None:
                    waiting["up_a"], waiting["up_b"] = self._name(d, node)
                    waiting = None
                continue
            if not node.children:
                node.leaves += 1
            if d:
                node.saved += (node.n - 1) * self.lens[d - 1]
            row = {"kind": NODE, "conv_id": node.least, "depth": d, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}
            if not node.ended:
                row["ends_sha256"] = _EMPTY
            elif node.ids is not None and len(node.ids) == node.ended:
                row["ends_sha256"] = hashlib.sha256(",".join(map(str, node.ids)).encode()).hexdigest()
            if self.stitching or node.name is not None:
                row["node_a"], row["node_b"] = self._name(d, node)
            if waiting is not None:
                waiting["parent_conv_id"] = node.least
            waiting = row if d else None
            self.out.append(row)
            if d:
                self.stack[d - 1].add(node.n, node.least, 1, node.leaves, node.saved, 0)
        if waiting is not None:
            waiting["up_a"], waiting["up_b"] = self._name(depth, self.stack[depth])

    def add(self, key: bytes, lens: list[int], first: int, stats: list[tuple], end: int | None = None) -> None:
        depth = len(lens)
        if self.key is None:
            self.stack.append(_Node())
            if not self.last:
                self.path, self.spine = (key, lens, [None] * (depth + 1)), depth
        else:
            shared = common_turns(self.key, key)
            self._pop(shared)
            self.spine = min(self.spine, shared)
        while len(self.stack) <= depth:
            self.stack.append(_Node())
        self.key, self.lens = key, lens
        for d, s in enumerate(stats, first):
            self.stack[d].add(*s)
        if end is not None:
            node = self.stack[depth]
            if node.ids is None:
                node.ids = array("q")
            node.ids.append(end)

    def finish(self) -> None:
        """Close all, or hand on the two open paths."""
        if self.key is None:
            return
        if self.last:
            self._pop(-1)
            return
        for d, node in enumerate(self.stack):
            self._ends(d, node)
        mine = [self._stats(x) for x in self.stack]
        shared = self.spine + 1
        key, lens, gathered = self.path
        self.out.append(self._path(0, key, lens, 0, mine[:shared] + gathered[shared:]))
        if len(mine) > shared:
            self.out.append(self._path(1, self.key, self.lens, shared, mine[shared:]))

    def _path(self, side: int, key: bytes, lens: list[int], first: int, stats: list[tuple]) -> dict:
        lists = {s: [x[i] for x in stats] for i, s in enumerate(_STATS)}
        return {"kind": PATH, "part": self.part, "side": side, "key": key, "lens": lens, "first": first} | lists


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _given(sweep: Sweep, least: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of a sweep's rows so far, if there are ``least``."""
    if len(sweep.out) >= least:
        for i in range(0, len(sweep.out), 4096):
            yield pa.RecordBatch.from_pylist(sweep.out[i : i + 4096], schema=_SCHEMA)
        sweep.out = []


def _sweep_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = Sweep(TaskContext.get().partitionId())
    for batch in batches:
        for conv, key, lens in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            sweep.add(key, lens, len(lens), [(1, conv, 0, 0, 0, 1)], end=conv)
        yield from _given(sweep)
    sweep.finish()
    yield from _given(sweep, 1)


def _stitch(last: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = None
        for batch in batches:
            for row in batch.to_pylist():
                if sweep is None or sweep.part != row["part"]:
                    if sweep is not None:
                        sweep.finish()
                        yield from _given(sweep, 1)
                    sweep = Sweep(row["part"], last, stitching=True)
                sweep.add(row["key"], row["lens"], row["first"], list(zip(*[row[s] for s in _STATS], strict=True)))
            yield from _given(sweep)
        if sweep is not None:
            sweep.finish()
            yield from _given(sweep, 1)

    return work


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each node over its chunks, which come in order and are not kept."""
    now, sha, done = None, None, []
    for batch in batches:
        for a, b, ids in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if now != (a, b):
                if sha is not None:
                    done.append((*now, sha.hexdigest()))
                now, sha = (a, b), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if len(done) > 4096:
            yield _hashes(done)
            done = []
    if sha is not None:
        done.append((*now, sha.hexdigest()))
    yield _hashes(done)


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"ea": a, "eb": b, "sha": s} for a, b, s in rows], schema=pa.schema([("ea", pa.int64()), ("eb", pa.int64()), ("sha", pa.string())]))


def prefix_trie(conversations: DataFrame, ranges: int | None = None) -> DataFrame:
    """Nodes of the trie of conversations (``conv_id``, unique, and ``turns`` as of ``turn_arrays``).

    A node for each distinct sequence of first turns, the empty one included: ``conv_id`` (the smallest member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``
    (of the comma-joined ids of conversations that end there). No conversations, no nodes. Turns are told apart
    by 128 bits of their digest. A conversation is a row of some 24 bytes a turn, and one task holds one at a time.
    """
    spark = conversations.sparkSession
    prepare(spark)
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["d"])), ""))
    rows = save(conversations.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["n"]).alias("lens")))
    parts = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    dealt = rows.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    # One job draws the bounds, deals the rows and sweeps them, so open paths always belong to these ranges.
    swept = [save(dealt.mapInArrow(_sweep_range, _OUT))]
    while len(swept) == 1 or parts > 1:
        parts = -(-parts // STITCH)
        paths = swept[-1].where(F.col("kind") == PATH).withColumns({"order": F.col("part"), "part": F.floor(F.col("part") / STITCH)})
        paths = paths.repartition(parts, "part").sortWithinPartitions("part", "order", "side").drop("order")
        swept.append(save(paths.mapInArrow(_stitch(parts == 1), _OUT)))
    free_shuffles(spark)

    own = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = reduce(DataFrame.unionByName, [s.where(F.col("kind") == NODE).select(*own, "node_a", "node_b", "up_a", "up_b") for s in swept])
    chunks = swept[0].where(F.col("kind") == ENDS).select("node_a", "node_b", "ids", "part", "side")
    hashed = chunks.repartition("node_a").sortWithinPartitions("node_a", "node_b", "part", "side").drop("part", "side").mapInArrow(_hash_ends, "ea long, eb long, sha string")
    open_ends = nodes.where("ends_sha256 is null").join(hashed, (F.col("node_a") == F.col("ea")) & (F.col("node_b") == F.col("eb"))).withColumn("ends_sha256", F.col("sha")).drop("ea", "eb", "sha")
    nodes = nodes.where("ends_sha256 is not null").unionByName(open_ends)
    names = nodes.where("node_a is not null").select(F.col("node_a").alias("up_a"), F.col("node_b").alias("_b"), F.col("conv_id").alias("_parent"))
    waiting = hub_join(nodes.where("up_a is not null"), names, "up_a", "conv_id").where("up_b = _b").withColumn("parent_conv_id", F.col("_parent"))
    return nodes.where("up_a is null").select(*own).unionByName(waiting.select(*own))


#: SQL of the trie over ``conversations``. CRC-32 is taken bit by bit.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT DISTINCT c, c - c % 100 AS b, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda u, v: list_reduce(list_prepend(xor(u, v), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h FROM t),
a AS (SELECT h.c, 0 AS o, i, r, x FROM h JOIN t ON t.c = h.b AND t.i <= h.h UNION ALL SELECT h.c, 1, i, r, x FROM h JOIN t ON t.c = h.c AND t.i > h.h),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY o, i) AS i, {'r': r, 'x': x} AS k, length(x) AS l FROM a),
s AS (SELECT c, list(k ORDER BY i) AS k, list(l ORDER BY i) AS l FROM n GROUP BY 1),
w AS (SELECT h.c, coalesce(k, []) AS k, coalesce(l, []) AS l FROM h LEFT JOIN s USING (c)),
p AS (SELECT c, d, k[:d] AS p, CASE WHEN d > 0 THEN l[d] ELSE 0 END AS l, d = len(k) AS e FROM (SELECT *, unnest(range(0, len(k) + 1)) AS d FROM w)),
g AS (SELECT p, d AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(l) AS own, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE e), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
u AS (SELECT p[:depth - 1] AS p, depth - 1 AS depth, count(*) AS n FROM g WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT g.*, coalesce(u.n, 0) AS n_children FROM g LEFT JOIN u ON u.depth = g.depth AND u.p = g.p),
z AS (SELECT p[:k] AS p, k AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM f) GROUP BY 1, 2)
SELECT f.conv_id, f.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, z.n_leaves, z.saved_tokens, f.ends_sha256
FROM f JOIN z ON z.depth = f.depth AND z.p = f.p LEFT JOIN f q ON f.depth > 0 AND q.depth = f.depth - 1 AND q.p = f.p[:f.depth - 1]
"""
