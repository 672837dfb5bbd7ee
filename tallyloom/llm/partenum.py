"""N-gram Jaccard join by PartEnum signatures, and its classes (operator 12).

Two sets with Jaccard similarity p differ by at most k = (1 - p) / (1 + p) of the sum of their sizes.

1. Documents with equal shingle sets are one class; only its smallest id goes on.
2. Sizes are cut into bands. A set belongs to the instance of its band, and as a guest to that of the band
   below where it could have partners there, so partners always share an instance.
3. An instance partitions the domain of shingles, by a hash, into groups and each group into three cells.
   Of any floor(k / 2) + 1 groups one has at most one difference between partners, so two of its cells are
   equal. A signature is a group, two of its cells and all of a set's shingles there: the three subsets of two cells are
   enumerated. Groups are taken in one order for all sets, up to the (floor(k / 2) + 1)-th that is rich, which has
   shingles in two cells at least: the first group that is rich in either of two partners and has at most one
   difference is within reach of both, and what they share there isn't empty. Sets of small
   bands have each shingle for a group of its own, of which the first k + 1 are taken.
4. A set without enough rich groups (the hash decides, so hardly any) would break the argument: where one occurs, all sets of
   that instance get signatures of single shingles too. Thus no link can be missed.
5. Signatures are range-sorted with ids, so that frequent ones are dealt over tasks, and equal runs read off. Each member of
   a run is compared with the first, on full sets, unless the counts of parts of the domain (256 and more) differ by too much already. Runs whose members these links, followed to their ends, don't unite are
   compared further: short ones as pairs. Near copies share many long runs, mostly with the same first member, so long runs with one first member are one crowd, where each member comes once: a few
   strangers are compared with all others, else all by blocks with their counts, where only pairs that may be partners are rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import discard, free_shuffles, hub_join, mix, prepare, save, small_side
from .neardup import BLOCK, _keys, _sets, components

_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15
#: Members of a run that are compared as pairs, and strangers of a crowd that are compared with all others.
FEW = 16
#: Sizes below this are in bands whose groups are single shingles.
SMALL = 64
#: Parts of the domain whose elements are counted for each set, to tell pairs that can't be partners: at least and at most.
COUNTED, FINEST = 256, 8192
#: Counts that one step of their comparison may hold.
_CELLS = 8_000_000
#: Rows of two numbers in an Arrow batch.
WIDE_ROWS = 1 << 16
_SUBSETS = ((0, 1), (0, 2), (1, 2))


def most_differences(size, percent: int):
    """Most differences between a set of this size and any partner."""
    return (100 - percent) * (size + size * 100 // percent) // (100 + percent)


def band_edges(percent: int) -> np.ndarray:
    """The least size of each band; a band ends at sqrt(2) times it."""
    return np.unique(np.floor(2.0 ** (np.arange(0, 126) / 2)).astype(np.int64))


def instances(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The instance of each size and the one where it is a guest (-1 for none)."""
    edges = band_edges(percent)
    own = np.searchsorted(edges, size, side="right") - 1
    guest = np.where((own > 0) & (size * percent <= 100 * (edges[own] - 1)), own - 1, -1)
    return own, guest


def groups_of(instance: np.ndarray, percent: int) -> np.ndarray:
    """Groups of an instance: enough for its largest sets to have rich ones to spare; 0 for single shingles."""
    edges = band_edges(percent)
    k = most_differences((edges[instance + 1] - 1) * 100 // percent, percent)
    return np.where(edges[instance] < SMALL, 0, 2 * k // 3 + 1)


def _singles(x, at, n_rows, size, k, instance, chosen):
    """(row, signature): the first k + 1 shingles of each chosen row in the order of their hashes."""
    mine = chosen[at]
    x, at = x[mine], at[mine]
    order = np.lexsort((x, at))
    x, at = x[order], at[order]
    first = np.searchsorted(at, np.arange(n_rows))
    keep = np.arange(len(at)) - first[at] <= k[at]
    x, at = x[keep], at[keep]
    return at, mix(x + (instance[at].astype(np.uint64) * _U(2) + _U(1)) * _U(_GOLD))


def _grouped(x, u, at, n_rows, k, instance, n_groups, chosen):
    """(row, signature) of subsets of two cells of groups, and which rows have too few rich groups."""
    poor = np.zeros(n_rows, dtype=bool)
    mine = chosen[at]
    x, u, at = x[mine], u[mine], at[mine]
    if not len(at):
        return at, np.zeros(0, np.uint64), poor
    n1 = n_groups[at].astype(np.uint64)
    group = ((x >> _U(32)) * n1 >> _U(32)).astype(np.int64)
    cell = ((x & _U(0xFFFFFFFF)) * _U(3) >> _U(32)).astype(np.int64)
    wide = int(n_groups.max()) + 1
    code = (at * wide + group) * 3 + cell
    order = np.argsort(code, kind="stable")
    code, value = code[order], mix(u[order] + _U(0x452821E638D01377))
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    total, code = np.add.reduceat(value, start), code[start]
    where, index = np.unique(code // 3, return_inverse=True)
    held = np.zeros((len(where), 3), dtype=np.uint64)
    held[index, code % 3] = mix(total)
    row, group = where // wide, where % wide
    rich = (held != 0).sum(axis=1) >= 2
    before = np.cumsum(rich) - rich
    first = np.searchsorted(row, np.arange(n_rows))
    before -= np.concatenate([before, [0]])[np.minimum(first, len(before))][row]
    need = k // 2 + 1
    n_rich = np.bincount(row, weights=rich, minlength=n_rows)
    poor = chosen & (n_rich < need)
    keep = before < need[row]
    held, row, group = held[keep], row[keep], group[keep]
    salt = mix(instance[row].astype(np.uint64) * _U(_GOLD) + group.astype(np.uint64))
    rows, out = [], []
    for i, (a, b) in enumerate(_SUBSETS):
        some = (held[:, a] != 0) | (held[:, b] != 0)
        rows.append(row[some])
        out.append(mix(held[some, a] * _U(0xD6E8FEB86659FD93) + mix(held[some, b] + _U(i + 1)) + salt[some]))
    return np.concatenate(rows), np.concatenate(out), poor


def signatures_of(u: np.ndarray, at: np.ndarray, n_rows: int, percent: int, only: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(row, signature) of sets given as distinct hashes and rows, and (row, instance) where a set has too few rich groups.

    ``only``: signatures of single shingles in these instances instead.
    """
    size = np.bincount(at, minlength=n_rows)
    k = most_differences(size, percent)
    rows, out, poor = [], [], []
    for role, instance in enumerate(instances(np.maximum(size, 1), percent)):
        there = (instance >= 0) & (k > 0)
        instance = np.maximum(instance, 0)
        n_groups = groups_of(instance, percent)
        x = mix(u ^ _U(0xA4093822299F31D0))
        if only:
            got = [_singles(x, at, n_rows, size, k, instance, there & np.isin(instance, only))]
        else:
            row, sig, few = _grouped(x, u, at, n_rows, k, instance, n_groups, there & (n_groups > 0))
            poor += [(r, int(instance[r])) for r in np.flatnonzero(few)]
            got = [(row, sig), _singles(x, at, n_rows, size, k, instance, there & (n_groups == 0))]
        rows += [g[0] for g in got]
        out += [g[1] for g in got]
    row, sig = np.concatenate(rows), np.concatenate(out)
    order = np.argsort(row, kind="stable")
    return row[order], sig[order], poor


def parts_of(size: np.ndarray) -> np.ndarray:
    """Parts whose elements are counted for sets of these sizes: doubled until a part has two elements at most. In coarser parts differences cancel out."""
    return np.minimum(COUNTED << np.maximum(np.ceil(np.log2(np.maximum(size, 1) / (2 * COUNTED))), 0).astype(np.int64), FINEST)


def counts_of(u: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A byte for each part of each set (255 for more)."""
    parts = parts_of(size)
    edges = np.concatenate([[0], np.cumsum(parts)])
    shift = (64 - np.log2(parts).astype(np.int64)).astype(np.uint64)
    n = np.minimum(np.bincount(edges[at] + (u >> shift[at]).astype(np.int64), minlength=edges[-1]), 255).astype(np.uint8).tobytes()
    return [n[i:j] for i, j in zip(edges, edges[1:], strict=False)]


def _folded(counts: list[bytes], parts: int) -> np.ndarray:
    """Counts of so many parts, made of counts of as many or more."""
    out = np.empty((len(counts), parts), dtype=np.int16)
    length = np.array([len(c) for c in counts], dtype=np.int64)
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        held = np.frombuffer(b"".join(counts[i] for i in rows.tolist()), dtype=np.uint8).reshape(len(rows), parts, n // parts)
        out[rows] = held.sum(axis=2, dtype=np.int16)
    return out


def may_link(counts: list[bytes], size: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows x and y, pair by pair, differ by no more elements than partners may, in parts as fine as both have."""
    good = np.zeros(len(x), dtype=bool)
    length = np.array([len(c) for c in counts], dtype=np.int64)
    both = np.minimum(length[x], length[y])
    for parts in np.unique(both):
        pairs = np.flatnonzero(both == parts)
        used, place = np.unique(np.concatenate([x[pairs], y[pairs]]), return_inverse=True)
        held = _folded([counts[i] for i in used.tolist()], int(parts))
        left, right = place[: len(pairs)], place[len(pairs) :]
        step = max(1, _CELLS // int(parts))
        for i in range(0, len(pairs), step):
            a, b = left[i : i + step], right[i : i + step]
            total = size[used[a]] + size[used[b]]
            good[pairs[i : i + step]] = np.abs(held[a] - held[b]).sum(axis=1, dtype=np.int64) <= (100 - percent) * total // (100 + percent)
    return good


def set_keys(source: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``n_shingles`` and a 128-bit key of each document's set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, u, at in _sets(batch.column(1), width):
                edges = np.searchsorted(at, np.arange(n + 1))
                one, two = _keys(u, edges)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.diff(edges), pa.int64()), pa.array(one), pa.array(two)], names=["doc_id", "n_shingles", "key1", "key2"])

    return source.mapInArrow(work, "doc_id long, n_shingles long, key1 long, key2 long")


def signatures(source: DataFrame, width: int, percent: int, only: tuple[int, ...] = ()) -> DataFrame:
    """``rep``, ``n``, its key, ``sigs``, ``poor`` (instances) and ``counts`` of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, u, at in _sets(batch.column(1), width):
                where = np.searchsorted(at, np.arange(n + 1))
                one, two = _keys(u, where)
                row, sig, poor = signatures_of(u, at, n, percent, only)
                counts = counts_of(u, at, np.diff(where))
                lists = [[] for _ in range(n)]
                for r, t in poor:
                    lists[r].append(t)
                edges = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(np.diff(where), pa.int64()), pa.array(one), pa.array(two), pa.ListArray.from_arrays(edges, pa.array(sig.view(np.int64))), pa.array(lists, pa.list_(pa.int32())), pa.array(counts, pa.binary())],
                    names=["rep", "n", "key1", "key2", "sigs", "poor", "counts"],
                )

    return source.mapInArrow(work, "rep long, n long, key1 long, key2 long, sigs array<long>, poor array<int>, counts binary")


@contextmanager
def _wide(spark: SparkSession):
    """Large Arrow batches for rows of a few numbers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, WIDE_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, old)


_RUNS = "sig long, members array<long>, sizes array<long>"


def _runs(few: int):
    """Runs of equal signatures of a range in order.

    Short runs are lists (sig null). Members of a long one are a row each, beside its first member. Those of the range's first run, and of its last (or the first
    member of a long last one), are rows of their own, as the run may go on in other ranges.
    """

    def lists(sig, rep, n, edges):
        edges = pa.array(np.asarray(edges, dtype=np.int32))
        columns = [pa.ListArray.from_arrays(edges, pa.array(v)) for v in (rep, n)]
        return pa.RecordBatch.from_arrays([pa.nulls(len(edges) - 1, pa.int64()) if sig is None else pa.array(sig), *columns], names=["sig", "members", "sizes"])

    def alone(sig, rep, n):
        return lists(sig, rep, n, np.arange(len(sig) + 1))

    def beside(sig, rep, n, first, first_n):
        return lists(sig, np.stack([first, rep], axis=1).ravel(), np.stack([first_n, n], axis=1).ravel(), np.arange(len(sig) + 1) * 2)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.zeros(0, np.int64)] * 3
        held, apart, head = none, None, None  # apart: a run that is passed on as it comes; head: its first member, unless the run is the range's first
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            if apart is None:
                apart = held[0][0]
            start = np.flatnonzero(np.concatenate([[True], held[0][1:] != held[0][:-1]]))
            length = np.diff(np.append(start, len(held[0])))
            open_at = start[-1]  # the last run may go on
            start, length = start[:-1], length[:-1]
            known = held[0][start] == apart
            first, first_n = held[1][start].copy(), held[2][start].copy()
            if head is not None:
                first[known], first_n[known] = head
            single = known & (head is None)
            mark = np.repeat(single, length)
            if mark.any():
                yield alone(*[h[:open_at][mark] for h in held])
            long = ((length > few) | known) & ~single
            mark = np.repeat(long, length)
            if mark.any():
                yield beside(*[h[:open_at][mark] for h in held], np.repeat(first[long], length[long]), np.repeat(first_n[long], length[long]))
            short = ~long & ~single & (length > 1)
            if short.any():
                mark = np.repeat(short, length)
                yield lists(None, *[h[:open_at][mark] for h in held[1:]], np.concatenate([[0], np.cumsum(length[short])]))
            held = [h[open_at:] for h in held]
            if len(held[0]) > few or held[0][0] == apart:
                if held[0][0] != apart:
                    apart, head = held[0][0], (held[1][0], held[2][0])
                yield alone(*held) if head is None else beside(*held, np.full(len(held[0]), head[0]), np.full(len(held[0]), head[1]))
                held = none
        if len(held[0]):
            yield alone(*held)
        elif head is not None:
            yield alone(np.array([apart]), np.array([head[0]]), np.array([head[1]]))

    return work


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ids have different labels; an id without one is its own."""
    for c in ("a", "b"):
        pairs = pairs.join(small_side(labels).select(F.col("node").alias(f"_n{c}"), F.col("component").alias(f"_l{c}")), F.col(c) == F.col(f"_n{c}"), "left").drop(f"_n{c}")
    return pairs.where(F.coalesce("_la", "a") != F.coalesce("_lb", "b")).select("a", "b")


def _sets_beside(docs: DataFrame, width: int) -> DataFrame:
    """``a``, ``b`` and the shingle set of ``text``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, u, at in _sets(batch.column(2), width):
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(n + 1)).astype(np.int32)), pa.array(u.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), lists], names=["a", "b", "shingles"])

    return docs.select("a", "b", "text").mapInArrow(work, "a long, b long, shingles array<long>")


def _possible(pairs: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b; saved) that differ by no more elements than partners may, as far as the counts of parts tell: no partner is lost."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size = np.concatenate([batch.column(2).to_numpy(), batch.column(4).to_numpy()])
            good = may_link(batch.column(3).to_pylist() + batch.column(5).to_pylist(), size, np.arange(n), np.arange(n, 2 * n), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    ids = save(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    counts = counts.join(small_side(ids), "rep", "left_semi")
    side = lambda c: counts.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("counts").alias(f"c{c}"))
    both = hub_join(pairs.join(side("b"), "b"), side("a"), "a", "b", pairs).select("a", "b", "na", "ca", "nb", "cb")
    return both.mapInArrow(work, "a long, b long").distinct()


def _in_crowds(rows: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (``head``, ``b``, ``label``; saved) of one crowd with different labels that may be partners.

    Members come with their counts and never as pairs: a crowd is cut into blocks of BLOCK, and each pair of blocks is compared in a task.
    """
    size = rows.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    held = rows.join(small_side(save(size)), "head").withColumn("own", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    members = save(rows.select(F.col("b").alias("rep")).distinct())
    held = held.join(counts.join(small_side(members), "rep", "left_semi").withColumnRenamed("rep", "b"), "b").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select("head", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "b", "label", "n", "counts")

    def compare(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        own, rep, label, n = (table[c].to_numpy() for c in ("own", "b", "label", "n"))
        parts = table["counts"].to_pylist()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found = []
        for at in range(0, len(left), 32):
            some = left[at : at + 32]
            small, large = np.minimum(n[some][:, None], n[right][None]), np.maximum(n[some][:, None], n[right][None])
            x, y = np.nonzero((label[some][:, None] != label[right][None]) & (100 * small >= percent * large) & ((i != j) | (rep[some][:, None] < rep[right][None])))
            x, y = some[x], right[y]
            good = may_link(parts, n, x, y, percent)
            found.append(np.stack([np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])])[:, good])
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return held.groupBy("head", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _verified(pairs: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b; saved) that are links on full sets.

    The set of b is made where its text is read and travels to a once, with a beside it; nothing else of it is kept or sent.
    """
    heads = save(pairs.select("a").distinct())
    left = _sets_beside(source.join(small_side(pairs), F.col("doc_id") == F.col("b")), width).withColumnRenamed("shingles", "sb")
    right = _sets_beside(source.join(small_side(heads), F.col("doc_id") == F.col("a")).withColumn("b", F.col("a")), width).select("a", F.col("shingles").alias("sa"))
    both = hub_join(left, right, "a", "b", pairs)
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b").distinct()


def _links(reps: DataFrame, source: DataFrame, width: int, percent: int, only: tuple[int, ...] = ()) -> DataFrame:
    """Verified links between representatives by the signatures in ``reps``, enough of them to unite each class.

    ``reps`` is deleted once its signatures are dealt.
    """
    spark = reps.sparkSession
    near = f"100 * least(na, nb) >= {int(percent)} * greatest(na, nb)"
    flat = reps.select(F.explode("sigs").alias("sig"), "rep", "n")
    counts = save(reps.select("rep", "n", "counts"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _wide(spark):
        runs = save(flat.repartitionByRange(parts, "sig", "rep").sortWithinPartitions("sig", "rep").mapInArrow(_runs(FEW), _RUNS))
    discard(reps)
    free_shuffles(spark)
    lists = save(runs.where("sig is null").groupBy("members").agg(F.first("sizes").alias("sizes")))
    long = runs.where("size(members) = 2 and sig is not null").select("sig", *[F.col(c)[i].alias(n) for n, c, i in (("b", "members", 1), ("nb", "sizes", 1), ("a", "members", 0), ("na", "sizes", 0))])
    single = runs.where("size(members) = 1 and sig is not null").select("sig", F.col("members")[0].alias("b"), F.col("sizes")[0].alias("nb"))
    heads = single.groupBy("sig").agg(F.min(F.struct("b", "nb")).alias("h"), F.count("*").alias("m")).where("m > 1").select("sig", F.col("h.b").alias("a"), F.col("h.nb").alias("na"))
    many = save(long.unionByName(save(hub_join(single, save(heads), "sig", "b"))).select("a", "na", "b", "nb").distinct())
    others = lambda c: F.slice(c, F.lit(2), F.size(c) - 1)
    star = lists.select(F.col("members")[0].alias("a"), F.col("sizes")[0].alias("na"), F.explode(F.arrays_zip(others("members").alias("m"), others("sizes").alias("s"))).alias("o"))
    star = star.select("a", "na", F.col("o.m").alias("b"), F.col("o.s").alias("nb")).unionByName(many.where("a <> b").select("a", "na", "b", "nb"))
    star = save(star.where(near).select("a", "b").distinct())
    # Each with its smallest leader first; the other leaders only where that leaves the two apart.
    star = save(_possible(star, counts, percent))
    tree = save(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = save(_verified(tree, source, width, percent))
    free_shuffles(spark)
    other = save(_apart(star.join(tree, ["a", "b"], "left_anti"), save(components(links))))
    links = save(links.unionByName(_verified(other, source, width, percent)))
    labels = save(components(links))
    free_shuffles(spark)

    # Pairs of short runs that the links so far leave apart.
    each = lists.where("size(members) > 2").select("members", "sizes", F.explode(F.sequence(F.lit(2), F.size("members") - 1)).alias("i"))
    each = each.select(F.col("members")[F.col("i") - 1].alias("a"), F.col("sizes")[F.col("i") - 1].alias("na"), F.explode(F.arrays_zip(F.slice("members", F.col("i") + 1, F.size("members")).alias("m"), F.slice("sizes", F.col("i") + 1, F.size("members")).alias("s"))).alias("o"))
    pairs = each.select("a", "na", F.col("o.m").alias("b"), F.col("o.s").alias("nb")).where(near).select("a", "b").distinct()
    pairs = _apart(pairs, labels)

    # Crowds, the long runs of one first member: strangers to its largest class are compared with all others if they are few, else all by blocks.
    member = many.join(small_side(labels).select(F.col("node").alias("_n"), "component"), F.col("b") == F.col("_n"), "left").select(F.col("a").alias("head"), "b", "nb", F.coalesce("component", "b").alias("label"))
    member = save(member)
    sizes = member.groupBy("head", "label").agg(F.count("*").alias("c")).groupBy("head").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top"))
    torn = save(sizes.where("m > top.c").select("head", "m", F.col("top.c").alias("c"), F.col("top.label").alias("label")))
    mild = save(torn.where(F.col("m") - F.col("c") <= FEW).select("head", F.col("label").alias("main")))
    strangers = member.join(small_side(mild), "head").where(F.col("label") != F.col("main")).select("head", F.col("b").alias("x"), F.col("nb").alias("nx"), F.col("label").alias("lx"))
    met = hub_join(member.join(small_side(mild.select("head")), "head", "left_semi"), strangers, "head", "b", member).where((F.col("b") != F.col("x")) & (F.col("label") != F.col("lx")))
    met = met.withColumnRenamed("nx", "na").where(near).select(F.least("b", "x").alias("a"), F.greatest("b", "x").alias("b"))
    pairs = _possible(save(pairs.unionByName(met).distinct()), counts, percent)
    wild = save(torn.where(F.col("m") - F.col("c") > FEW).select("head"))
    if not wild.isEmpty():
        crowd = save(member.join(small_side(wild), "head", "left_semi").select("head", "b", "label"))
        pairs = pairs.unionByName(_in_crowds(crowd, counts, percent)).distinct()
    pairs = save(pairs)
    more = _verified(pairs, source, width, percent)
    return save(links.unionByName(more))


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of the n-gram Jaccard join: ``doc_id``, ``n_shingles``, ``component_id`` and ``n_texts``.

    Documents are linked if ``100 * |A and B| >= percent * |A or B|`` on their sets of ``width``-word shingles (A-Z
    lower-cased; words are runs without space and \\x09-\\x0D; with fewer words the whole sequence is the one shingle).
    ``component_id`` is the smallest id reachable over links, ``n_texts`` the number of different sets in the class. Null
    and empty texts and texts without words have an empty set and stand alone, and so does a row with a null id. Rows with
    one id are of one class, whatever their texts. An empty table gives an empty result. Other columns are not read.
    ``percent`` must be 75 to 100: a partner is then in the same band or the next.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent must be 75 to 100")
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = save(set_keys(source, width))
    full = keys.where("n_shingles > 0 and doc_id is not null")
    classes = save(full.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep")))
    # Sets whose size allows no difference have no other partner.
    able = f"{100 - percent} * (n_shingles + n_shingles * 100 div {percent}) >= {100 + percent}"
    own = save(classes.join(full.where(able).select("key1", "key2").distinct(), ["key1", "key2"]).select(F.col("rep").alias("_rep"), F.col("key1").alias("_k1"), F.col("key2").alias("_k2")))
    chosen = source.join(small_side(own.select("_rep")), F.col("doc_id") == F.col("_rep"), "left_semi")

    def signed(only: tuple[int, ...] = ()) -> DataFrame:
        # An id may have several texts; its class's representative is the one with the class's key.
        found = signatures(chosen, width, percent, only)
        held = found.join(small_side(own), (F.col("rep") == F.col("_rep")) & (F.col("key1") == F.col("_k1")) & (F.col("key2") == F.col("_k2")), "left_semi")
        return save(held.groupBy("key1", "key2", "rep").agg(F.first("n").alias("n"), F.first("sigs").alias("sigs"), F.first("poor").alias("poor"), F.first("counts").alias("counts"))) if several else save(held)

    several = not full.groupBy("doc_id").count().where("count > 1").isEmpty()
    reps = signed()
    bare = sorted(r[0] for r in reps.select(F.explode("poor").alias("t")).distinct().collect())  # some hundred instances at most
    links = _links(reps, source, width, percent)
    if bare:
        links = links.unionByName(_links(signed(tuple(bare)), source, width, percent))
    if several:  # an id with several sets joins their classes
        links = links.unionByName(full.select("doc_id", "key1", "key2").distinct().join(classes, ["key1", "key2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    final = save(components(links))

    named = F.col("n_shingles") > 0
    held = classes.select(F.col("key1").alias("k1"), F.col("key2").alias("k2"), "rep").join(small_side(final), F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("group"))
    held = save(held)
    texts = held.groupBy("group").agg(F.count("*").alias("n_texts"))
    held = held.join(small_side(save(texts)), "group")
    out = keys.join(small_side(save(held.select("k1", "k2", "group", "n_texts"))), named & F.col("doc_id").isNotNull() & (F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2")), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("group", "doc_id").alias("component_id"), F.coalesce("n_texts", F.lit(1)).alias("n_texts"))


#: SQL of the join over ``documents``.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS k FROM s GROUP BY 1),
t AS (SELECT k, any_value(n) AS n, min(doc_id) AS rep FROM n GROUP BY 1),
sn AS (SELECT rep, sh, n FROM s JOIN t ON s.doc_id = t.rep),
p AS (SELECT a.rep AS a, b.rep AS b FROM sn a JOIN sn b ON a.sh = b.sh AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(x, y) AS (SELECT rep, rep FROM t UNION SELECT l.b, r.y FROM r JOIN l ON r.x = l.a),
c AS (SELECT x AS rep, min(y) AS comp FROM r GROUP BY 1),
m AS (SELECT comp, count(*) AS n_texts FROM c GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp, doc_id) AS component_id, coalesce(n_texts, 1) AS n_texts FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN t USING (k) LEFT JOIN c ON c.rep = t.rep LEFT JOIN m USING (comp)
"""
