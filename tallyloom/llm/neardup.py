"""Near-duplicate groups by SuperMinHash, banding, verification and union-find (operator 6).

1. A pass over the texts gives every document its shingle set's size, a 128-bit
   key of the set, and a SuperMinHash signature cut into bands. Signatures are
   made level by level for a whole batch: at level j each element has one rank
   ``j + r`` for one place of its own random permutation, and a document stops
   as soon as no later level could lower any place.
2. Documents with equal sets are one class; the smallest id stands for it. Only
   representatives go on, so thousands of copies cost one row each.
3. Representatives that share a band are compared with the smallest of that
   bucket (a star, never all pairs), on full sets, and take the smallest
   label over verified links.
4. Members of a bucket that still have different labels are compared with
   each other if they share a second band too: as pairs where few
   share both bands, else in blocks of the family that such buckets form, where
   a matrix product of each pair of blocks gives the links and no
   pair is ever a row. Two documents at the
   threshold share two of the 32 bands but for a chance of about one in a
   million, while those that share just a passage rarely do.
5. Links are united by large-star and small-star rounds, each written to the
   shared scratch folder; nothing about documents reaches the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import distinct, free_shuffles, hub_join, mix, pieces, prepare, save, shingles, small_side, text_buffer, words

BANDS, ROWS = 32, 4
_GOLD = 0x9E3779B97F4A7C15
_U = np.uint64
#: Members of a bucket that are compared as pairs; those of larger ones, by blocks.
FEW, BLOCK = 16, 1024
#: Elements times places that one step of signature making may hold.
_CELLS = 8_000_000


def superminhash(elements: np.ndarray, row: np.ndarray, n_rows: int, places: int) -> np.ndarray:
    """Signatures (rows x places) of sets given as distinct hashes and rows.

    A value holds the level in its top byte and the 56-bit rank below it, so
    values order as level + rank. Empty sets keep the largest value throughout.
    """
    out = np.full(n_rows * places, np.iinfo(np.uint64).max, dtype=np.uint64)
    live, at, perm = elements, row, None
    for level in range(places):
        if not len(live):
            break
        salt = (2 * level + 1) * _GOLD
        rank = mix(live + _U(salt & (1 << 64) - 1)) >> _U(8) | _U(level << 56)
        pick = mix(live + _U(salt + _GOLD & (1 << 64) - 1))
        k = (level + (pick >> _U(32)).astype(np.int64) % (places - level)).astype(np.int64)
        if perm is None:
            place = k
        else:
            each = np.arange(len(live))
            place = perm[each, k].astype(np.int64)
            perm[each, k] = perm[each, level]
        np.minimum.at(out, at * places + place, rank)
        most = out.reshape(n_rows, places).max(axis=1)
        open_rows = most >= _U(level + 1 << 56)
        stay = open_rows[at]
        if perm is None:
            live, at, k = live[stay], at[stay], k[stay]
            perm = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(live), 1))
            perm[np.arange(len(live)), k] = 0
        elif not stay.all():
            live, at, perm = live[stay], at[stay], perm[stay]
    return out.reshape(n_rows, places)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, distinct shingle hashes, their row) of runs of rows."""
    buf, off = text_buffer(column)
    for a, b in pieces(off):
        part, edges = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        h, row, _, _ = words(part, edges)
        s, at = shingles(h, row, b - a, width)
        u, at = distinct(s, at, b - a)
        yield a, b - a, u, at


def _keys(u: np.ndarray, where: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit keys of each set, whose elements end at ``where``."""
    out = []
    for salt in (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(u ^ salt), dtype=np.uint64)])
        out.append(mix(total[where[1:]] - total[where[:-1]] + np.diff(where).astype(np.uint64)).view(np.int64))
    return out


def signatures(docs: DataFrame, width: int = 2, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``key1``, ``key2`` and the band hashes (null if the set is empty)."""
    prepare(docs.sparkSession)
    places = bands * rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, u, at in _sets(batch.column(1), width):
                count = np.bincount(at, minlength=n)
                step = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(count) // max(1, _CELLS // places)])))
                sig = np.empty((n, places), dtype=np.uint64)
                edge = [0, *(step + 1).tolist(), n]
                where = np.concatenate([[0], np.cumsum(count)])
                for a, b in zip(edge, edge[1:], strict=False):
                    if b > a:
                        sig[a:b] = superminhash(u[where[a] : where[b]], at[where[a] : where[b]] - a, b - a, places)
                band = np.zeros((n, bands), dtype=np.uint64)
                for k in range(rows):
                    band = mix(band * _U(0xD6E8FEB86659FD93) + sig.reshape(n, bands, rows)[:, :, k])
                band = mix(band + np.arange(1, bands + 1, dtype=np.uint64) * _U(_GOLD))
                keys = _keys(u, where)
                flat = pa.array(band.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), flat, mask=pa.array(count == 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(count, pa.int64()), pa.array(keys[0]), pa.array(keys[1]), lists],
                    names=["doc_id", "n_shingles", "key1", "key2", "bands"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(work, "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>")


def shingle_sets(docs: DataFrame, width: int = 2) -> DataFrame:
    """``doc_id``, the two keys of its full shingle set, and that set as an ascending array of 64-bit hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, u, at in _sets(batch.column(1), width):
                edges = np.searchsorted(at, np.arange(n + 1))
                keys = _keys(u, edges)
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(u.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(keys[0]), pa.array(keys[1]), lists], names=["doc_id", "key1", "key2", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, key1 long, key2 long, shingles array<long>")


def _sets_of(pairs: DataFrame, source: DataFrame, width: int) -> DataFrame:
    """Full sets of the documents in pairs, one row for each set of an id."""
    ids = save(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    sets = shingle_sets(source.join(small_side(ids), "doc_id", "left_semi"), width)
    return save(sets.dropDuplicates(["doc_id", "key1", "key2"]).select("doc_id", "shingles"))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * |A and B| >= percent * |A or B| on full sets, those of an a with many pairs in several tasks."""
    left = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    both = hub_join(pairs.join(left, "b"), right, "a", "b", pairs)
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return both.where(common * 100 >= union * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of edges (a, b).

    Alternating large-star and small-star rounds (Kiveris et al. 2014), until every
    node hangs on one root; each round's edges are written to the shared scratch
    folder. The driver sees one count a round.
    """
    now = save(edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct())
    while True:
        roles = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("child")), F.struct(F.col("v").alias("node"), F.lit(0).alias("child")))).alias("r")).select("r.*")
        uneven = roles.groupBy("node").agg(F.sum("child").alias("up"), F.min("child").alias("root")).where("up > 1 or up = 1 and root = 0")
        if uneven.isEmpty():
            break
        both = save(now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = hub_join(both, low, "u", "v").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = save(small.where("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _families(many: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """Links across labels in families, the components of buckets with many members.

    A family is cut into blocks, and each pair of blocks is a task of its own that
    compares their sets by a matrix product and returns the links alone.
    """
    family = components(many.select("a", "b"))
    labels = many.groupBy(F.col("b").alias("rep")).agg(F.min("label").alias("label"))
    member = save(family.join(labels, F.col("node") == F.col("rep")).select("component", "rep", "label"))
    size = member.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sets = _sets_of(member.select(F.col("rep").alias("a"), F.col("rep").alias("b")), source, width)
    rows = member.join(size, "component").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own"), "rep", "label", "shingles")

    def compare(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        own, rep, label = table["own"].to_numpy(), table["rep"].to_numpy(), table["label"].to_numpy()
        lists = table["shingles"].combine_chunks()
        a, b = links_between(lists, np.flatnonzero(own == i), np.flatnonzero(own == j), label, percent)
        return pa.table({"a": pa.array(np.minimum(rep[a], rep[b]), pa.int64()), "b": pa.array(np.maximum(rep[a], rep[b]), pa.int64())})

    return rows.groupBy("component", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def links_between(lists: pa.ListArray, left: np.ndarray, right: np.ndarray, label: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of linked sets, one of each side, with different labels."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    size = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    _, code, n = np.unique(flat, return_inverse=True, return_counts=True)
    common = n[code] > 1  # others are in no intersection
    code, row = code[common], row[common]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    code = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]])) if len(code) else code
    place_l, place_r = np.full(len(size), -1), np.full(len(size), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    step = 4096
    edges = np.searchsorted(code, np.arange(0, (int(code[-1]) if len(code) else 0) + step + 1, step))
    for k in range(len(edges) - 1):
        c, r = code[edges[k] : edges[k + 1]] - k * step, row[edges[k] : edges[k + 1]]
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        on = place_l[r] >= 0
        x[place_l[r[on]], c[on]] = 1
        on = place_r[r] >= 0
        y[place_r[r[on]], c[on]] = 1
        both += x @ y.T
    union = size[left][:, None] + size[right][None, :] - both
    a, b = np.nonzero((both * 100 >= union * percent) & (label[left][:, None] != label[right][None, :]))
    return left[a], right[b]


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked if ``100 * |A and B| >= percent * |A or B|`` on
    their sets of ``width``-word shingles (A-Z lower-cased; words are runs without
    space and \\x09-\\x0D; fewer words: the whole sequence is the one shingle).
    ``component_id`` is the smallest id reachable over links, ``kept`` tells
    whether that is the row's own. Null and empty texts, or texts without words,
    have an empty set and stand alone. A null id takes part in no group and is
    kept. Each row has its own text's set; rows with the same id, whatever their texts, are of one
    component, which a link of any of them joins. An empty table gives an empty result.
    Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = save(signatures(source, width, bands, rows))
    full = sig.where("n_shingles > 0 and doc_id is not null")
    reps = save(full.groupBy("key1", "key2").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")))
    flat = reps.select("rep", "n", F.explode("bands").alias("band"))
    first = F.min(F.struct("rep", "n")).alias("first")
    shared = flat.groupBy("band").agg(first, F.count("*").alias("m")).where("m > 1").select("band", F.col("first.rep").alias("leader"), F.col("first.n").alias("na"))
    buckets = save(flat.join(shared, "band"))
    free_shuffles(spark)

    near = f"100 * least(n, na) >= {int(percent)} * greatest(n, na)"
    star = save(buckets.where("rep <> leader").where(near).select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct())
    links = save(verify(star, _sets_of(star, source, width), percent))
    free_shuffles(spark)

    # Two hops towards the smallest leader label most of a component alike; what they miss costs a pair, not a link.
    hop = save(links.groupBy("b").agg(F.min("a").alias("a")))
    label = hop.alias("x").join(small_side(hop).alias("y"), F.col("x.a") == F.col("y.b"), "left").select(F.col("x.b").alias("node"), F.coalesce("y.a", "x.a").alias("label"))
    labelled = buckets.join(small_side(save(label)), F.col("rep") == F.col("node"), "left").select("band", "rep", F.coalesce("label", "rep").alias("label"))
    torn = save(labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band"))
    rest = save(labelled.join(small_side(torn), "band", "left_semi"))
    second = reps.join(small_side(rest), "rep").select("rep", "n", "label", "band", F.explode("bands").alias("other")).where("band <> other")
    low, high = F.least("band", "other"), F.greatest("band", "other")
    keyed = save(second.select(F.xxhash64(low, high).alias("key"), low.alias("low"), high.alias("high"), "rep", "n", "label").distinct())
    mixed = keyed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), F.min("low").alias("low"), F.min("high").alias("high"))
    mixed = save(mixed.where("lo <> hi").select("key", "m", "low", "high"))
    few = keyed.join(small_side(mixed.where(F.col("m") <= FEW)), "key", "left_semi")
    right = few.select("key", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("label").alias("other"))
    pairs = few.join(right, "key").where((F.col("a") < F.col("rep")) & (F.col("other") != F.col("label"))).where(near)
    pairs = save(pairs.select("a", F.col("rep").alias("b")).distinct())
    more = verify(pairs, _sets_of(pairs, source, width), percent)
    crowded = mixed.where(F.col("m") > FEW).select(F.explode(F.array("low", "high")).alias("band")).distinct()
    crowded = save(crowded)
    many = save(rest.join(small_side(crowded), "band", "left_semi"))
    heads = save(many.groupBy("band").agg(F.min("rep").alias("a")))
    many = many.join(small_side(heads), "band").select("a", F.col("rep").alias("b"), "label").distinct()
    if not many.isEmpty():
        more = more.unionByName(_families(many, source, width, percent))
    key = F.struct("key1", "key2")
    several = save(full.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("doc_id"))
    if not several.isEmpty():  # an id with several sets joins their classes
        rows_of = full.join(small_side(several), "doc_id", "left_semi").select("doc_id", "key1", "key2").distinct()
        more = more.unionByName(rows_of.join(reps, ["key1", "key2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    final = save(components(links.unionByName(more)))

    named = F.col("n_shingles") > 0
    classes = reps.select(F.col("key1").alias("k1"), F.col("key2").alias("k2"), "rep")
    member = sig.select("doc_id", "n_shingles", "key1", "key2").join(classes, named & F.col("doc_id").isNotNull() & (F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2")), "left")
    out = member.join(small_side(final), F.col("rep") == F.col("node"), "left")
    group = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
sn AS (SELECT doc_id, sh, n FROM s JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sn a JOIN sn b ON a.sh = b.sh AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.comp FROM r JOIN l ON r.doc = l.a),
c AS (SELECT doc, min(comp) AS comp FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, comp AS component_id, doc_id = comp AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.doc = doc_id
"""
