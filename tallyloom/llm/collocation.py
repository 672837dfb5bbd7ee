"""Phrase collocations by position bitmaps (operator 13), as in SPAM (Ayres et al. 2002).

1. Documents are cut into shards of some megabytes, at ends of pieces. Every word occurrence of a shard
   has a position; one position is left out between pieces, so nothing reaches over it.
2. A word of a shard is a compressed bitmap of its positions: chunks of 16 bits, of which only those with a bit
   set are kept, ordered by word. A phrase is extended by a word as follows: the phrase's bitmap (of its last positions) is shifted by one, carries
   going to the next chunk, and ANDed with the bitmaps of the words that have bits in the same chunks; popcounts give the
   occurrences. Words of one slice of prefixes are extended to pairs and these to triples before the next slice.
3. Popcounts are summed over shards. A first pass counts words and hashed pairs. Pairs that occur often enough
   set bits of a table of bounded size; the second pass extends only pairs whose bits are set, to triples whose second pair
   has its bit set too. False hits of that table cost rows, and the sums leave them out, so any size is exact.
4. Scores, cuts and longer phrases are joins of the counted phrases; frequent words are dealt over several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import LOWER, free_shuffles, give_back, hub_join, mix, prepare, save, text_buffer, words

#: Bytes of a shard's texts, chunks extended at once, bits of a chunk.
SHARD_BYTES, SLICE, BITS = 2 << 20, 1 << 14, 16
#: The table of frequent pairs: bits a pair, most bits in all (16 MB), bits of one of its blocks.
BITS_A_PAIR, MOST_BITS, BLOCK_BITS = 16, 1 << 27, 1 << 18
#: Parts of a language that are ranked before the language is.
RANKED_PARTS = 16
UNKNOWN = "und"

_U = np.uint64
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
_SPACE = _BREAK.copy()
_SPACE[[0x20, 0x09]] = True


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0xD6E8FEB86659FD93) + mix(b + _U(0x9E3779B97F4A7C15)))


class Bitmaps:
    """Compressed position bitmaps of the words of a shard: (word, chunk, mask), by word and by chunk."""

    def __init__(self, word: np.ndarray, position: np.ndarray):
        chunk = position // BITS
        n = int(chunk[-1]) + 2 if len(chunk) else 1
        code = word * n + chunk
        order = np.argsort(code, kind="stable")
        code = code[order]
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        bit = (np.uint16(1) << (position % BITS).astype(np.uint16))[order]
        self.mask = np.bitwise_or.reduceat(bit, start) if len(start) else np.zeros(0, np.uint16)
        self.word, self.chunk = np.divmod(code[start], n)
        by_chunk = np.argsort(self.chunk, kind="stable")
        self.first = np.searchsorted(self.chunk[by_chunk], np.arange(n + 1))
        self.there_word, self.there_mask = self.word[by_chunk], self.mask[by_chunk]

    def extend(self, prefix: np.ndarray, chunk: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """(prefix, word, chunk, mask) where the shifted bitmap of a prefix and a word's bitmap have bits in common."""
        carry = mask >> np.uint16(BITS - 1) != 0
        shifted = mask << np.uint16(1)
        stay = shifted != 0
        prefix = np.concatenate([prefix[stay], prefix[carry]])
        chunk = np.concatenate([chunk[stay], chunk[carry] + 1])
        mask = np.concatenate([shifted[stay], np.ones(int(carry.sum()), np.uint16)])
        low = self.first[chunk]
        count = self.first[chunk + 1] - low
        each = np.repeat(np.arange(len(prefix)), count)
        other = np.arange(len(each)) + np.repeat(low - (np.cumsum(count) - count), count)
        both = mask[each] & self.there_mask[other]
        hit = both != 0
        each, other = each[hit], other[hit]
        return prefix[each], self.there_word[other], chunk[each], both[hit]


def _totals(code: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the popcounts of their masks."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    bits = np.bitwise_count(mask[order]).astype(np.int64)
    return code[start], np.add.reduceat(bits, start) if len(start) else bits


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(bytes, offsets of texts, their languages), about SHARD_BYTES each. Longer texts are cut at ends of pieces."""
    held, size = [], 0

    def joined():
        buf = np.concatenate([b for b, _, _ in held])
        edges = np.concatenate([[0], *[o[1:] + at for (_, o, _), at in zip(held, np.cumsum([0] + [len(b) for b, _, _ in held]), strict=False)]])
        return buf, edges.astype(np.int64), [x for _, _, g in held for x in g]

    for batch in batches:
        buf, off = text_buffer(batch.column(0))
        langs = [UNKNOWN if x is None else x for x in batch.column(1).to_pylist()]
        row = 0
        while row < len(langs):
            last = max(row + 1, int(np.searchsorted(off, off[row] + SHARD_BYTES - size, side="right")) - 1)
            last = min(last, len(langs))
            part, edges = buf[off[row] : off[last]], off[row : last + 1] - off[row]
            if len(part) > SHARD_BYTES:  # one long text
                cuts = np.flatnonzero(_BREAK[part]) + 1
                at = 0
                while len(part) - at > SHARD_BYTES:
                    k = int(np.searchsorted(cuts, at + SHARD_BYTES, side="right")) - 1
                    k = k if k >= 0 and cuts[k] > at else k + 1
                    if k >= len(cuts):
                        break
                    yield part[at : cuts[k]], np.array([0, cuts[k] - at]), langs[row:last]
                    at = int(cuts[k])
                part, edges = part[at:], np.array([0, len(part) - at])
            held.append((part, edges, langs[row:last]))
            size += len(part)
            row = last
            if size >= SHARD_BYTES:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


class Shard:
    """The words of a shard: ids by language and word, and their bitmaps."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, langs: list[str]):
        h, row, self.start, self.end = words(buf, offsets, _SPACE)
        salts = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
        salt = np.array([salts[x] for x in langs], dtype=np.uint64)
        piece = np.cumsum(_BREAK[buf])[self.start] if len(h) else row
        new = np.ones(len(h), dtype=bool)
        new[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
        self.ids, self.at, word = np.unique(mix(h ^ salt[row]) if len(h) else h, return_index=True, return_inverse=True)
        self.row, self.langs, self.buf = row, langs, buf
        self.bitmaps = Bitmaps(word.astype(np.int64), np.arange(len(h)) + np.cumsum(new))

    def spelled(self) -> tuple[list[str], list[str]]:
        """Language and spelling of each id."""
        low = LOWER[self.buf].tobytes()
        return [self.langs[r] for r in self.row[self.at].tolist()], [low[a:b].decode() for a, b in zip(self.start[self.at].tolist(), self.end[self.at].tolist(), strict=True)]

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        b = self.bitmaps
        for i in range(0, len(b.word), SLICE):
            yield b.word[i : i + SLICE], b.chunk[i : i + SLICE], b.mask[i : i + SLICE]


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lang, word, n) of the words of a shard, and (hash, null, null, n) of its pairs."""
    names = ["id", "lang", "word", "n"]
    for buf, offsets, langs in _shards(batches):
        shard = Shard(buf, offsets, langs)
        v = len(shard.ids)
        if not v:
            continue
        word, n = _totals(shard.bitmaps.word, shard.bitmaps.mask)
        lang, spelled = shard.spelled()
        yield pa.RecordBatch.from_arrays([pa.array(shard.ids[word].view(np.int64)), pa.array(lang), pa.array(spelled), pa.array(n)], names=names)
        codes, bits = [], []
        for piece in shard.slices():
            a, b, _, mask = shard.bitmaps.extend(*piece)
            code, n = _totals(a * v + b, mask)
            codes.append(code)
            bits.append(n)
        code, n = np.concatenate(codes), np.concatenate(bits)
        order = np.argsort(code, kind="stable")
        code = code[order]
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        n = np.add.reduceat(n[order], start) if len(start) else n
        key = pair_hash(shard.ids[code[start] // v], shard.ids[code[start] % v]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.nulls(len(key), pa.string()), pa.nulls(len(key), pa.string()), pa.array(n.astype(np.int64))], names=names)
        del shard, codes, bits, code, n, order, start, key
        give_back()


def _count_phrases(table, bits: int):
    """(w1, w2, w3, n) of pairs and triples of a shard (w3 null: a pair) that the table of frequent pairs doesn't rule out."""

    def frequent(flags, a, b):
        slot = pair_hash(a, b) & _U(bits - 1)
        return flags[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8) & 1 != 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(table.value, dtype=np.uint8)
        for buf, offsets, langs in _shards(batches):
            shard = Shard(buf, offsets, langs)
            v, ids = len(shard.ids), shard.ids
            for piece in shard.slices():
                a, b, chunk, mask = shard.bitmaps.extend(*piece)
                pair, index = np.unique(a * v + b, return_inverse=True)
                often = frequent(flags, ids[pair // v], ids[pair % v])
                keep = often[index]
                index, chunk, mask = index[keep], chunk[keep], mask[keep]
                code, n = _totals(index, mask)
                yield _phrases(ids, pair[code] // v, pair[code] % v, None, n)
                p, c, _, mask = shard.bitmaps.extend(index, chunk, mask)
                code, n = _totals(p * v + c, mask)
                w1, w2, w3 = pair[code // v] // v, pair[code // v] % v, code % v
                keep = frequent(flags, ids[w2], ids[w3]) if len(code) else np.zeros(0, bool)
                yield _phrases(ids, w1[keep], w2[keep], w3[keep], n[keep])
            del shard
            give_back()

    return work


def _phrases(ids, w1, w2, w3, n) -> pa.RecordBatch:
    third = pa.nulls(len(n), pa.int64()) if w3 is None else pa.array(ids[w3].view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(ids[w1].view(np.int64)), pa.array(ids[w2].view(np.int64)), third, pa.array(n.astype(np.int64))], names=["w1", "w2", "w3", "n"])


def _table_of(pairs: DataFrame) -> tuple[bytes, int]:
    """The bits of pairs (``id``), and how many there are: a power of two, MOST_BITS at most."""
    n, bits = pairs.count(), 1 << 16
    while bits < min(BITS_A_PAIR * n, MOST_BITS):
        bits *= 2
    wide = min(bits, BLOCK_BITS)
    slot = F.col("id").bitwiseAND(F.lit(bits - 1))

    def block(key, table):
        at = table["slot"].to_numpy() % wide
        flags = np.zeros(wide, dtype=np.uint8)
        flags[at] = 1
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "flags": pa.array([np.packbits(flags, bitorder="little").tobytes()])})

    rows = pairs.select(slot.alias("slot"), (slot / wide).cast("long").alias("block")).distinct().groupBy("block").applyInArrow(block, "block long, flags binary").collect()
    out = bytearray(bits // 8)
    for r in rows:
        out[r["block"] * wide // 8 : (r["block"] + 1) * wide // 8] = r["flags"]
    return bytes(out), bits


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact."""
    d = [c.cast("decimal(18,0)") for c in (a, left, right)]
    return F.call_function("div", d[0] * d[0] * F.lit(1_000_000).cast("decimal(7,0)"), d[1] * d[2])


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, covered: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Phrases of two and three words that occur more often than their parts let expect.

    Returns ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``, each language's first ``top``. Texts (A-Z lower-cased;
    null is empty) are cut into pieces at ``. , ; : ! ?`` and \\x0A-\\x0D, pieces into words at spaces and tabs. A null language is ``und``.
    Candidates occur ``least`` times (a) within pieces. A cut gives l and r, the occurrences of both parts, and
    floor(1000000 a a / (l r)); the lowest counts, of equal ones the first. Candidates inside a longer one that has ``covered`` percent of their
    occurrences are left out. Ranks are by score and a, descending, then by the phrase's bytes. Repeated rows are counted as often
    as they occur; an empty table gives an empty result. Words are told apart by 64 bits of a hash. Counts up to 10^15 are exact.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = source.mapInArrow(_count_pairs, "id long, lang string, word string, n long").groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))
    counted = save(counted.where(f"lang is not null or n >= {int(least)}"))
    free_shuffles(spark)
    table, bits = _table_of(counted.where("lang is null"))
    shared = spark.sparkContext.broadcast(table)
    phrases = source.mapInArrow(_count_phrases(shared, bits), "w1 long, w2 long, w3 long, n long").groupBy("w1", "w2", "w3").agg(F.sum("n").alias("a"))
    phrases = save(phrases.where(f"a >= {int(least)}"))
    free_shuffles(spark)

    spelled = save(counted.where(f"lang is not null and n >= {int(least)}"))
    side = lambda k: spelled.select(F.col("id").alias(f"w{k}"), *([F.col("lang")] if k == 1 else []), F.col("word").alias(f"x{k}"), F.col("n").alias(f"f{k}"))
    pairs = hub_join(phrases.where("w3 is null").drop("w3"), side(1), "w1", "w2")
    pairs = save(hub_join(save(pairs), side(2), "w2", "w1").withColumn("key", F.xxhash64("w1", "w2")))
    triples = phrases.where("w3 is not null").withColumn("key", F.xxhash64("w1", "w2"))
    one = pairs.select("key", F.col("w1").alias("p"), F.col("w2").alias("q"), "lang", "x1", "x2", "f1", F.col("a").alias("f12"))
    triples = save(hub_join(triples, one, "key", "w3").where("w1 = p and w2 = q").drop("p", "q").withColumn("key", F.xxhash64("w2", "w3")))
    two = pairs.select("key", F.col("w1").alias("p"), F.col("w2").alias("q"), F.col("x2").alias("x3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
    triples = save(hub_join(triples, two, "key", "w1").where("w2 = p and w3 = q").drop("p", "q"))

    longer = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("w1", "w2").agg(F.max("a").alias("most"))
    left = pairs.join(longer, ["w1", "w2"], "left").where(f"most is null or 100 * most < {int(covered)} * a")
    left = left.select("lang", F.concat_ws(" ", "x1", "x2").alias("phrase"), "a", F.struct(_score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f2").alias("r")).alias("c"))
    cuts = [F.struct(_score(F.col("a"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, x, y in ((1, "f1", "f23"), (2, "f12", "f3"))]
    both = left.unionByName(triples.select("lang", F.concat_ws(" ", "x1", "x2", "x3").alias("phrase"), "a", F.least(*cuts).alias("c")))
    order = [F.desc("c.score"), F.desc("a"), F.asc("phrase")]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    part = both.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS))).withColumn("_at", place("lang", "_part")).where(F.col("_at") <= top)
    ranked = part.withColumn("rank", place("lang").cast("long")).where(F.col("rank") <= top)
    total = counted.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").cast("long").alias("score"))


#: SQL of the collocations of ``documents``.
ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS ph, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(k))),
f AS (SELECT lang, k, ph, any_value(w1) AS w1, CASE WHEN k > 1 THEN any_value(w2) END AS w2, CASE WHEN k > 2 THEN any_value(w3) END AS w3, count(*) AS a FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
u AS (SELECT lang, k, ph, a, 1 AS j, w1 AS lp, CASE WHEN k = 2 THEN w2 ELSE w2 || ' ' || w3 END AS rp FROM c UNION ALL SELECT lang, k, ph, a, 2, w1 || ' ' || w2, w3 FROM c WHERE k = 3),
s AS (SELECT u.lang, u.k, u.ph, u.a, j, l.a AS l, r.a AS r, (1000000::HUGEINT * u.a * u.a) // (l.a::HUGEINT * r.a) AS score FROM u JOIN f l ON l.lang = u.lang AND l.ph = u.lp JOIN f r ON r.lang = u.lang AND r.ph = u.rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, k, ph ORDER BY score, j) = 1),
m AS (SELECT lang, ph, max(a) AS most FROM (SELECT lang, w1 || ' ' || w2 AS ph, a FROM c WHERE k = 3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM c WHERE k = 3) GROUP BY 1, 2),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, ph) AS rank, ph AS phrase, a, l, r, score::BIGINT AS score FROM b LEFT JOIN m USING (lang, ph) WHERE k = 3 OR most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
