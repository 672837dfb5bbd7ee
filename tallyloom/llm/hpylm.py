"""Language-model scores by a hierarchical Pitman-Yor model (operator 5).

The model is a chain of Chinese restaurants. Every previous word has a restaurant that seats
the training tokens after it (a text's first word follows its end); all of them share one
restaurant of words, whose customers are their tables; its parent spells words out, symbol by
symbol, in restaurants whose contexts are the last three, two, one and no symbols of the
word, each sharing the parent that drops the farthest symbol; the last parent is uniform.

Seating is sampled by Gibbs sweeps: the like customers of a restaurant leave together and come
back by the restaurant's rule, in runs of a 24th of those already back (one by one at
first), so the work grows with the log of their number. Draws come from hashes of
what is seated, so they depend neither on partitions nor on order. Predictive probabilities
are averaged over the kept seatings. Discounts are ``n1 / (n1 + 2 n2)`` of each level's counts.

Words and pairs of words are counted exactly over all training texts. Documents are dealt to blocks,
whose tokens stay in a file of the shared folder; what travels are packed messages between blocks
and buckets. A bucket has a range of the hashes of words and of pairs, adds up the
messages of all blocks, and answers each in the same order, so answers carry no keys. Of the
blocks that have a pair one owns it and counts its tables; the others draw the
same ones. No table of words or pairs is ever broadcast or collected, and a frequent word is one entry a block.
What the driver and every executor hold is the spelling model alone, bounded by 2**17 contexts of 64
symbols and sent as the rows of contexts that occurred.
"""

from __future__ import annotations

import pickle
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import discard, free_shuffles, give_back, mix, open_folder, prepare, save, scratch_dir
from .base import words as words_of
from .elias_fano import EliasFano

#: Tokens of a block of documents (a longer document is a block of its own).
BLOCK_TOKENS = 2_000_000
SYMBOLS, FAR = 64, 32
LEVELS = (1, SYMBOLS, SYMBOLS**2, SYMBOLS**2 * FAR)
OTHER = SYMBOLS - 1
THETA = 1.0
#: Probability that the parent of the word restaurant gives to the end of a text.
END_BASE = 1e-3
#: Seatings of words drawn before the first kept one, and kept ones; sweeps over spellings for each, and kept ones of these.
BURN, SAMPLES, SWEEPS, KEPT = 1, 2, 6, 3
#: Customers come in runs of this part of those seated; so many expected hits of a run are drawn exactly.
RUN, FEW_HITS = 24, 30
#: Bits of a pair's hash.
PAIR_BITS = 56
_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15


# --- seating -----------------------------------------------------------------


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each 64-bit key."""
    return ((mix(keys ^ mix(np.array([salt & (1 << 64) - 1], np.uint64))) >> _U(11)) + 0.5) / float(1 << 53)


def _binomial(m: np.ndarray, q: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How many of m draws hit with chance q, from uniform numbers: by adding up chances, or by the normal law where over FEW_HITS are expected."""
    mean = m * q
    out = np.floor(mean + np.sqrt(mean * (1 - q)) * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v) + 0.5)
    live = np.flatnonzero(mean <= FEW_HITS)
    out[live] = 0
    q, m, u = np.minimum(q[live], 1 - 1e-12), m[live], u[live]
    chance = np.exp(m * np.log1p(-q))
    total, k = chance.copy(), 0
    while (go := np.flatnonzero((total < u) & (k < m))).size:
        live, q, m, u, total = live[go], q[go], m[go], u[go], total[go]
        chance = chance[go] * (m - k) / (k + 1) * q / (1 - q)
        total += chance
        k += 1
        out[live] = k
    return np.clip(out, 0, None).astype(np.int64)


def seat(c: np.ndarray, p: np.ndarray, others: np.ndarray, d: float, keys: np.ndarray, salt: int) -> np.ndarray:
    """Tables of c like customers that come in again, by the restaurant's rule.

    ``p`` is their parent's probability, ``others`` the tables of other dishes. With n of them on t tables the
    next opens one with weight ``(THETA + d (others + t)) p`` and joins one with ``n - d t``. They come in runs of a
    RUN-th of those already seated, one by one at first; chances are the same within a run.
    """
    out = np.minimum(c, 1).astype(np.int64)
    live = np.flatnonzero(c > 1)
    # The most customers first: those still to come are of the first few then, so nothing is copied from turn to turn.
    less = -c[live].astype(np.int64)
    order = np.argsort(less, kind="stable")
    live, less = live[order], less[order]
    p, others, keys, t = p[live], others[live], keys[live], out[live]
    n, turn, k = 1, 0, len(live)
    while k:
        run = 1 + n // RUN
        a = (THETA + d * (others[:k] + t[:k])) * p[:k]
        q = a / (a + np.maximum(n - d * t[:k], 1e-9))
        u = _uniform(keys[:k], salt * 0x51ED2701 + turn * _GOLD)
        if run == 1:
            t[:k] += u < q
        else:
            m = np.minimum(run, -less[:k] - n)
            t[:k] += np.minimum(m, _binomial(m, q, u, _uniform(keys[:k], salt * 0x51ED2701 + turn * _GOLD + 1)))
        n += run
        k = int(np.searchsorted(less, -n))
        turn += 1
    out[live] = t
    return out


def discount(n1: int, n2: int) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


# --- spelling ----------------------------------------------------------------


def cells(words: pa.Array, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells (context of three symbols, next symbol) of spellings, and their word.

    Every word ends with symbol 0, which also stands before its beginning.
    """
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    off = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    n = np.diff(off)
    size = len(raw) + len(n)
    own = np.repeat(np.arange(len(n)), n + 1)
    s = np.zeros(size + 3, dtype=np.int64)
    inside = np.ones(size, dtype=bool)
    inside[off[1:] + np.arange(len(n))] = False
    s[3:][inside] = symbol[raw]
    place = np.arange(size) - (off[:-1] + np.arange(len(n)))[own]
    s1 = np.where(place >= 1, s[2 : size + 2], 0)
    s2 = np.where(place >= 2, s[1 : size + 1], 0)
    s3 = np.where(place >= 3, s[:size], 0)
    return ((s1 * SYMBOLS + s2) * FAR + s3 % FAR) * SYMBOLS + s[3:], own


@dataclass
class Spelling:
    """log10 of symbols' probabilities: by contexts of two, and of three where such a context occurred.

    A context without customers passes its parent's probabilities on, so it needs no row.
    """

    near: np.ndarray
    seen: np.ndarray
    far: np.ndarray

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each context of three, and all rows."""
        at = np.repeat(np.arange(len(self.near), dtype=np.int32), FAR)
        at[self.seen] = len(self.near) + np.arange(len(self.seen), dtype=np.int32)
        return at, np.concatenate([self.near, self.far])


def spelling(n_cells: np.ndarray, seed: int) -> Spelling:
    """Averaged predictive probabilities of spellings with these cell counts."""
    p = [np.full((k, SYMBOLS), 1 / SYMBOLS, dtype=np.float32) for k in LEVELS]
    up = (1, SYMBOLS, SYMBOLS, FAR)
    seen = np.flatnonzero(n_cells.reshape(LEVELS[3], SYMBOLS).any(axis=1))
    near, far = np.zeros((LEVELS[2], SYMBOLS)), np.zeros((len(seen), SYMBOLS))
    tables: list[np.ndarray | None] = [None] * len(LEVELS)
    for sweep in range(SWEEPS):
        c = n_cells
        kept = []
        for level in (3, 2, 1, 0):
            at = np.flatnonzero(c)
            own, sym, n = at // SYMBOLS, at % SYMBOLS, c[at].astype(np.int64)
            d = discount(int((n == 1).sum()), int((n == 2).sum()))
            base = (p[level - 1][own // up[level], sym] if level else np.full(len(at), 1 / SYMBOLS)).astype(np.float64)
            before = tables[level]
            others = np.bincount(own, before[at], LEVELS[level])[own] - before[at] if before is not None else np.zeros(len(at))
            t = seat(n, base, others, d, mix(at.astype(np.uint64) + _U(level << 40)), seed * 64 + sweep)
            tables[level] = np.zeros(LEVELS[level] * SYMBOLS, np.int32)
            tables[level][at] = t
            kept.append((level, at, n, t, d))
            if level:
                c = np.bincount(own // up[level] * SYMBOLS + sym, t, LEVELS[level - 1] * SYMBOLS)
        for level, at, n, t, d in reversed(kept):
            own = at // SYMBOLS
            customers, total = np.bincount(own, n, LEVELS[level]), np.bincount(own, t, LEVELS[level])
            back = ((THETA + d * total) / (THETA + customers)).astype(np.float32)
            parent = np.repeat(p[level - 1], up[level], axis=0) if level else np.full((1, SYMBOLS), 1 / SYMBOLS, np.float32)
            p[level] = parent * back[:, None]
            p[level].reshape(-1)[at] += ((n - d * t) / (THETA + customers[own])).astype(np.float32)
        if sweep >= SWEEPS - KEPT:
            near += p[2] / KEPT
            far += p[3][seen] / KEPT
    return Spelling(np.log10(near).astype(np.float32), seen.astype(np.int32), np.log10(far).astype(np.float32))


def base_log(words: pa.Array, symbol: np.ndarray, log_p: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Natural log of what the spelling model gives each word; the empty word is the end of a text."""
    cell, own = cells(words, symbol)
    at, rows = log_p
    value = rows[at[cell // SYMBOLS], cell % SYMBOLS].astype(np.float64)
    value[cell % SYMBOLS == OTHER] -= np.log10(256 - SYMBOLS + 2)
    out = np.bincount(own, value, len(words)) * np.log(10) + np.log(1 - END_BASE)
    end = np.asarray(pc.binary_length(words)) == 0
    return np.where(end, np.log(END_BASE), out)


# --- packed arrays and words -------------------------------------------------


def _pack(**values: np.ndarray | bytes | int) -> bytes:
    """Arrays in as few bytes as their largest value needs, bytes of like weight together, compressed."""

    def planes(v):
        if not isinstance(v, np.ndarray) or not len(v):
            return v
        if v.dtype.kind in "iu" and v.min() >= 0:
            v = v.astype(np.min_scalar_type(int(v.max())))
        raw = np.ascontiguousarray(v).view(np.uint8).reshape(len(v), -1)
        return v.dtype.str, b"".join(raw[:, k].tobytes() for k in range(raw.shape[1]))

    raw = pickle.dumps({k: planes(v) for k, v in values.items()}, protocol=5)
    return len(raw).to_bytes(8, "little") + bytes(pa.Codec("zstd", 1).compress(raw))


def _unpack(data: bytes) -> dict:
    def whole(v):
        if not isinstance(v, tuple):
            return v
        size = np.dtype(v[0]).itemsize
        raw = np.empty((len(v[1]) // size, size), np.uint8)
        for k, plane in enumerate(np.frombuffer(v[1], np.uint8).reshape(size, -1)):
            raw[:, k] = plane
        return raw.reshape(-1).view(v[0])

    raw = pickle.loads(pa.Codec("zstd", 1).decompress(data[8:], int.from_bytes(data[:8], "little")))
    return {k: whole(v) for k, v in raw.items()}


def _put(folder: str, data: bytes) -> str:
    """Write a file of its own in the folder; its name."""
    store, base = open_folder(folder)
    store.create_dir(base, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{base}/{name}") as out:
        out.write(data)
    return name


def _get(folder: str, name: str) -> bytes:
    store, base = open_folder(folder)
    with store.open_input_stream(f"{base}/{name}") as file:
        return file.read()


def _drop(folder: str) -> None:
    """Delete a folder of files that nothing reads any more (without documents there is none)."""
    store, base = open_folder(folder)
    store.create_dir(base, recursive=True)
    store.delete_dir(base)


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words without white space."""
    full = [w for w in words if w]
    raw = np.frombuffer(b" ".join(full), np.uint8)
    out = np.full(len(words), _GOLD, np.uint64)
    if full:
        out[[i for i, w in enumerate(words) if w] if len(full) < len(words) else slice(None)] = words_of(raw, np.array([0, len(raw)]))[0]
    return out


def _word_array(data: dict) -> pa.Array:
    return pa.array(data["words"].split(b"\n") if data["n"] else [], pa.large_binary())


def _pair_hash(h: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h[u] * _U(0xD6E8FEB86659FD93) + mix(h[w])) >> _U(64 - PAIR_BITS)


def _edges(buckets: int) -> np.ndarray:
    return np.array([(k << PAIR_BITS) // buckets for k in range(buckets)] + [1 << PAIR_BITS], np.uint64)


# --- blocks ------------------------------------------------------------------

_MESSAGES = "block long, bucket int, name string, state string, words binary, pairs binary"


def _blocks(batches: Iterator[pa.RecordBatch], folder: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """Deal documents to blocks; a row names each block's file, and rows of messages have its words and pairs for each bucket.

    A block's words are numbered by bucket, then hash. Its file has the tokens of all
    documents, one after the other, by how frequent they are; its first state has the words' hashes.
    """
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    docs: list[tuple] = []
    parts: list[np.ndarray] = []
    tokens = 0
    edges = _edges(buckets)

    def flush() -> pa.RecordBatch:
        nonlocal number, tokens
        listed, m, block = list(number), len(number), uuid.uuid4().int >> 66
        h = hashes(listed)
        bucket = (h % _U(buckets)).astype(np.int64)
        order = np.lexsort((h, bucket))
        rank = np.empty(m, np.int32)
        rank[order] = np.arange(m, dtype=np.int32)
        listed, h = [listed[i] for i in order.tolist()], h[order]
        ids = rank[np.concatenate(parts)]
        doc_id, held, size = zip(*docs, strict=True)
        size, held = np.array(size), np.array(held)
        out = np.repeat(held, size)
        c = np.bincount(ids[~out], minlength=m)
        code = _pair_codes(ids, m) * 2 + out
        found, times = np.unique(code, return_counts=True)
        pair = found >> 1
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        pair_c = np.add.reduceat(np.where(found & 1, 0, times), first)
        u, w = np.divmod(pair[first], m)
        key = _pair_hash(h, u, w)
        by = np.argsort(key)
        key, pair_c = key[by], pair_c[by]
        often = np.argsort(-np.bincount(ids, minlength=m), kind="stable")
        place = np.empty(m, np.int32)
        place[often] = np.arange(m, dtype=np.int32)
        name = _put(f"{folder}/tokens", _pack(ids=place[ids], often=often, size=size, held=held, doc_id=pickle.dumps(doc_id)))
        state = _put(f"{folder}/state", _pack(hashes=h))
        word_edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        pair_edge = np.searchsorted(key, edges)
        rows = [(block, -1, name, state, None, None)]
        for b in range(buckets):
            i, j = word_edge[b], word_edge[b + 1]
            k, l = pair_edge[b], pair_edge[b + 1]  # noqa: E741
            if i < j or k < l:
                mine = _pack(n=int(j - i), words=b"\n".join(listed[i:j]), c=c[i:j])
                rows.append((block, b, None, None, mine, _pack(keys=EliasFano.of(key[k:l].astype(np.int64)).to_bytes(), c=pair_c[k:l])))
        number = defaultdict(count().__next__)
        docs.clear()
        parts.clear()
        tokens = 0
        columns = list(zip(*rows, strict=True))
        types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in _MESSAGES.split(", ")])

    for batch in batches:
        for doc_id, text, held in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = (text or "").encode("utf-8", "surrogatepass").lower().split()
            found.append(b"")
            parts.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
            docs.append((doc_id, held, len(found)))
            tokens += len(found)
            if tokens >= BLOCK_TOKENS:
                yield flush()
                give_back()
    if docs:
        yield flush()
    give_back()


def _tokens(folder: str, name: str) -> dict:
    data = _unpack(_get(f"{folder}/tokens", name))
    return data | {"ids": data["often"].astype(np.int64)[data["ids"]]}


def _pair_codes(ids: np.ndarray, m: int) -> np.ndarray:
    """Each token's pair (previous word, word) as one number. A text ends with its end, so the next one's first word follows it."""
    end = ids[-1:]
    return np.concatenate([end, ids[:-1]]).astype(np.int64) * m + ids


_REDUCED = "block long, bucket int, words binary, pairs binary, vocabulary binary, tokens long, types long, n1 long, n2 long"


def _reduce(key: tuple, table: pa.Table) -> pa.Table:
    """Add up a bucket's messages: an answer for each block, and the bucket's vocabulary.

    A block gets its words' places in the vocabulary and counts, its pairs' counts and which of the pairs it owns.
    """
    blocks = table["block"].to_pylist()
    said = [_unpack(x) for x in table["words"].to_pylist()]
    pairs = [_unpack(x) for x in table["pairs"].to_pylist()]
    known = pa.concat_arrays([_word_array(x) for x in said]).dictionary_encode()
    place = known.indices.to_numpy()
    listed = known.dictionary.to_pylist()
    c = np.bincount(place, np.concatenate([x["c"] for x in said]), len(listed)).astype(np.int64)
    codes = [EliasFano.from_bytes(x["keys"])[0] for x in pairs]
    keys = np.concatenate([x.slice(0, x.n) for x in codes])
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    pair_c = np.bincount(which, np.concatenate([x["c"] for x in pairs]), len(first)).astype(np.int64)
    owned = np.zeros(len(keys), dtype=bool)
    owned[first] = True
    every = pair_c[which]
    at = np.cumsum([0] + [x["n"] for x in said])
    pair_at = np.cumsum([0] + [x.n for x in codes])
    words = [_pack(place=place[i:j], c=c[place[i:j]]) for i, j in zip(at, at[1:], strict=False)]
    back = [_pack(c=every[i:j], owned=np.packbits(owned[i:j])) for i, j in zip(pair_at, pair_at[1:], strict=False)]
    whole = _pack(n=len(listed), words=b"\n".join(listed), c=c)
    n = len(blocks)
    stats = (int(c.sum()), int((c > 0).sum()), int((pair_c == 1).sum()), int((pair_c == 2).sum()))
    return pa.table(
        {
            "block": pa.array([*blocks, None], pa.int64()), "bucket": pa.array([key[0].as_py()] * (n + 1), pa.int32()), "words": pa.array([*words, None], pa.binary()),
            "pairs": pa.array([*back, None], pa.binary()), "vocabulary": pa.array([None] * n + [whole], pa.binary()),
            **{k: pa.array([None] * n + [v], pa.int64()) for k, v in zip(("tokens", "types", "n1", "n2"), stats, strict=True)},
        }
    )


@dataclass
class Block:
    """A block's tokens, and what is known of its words and of its pairs that occur more than once in training."""

    data: dict

    @property
    def size(self) -> int:
        return len(self.data["place"])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Previous word and word of the pairs that occur more than once."""
        return np.repeat(np.arange(self.size), self.data["many_of"]), self.data["w"].astype(np.int64)

    def tables(self, buckets: int, block: int) -> pa.Table:
        """Messages with the tables of owned pairs, by previous word and by word, for each bucket."""
        d = self.data
        own = np.unpackbits(d["owned"], count=len(d["w"])).astype(bool)
        u, w = self.pairs()
        by_u = d["single_u"] + np.bincount(u[own], d["t"][own], self.size).astype(np.int64)
        by_w = d["single_w"] + np.bincount(w[own], d["t"][own], self.size).astype(np.int64)
        edge = np.searchsorted(d["bucket"], np.arange(buckets + 1))
        rows = [(b, _pack(place=d["place"][i:j], u=by_u[i:j], w=by_w[i:j])) for b, (i, j) in enumerate(zip(edge, edge[1:], strict=False)) if i < j]
        return pa.table({"block": pa.array([block] * len(rows), pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int32()), "name": pa.nulls(len(rows), pa.string()), "state": pa.nulls(len(rows), pa.string()), "tables": pa.array([r[1] for r in rows], pa.binary())})


_TABLES = "block long, bucket int, name string, state string, tables binary"


def _named(block: int, name: str, state: str) -> pa.Table:
    return pa.table({"block": pa.array([block], pa.int64()), "bucket": pa.array([-1], pa.int32()), "name": pa.array([name]), "state": pa.array([state]), "tables": pa.nulls(1, pa.binary())})


def _start(key: tuple, left: pa.Table, right: pa.Table, folder: str, buckets: int) -> pa.Table:
    """A block's state from the buckets' answers: each pair on one table."""
    block, name = key[0].as_py(), left["name"][0].as_py()
    d = _tokens(folder, name)
    h = _unpack(_get(f"{folder}/state", left["state"][0].as_py()))["hashes"]
    m = len(h)
    right = right.sort_by("bucket")
    said = [_unpack(x) for x in right["words"].to_pylist()]
    back = [_unpack(x) for x in right["pairs"].to_pylist()]
    pair = np.sort(_pair_codes(d["ids"], m))  # np.unique would hash all tokens first
    pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])]
    u, w = np.divmod(pair, m)
    hashed = _pair_hash(h, u, w)
    by = np.argsort(hashed)
    c, owned = np.empty(len(pair), np.int64), np.empty(len(pair), dtype=bool)
    c[by] = np.concatenate([x["c"] for x in back])
    owned[by] = np.concatenate([np.unpackbits(x["owned"], count=len(x["c"])) for x in back]).astype(bool)
    once, many = owned & (c == 1), np.flatnonzero(c > 1)
    state = {
        "place": np.concatenate([x["place"] for x in said]), "c": np.concatenate([x["c"] for x in said]), "bucket": np.repeat(right["bucket"].to_numpy(), [len(x["c"]) for x in said]),
        "pair_c": c, "single_u": np.bincount(u[once], minlength=m), "single_w": np.bincount(w[once], minlength=m),
        "many_of": np.bincount(u[many], minlength=m), "w": w[many], "t": np.ones(len(many), np.int64), "owned": np.packbits(owned[many]), "keys": hashed[many] & _U(0xFFFFFFFF),
    }
    return pa.concat_tables([_named(block, name, _put(f"{folder}/0", _pack(**state))), Block(state).tables(buckets, block)])


# --- the restaurant of words -------------------------------------------------

_WORDS = "bucket int, vocabulary binary, state binary, cell long, n long, customers long, types long, n1 long, n2 long, tables long, mass double"


def _words_row(bucket: int, vocabulary: bytes, state: dict, tables: int = 0, mass: float = 0.0) -> pa.Table:
    w = state["w"]
    numbers = (int(w.sum()), int((w > 0).sum()), int((w == 1).sum()), int((w == 2).sum()), tables)
    return pa.table(
        {
            "bucket": pa.array([bucket], pa.int32()), "vocabulary": pa.array([vocabulary], pa.binary()), "state": pa.array([_pack(**state)], pa.binary()), "cell": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()),
            **{k: pa.array([v], pa.int64()) for k, v in zip(("customers", "types", "n1", "n2", "tables"), numbers, strict=True)}, "mass": pa.array([mass]),
        }
    )


def _add_tables(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """A bucket's words with the tables of all pairs: ``u`` of those after a word, ``w`` of those with a word."""
    vocabulary = left["vocabulary"][0].as_py()
    n = _unpack(vocabulary)["n"]
    before = left["state"][0].as_py()
    u, w = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for data in right["tables"].to_pylist():
        x = _unpack(data)
        u[x["place"]] += x["u"]
        w[x["place"]] += x["w"]
    t = np.minimum(w, 1) if before is None else _unpack(before)["t"]
    return _words_row(key[0].as_py(), vocabulary, {"u": u, "w": w, "t": t})


def _seat_words(batches: Iterator[pa.RecordBatch], symbol: np.ndarray, d: float, log_p: tuple | None, total: int, salt: int) -> Iterator[pa.RecordBatch]:
    """Seat the words' customers again, given how words are spelt, and count the cells of their tables' spellings.

    Without a spelling model each word with customers has a table. ``mass`` is what the spelling model gives to words with customers.
    """
    cell_counts = np.zeros(LEVELS[3] * SYMBOLS, dtype=np.int64)
    for batch in batches:
        for bucket, vocabulary, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            state = _unpack(data)
            words, mass = _word_array(_unpack(vocabulary)), 0.0
            if log_p is None:
                state["t"] = np.minimum(state["w"], 1)
            elif len(words):
                p = np.exp(base_log(words, symbol, log_p))
                state["t"] = seat(state["w"], p, np.maximum(total - state["t"].astype(np.int64), 0), d, hashes(words.to_pylist()), salt)
                mass = float(p[state["w"] > 0].sum())
            cell, own = cells(words, symbol)
            real = np.asarray(pc.binary_length(words))[own] > 0
            np.add.at(cell_counts, cell[real], state["t"][own][real].astype(np.int64))
            yield from _words_row(bucket, vocabulary, state, int(state["t"].sum()), mass).to_batches()
    give_back()
    at = np.flatnonzero(cell_counts)
    for begin in range(0, len(at), 65536):
        part = at[begin : begin + 65536]
        blank = [pa.nulls(len(part), t) for t in (pa.int32(), pa.binary(), pa.binary())]
        rest = [pa.nulls(len(part), pa.int64()) for _ in range(5)]
        yield pa.RecordBatch.from_arrays([*blank, pa.array(part), pa.array(cell_counts[part]), *rest, pa.nulls(len(part), pa.float64())], names=[f.split()[0] for f in _WORDS.split(", ")])


def _gather(seated: DataFrame) -> np.ndarray:
    """Counts of cells: at most LEVELS[3] * SYMBOLS rows reach the driver."""
    table = seated.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(LEVELS[3] * SYMBOLS, dtype=np.int64)
    out[table["cell"].to_numpy()] = table["n"].to_numpy()
    return out


def _alphabet(vocabulary: DataFrame) -> np.ndarray:
    """Symbols of bytes: the 62 most frequent in the vocabulary have their own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, dtype=np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                n += np.bincount(np.frombuffer(_unpack(data)["words"], np.uint8), minlength=256)
        yield pa.RecordBatch.from_pydict({"byte": pa.array(range(256), pa.int32()), "n": pa.array(n)})

    rows = vocabulary.select("vocabulary").mapInArrow(work, "byte int, n long").where("byte <> 10").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    out = np.full(256, OTHER, dtype=np.int64)
    for k, r in enumerate(sorted(rows, key=lambda r: (-r["n"], r["byte"]))[: SYMBOLS - 2]):
        out[r["byte"]] = k + 1
    return out


@dataclass
class Parent:
    """The restaurant of words in one seating: its discount, customers, tables, and what the spelling model gives to known words."""

    discount: float
    customers: int
    tables: int
    known: float
    log_p: tuple

    def unknown(self) -> float:
        """What is left for all words without customers, together."""
        return (THETA + self.discount * self.tables) / (THETA + self.customers) * max(1e-9, 1 - self.known)


def _answer(key: tuple, left: pa.Table, right: pa.Table, symbol: np.ndarray, parent: Parent) -> pa.Table:
    """For each block, its words' probabilities (0 for words without customers) and the tables after them."""
    state = _unpack(left["state"][0].as_py())
    words = _word_array(_unpack(left["vocabulary"][0].as_py()))
    new = (THETA + parent.discount * parent.tables) * np.exp(base_log(words, symbol, parent.log_p))
    p = (np.maximum(state["w"] - parent.discount * state["t"], 0) + new) / (THETA + parent.customers)
    p = np.where(state["w"] > 0, p, 0).astype(np.float32)
    answers = []
    for data in right["tables"].to_pylist():
        place = _unpack(data)["place"]
        answers.append(_pack(p=p[place], u=state["u"][place]))
    return pa.table({"block": right["block"], "bucket": right["bucket"], "answer": pa.array(answers, pa.binary())})


def _heard(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    said = [_unpack(x) for x in right.sort_by("bucket")["answer"].to_pylist()]
    return np.concatenate([x["p"] for x in said]).astype(np.float64), np.concatenate([x["u"] for x in said]).astype(np.int64)


def _seat_pairs(key: tuple, left: pa.Table, right: pa.Table, folder: str, buckets: int, d: float, salt: int, keep: float | None) -> pa.Table:
    """Seat a block's pairs again. With ``keep``, the parent's probability of unknown words, this answer and the tables before it are a kept sample."""
    block = key[0].as_py()
    s = _unpack(_get(f"{folder}/{salt - 1}", left["state"][0].as_py()))
    p, after = _heard(right)
    if keep is not None:
        n = s.get("samples", 0)
        s |= {"samples": n + 1, f"p{n}": p.astype(np.float32), f"u{n}": after, f"t{n}": s["t"], f"unknown{n}": keep}
    u, w = Block(s).pairs()
    c = s["pair_c"][s["pair_c"] > 1].astype(np.int64)
    s["t"] = seat(c, p[w], np.maximum(after[u] - s["t"], 0), d, mix(s["keys"].astype(np.uint64)), salt)
    return pa.concat_tables([_named(block, left["name"][0].as_py(), _put(f"{folder}/{salt}", _pack(**s))), Block(s).tables(buckets, block)])


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(key: tuple, left: pa.Table, right: pa.Table, folder: str, last: int, d: float, tokens: int, types: int, unknown: float) -> pa.Table:
    """Scores of a block's documents; the last answer and the tables before it are the last sample."""
    s = _unpack(_get(f"{folder}/{last}", left["state"][0].as_py()))
    s |= _tokens(folder, left["name"][0].as_py())
    n, m = s.get("samples", 0), len(s["place"])
    p, after = _heard(right)
    s |= {f"p{n}": p, f"u{n}": after, f"t{n}": s["t"], f"unknown{n}": unknown}
    ids, c = s["ids"], s["c"].astype(np.int64)
    pair, which = np.unique(_pair_codes(ids, m), return_inverse=True)
    u, w = np.divmod(pair, m)
    pair_c = s["pair_c"].astype(np.float64)
    total = np.zeros(len(pair))
    for k in range(n + 1):
        t = np.minimum(pair_c, 1)
        t[pair_c > 1] = s[f"t{k}"]
        up = np.where(c[w] > 0, s[f"p{k}"][w].astype(np.float64), s[f"unknown{k}"])
        total += (np.maximum(pair_c - d * t, 0) + (THETA + d * s[f"u{k}"][u]) * up) / (THETA + c[u])
    lp = np.log10(total / (n + 1))[which]
    base = np.log10((c + 1) / (tokens + 1 * (types + 1)))[ids]
    size = s["size"].astype(np.int64)
    begin = np.cumsum(size) - size
    add = lambda x: np.add.reduceat(x, begin)
    rows = len(size)
    return pa.table(
        {
            "doc_id": pa.array(pickle.loads(s["doc_id"]), pa.int64()), "held_out": pa.array(s["held"]), "n_tokens": pa.array(size), "n_known": pa.array(add((c > 0)[ids].astype(np.int64))),
            "train_tokens": pa.array([tokens] * rows, pa.int64()), "base_score": pa.array(add(base)), "score": pa.array(add(lp)),
        }
    )


def _by(left: DataFrame, right: DataFrame, key: str, schema: str, work: Callable, *given) -> DataFrame:
    """What ``work`` makes of both tables' rows of each key, and of what is given."""

    def run(k: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out = work(k, a, b, *given)
        give_back()
        return out

    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, schema)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, burn: int = BURN) -> DataFrame:
    """Scores of whole texts by a model of those where ``held_out`` isn't true.

    A-Z are lower-cased; tokens are the words (runs without space and \\x09-\\x0D)
    and one end. Returns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known`` (tokens
    seen in training), ``train_tokens``, ``base_score`` (log10 of add-one
    probabilities) and ``score`` (log10 of the text's probability under the model, each word given the one
    before it; perplexity is ``10 ** (-score / n_tokens)``). As in the base, all words never seen in training are one
    type, which gets what the known words leave. A null text counts as empty: it has the end alone.
    Null ids and repeated rows are scored like others, and ``held_out`` null means
    false. With no training text every count is 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = scratch_dir(spark) + "-blocks"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    sent = save(source.mapInArrow(lambda b: _blocks(b, folder, buckets), _MESSAGES))
    reduced = save(sent.where("bucket >= 0").select("block", "bucket", "words", "pairs").groupBy("bucket").applyInArrow(_reduce, _REDUCED))
    blocks = save(sent.where("bucket < 0").select("block", "name", "state"))
    discard(sent)
    del sent
    free_shuffles(spark)
    tokens, types, n1, n2 = (int(x or 0) for x in reduced.agg(*[F.sum(x) for x in ("tokens", "types", "n1", "n2")]).first())
    d = discount(n1, n2)
    answers = reduced.where("block is not null").select("block", "bucket", "words", "pairs")
    state = save(_by(blocks, answers, "block", _TABLES, _start, folder, buckets))
    words = save(reduced.where("vocabulary is not null").select("bucket", "vocabulary", F.lit(None).cast("binary").alias("state")))
    discard(reduced)
    _drop(f"{folder}/state")
    free_shuffles(spark)
    symbol = _alphabet(words)
    log_p = None
    for k in range(burn + samples):
        names, messages = state.where("bucket < 0").select("block", "name", "state"), state.where("bucket >= 0").select("block", "bucket", "tables")
        added = save(_by(words, messages, "bucket", _WORDS, _add_tables).select("bucket", "vocabulary", "state", "customers", "types", "n1", "n2"))
        customers, once, twice = (int(x or 0) for x in added.agg(F.sum("customers"), F.sum("n1"), F.sum("n2")).first())
        dw = discount(once, twice)
        if log_p is None:
            first = save(added.select("bucket", "vocabulary", "state").mapInArrow(lambda b: _seat_words(b, symbol, dw, None, 0, 0), _WORDS))
            total, log_p = int(first.agg(F.sum("tables")).first()[0] or 0), spelling(_gather(first), 0).lookup()
            discard(first)
        drawn = added.select("bucket", "vocabulary", "state").mapInArrow(lambda b, p=log_p, n=total, k=k: _seat_words(b, symbol, dw, p, n, k + 1), _WORDS)
        seated = save(drawn)
        discard(added)
        discard(words)
        total, known = (x or 0 for x in seated.agg(F.sum("tables"), F.sum("mass")).first())
        parent = Parent(dw, customers, int(total), float(known), log_p)
        words = seated.where("vocabulary is not null").select("bucket", "vocabulary", "state")
        words._scratch = seated._scratch
        back = _by(words, messages, "bucket", "block long, bucket int, answer binary", _answer, symbol, parent)
        kept = parent.unknown() if k >= burn else None
        if k == burn + samples - 1:
            return _by(names, back, "block", _SCORES, _score, folder, k, d, tokens, types, kept)
        before, state = state, save(_by(names, back, "block", _TABLES, _seat_pairs, folder, buckets, d, k + 1, kept))
        discard(before)
        _drop(f"{folder}/{k}")
        log_p, total = spelling(_gather(seated), k + 1).lookup(), int(total)
        free_shuffles(spark)
    raise ValueError("no sample is kept")
