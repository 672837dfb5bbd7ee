"""Token ids in binary shards with Elias-Fano boundaries (operator 4).

A shard file holds one range of documents, ascending by id: the concatenated
ids, then the document boundaries and the document ids as Elias-Fano codes
(see :mod:`.elias_fano`), then a fixed trailer. One document's ids are found
with two selects; a reader of all documents decodes the boundaries of a run of
them at a time, from the run's sample on. Neither makes a table of a shard's offsets.

    ids      n_ids x width bytes, little-endian (2 bytes if the vocabulary fits)
    bounds   Elias-Fano, n_docs + 1 values from 0 to n_ids
    doc_ids  Elias-Fano, the non-null ids; null ids come first in a shard
    trailer  magic, width, n_docs, n_null, n_ids, bytes of bounds and doc_ids

Writing shuffles texts once (by ranges of ids). A task streams its ids into a
file of its own attempt, renamed when whole; only shards of successful attempts
are in the manifest, so lost executors and repeated tasks leave no trace in it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import open_folder, pieces, prepare, save, scratch_dir, text_buffer
from .elias_fano import EliasFano
from .pieces import MARKS, shared

MAGIC = b"TLMIDS01"
_TRAILER = struct.Struct("<8sBQQQQQ")
#: Ids, and documents, that a reader holds at a time.
READ_IDS, READ_DOCS = 2_000_000, 2048
#: Bytes of text that go to a shard, where that makes more shards than the session has shuffle partitions.
SHARD_BYTES = 1 << 28
#: Bytes of text that are encoded together; a longer text is encoded alone.
RUN_BYTES = 1 << 23
_LETTERS = "".join(chr(c) for c in range(128) if chr(c).isalpha())


def _gather(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``flat``, one after the other; run i has ``size[i]`` values."""
    start = np.cumsum(size) - size
    each = size[which]
    before = np.cumsum(each) - each
    return flat[np.repeat(start[which] - before, each) + np.arange(int(each.sum()))]


class WordEncoder:
    """Encodes texts whose tokenizer drops white space, word by word.

    Such a tokenizer's pieces never reach over white space, so the ids of a
    text are those of its words in turn. The distinct words of a run of texts are found by
    Arrow (split at ASCII white space alone; a word with other white space goes to the library as
    it is). Latin letters with or without marks after them are one or two tokens, which are
    collected once more, so that Python sees a token once a run; ids are put together by offsets.
    """

    def __init__(self, vocab_path: str, width: int):
        self.pieces = shared(vocab_path, True, f"<u{width}")
        self.dtype = np.dtype(f"<u{width}")

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, each with the end id, and the ids of each."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = lists.flatten().dictionary_encode()
        edges = np.asarray(lists.offsets)
        ids, n = self._words(words.dictionary)
        code = words.indices.to_numpy()
        # The end is one more word, which stands behind each text's words.
        ids, n = np.append(ids, np.array(end, self.dtype)), np.append(n, 1)
        code = np.insert(code, edges[1:] - edges[0], len(n) - 1)
        total = np.concatenate([[0], np.cumsum(n[code])])
        edges = edges - edges[0] + np.arange(len(edges))
        return _gather(ids, n, code), total[edges[1:]] - total[edges[:-1]]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after the other, and how many each has."""
        core = pc.ascii_rtrim(words, characters=MARKS)
        plain = pc.and_(pc.ascii_is_alpha(core), pc.string_is_ascii(words))
        own = np.flatnonzero(np.asarray(plain))
        atoms = pa.concat_arrays([pc.ascii_lower(core.take(own)), pc.ascii_ltrim(words.take(own), characters=_LETTERS)]).dictionary_encode()
        held = self.pieces.tokens
        token = [held.get(t) or self.pieces.token(t) if t else b"" for t in atoms.dictionary.to_numpy(zero_copy_only=False)]
        rest = words.filter(pc.invert(plain)).to_numpy(zero_copy_only=False)
        token += map(self.pieces.piece, rest)
        token.append(b"")
        n = np.fromiter(map(len, token), np.int64, len(token)) // self.dtype.itemsize
        pair = np.full((len(words), 2), len(token) - 1)
        pair[own] = atoms.indices.to_numpy().reshape(2, -1).T
        other = np.ones(len(words), dtype=bool)
        other[own] = False
        pair[other, 0] = len(atoms.dictionary) + np.arange(len(rest))
        return _gather(np.frombuffer(b"".join(token), self.dtype), n, pair.ravel()), n[pair].sum(axis=1)


def write_shards(docs: DataFrame, vocab_path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Tokenize whole texts into shards in ``folder``; return the manifest.

    The manifest has a row a shard, in order: ``shard`` int, ``path``,
    ``n_docs``, ``n_ids`` long. Documents ascend by id through all shards, null
    ids first; repeated ids are all kept, ordered by a hash of the text, so that
    one id's rows may fill several shards. A null text counts
    as empty and has the end id alone. An empty table gives no shards.
    """
    spark = docs.sparkSession
    prepare(spark)
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(vocab_path).get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if shards is None:
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    source = source.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "tie")
    source = source.sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    filesystem, root = open_folder(folder)
    filesystem.create_dir(root, recursive=True)

    return save(source.mapInArrow(lambda batches: _write(batches, folder, vocab_path, width, end_id), "shard int, path string, n_docs long, n_ids long"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to RUN_BYTES."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > RUN_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _write(batches: Iterator[pa.RecordBatch], folder: str, vocab_path: str, width: int, end_id: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    shard, attempt = context.partitionId(), context.taskAttemptId()
    store, base = open_folder(folder)
    path, name = f"{base}/.shard-{shard:06d}-{attempt}", f"shard-{shard:06d}-{attempt}.tlm"
    encoder = WordEncoder(vocab_path, width)
    lengths: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    n_null, out = 0, None
    for batch in _runs(batches):
        out = out or store.open_output_stream(path)
        for first, last in pieces(text_buffer(batch.column(1))[1], RUN_BYTES):
            ids, n = encoder.encode(batch.column(1).slice(first, last - first), end_id)
            out.write(ids.tobytes())
            lengths.append(n)
        n_null += batch.column(0).null_count
        keys.append(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
    if out is None:
        return
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
    codes = [EliasFano.of(bounds).to_bytes(), EliasFano.of(np.concatenate(keys)).to_bytes()]
    n_docs, n_ids = len(bounds) - 1, int(bounds[-1])
    out.write(codes[0] + codes[1] + _TRAILER.pack(MAGIC, width, n_docs, n_null, n_ids, len(codes[0]), len(codes[1])))
    out.close()
    store.move(path, f"{base}/{name}")
    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_ids": [n_ids]})


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the shards: ``doc_id``, ``start``, ``n_tokens``, ``ids``.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian
    unsigned 32-bit integers. The driver sees one row a shard.
    """
    prepare(spark)
    rows, before = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        rows.append((r["path"], before))
        before += r["n_ids"]
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not rows:
        return spark.createDataFrame([], schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = open_folder(path)
                with store.open_input_file(place) as file:
                    yield from _documents(file, first)

    return spark.createDataFrame(rows, "path string, first long").repartition(len(rows)).mapInArrow(work, schema)


def _documents(file, first: int) -> Iterator[pa.RecordBatch]:
    size = file.size()
    file.seek(size - _TRAILER.size)
    magic, width, n_docs, n_null, n_ids, n_bounds, n_keys = _TRAILER.unpack(file.read(_TRAILER.size))
    if magic != MAGIC or size != n_ids * width + n_bounds + n_keys + _TRAILER.size:
        raise ValueError("not a whole shard")
    file.seek(n_ids * width)
    bounds, _ = EliasFano.from_bytes(file.read(n_bounds))
    keys, _ = EliasFano.from_bytes(file.read(n_keys))
    begin = 0
    while begin < n_docs:
        edge = bounds.slice(begin, min(n_docs, begin + READ_DOCS) + 1)
        fits = int(np.searchsorted(edge, edge[0] + READ_IDS, side="right")) - 1
        last = begin + max(1, min(fits, len(edge) - 1))
        edge = edge[: last - begin + 1]
        named = keys.slice(max(0, begin - n_null), max(0, last - n_null))
        file.seek(int(edge[0]) * width)
        data = np.frombuffer(file.read(int(edge[-1] - edge[0]) * width), dtype=f"<u{width}").astype("<u4")
        cut = pa.array(((edge - edge[0]) * 4).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.nulls(last - begin - len(named), pa.int64()), pa.array(named)]),
                pa.array(edge[:-1] + first),
                pa.array(np.diff(edge)),
                pa.Array.from_buffers(pa.binary(), last - begin, [None, cut.buffers()[1], pa.py_buffer(data)]),
            ],
            names=["doc_id", "start", "n_tokens", "ids"],
        )
        begin = last


def document_ids(file, i: int) -> np.ndarray:
    """Ids of the i-th document of an open shard: two selects and one read."""
    size = file.size()
    file.seek(size - _TRAILER.size)
    _, width, _, _, n_ids, n_bounds, _ = _TRAILER.unpack(file.read(_TRAILER.size))
    file.seek(n_ids * width)
    bounds, _ = EliasFano.from_bytes(file.read(n_bounds))
    a, b = bounds.select(i), bounds.select(i + 1)
    file.seek(a * width)
    return np.frombuffer(file.read((b - a) * width), dtype=f"<u{width}")


def tokenize_to_files(docs: DataFrame, vocab_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write all documents to shards and read them back; see the two halves."""
    folder = folder or scratch_dir(docs.sparkSession) + "-shards"
    return read_shards(docs.sparkSession, write_shards(docs, vocab_path, folder, end_id))
