"""BPE encoding and decoding with content-defined chunk reuse (operator 10).

A rolling hash over the last 16 code points cuts every text into chunks, so a
passage that many documents share falls into the same chunks wherever it
stands. A task encodes each distinct chunk once and keeps its ids. Cuts fall
anywhere, also inside words, so the ids near a cut can't be trusted: every
join is repaired by encoding again the text from the last *settled* place of
the left chunk to the first settled place of the right one, and the stretch
grows over further chunks until both ends are settled.

A place before a blank or a line feed is settled if the characters on both
sides of that blank aren't white space: in byte-level BPE the splitting
pattern then always begins a new piece there, whatever else stands around it,
so ids on either side can't change. What lies between the first and last
settled place of a chunk is encoded piece by piece, and the ids of a piece come
from the tokenizers library once per task.

The work needs no shuffle: a lost executor's task runs again on its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import prepare
from .pieces import Cache, byte_characters, shared

WINDOW = 16
#: Mean chunk length is 2**CHUNK_BITS code points; MAX_CHUNK bounds it (such a
#: cut is repaired like any other).
CHUNK_BITS = 9
MAX_CHUNK = 8192
#: A task forgets its chunks beyond so many characters.
CACHE_CHARS = 8_000_000


def cuts(text: str) -> list[int]:
    """Ends of the content-defined chunks of a text, in code points."""
    n = len(text)
    if n <= WINDOW:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    step, m = 1, 0x2C1B3C6D
    while step < WINDOW:
        grown = h.copy()
        grown[step:] += h[:-step] * np.uint32(pow(m, step, 1 << 32))
        h, step = grown, step * 2
    h = (h * np.uint32(0x297A2D39)) >> np.uint32(32 - CHUNK_BITS)
    ends = np.flatnonzero(h[WINDOW - 1 : -1] == 0) + WINDOW
    out, last = [], 0
    for end in [*ends.tolist(), n]:
        while end - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


class ChunkEncoder:
    """Encodes whole texts as the tokenizer would; ids as little-endian uint32."""

    def __init__(self, vocab_path: str):
        self.encoder = shared(vocab_path, False, "<u4")
        self.pieces = Cache()
        self.chunks: dict[str, tuple] = {}
        self.chunk_chars = 0

    def _library(self, text: str) -> bytes:
        return self.encoder.library(text)

    def _piece(self, part: str) -> bytes | None:
        """Ids of a part that follows a blank (or begins with a line feed)."""
        got = self.pieces.get(part)
        if got is None:
            body = part[1:] if part[:1] == "\n" else part
            if not body or body[0].isspace() or body[-1].isspace():
                return None
            got = self.encoder.piece(part if part[0] == "\n" else " " + part)
            self.pieces.put(part, got)
        return got

    def run(self, text: str, at_start: bool) -> bytes:
        """Ids of a text whose two ends are settled."""
        if not text:
            return b""
        parts = text.replace("\n", " \n").split(" ")
        out = list(map(self.pieces.young.get, parts))
        if at_start and text[0] not in " \n":
            first = parts[0]
            if first[-1:].isspace() or first[:1].isspace():
                return self._library(text)
            out[0] = self.encoder.piece(first)
        elif parts[0]:
            return self._library(text)
        else:
            out[0] = b""
            if at_start and len(parts) > 1:  # white space opens the text: nothing before it settles the place
                return self._library(text)
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    ids = self._piece(parts[i])
                    if ids is None:
                        return self._library(text)
                    out[i] = ids
        return b"".join(out)

    def _settled(self, text: str, last: bool) -> int:
        """The first or last settled place inside a text, or -1."""
        i = len(text) if last else 0
        while True:
            if last:
                i = max(text.rfind(" ", 0, i), text.rfind("\n", 0, i))
            else:
                found = [x for x in (text.find(" ", i + 1), text.find("\n", i + 1)) if x >= 0]
                i = min(found, default=-1)
            if i < 0 or last and i == 0:
                return -1
            if 0 < i < len(text) - 1 and not text[i - 1].isspace() and not text[i + 1].isspace():
                return i

    def _chunk(self, chunk: str) -> tuple:
        first = self._settled(chunk, False)
        if first < 0:
            got = ("", None, "")
        else:
            last = self._settled(chunk, True)
            got = (chunk[:first], self.run(chunk[first:last], False), chunk[last:])
        self.chunk_chars += len(chunk) * 2 + 200
        if self.chunk_chars > CACHE_CHARS:
            self.chunks.clear()
            self.chunk_chars = 0
        self.chunks[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        out, pending, at_start, begin = [], "", True, 0
        held: list[str] = []
        for end in cuts(text):
            chunk = text[begin:end]
            begin = end
            head, ids, tail = self.chunks.get(chunk) or self._chunk(chunk)
            if ids is None:  # no settled place: the join reaches over this chunk
                held.append(chunk)
                continue
            if held:
                pending += "".join(held)
                held = []
            out.append(self.run(pending + head, at_start))
            out.append(ids)
            pending, at_start = tail, False
        out.append(self.run(pending + "".join(held), at_start))
        return b"".join(out)


class TableDecoder:
    """Decodes arrays of ids through the vocabulary's bytes."""

    def __init__(self, vocab_path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocab_path)
        byte = {c: b for b, c in byte_characters().items()}
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        tokens = [tokenizer.id_to_token(i) or "" for i in range(size)]
        raw = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in tokens]
        self.length = np.array([len(x) for x in raw], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.flat = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def decode(self, ids: bytes) -> str:
        i = np.frombuffer(ids, dtype="<u4")
        if not len(i):
            return ""
        n = self.length[i]
        shift = self.start[i] - (np.cumsum(n) - n)
        return self.flat[np.repeat(shift, n) + np.arange(int(n.sum()))].tobytes().decode("utf-8", "replace")


def round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode whole texts and decode the ids again, in one pass.

    Returns ``keep`` (by default ``id_col``) as it is, with ``n_tokens`` long,
    ``ids`` binary (little-endian unsigned 32-bit integers) and ``decoded``
    string; columns of ``keep`` with these three names give way. A null text
    counts as empty: no ids, and an empty decoded text. Repeated rows stay
    repeated; an empty table gives an empty result. ``vocab_path`` must name a
    byte-level BPE file that executors can open.
    """
    prepare(docs.sparkSession)
    own = ["n_tokens", "ids", "decoded"]
    keep = [c for c in (keep if keep is not None else [id_col]) if c not in own]
    names = list(dict.fromkeys([*keep, text_col]))
    source = docs.select(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep)
    schema = ", ".join(x for x in (fields, "n_tokens long, ids binary, decoded string") if x)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = ChunkEncoder(vocab_path), TableDecoder(vocab_path)
        for batch in batches:
            ids = [encoder.encode(t or "") for t in batch.column(names.index(text_col)).to_pylist()]
            columns = [batch.column(names.index(c)) for c in keep]
            columns += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([decoder.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *own])

    return source.mapInArrow(work, schema)
