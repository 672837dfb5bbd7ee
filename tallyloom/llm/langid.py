"""Language identification by string kernels (operator 1).

The kernel of two texts is their number of shared n-grams of characters (blended
spectrum: lengths 1 to 3; presence, not counts), divided by the root of the
product of their numbers of n-grams. A bounded set of landmark texts
gives Nyström features of it, and kernel ridge regression, one language versus the
rest, is solved on these. A batch of texts is scored by two matrix products: presence
bits by landmarks, and kernel values by weights.

N-grams are hashed to 2**13 presence bits. Letters are lower-cased; everything else
counts as one blank. Whole texts are read, in bounded pieces, and nothing is shuffled but the choice of the
training sample: for each language one document for each of ``per_language`` hash
buckets of the document id, at most; the driver receives their presence bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import prepare

BITS = 13
LENGTHS = (1, 2, 3)
#: The bound of the labelled sample, by language, and of all landmarks (one a language at least).
PER_LANGUAGE = 400
LANDMARKS = 192
RIDGE = 1e-2
#: A learned language's texts are taken to have so many new n-grams at least.
LEAST_NEW = 0.02
UNKNOWN = "und"
#: Rows of the sample that are unpacked at once.
_ROWS = 1024
#: Code points handled at once.
_PIECE = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower case of every letter; 32 for all other code points."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x33480):  # beyond, no letters are assigned
        if (s := chr(c)).isalpha():
            out[c] = ord(s.lower()[0])
    return out


def presence(texts: list[str | None]) -> np.ndarray:
    """Presence bits (texts x 2**BITS, as uint8) of the texts' n-grams.

    A text without letters has no bit set.
    """
    size, table = 1 << BITS, _letters()
    out = np.zeros((len(texts), size), dtype=np.uint8)
    for i, text in enumerate(texts):
        if not text:
            continue
        seen = out[i]
        for begin in range(0, len(text), _PIECE):
            code = table[np.frombuffer(text[max(0, begin - 3) : begin + _PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
            blank = code == 32
            code = code[~blank | np.concatenate([[True], ~blank[:-1]])]  # a run of others is one blank
            for n in LENGTHS:
                if len(code) >= n:
                    h = np.full(len(code) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
                    for k in range(n):
                        h = (h ^ code[k : k + len(h)]) * np.uint32(0x85EBCA6B)
                        h ^= h >> np.uint32(13)
                    h = (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
                    if n == 1:
                        h = h[code != 32]
                    seen[h] = 1
    return out


@dataclass
class Model:
    """Landmarks' packed presence bits and the weights of their kernel values."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    #: Share of a learned language's n-grams that no landmark has: each landmark against the others.
    new: float = 1.0

    def strangeness(self, bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Natural log odds of n-grams that meet the landmarks' bits by chance, against those of a learned language."""
        known = marks.any(axis=0)
        chance = min(max(float(known.mean()), 1e-3), 1 - 1e-3)
        new = min(self.new, 1 - chance)
        n, met = bits.sum(axis=1), bits @ known.astype(np.float32)
        return (n - met) * np.log((1 - chance) / new) + met * np.log(chance / (1 - new))

    def scores(self, bits: np.ndarray) -> np.ndarray:
        marks = np.unpackbits(self.landmarks, axis=1)[:, : bits.shape[1]].astype(np.float32)
        return _kernel(bits.astype(np.float32), marks) @ self.weights + self.bias


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb = a.sum(axis=1), b.sum(axis=1)
    return (a @ b.T) / np.sqrt(np.maximum(1, na)[:, None] * np.maximum(1, nb)[None, :])


def train(packed: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on packed presence bits; rows take turns by language as landmarks, so each language has one.

    The sample stays packed (1 KB a row); its kernel values with the landmarks are made block by block.
    """
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], dtype=np.int64)
    if not len(y):
        return Model([], np.zeros((0, (1 << BITS) // 8), np.uint8), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    turn = np.zeros(len(y), dtype=np.int64)
    for c in range(len(languages)):
        turn[y == c] = np.arange((y == c).sum())
    chosen = np.lexsort((y, turn))[: max(landmarks, len(languages))]
    marks = np.unpackbits(packed[chosen], axis=1).astype(np.float32)
    k_mm = _kernel(marks, marks).astype(np.float64)
    values, vectors = np.linalg.eigh(k_mm)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.concatenate([_kernel(np.unpackbits(packed[i : i + _ROWS], axis=1).astype(np.float32), marks) @ root for i in range(0, len(y), _ROWS)])
    target = np.where(y[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    share = np.bincount(y, minlength=len(languages)).astype(np.float64)
    weight = (len(y) / (len(languages) * share))[y]
    mean = (weight[:, None] * phi).sum(axis=0) / weight.sum()
    centre = (weight[:, None] * target).sum(axis=0) / weight.sum()
    p = phi - mean
    beta = np.linalg.solve(p.T @ (weight[:, None] * p) + ridge * len(y) * np.eye(p.shape[1]), p.T @ (weight[:, None] * (target - centre)))
    new = max(LEAST_NEW, float(marks[:, marks.sum(axis=0) == 1].sum() / marks.sum()))
    return Model(languages, packed[chosen], (root @ beta).astype(np.float32), (centre - mean @ beta).astype(np.float32), new)


def sample(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` ids for each language: the least hash of each bucket."""
    h = F.xxhash64(F.lit(11), "doc_id")
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select(F.col("lang"), F.pmod(h, F.lit(per_language)).alias("bucket"), F.struct(h.alias("h"), F.col("doc_id").cast("long").alias("doc_id")).alias("pick"))
    return rows.groupBy("lang", "bucket").agg(F.min("pick").alias("pick")).select(F.col("pick.doc_id").alias("doc_id"), F.col("lang"))


def fit(docs: DataFrame, usable: Column | None = None, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model:
    """Learn from ``text`` and non-null ``lang`` of the rows where ``usable`` holds.

    Rows without letters teach nothing. With no labelled row the model knows
    no language and predicts ``und`` alone.
    """
    prepare(docs.sparkSession)
    usable = F.lit(True) if usable is None else usable
    picked = sample(docs, usable, per_language)  # bounded by per_language times the number of languages
    source = docs.where(usable).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang"), F.col("text")).join(F.broadcast(picked), ["doc_id", "lang"], "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.packbits(presence(batch.column(2).to_pylist()), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.tobytes() for b in bits], pa.binary())], names=["doc_id", "lang", "bits"])

    found = source.mapInArrow(work, "doc_id long, lang string, bits binary")
    rows = found.groupBy("lang", "doc_id").agg(F.min("bits").alias("bits")).collect()
    rows = sorted((r["lang"], r["doc_id"], bytes(r["bits"])) for r in rows if any(r["bits"]))
    packed = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).reshape(len(rows), -1) if rows else np.zeros((0, (1 << BITS) // 8), np.uint8)
    return train(packed, [r[0] for r in rows], landmarks)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, strangeness: bool = False) -> DataFrame:
    """``lang_pred`` and ``score`` (0 to 1) of whole texts.

    Returns ``keep`` (by default ``doc_id``) as it is, with the two columns, and if asked for
    ``strangeness``, the log odds that a text is like no language of the model (0 without letters); columns of
    ``keep`` with these names give way. A text that is null or has no letter,
    and every text under a model without languages, is ``und`` with score 0. Equal
    scores go to the first language by name. Repeated rows stay repeated; an empty
    table gives an empty result.
    """
    prepare(docs.sparkSession)
    own = ["lang_pred", "score", *["strangeness"] * strangeness]
    keep = [c for c in (keep if keep is not None else ["doc_id"]) if c not in own]
    names = list(dict.fromkeys([*keep, text_col]))
    source = docs.select(*names)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(model.landmarks, axis=1).astype(np.float32)
        for batch in batches:
            texts = batch.column(names.index(text_col)).to_pylist()
            lang, score, strange = [], [], []
            for begin in range(0, len(texts), 64):
                bits = presence(texts[begin : begin + 64]).astype(np.float32)
                some = bits.any(axis=1)
                if not model.languages:
                    some[:] = False
                    raw = np.zeros((len(bits), 1))
                else:
                    raw = _kernel(bits, marks) @ model.weights + model.bias
                e = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))
                best = raw.argmax(axis=1)
                share = e[np.arange(len(best)), best] / e.sum(axis=1)
                lang += [model.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                if strangeness:
                    strange += model.strangeness(bits, marks).astype(float).tolist() if model.languages else [0.0] * len(bits)
                score += [float(p) if s else 0.0 for p, s in zip(share, some, strict=True)]
            columns = [batch.column(names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), *[pa.array(strange, pa.float64())] * strangeness], names=[*keep, *own])

    return source.mapInArrow(work, ", ".join([*fields, "lang_pred string, score double", *["strangeness double"] * strangeness]))


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))
