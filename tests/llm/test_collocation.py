"""Collocations by bitmaps against a plain count."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tallyloom.llm import collocation

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, rank string"


def plain(rows, least=10, top=2000, covered=50):
    count, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    cand = {p: a for p, a in count.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        inside = [b for (g, v), b in cand.items() if g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * b >= covered * a for b in inside):
            continue
        score, _, left, right = min((1000000 * a * a // (count[lang, w[:k]] * count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((g, i, p.decode(), -a, x, y, total[g], -s) for g, v in out.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top], 1))


def ours(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in collocation.collocations(table, **more).collect())


def made(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "New", "york", "city", "é", "日本", "a", "b", "of", "x"]
    parts = [" ", "  ", "\t", ". ", "\n", ",", " ", " ", " "]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 40, 200])))
        rows.append((i, text, rng.choice(["en", "fr", None])))
    rows += [(1, "new york city " * 700, "en"), (1, "new york city " * 700, "en"), (2, None, "fr"), (3, "", None), (None, "only nine " * 9, "de"), (4, "and ten. " * 10, "de")]
    return rows


@pytest.mark.parametrize("seed, size", [(1, 4 << 20), (2, 500)])
def test_equal_a_plain_count(spark, monkeypatch, seed, size):
    monkeypatch.setattr(collocation, "SHARD_BYTES", size)
    rows = made(seed)
    assert ours(spark, rows) == plain(rows)


def test_ties_and_top(spark):
    """Equal scores and counts stand in order of their bytes, and the cut falls among them."""
    rows = [(i, f"{a}{i} {b}{i}. " * 10, "en") for i in range(30) for a, b in (("z", "y"), ("é", "b"))]
    assert ours(spark, rows, top=7) == plain(rows, top=7)


def test_nothing(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(1, None, None), (2, " . ", "en")]) == []


def test_full_table_of_pairs_only_costs_rows(spark, monkeypatch):
    monkeypatch.setattr(collocation, "MOST_BITS", 1 << 16)
    monkeypatch.setattr(collocation, "BLOCK_BITS", 1 << 12)
    rows = made(4)
    assert ours(spark, rows) == plain(rows)


def test_bitmaps_shift_over_chunks():
    word = np.array([0, 1, 0, 1, 2, 0, 1] * 9)
    position = np.arange(len(word)) + np.arange(len(word)) // 11
    b = collocation.Bitmaps(word, position)
    prefix, then, _, mask = b.extend(b.word, b.chunk, b.mask)
    found = Counter()
    for p, w, m in zip(prefix.tolist(), then.tolist(), mask.tolist(), strict=True):
        found[p, w] += m.bit_count()
    at = dict(zip(position.tolist(), word.tolist(), strict=True))
    assert found == Counter((w, at[p + 1]) for p, w in at.items() if p + 1 in at)


def test_long_texts_are_cut_at_ends_of_pieces(monkeypatch):
    monkeypatch.setattr(collocation, "SHARD_BYTES", 40)
    text = "one two three, " * 10 + "x" * 100 + ". and so on"
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", text, None, "c"]), pa.array(["en", "fr", "en", None])], names=["text", "lang"])
    parts = list(collocation._shards(iter([batch])))
    assert b"".join(p[0].tobytes() for p in parts if p[2] == ["fr"]) + parts[-1][0].tobytes() == (text[:251] + "a b" + text[251:] + "c").encode()
    assert parts[-1][2] == ["en", "fr", "en", "und"]
    assert all(len(p[1]) == len(p[2]) + 1 and p[1][-1] == len(p[0]) for p in parts)
