"""The n-gram Jaccard join against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
from tallyloom.llm import partenum

SCHEMA = "doc_id long, text string, sig long, kept string, component_id int"


def shingle_set(text, width=5):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([" ".join(w)]) if w else frozenset()


def plain(rows, percent=80):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(i), root(j)))
            up[y] = x
    out = [(i, len(s), i if i is None else root(i)) for i, s in sets]
    texts = {}
    for (i, _, c), (_, s) in zip(out, sets, strict=True):
        if i is not None and s:
            texts.setdefault(c, set()).add(s)
    return sorted(((i, n, c, len(texts[c]) if i is not None and n else 1) for i, n, c in out), key=repr)


def ours(spark, rows, **more):
    table = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in partenum.jaccard_classes(table, **more).collect()), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.choice([0, 1])] = [f"w{rng.randrange(10**6)}"]
    return words


def made(seed):
    """Groups of near copies of all sizes, near and beyond the threshold, under a passage that many share."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for size in (3, 5, 8, 9, 12, 20, 40, 66, 90, 130, 300, 700):
        for _ in range(3):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)] + (passage if rng.random() < 0.5 else [])
            rows += [edited(rng, base, k) for k in (0, 0, 1, max(1, size // 60), max(1, size // 45), max(1, size // 30))]
    rng.shuffle(rows)
    texts = [(i, " ".join(w)) for i, w in enumerate(rows)]
    return [*texts, (1000, None), (1001, ""), (1002, " \t"), (None, texts[0][1]), (5, texts[9][1]), (1003, texts[3][1].upper()), (1004, texts[3][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_all_pairs(spark, seed):
    rows = made(seed)
    assert ours(spark, rows) == plain(rows)


def test_long_runs(spark, monkeypatch):
    """Runs of near copies that one leader doesn't unite: strangers by pairs, crowds by blocks."""
    monkeypatch.setattr(partenum, "FEW", 2)
    rng = random.Random(7)
    base = [f"w{k}" for k in range(400)]
    rows, now = [], base
    for i in range(30):  # a chain: each is like the next, the ends aren't alike
        rows.append((i, " ".join(now)))
        now = now[:]
        for _ in range(6):
            now[rng.randrange(len(now))] = f"x{rng.randrange(10**6)}"
    rows += [(100 + i, " ".join(edited(rng, base, 3))) for i in range(12)]
    assert ours(spark, rows) == plain(rows)


def test_members_of_a_crowd_come_once(spark, monkeypatch):
    """Near copies share many runs with one first member: a member is a row once beside it, however many they share."""
    monkeypatch.setattr(partenum, "FEW", 2)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([8, 12, 16])))) for i in range(40)]
    seen = []
    whole = partenum._in_crowds

    def crowds(members, counts, percent):
        seen.append((members.count(), members.select(members.columns[0], "b").distinct().count(), members.select("b").distinct().count()))
        return whole(members, counts, percent)

    monkeypatch.setattr(partenum, "_in_crowds", crowds)
    assert ours(spark, rows) == plain(rows)
    assert seen and all(n == once and n <= 20 * texts for n, once, texts in seen)


def test_sets_without_rich_groups(spark, monkeypatch):
    """Where too few groups are rich, single shingles find what groups can't."""
    monkeypatch.setattr(partenum, "groups_of", lambda instance, percent: np.where(instance >= 6, 1, 0))
    rows = made(3)
    assert ours(spark, rows) == plain(rows)


def test_nothing(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(1, None)]) == [(1, 0, 1, 1)]
    with pytest.raises(ValueError):
        partenum.jaccard_classes(spark.createDataFrame([], SCHEMA), percent=50)


def test_partners_share_a_signature():
    rng = np.random.default_rng(3)
    for size in (4, 5, 9, 30, 63, 64, 70, 91, 128, 300, 1000):
        for percent in (75, 80, 90):
            k = int(partenum.most_differences(size, percent))
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            for _ in range(12):
                out = int(rng.integers(0, k + 1))
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[out:]], rng.integers(0, 2**63, int(rng.integers(0, k + 1)), dtype=np.uint64)]))
                if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
                    continue
                both = np.concatenate([a, b])
                at = np.repeat([0, 1], [len(a), len(b)])
                row, sig, poor = partenum.signatures_of(both, at, 2, percent)
                if not poor and k:
                    assert len(np.intersect1d(sig[row == 0], sig[row == 1])), (size, percent)


def test_counts_tell_large_sets_apart():
    """Counts lose no partner, and tell most other pairs apart in large sets too, where 256 parts don't."""
    rng = np.random.default_rng(5)
    for size in (30, 300, 520, 1000, 3000, 6000, 40000):
        base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64)) << np.uint64(1)
        sets = [base]
        for share in (0.95, 0.9, 0.82, 0.75, 0.6):
            keep = base[rng.permutation(len(base))[: int(len(base) * share)]]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(len(base) * (1 - share)), dtype=np.uint64) << np.uint64(1)])))
        n = np.array([len(x) for x in sets])
        counts = partenum.counts_of(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), n)
        x, y = (np.array(v) for v in zip(*combinations(range(len(sets)), 2), strict=True))
        good = partenum.may_link(counts, n, x, y, 80)
        for i, j, g in zip(x, y, good, strict=True):
            common = len(np.intersect1d(sets[i], sets[j]))
            alike = 100 * common / (n[i] + n[j] - common)
            assert g or alike < 80, (size, i, j)
            assert not g or alike >= 65 or size > 2 * partenum.FINEST, (size, i, j, alike)


def test_runs_of_a_range():
    """Whatever the batches, members meet the same first one, and only the outer runs stay open."""
    import pyarrow as pa

    rng = random.Random(9)
    for _ in range(60):
        rows = sorted((rng.choice([1, 1, 1, 2, 3, 4, 4, 4, 5, 6]), i, 10 + i) for i in rng.sample(range(100), rng.randrange(1, 30)))
        cuts = sorted(rng.sample(range(len(rows) + 1), min(3, len(rows))))
        parts = [rows[i:j] for i, j in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in p], pa.int64()) for k in range(3)], names=["sig", "rep", "n"]) for p in parts]
        lists, long, single = [], set(), set()
        for batch in partenum._runs(3)(iter(batches)):
            for r in batch.to_pylist():
                assert r["sizes"] == [10 + m for m in r["members"]]
                if r["sig"] is None:
                    lists.append(r["members"])
                elif len(r["members"]) == 2:
                    long.add((r["sig"], *r["members"]))
                else:
                    single.add((r["sig"], *r["members"]))
        runs = {}
        for sig, rep, _ in rows:
            runs.setdefault(sig, []).append(rep)
        first, last = rows[0][0], rows[-1][0]
        inner = {s: m for s, m in runs.items() if s not in (first, last)}
        assert sorted(lists) == sorted(m for m in inner.values() if 1 < len(m) <= 3)
        assert {x for x in long if x[0] != last} == {(s, m[0], x) for s, m in inner.items() if len(m) > 3 for x in m}
        assert {(s, x) for s, x in single if s == first} == {(first, x) for x in runs[first]}
        if last != first:
            ends = {x for s, x in single if s == last}
            held = {x for s, _, x in long if s == last}
            assert runs[last][0] in ends and ends | held == set(runs[last]) and all(m == runs[last][0] for s, m, _ in long if s == last)
        assert {s for s, _ in single} <= {first, last}
