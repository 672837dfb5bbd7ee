"""Operators in levels, narrowed or prefixed forms, against plain Python on random rows."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tallyloom.operators import aggregate, resolve, windows


def test_order_statistics(spark):
    rng = random.Random(1)
    rows = [("big", rng.choice([rng.gauss(0, 1e6), float(rng.randrange(50)), rng.random()])) for _ in range(12_000)]
    rows += [("tied", 4.0)] * 7_000 + [("tied", 9.0)] * 6_999 + [(None, float(v)) for v in (3, 1, 2)] + [("few", 5.0), ("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    values = defaultdict(list)
    for k, v in rows:
        if v is not None:
            values[k].append(v)
    got = {r.k: r.m for r in aggregate.upper_median(df, ["k"], "v", "m").collect()}
    assert got == {k: sorted(v)[len(v) // 2] for k, v in values.items()}
    assert {r.k: r.median for r in aggregate.summary(df.where("k <> 'none' or k is null"), ["k"], "v").collect()} == got
    everything = [v for _, v in rows if v is not None]
    shares = [0.0, 1 / 6, 0.5, 0.9, 1.0]
    for part in (everything, everything[:11], everything[:1]):
        assert np.allclose(aggregate.quantiles(spark.createDataFrame([(v,) for v in part], "v double"), "v", shares), np.quantile(part, shares), rtol=1e-12)
    assert aggregate.quantiles(df.where("false"), "v", shares) == []
    assert aggregate.upper_median(df.where("false"), ["k"], "v", "m").count() == 0


def test_nearest(spark):
    rng = random.Random(2)
    left = [(i, rng.choice([0, 0, 0, 1, None]), float(rng.randrange(-300, 300)) if i % 9 else None) for i in range(300)]
    right = [(i, rng.choice([0, 0, 1, 2, None]), float(rng.randrange(-300, 300)) if i % 7 else None) for i in range(60)]
    got = resolve.nearest_in_block(spark.createDataFrame(left, "l int, k int, x double"), spark.createDataFrame(right, "r int, k int, y double"), "l", "r", "k", "x", "y", 13.0)
    expected = {}
    for i, k, x in left:
        near = [(abs(x - y), r) for r, b, y in right if k is not None and b == k and x is not None and y is not None and abs(x - y) <= 13]
        if near:
            expected[i] = min(near)
    assert {r.l: (r.gap, r.r) for r in got.collect()} == expected
    assert len(expected) > 100


def test_token_overlap(spark):
    rng = random.Random(3)
    words = ["the"] * 8 + ["of"] * 5 + [f"w{i}" for i in range(40)]
    sets = lambda n: [(i, None if i == 3 else [rng.choice(words) for _ in range(rng.randrange(14))] + [None]) for i in range(n)]
    a, b = sets(80), sets(50)
    frames = [spark.createDataFrame(x, f"{n} int, t{n} array<string>") for x, n in ((a, "a"), (b, "b"))]
    for least in (1, 2, 4):
        expected = {}
        for i, x in a:
            for j, y in b:
                n = len((set(x or []) & set(y or [])) - {None})
                if n >= least:
                    expected[i, j] = n
        got = resolve.token_overlap(*frames, "a", "b", "ta", "tb", least)
        assert {(r.a, r.b): r.shared for r in got.collect()} == expected
        assert expected


def test_unique_candidate_without_conditions(spark):
    mentions = spark.createDataFrame([(1, "x"), (2, "y"), (3, "q"), (4, "y"), (4, "z"), (5, None)], "m int, k string")
    towns = spark.createDataFrame([("x", "A"), ("x", "B"), ("y", "A"), ("z", "C")], "k string, p string")
    assert sorted((r.m, r.p) for r in resolve.unique_candidate(mentions, towns, "m", "k", []).collect()) == [(2, "A")]


def test_windows_by_range(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "b", None]), rng.randrange(40), rng.choice([None, i])) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, k string, t int, v int")
    for apply in (
        lambda d, r: windows.forward_fill(d, ["k"], ["t", "i"], "v", "out", r),
        lambda d, r: windows.this_or_previous(d, ["k"], ["t", "i"], F.col("v") % 3 == 0, "out", r),
        lambda d, r: windows.occurrence(d, ["k"], ["t", "i"], "out", r),
    ):
        plain = {r.i: r.out for r in apply(df, None).collect()}
        for ranges in (F.floor(F.col("t") / 7), F.col("t"), F.lit(0)):
            out = apply(df, ranges)
            assert out.columns == ["i", "k", "t", "v", "out"]
            assert {r.i: r.out for r in out.collect()} == plain
        assert len(plain) == 600


def test_neighbour_fill_in_levels(spark, monkeypatch):
    monkeypatch.setattr(windows, "RANGES", 3)
    rng = random.Random(5)
    values = [rng.choice(["a", "b", None, None, None, None]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    filled = []
    for i, v in enumerate(values):
        before = next((x for x in reversed(values[:i]) if x), None)
        after = next((x for x in values[i + 1 :] if x), None)
        filled.append(v or (before if before == after else None))
    for levels in (1, 2, 3):
        got = windows.neighbour_fill(df, "i", "v", F.floor(F.col("i") / 2), levels).orderBy("i").collect()
        assert [r.filled for r in got] == filled
