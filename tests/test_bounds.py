"""Similarity joins with bounds against all pairs by difflib."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from tallyloom.functions import similarity
from tallyloom.operators import resolve


def made(seed, n):
    rng = random.Random(seed)
    parts = ["san", "jose", "rizal", "santa", "cruz", "del", "norte", "villa", "a", "lapu", "é", "aaaa", "national", "general", "hospital"]
    names = []
    for _ in range(n):
        name = " ".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 30])))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(name) + 1)
            name = name[:at] + rng.choice(["", "x", "s"]) + name[at + rng.choice([0, 1]) :]
        names.append(name)
    return names


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def test_bound_is_never_below_the_ratio(spark):
    names = made(1, 60)
    rows = [(a, b) for a in names for b in names]
    table = resolve.bounded(resolve.with_bags(resolve.with_bags(spark.createDataFrame(rows, "a string, b string"), "a", "l"), "b", "r"), "a", "b")
    got = table.select("a", "b", "_most").collect()
    assert all(r._most >= ratio(r.a, r.b) for r in got) and all(r._most <= 1 for r in got)
    assert sum(r._most for r in got) < 0.75 * len(got)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_best_of_block(spark, kind):
    """Ties go to the smallest id, text ids work, and few pairs are compared."""
    rng = random.Random(2)
    make = (lambda i: i) if kind == "int" else (lambda i: f"H{i:03}")
    left = [(make(i), rng.choice("xyz"), n) for i, n in enumerate(made(3, 60))] + [(make(900), "none", "rizal"), (make(901), "x", None)]
    right = [(make(i), rng.choice("xy"), n) for i, n in enumerate(made(4, 80))]
    right += [(make(500 + i), b, n) for i, (_, b, n) in enumerate(right[:20])]
    l, r = (spark.createDataFrame(x, f"{c} {kind}, b string, n{c} string") for x, c in ((left, "l"), (right, "r")))
    expected = {}
    for i, b, n in left:
        pool = [(k, v) for k, c, v in right if c == b]
        if not pool:
            expected[i] = (None, None, "no_block")
        elif n is None:
            expected[i] = (None, None, "not_found")
        elif any(v == n for _, v in pool):
            expected[i] = (min(k for k, v in pool if v == n), 1.0, "exact")
        else:
            best, score = None, -1.0
            for k, v in sorted(pool):
                if ratio(v, n) > score:
                    best, score = k, ratio(v, n)
            expected[i] = (best, score, "found" if score >= 0.75 else "not_found")
    got = resolve.exact_then_fuzzy(l, r, "l", "r", "b", "nl", "nr", 0.75)
    assert {x.l: (x.r, x.score, x.status) for x in got.collect()} == expected
    assert {s for *_, s in expected.values()} == {"exact", "found", "not_found", "no_block"}
    near = resolve.bounded(resolve.with_bags(l.withColumnRenamed("nl", "_ln"), "_ln", "l").join(resolve.with_bags(r.withColumnsRenamed({"nr": "_rn", "r": "_rid"}), "_rn", "r"), "b"), "_ln", "_rn")
    first, others = resolve.worth_comparing(near.where("_most < 1"), "l")
    assert first.count() + others.count() < near.count() / 3


@pytest.mark.parametrize("least", [0.7, 0.9, 1.0])
def test_alike_without_blocks(spark, least):
    a, b = made(5, 100), made(6, 100)
    l, r = (spark.createDataFrame([(x,) for x in [*n, None]], f"{c} string") for n, c in ((a, "a"), (b, "b")))
    expected = {(x, y): ratio(x, y) for x in set(a) for y in set(b) if ratio(x, y) >= least}
    assert {(x.a, x.b): x.ratio for x in resolve.alike(l, r, "a", "b", least).collect()} == expected
    assert len(expected) > 10 or least == 1.0
    if least == 0.9:
        assert resolve.alike_candidates(l, r, "a", "b", least).count() < 3 * len(expected) < len(set(a)) * len(set(b)) / 10


def test_containment(spark):
    rng = random.Random(7)
    letters = "abc"
    names = lambda n: [(rng.choice([1, 2]), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])))) for _ in range(n)]
    a, b = names(80), names(80)
    l, r = (spark.createDataFrame(x, f"k int, {c} string") for x, c in ((a, "a"), (b, "b")))
    expected = {(k, x, y) for k, x in a for j, y in b if k == j and x and y and (x in y or y in x)}
    got = resolve.contained_either_way(l, r, "a", "b", "k")
    assert {tuple(x) for x in got.collect()} == expected and len(expected) > 100
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString() and "Join Inner" in plan


def test_bags(spark):
    row = spark.createDataFrame([("banana", ""), ("a", None)], "a string, b string")
    bag = lambda c, k: similarity.numbered(similarity.runs(F.col(c), k))
    got = row.select(bag("a", 1).alias("x"), bag("a", 2).alias("y"), bag("b", 2).alias("z")).collect()
    assert got[0].x == ["b1", "a1", "n1", "a2", "n2", "a3"] and got[0].y == ["ba1", "an1", "na1", "an2", "na2"] and got[0].z == []
    assert got[1].x == ["a1"] and got[1].y == [] and not got[1].z
