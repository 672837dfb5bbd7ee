"""Polygons, nearest sites and the bootstrap against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F
from tallyloom.operators import aggregate, spatial

RINGS = "array<array<array<double>>>"


def crossings(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
                odd = not odd
    return odd


def star(rng, cx, cy, r):
    n = rng.choice([3, 5, 9])
    ring = [[cx + r * rng.uniform(0.2, 1) * math.cos(2 * math.pi * k / n), cy + r * rng.uniform(0.2, 1) * math.sin(2 * math.pi * k / n)] for k in range(n)]
    return [*ring, ring[0]]


def shapes(seed):
    rng = random.Random(seed)
    out = [(i, [star(rng, rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([1, 8, 40]))]) for i in range(30)]
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    return [*out, (100, [square(-100.0, 100.0), square(-90.0, 90.0)]), (101, []), (102, [[]]), (103, None), (104, [[[1.0, 1.0]]]), (105, [square(0.0, 1.0)]), (106, [[[1.0, 0.0], [2.0, 0.0], [2.0, 1.0], [1.0, 1.0], [1.0, 0.0]]])]


@pytest.mark.parametrize("size", [3.0, 25.0])
def test_points_in_polygons(spark, size):
    rng = random.Random(2)
    polygons = shapes(1)
    points = [(i, rng.uniform(-110, 110), rng.uniform(-110, 110)) for i in range(400)] + [(900, 1.0, 0.5), (901, 0.0, 0.0), (902, None, 1.0), (903, 1.0, 1.0)]
    expected = {(p, g) for p, x, y in points if x is not None for g, rings in polygons if rings and crossings(rings, x, y)}
    got = spatial.containing(spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(polygons, f"g int, rings {RINGS}"), "x", "y", "g", size)
    assert {(r.p, r.g) for r in got.collect()} == expected and len(expected) > 100
    assert (900, 106) in expected and (900, 105) not in expected  # a shared border is in one of two
    hollow = spatial.cells(spark.createDataFrame([p for p in polygons if p[0] == 100], f"g int, rings {RINGS}"), 5.0).count()
    assert hollow < 700  # of 41 x 41 cells of its bounds


def test_nearest_sites(spark):
    rng = random.Random(3)
    sites = [(i, rng.gauss(0, 5) if i % 3 else rng.uniform(-500, 500), rng.gauss(0, 5), rng.choice([1.0, 4.0, 30.0])) for i in range(80)] + [(500, None, 1.0, 3.0), (79, 2.0, 2.0, 3.0), (81, 2.0, 2.0, 3.0)]
    points = [(i, rng.uniform(-600, 600), rng.uniform(-9, 9)) for i in range(150)] + [(900, 2.0, 2.0), (901, 1.0, None)]
    p, s = spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(sites, "s int, x double, y double, r double")
    gap = lambda a, b: math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)
    whole = lambda rows: [r for r in rows if r[1] is not None and r[2] is not None]
    expected = {a[0]: min((gap(a, b), b[0]) for b in whole(sites)) for a in whole(points)}
    assert {r.p: (r.gap, r.s) for r in spatial.nearest(p, s, "p", "s", 2.0).collect()} == expected
    expected = {a[0]: min(v) for a in whole(points) if (v := [(gap(a, b), b[0]) for b in whole(sites) if gap(a, b) < b[3]])}
    assert {r.p: (r.gap, r.s) for r in spatial.nearest(p, s, "p", "s", 30.0, reach="r").collect()} == expected and expected
    assert spatial.nearest(p, s.where("false"), "p", "s", 2.0).count() == 0
    assert spatial.nearest(p.where("false"), s, "p", "s", 2.0).count() == 0


def test_drawn_points(spark):
    rows = [(seed, rings) for seed in range(25) for _, rings in shapes(4)[:32] if rings]
    thin = [[[0.0, 0.0], [100.0, 100.0], [100.0, 100.0001], [0.0, 0.0]]]
    table = spark.createDataFrame([*rows, (7, thin)], f"seed int, rings {RINGS}")
    got = table.select("seed", "rings", spatial.drawn_point(F.col("rings"), F.col("seed")).alias("p")).collect()
    hash_of = lambda n: (v := math.sin(n * 12.9898 + 78.233) * 43758.5453) - math.floor(v)
    for r in got:
        xs, ys = zip(*[q for ring in r.rings for q in ring], strict=True)
        tries = [(min(xs) + hash_of(r.seed * 31 + j * 7.1) * (max(xs) - min(xs)), min(ys) + hash_of(r.seed * 17 + j * 3.3) * (max(ys) - min(ys))) for j in range(60)]
        first = next((j for j, t in enumerate(tries) if crossings(r.rings, *t)), None)
        assert r.p.tried == first
        if first is not None:
            assert (r.p.x, r.p.y) == pytest.approx(tries[first], abs=1e-6) and crossings(r.rings, r.p.x, r.p.y)
    assert got[-1].p.tried is None and got[-1].p.x == pytest.approx(200 / 3, abs=1e-3)


def test_bootstrap_is_one_loop_to_the_bit(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("a", i, rng.gauss(0, 1e3)) for i in range(301)] + [("b", 1, 5.0)] + [(None, i, float(i)) for i in range(8)] + [("c", 1, None)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "k string, o int, v double").repartition(3)
    expected = {}
    for k in ("a", "b", None):
        values = [v for _, _, v in sorted((r for r in rows if r[0] == k and r[2] is not None), key=lambda r: r[1])]
        one, n = random.Random(7), len(values)
        means = sorted(sum(values[one.randrange(n)] for _ in range(n)) / n for _ in range(2000))
        expected[k] = (n, means[50], means[1949])
    got = aggregate.bootstrap_ci(table, ["k"], "v", "o")
    assert {r.k: (r.n, r.lo, r.hi) for r in got.collect()} == expected
    few = list(aggregate.draw_states(7, 301, 2000, 250))
    assert [(f, s) for f, s, _ in few] == [(250 * i, 250) for i in range(8)] and len({s for *_, s in few}) == 8
