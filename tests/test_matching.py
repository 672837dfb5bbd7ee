"""Matching against registries: every status, ties, and plain loops over all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F
from tallyloom.functions.text import fold
from tallyloom.plans import matching, people, places, records

SCHOOLS = "school_id string, muni string, names array<string>, name string, barangay string, annex_status string, offers_es boolean, offers_jhs boolean, offers_shs boolean"
ACTS = "ra int, munis array<string>, title string, action string, target string"


def school_rows(seed):
    rng = random.Random(seed)
    first, kinds = ["Luna", "Rizal", "Mabini", "Lunna", "San Roque"], ["NHS", "HS", "ES", "National High School", "Elementary School", "Central School", "IS", "National High School - Annex"]
    schools = []
    for i in range(60):
        name = f"{rng.choice(first)} {rng.choice(kinds)}"
        schools.append((f"{i:03}", rng.choice(["t1", "t2", "t3"]), sorted({name, f"{rng.choice(first)} {rng.choice(kinds)}"}), name, rng.choice(["San Isidro", "San Isidro II", "Pob.", None]), rng.choice(["", None, "Annex or Extension school(s)"]), *[rng.random() < 0.5 for _ in range(3)]))
    acts = []
    for ra in range(120):
        target = rng.choice([None, None, f"{rng.choice(first)} {rng.choice(['National High School', 'Elementary School', 'School'])}", "Zyxwv Trade School"])
        place = rng.choice([" in Barangay San Isidro, T", " in Sitio High School", " in Barangay Zzz", ""])
        acts.append((ra, rng.choice([["t1"], ["t2", "t1"], ["t9"], []]), f"An Act Separating the {target or 'High School'}{place}", rng.choice(["separate", "establish"]), target))
    return acts, schools


def test_schools_equal_a_plain_loop(spark):
    acts, schools = school_rows(1)
    table, listed = spark.createDataFrame(acts, ACTS), spark.createDataFrame(schools, SCHOOLS)
    names = sorted({n for s in schools for n in s[2]})
    targets = sorted({a[4] for a in acts if a[4]})
    both = spark.createDataFrame([(t, n) for t in targets for n in names], "t string, n string")
    likeness = {(r.t, r.n): r.s for r in both.select("t", "n", matching.school_likeness(matching.school_key(F.col("t")), matching.school_key(F.regexp_replace("n", r"\([^)]*\)", " "))).alias("s")).collect()}
    key = {r.b: r.k for r in listed.select("barangay").unionByName(spark.createDataFrame([("San Isidro",), ("Zzz",)], "barangay string")).distinct().select(F.col("barangay").alias("b"), fold(F.col("barangay")).alias("k")).collect()}
    expected = {}
    for ra, munis, title, action, target in acts:
        high = bool(re.search(matching.HIGH_LEVEL, target or title)) and not re.search(matching.LOW_LEVEL, target or "")
        low = bool(re.search(matching.LOW_LEVEL, target or "")) or (not high and bool(re.search(matching.LOW_LEVEL, title)))
        pool = [s for s in schools if s[1] in munis]
        barangays = re.findall(r"(?:Barangay|Sitio) (San Isidro|Zzz)", title)
        best, score = None, 0.0
        for s in pool:
            es, jhs, shs = s[6:]
            if high and not (jhs or shs or not es) or not high and low and not es:
                continue
            for n in s[2]:
                if target and likeness[target, n] > score:
                    best, score = s, likeness[target, n]
        if not pool:
            expected[ra] = (None, "no_town")
        elif not target and not barangays:
            expected[ra] = (None, "no_name")
        elif best and score >= 0.72:
            annex = re.search(matching.ANNEX_NAME, best[3]) or best[5] in matching.ANNEX_STATUS
            expected[ra] = (best[0], "annex" if action == "separate" and annex else "named")
        else:
            there = [s for s in pool if s[4] and any(key[b] in key[s[4]] for b in barangays) and (s[7] or s[8] or not high)]
            expected[ra] = (there[0][0], "barangay") if there else (None, "not_found")
    got = {r.ra: (r.school_id, r.match) for r in matching.match_schools(table, listed, F.col("target")).collect()}
    assert got == expected
    assert {m for _, m in expected.values()} == {"no_town", "no_name", "named", "annex", "barangay", "not_found"}


def hospital_acts(spark, *rows):
    return spark.createDataFrame(list(rows), "ra int, title string, munis array<string>, provinces array<string>")


@pytest.mark.parametrize("kind", ["int", "string"])
def test_hospitals(spark, kind):
    h = (lambda i: i) if kind == "int" else (lambda i: f"H{i}")
    beds = "An Act Increasing the Bed Capacity of the {} in the City of Q, from Ten to Fifty Beds"
    acts = hospital_acts(
        spark, (1, beds.format("Quirino Memorial Hospital"), ["q1"], ["P"]), (2, beds.format("Valenzuela Dela Rosa Hospital"), ["q1"], ["Valenzuela"]), (3, beds.format("Luna Vicente District Hospital"), [], ["Elsewhere"]),
        (4, beds.format("Mabini Hospital"), [], ["Elsewhere"]), (5, "An Act on Nothing", ["q1"], ["P"]), (6, beds.format("Zzz Hospital"), ["q1"], ["P"]), (7, beds.format("Far Lopez Hospital"), ["q1"], ["P"]),
    )
    registry = [
        (h(20), "Quirino Memorial Hospital", "Q", "P", "G"), (h(10), "Quirino Memorial Hospital", "Q", "P", "G"), (h(30), "Valenzuela Medical Center", "Q", "Valenzuela", "G"), (h(41), "Luna Vicente Dist. Hospital", "Z", "R", "G"), (h(40), "Luna Vicente District Hospital", "Y", "R", "G"),
        (h(50), "Mabini General Hospital", "Z", "R", "G"), (h(60), "Far Lopez Hospital", "W", "P", "G"), (h(5), "Quirino Memorial Hospital", "Q", "P", "P"),
    ]
    hospitals = spark.createDataFrame(registry, f"hid {kind}, name string, municipality string, province string, sector string")
    towns = spark.createDataFrame([("q1", "q")], "psgc10 string, town_key string")
    got = {r.ra: (r.hid, r.level, r.match) for r in matching.match_hospitals(acts, hospitals, towns).collect()}
    assert got[1] == (h(10), "town", "found")  # the first of equal scores, private ones not among them
    assert got[2][1:] == (None, "not_found")  # Valenzuela is only the province's name
    assert got[3] == (h(40), "national", "found")  # no hospital in its places: the closest name anywhere
    assert got[4][1:] == (None, "no_place")  # nearly equal words, but not nearly equal names
    assert got[5][2] == "no_name" and got[6][2] == "not_found" and got[7] == (h(60), "province", "found")


def test_winners_by_contained_surnames_equal_a_plain_loop(spark):
    rng = random.Random(4)
    names = ["li", "lim", "de lim", "lima", "limay", "o", "ong", "reyes", "delos reyes", "rey", "tan", "santan"]
    persons = [(f"p{i}", rng.choice(names), rng.choice(["", "ana", "jose"]), "", [13]) for i in range(40)]
    winners = [(i, 2004, rng.choice(names[::2]), rng.choice(["ana", "ben"]), "", "P") for i in range(12)]
    got = {r.id: r.wid for r in people.match_winners(spark.createDataFrame(persons, "id string, last string, first string, middle string, congresses array<int>"), spark.createDataFrame(winners, "wid int, year int, last string, first string, middle string, province string")).collect()}
    expected = {}
    for i, last, first, _, _ in persons:
        same = sum(1 for p in persons if p[1] == last)
        exact = [w for w in winners if w[2] == last]
        cands = exact or [w for w in winners if last in w[2] or w[2] in last]
        fits = [w for w in cands if first and (w[3] == first or w[3][:3] == first[:3])]
        if fits:
            expected[i] = fits[0][0]
        elif len(exact) == 1 and same == 1:
            expected[i] = exact[0][0]
        elif len(cands) == 1 and not first:
            expected[i] = cands[0][0]
    assert got == expected and any(w not in {x[0] for x in winners if x[2] == p[1]} for p in persons for w in [expected.get(p[0])] if w is not None)


def test_roll_up_takes_the_last_row(spark):
    rows = spark.createDataFrame([("a", 2001, 5, "first", 1), ("a", 2001, 3, "last", 2), ("a", 2000, 9, "old", 3), ("b", 2002, None, "none", 4)], "k string, y int, v int, name string, ord int")
    got = {r.k: (r.first_year, r.last_year, r.by_year, r.name) for r in records.roll_up(rows, "k", "y", "v", ["name"], "ord").collect()}
    assert got == {"a": (2000, 2001, {2000: 9, 2001: 3}, "last"), "b": (2002, 2002, {2002: None}, "none")}


def test_close_towns_go_to_the_first(spark):
    acts = spark.createDataFrame([(1, "An Act on Roads in the Municipality of Malabonn, Province of Abra", 1990)], "ra int, title string, year int")
    towns = [("02", "Malabona", "Abra", "Mun", "malabona"), ("01", "Malabono", "Abra", "Mun", "malabono")]
    gazetteer = spark.createDataFrame(towns, "psgc10 string, name string, province string, level string, town_key string")
    found = places.locate(acts, gazetteer, places.province_dimension(spark, ["Abra"])).first()
    assert found.munis == ["01"]


@pytest.mark.parametrize("ranges", [4, 64, None])
def test_places_in_order(spark, ranges):
    """Exact and the same in each run, over rows that were shuffled before."""
    rng = random.Random(5)
    values = rng.sample(range(10**9), 20_000)
    table = spark.createDataFrame([(v,) for v in values], "v long").repartition(7, "v")
    expected = {v: i for i, v in enumerate(sorted(values))}
    for _ in range(2):
        assert {r.v: r._row for r in records.row_index(table, "v", ranges).collect()} == expected


def test_seeded_sample_equals_a_plain_loop(spark):
    values = random.Random(6).sample(range(10**9), 5000)
    order = sorted(values)
    expected = {i: order[k] for i, k in enumerate(random.Random(8).sample(range(5000), 40))}
    for parts in (3, 11):
        table = spark.createDataFrame([(v,) for v in values], "v long").repartition(parts)
        assert {r.draw: r.v for r in records.seeded_sample(table, "v").collect()} == expected
    assert records.seeded_sample(spark.createDataFrame([], "v long"), "v").count() == 0
