import datetime as dt

from pyspark.sql import functions as F
from tallyloom.operators import aggregate
from tallyloom.plans import marts, matching


def test_barangays(spark):
    acts = [
        (1, "An Act Creating Barangay San Roque in the Municipality of X", "lgu", ["0100001000"]), (2, "An Act Separating Sitio A and Constituting It into a Separate Barangay to be Known as Barangay Malipayonn, X", "lgu", ["0100001000"]),
        (3, "An Act Creating Barangay Zzz in the City of Y", "lgu", ["0200000000"]), (4, "An Act Creating Certain Barangays", "lgu", ["0100001000"]), (5, "An Act Amending the Local Government Code by Creating Barangay A", "lgu", []),
    ]
    census = [("0100001000", "San Roque (Pob.)"), ("0100001000", "Malipayon"), ("0100001000", "San Rogue")]
    got = {r.ra: (r.match, r.census_name) for r in matching.match_barangays(spark.createDataFrame(acts, "ra int, title string, category string, munis array<string>"), spark.createDataFrame(census, "muni string, barangay string")).collect()}
    assert got == {1: ("found", "San Roque (Pob.)"), 2: ("found", "Malipayon"), 3: ("no_town", None), 4: ("no_name", None)}


def test_scores(spark):
    def score(make, *rows):
        table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, p array<string>")
        return [r.v for r in table.select("i", make.alias("v")).orderBy("i").collect()]

    a, b, place = F.col("a"), F.col("b"), F.col("p")
    got = score(
        matching.school_likeness(a, b), ("rizal national high school", "rizal national high school", None), ("rizal national high school", "bonifacio national high school", None),
        ("jose rizal high school", "jose rizal national high school", None), ("jose rizall school", "jose rizal school", None), ("high school", "central school", None),
    )
    assert got[0] == 1.05 and got[1] < matching.SCHOOL_LEAST <= got[2] and got[3] > 1 and got[4] < 0.8
    got = score(matching.hospital_likeness(a, b, place), ("bataan general hospital", "bataan general hospital and medical center", ["bataan"]), ("quirino memorial hospital", "rizal medical center", []))
    assert got == [0.95, 0.0]


def test_hospitals_and_schools(spark):
    acts = spark.createDataFrame([(1, "An Act Increasing the Bed Capacity of the Quirino Memorial Hospital in the City of Q, from Ten to Fifty Beds", ["q1"], ["P"]), (2, "An Act on Nothing", ["q1"], ["P"]), (3, "An Act Converting the Luna District Hospital into a General Hospital", [], ["Elsewhere"])], "ra int, title string, munis array<string>, provinces array<string>")
    registry = spark.createDataFrame([(7, "Quirino Mem. Med. Center", "Q", "P", "G"), (8, "Quirino Clinic", "Q", "P", "P"), (9, "Rizal Hospital", "Z", "P", "G")], "hid int, name string, municipality string, province string, sector string")
    towns = spark.createDataFrame([("q1", "q")], "psgc10 string, town_key string")
    got = {r.ra: (r.hid, r.level, r.match) for r in matching.match_hospitals(acts, registry, towns).collect()}
    assert got == {1: (7, "town", "found"), 2: (None, None, "no_name"), 3: (None, None, "no_place")}
    schools = spark.createDataFrame([("a", "q1", ["Luna NHS", "Luna HS"]), ("b", "q1", ["Rizal ES"])], "school_id string, muni string, names array<string>")
    wanted = spark.createDataFrame([(1, ["q1"], "Luna National High School"), (2, ["q1"], None), (3, [], "X"), (4, ["q1"], "Mabini Trade School")], "ra int, munis array<string>, target string")
    got = {r.ra: (r.school_id, r.match) for r in matching.match_schools(wanted, schools, F.col("target")).collect()}
    assert got == {1: ("a", "named"), 2: (None, "no_name"), 3: (None, "no_town"), 4: (None, "not_found")}


def test_marts(spark):
    d = dt.date
    rows = [
        (1, d(1990, 1, 5), 8, "school", "local", "t", True, ["A", "B"], ["01"], "https://lawphil.net/statutes/repacts/ra1990/ra_1_1990.html", "P1"), (2, d(1990, 1, 5), 8, "school", "local", "t", None, ["A"], [], "x", "P1"),
        (4, d(1991, 3, 1), 9, "citizenship", "private", "An Act Granting Philippine Citizenship to Jane Doe", False, [], [], None, "P2"), (5, None, None, "road", "local", "t", None, [], ["99"], "y", None),
    ]
    laws = spark.createDataFrame(rows, "ra int, date date, congress int, category string, scope string, title string, lapsed boolean, provinces array<string>, munis array<string>, href string, president string")
    assert {(r.province, r.congress): r.n for r in marts.province_counts(laws).collect()} == {("A", 8): 1.5, ("B", 8): 0.5}
    assert [(r.ra, r.towns, r.link) for r in marts.law_rows(laws, spark.createDataFrame([("01", "Town")], "psgc10 string, name string")).orderBy("ra").collect()] == [(1, "Town", "1990"), (2, "", "x"), (4, "", ""), (5, "99", "y")]
    c = marts.calendar(laws)
    assert [tuple(r) for r in c["big_days"].collect()] == [(d(1990, 1, 5), 2), (d(1991, 3, 1), 1)] and c["share_in_batches"].first()[0] == 0.0
    assert {tuple(r) for r in c["lapsed"].collect()} == {("P1", 1, 1, 2), ("P2", 0, 0, 1)}
    assert marts.citizenship_names(laws).first()["name"] == "Jane Doe"
    assert tuple(marts.headline(laws).first()) == (4, 3, 1, 1990, 1991, 2, 2, 1)
    labels = spark.createDataFrame([(1, "school", "local"), (2, "road", "local"), (77, "road", "local")], "ra int, category string, scope string")
    assert tuple(marts.accuracy(laws, labels).first()) == (2, 0.5, 1.0)
    bills = spark.createDataFrame([(8, 1, "local", None, d(1990, 1, 1)), (8, 2, "local", 5, d(1990, 1, 1)), (8, 3, "national", None, d(1990, 1, 2))], "congress int, bill int, scope string, ra int, date_filed date")
    assert {tuple(r) for r in marts.bill_funnel(bills, spark.createDataFrame([(8, 1)], "congress int, bill int")).collect()} == {(8, "local", 2, 2), (8, "national", 1, 0)}
    assert tuple(marts.busiest_filing_day(bills).first()) == (8, d(1990, 1, 1), 2, 3)
    terms = spark.createDataFrame([("x", 8, True), ("y", 8, False), ("z", 8, None)], "author string, congress int, family_seat boolean")
    filed = spark.createDataFrame([("x", 8, "local"), ("x", 8, "national")], "author string, congress int, scope string")
    counted = marts.term_counters(terms, filed, filed)
    assert {r.author: (r.bills_filed, r.local_laws_enacted) for r in counted.collect()} == {"x": (2, 1), "y": (0, 0), "z": (0, 0)}
    assert {r.family_seat: (r.n, r.median, r.zero_share) for r in marts.family_summary(counted, "author").collect()} == {True: (1, 1, 0.0), False: (1, 0, 1.0)}
    beds = spark.createDataFrame([(1, "found", 0.95, 50, "H", 40), (3, "found", 0.95, 60, "H", 40), (2, "found", 0.8, 10, "I", 5), (4, "found", 1.0, 10, "Mental X", 5)], "ra int, match string, match_score double, beds_to int, registry_name string, registry_beds int")
    assert [(r.ra, r.gap) for r in marts.hospital_beds(beds).collect()] == [(3, -20)]
    found = spark.createDataFrame([(1, 2020, "establish", "named", 2010), (2, 2021, "convert", "annex", None), (3, 1980, "establish", "named", 1)], "ra int, year int, action string, match string, first_year int")
    assert tuple(marts.school_existed(found).first()) == (2, 1, 1, 1) and marts.school_levels(found).count() == 2
    efforts = spark.createDataFrame([("local", True, 3, 0), ("national", True, 5, 4), ("local", False, 0, 0)], "scope string, linked boolean, floor_days int, debate_days int")
    assert {r.scope: (r.n, r.linked, r.share_laws, r.share_debate) for r in marts.effort_shares(efforts).collect()} == {"local": (2, 1, 0.667, 0.0), "national": (1, 1, 0.333, 1.0)}
    authored = spark.createDataFrame([(1, "x", "A", "road"), (2, "y", "B", "road"), (3, "x", "B", "court"), (4, "y", "B", "court")], "ra int, author string, province string, category string")
    assert [(r.author, r.province) for r in marts.top_authors(authored).collect()] == [("x", "A"), ("y", "B")]
    assert marts.kinds_by_congress(laws, F.col("category")).count() == 2


def test_rename_edges(spark):
    acts = [
        (3, "An Act Renaming the Luna Hospital in the City of Q as the Rizal General Hospital", "hospital"), (2, "An Act Changing the Name of Luna Hospital to Rizal General Hospital", "hospital"),
        (4, "An Act Upgrading the Rizal General Hospital into a Center to be known as the Mabini Medical Center", "hospital"), (5, "An Act Renaming the Luna Hospital to Luna District Hospital", "hospital"),
        (6, "An Act Renaming the Luna Hospital to Bonifacio Hospital", "school"), (7, None, "hospital"), (8, "An Act Renaming the District Hospital to Paz Hospital", "hospital"),
    ]
    table = spark.createDataFrame(acts, "ra int, title string, category string")
    got = {(r.old, r.new, r.ra) for r in matching.rename_edges(table).collect()}
    assert got == {("luna hospital", "rizal general hospital", 2), ("rizal general hospital", "mabini medical center", 4)}
    assert matching.rename_edges(table.limit(0)).count() == 0


def test_town_schools(spark):
    towns = spark.createDataFrame([("a", "luna", "abra", ["old", "luna"], False), ("b", "paz", "abra", ["older", "old"], False), ("c", "qc", "metro manila", ["qc"], True), ("d", "none", None, None, False)], "psgc10 string, name string, province string, keys array<string>, metro boolean")
    schools = spark.createDataFrame([(1, "luna", "abra"), (2, "luna", "cebu"), (3, "old", "cebu"), (4, "older", "x"), (5, "older", "y"), (6, "qc", "ncr 1"), (7, "qc", None), (8, None, "abra")], "school_id int, town string, province string")
    got = {(r.psgc10, r.school_id) for r in matching.town_schools(towns, schools).collect()}
    assert got == {("a", 1), ("b", 3), ("c", 6), ("c", 7)}
    assert matching.town_schools(towns, schools.limit(0)).count() == 0


def test_examples_totals_and_days(spark):
    import random

    rows = [(i, 8 if i % 3 else 9, "local" if i % 2 else "national", f"Title {i} " + "x" * 300 if i % 5 else "") for i in range(400)]
    good = [r for r in rows if r[1] == 8 and r[2] == "local" and r[3]]
    expected = {d: good[k][3][:220] for d, k in enumerate(random.Random(8).sample(range(len(good)), 40))}
    table = spark.createDataFrame(rows, "o int, congress int, scope string, title string").repartition(5)
    assert {r.draw: r.title for r in marts.filed_examples(table, "o").collect()} == expected
    wide = spark.createDataFrame([("3.9", "-2.5", "", "7"), ("nan", None, "x", "7"), ("1e3", "inf", " 4 ", "7")], "g1_a string, kinder_b string, jhsng_c string, g1 string")
    totals = aggregate.row_totals(wide, r"^(kinder|g\d+|esng|jhsng)_|^g1[12]_", "n")
    assert [r.n for r in totals.collect()] == [1, 0, 1004]
    efforts = spark.createDataFrame([(2, dt.date(2001, 1, 2)), (1, dt.date(2001, 1, 5)), (3, None)], "ra int, third date")
    assert tuple(marts.biggest_third_day(efforts).first()) == (dt.date(2001, 1, 5), 1) and marts.biggest_third_day(efforts.where("third is null")).count() == 0
