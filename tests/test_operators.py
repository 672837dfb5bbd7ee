import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from tallyloom.functions import dates, geo, text
from tallyloom.functions.similarity import likeness, ro_ratio, ro_ratio_tokens
from tallyloom.operators import aggregate, dedup, graph, intervals, provenance, resolve, rules, windows
from tallyloom.plans import laws
from tallyloom.sources import readers
from tallyloom.streaming import daily


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_terms_at_their_edges(spark):
    days = ["1948-04-14", "1948-04-15", "1948-04-16", "1948-04-17", "1957-03-17", "1980-01-01", None]
    got = column(spark, days, lambda c: laws.president_of(c.cast("date")))
    assert got == ["Roxas", None, None, "Quirino", None, "Marcos Sr.", None]
    got = column(spark, ["1949-12-29", "1980-01-01", "1946-01-01", "2028-07-24"], lambda c: laws.congress_of(c.cast("date")))
    assert got == [1, 7, None, 20]


def test_dates(spark):
    given = ["Februaty 12, 2001", "OCT 23 2025", "Sept. 1, 1969", "June 31, 1990", "July 3,2015", "Smarch 3, 2000", "", None, "May 5, 1950"]
    got = column(spark, given, dates.parse_date)
    d = dt.date
    assert got == [d(2001, 2, 12), d(2025, 10, 23), d(1969, 9, 1), None, d(2015, 7, 3), d(2000, 3, 3), None, None, d(1950, 5, 5)]


def test_ratio_keeps_argument_order(spark):
    assert (likeness("tide", "diet"), likeness("diet", "tide")) == (0.25, 0.5)
    rows = spark.createDataFrame([("tide", "diet", ["a", "b"], ["a"])], "a string, b string, x array<string>, y array<string>")
    got = rows.select(ro_ratio("a", "b"), ro_ratio("b", "a"), ro_ratio_tokens("x", "y")).first()
    assert tuple(round(v, 4) for v in got) == (0.25, 0.5, 0.6667)


def test_text_functions(spark):
    assert column(spark, ["Sto. Niño", "Peñaranda", None, "SN JOSE "], text.fold) == ["santo nino", "penaranda", "", "san jose"]
    assert column(spark, ["City of Baguio", "Iligan City", "Lapu-Lapu (Opon)"], text.place_core) == ["baguio", "iligan", "lapu lapu"]
    assert column(spark, ["an act an act", "one two three"], text.halve_doubled) == ["an act", "one two three"]
    assert column(spark, ["Fourteen Hundred and Eleven", "zero", "Twenty-five", "two thousand x one", None], text.words_to_int) == [1411, None, 25, 2000, None]
    got = column(spark, ["AN ACT CREATING THE CITY OF PASIG", "An Act Mixed", "bag-ong silang ii", "THE (LTO) OFFICE"], text.smart_title)
    assert got == ["An Act Creating the City of Pasig", "An Act Mixed", "Bag-ong Silang II", "The (LTO) Office"]
    assert column(spark, ["<p>a&amp;b</p><script>x</script>c<br/>d"], text.html_text) == ["a&b\n c\nd"]
    assert column(spark, ["1", " YES", "no", None], text.truthy) == [True, True, False, None]
    assert column(spark, ["37.0", "0102", None], text.pad_code) == ["0000000037", "0000000102", None]
    assert column(spark, ["PeÃ±a"], text.repair_encoding) == ["Peña"]
    assert column(spark, [1, 2, 11, 13, 22, 103], text.ordinal, "int") == ["1st", "2nd", "11th", "13th", "22nd", "103rd"]


def test_classifier_falls_through_guards(spark):
    titles = [
        "An Act Granting Philippine Citizenship to John Doe",
        "An Act Converting the Municipality of Baliuag in the Province of Bulacan into a Component City",
        "An Act Changing the Name of the Barangay High School Street of Poblacion",
        "An Act Amending Item 5 of Republic Act Numbered Fourteen Hundred and Eleven",
        "An Act Amending Certain Items on Bonds",
        "An Act Establishing a National High School in Barangay Tamdagan, Municipality of Vintar, Ilocos Norte",
        "An Act Amending the Local Government Code on Component City Income",
        "An Act Concreting Barangay Roads in All Barangays",
        "An Act on Fair Trade",
        None,
    ]
    got = column(spark, titles, laws.category)
    assert got == ["citizenship", "lgu", "school", "public_works", "national", "school", "national", "national", "national", "national"]
    assert column(spark, ["An Act to Establish a School", "Act Now Converting It", "Nothing"], laws.action) == ["establish", "convert", "other"]
    got = column(spark, ["Increasing the Bed Capacity from Fifty (50) to One Hundred (100) Beds", "From ten beds to twenty-five beds", "No beds"], laws.beds)
    assert [tuple(b) for b in got] == [(50, 100), (10, 25), (None, None)]


def test_provenance_and_dedup(spark):
    rows = spark.createDataFrame([(1, None, "b"), (2, "a", "b"), (3, None, None)], "k int, x string, y string")
    got = rows.select("k", provenance.coalesce_from([("first", F.col("x")), ("second", F.col("y"))]).alias("s")).orderBy("k").collect()
    assert [tuple(r.s) for r in got] == [("b", "second"), ("a", "first"), (None, None)]
    dup = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (2, 1, "z")], "k int, o int, v string")
    assert {tuple(r) for r in dedup.keep_first(dup, ["k"], ["o"]).select("k", "v").collect()} == {(1, "y"), (2, "z")}
    assert {tuple(r) for r in dedup.keep_last(dup, ["k"], ["o"]).select("k", "v").collect()} == {(1, "x"), (2, "z")}
    assert sorted(r[0] for r in dedup.missing_numbers(spark.createDataFrame([(1,), (3,)], "n int"), "n", 1, 4).collect()) == [2, 4]
    fresh, cached = spark.createDataFrame([(1, "n")], "k int, v string"), spark.createDataFrame([(1, "o"), (2, "p")], "k int, v string")
    assert sorted(map(tuple, provenance.prefer_fresh(fresh, cached, "k", ["v"]).collect())) == [(1, "n", "fresh"), (2, "p", "cached")]
    flags = spark.createDataFrame([(1, "National"), (1, "National"), (2, "Local"), (2, "National")], "g int, s string")
    assert sorted(map(str, (tuple(r) for r in provenance.default_only_blank(flags, "g", "s", "Local").collect()))) == ["(1, None)", "(1, None)", "(2, 'Local')", "(2, 'National')"]
    lists = spark.createDataFrame([(1, ["x", "b", "a"]), (2, ["x"])], "k int, vs array<string>")
    assert [tuple(r) for r in dedup.probe_array(lists, "k", "vs", spark.createDataFrame([("a",), ("b",)], "p string"), "p").collect()] == [(1, 1, "b")]


def test_windows(spark):
    rows = spark.createDataFrame([(0, None), (1, "a"), (2, None), (3, None), (4, "a"), (5, None), (6, "b"), (7, None)], "i int, v string")
    for width in (1, 2, 3, 100):
        got = windows.neighbour_fill(rows, "i", "v", F.floor(F.col("i") / width)).orderBy("i").collect()
        assert [r.filled for r in got] == [None, "a", "a", "a", "a", None, "b", None]
        assert [r.fill_source for r in got] == [None, "own", "neighbours", "neighbours", "own", None, "own", None]
    assert windows.neighbour_fill(rows.where("false"), "i", "v", F.lit(0)).count() == 0
    assert column(spark, [1.0, 2.0, 29.9, 80.0, None], lambda c: windows.threshold_bin(c, [2, 5, 12, 30, 80]), "double") == [0, 1, 3, 5, 0]


def test_aggregates(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 7), ("c", None)], "k string, v int")
    assert {tuple(r) for r in aggregate.upper_median(rows, ["k"], "v", "m").collect()} == {("a", 3), ("b", 7)}
    modes = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b")], "o int, v string").withColumn("k", F.lit(1))
    assert aggregate.mode_first(modes, ["k"], "v", "o", "best").first()["best"] == "b"
    assert aggregate.share_of_large_groups(rows.where("false"), "k", 2, "s").first()[0] == 0.0
    assert column(spark, [0.5, 1.5, 2.5], lambda c: aggregate.half_even(c, 0), "double") == [0.0, 2.0, 2.0]
    one = aggregate.bootstrap_ci(rows.withColumn("o", F.col("v")), ["k"], "v", "o", draws=100, low=2, high=97)
    assert {r.k: (r.n, r.lo <= r.hi) for r in one.collect()} == {"a": (4, True), "b": (1, True)}
    assert sorted(r[0] for r in aggregate.top_tied(rows.where("k <> 'b'").withColumn("v", F.least("v", F.lit(3))), "v").select("v").collect()) == [3, 3, 3]


def test_bootstrap_query_takes_2000_draws(spark):
    from tallyloom.plans import analytics

    sf = "/root/testdata/sf0.001"
    values = {}
    for r in spark.read.parquet(f"{sf}/customer.parquet").orderBy("c_custkey").collect():
        values.setdefault(r.c_mktsegment, []).append(r.c_acctbal)
    for r in analytics.bootstrap_ci(spark, sf).collect():
        v, rng = values[r.c_mktsegment], random.Random(7)
        means = sorted(sum(v[rng.randrange(len(v))] for _ in v) / len(v) for _ in range(2000))
        assert (r.n, r.lo, r.hi) == (len(v), means[50], means[1949])


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f")], "old string, new string")
    got = {(r.start, r["name"]): r.hop for r in graph.later_names(edges, 4).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "a"} == {"b": 1, "c": 2, "d": 3, "e": 4}
    splits = [("P", "Q", 1960), ("Q", "R", 1970), ("P", "S", 1950)]
    assert graph.successors(splits, "P", None) == ["P", "Q", "S", "R"]
    assert graph.successors(splits, "P", 1955) == ["P", "Q", "R"]
    assert graph.successors(splits, "P", 1990) == ["P"]
    assert graph.successors(splits, "P", 1955, defunct=frozenset("P")) == ["Q", "R"]
    assert graph.successors(splits, "P", 1990, defunct=frozenset("P")) == ["Q", "S"]


def test_resolution(spark):
    left = spark.createDataFrame([(1, "p", "lapaz"), (2, "p", "rizal"), (3, "q", "zzz"), (4, "r", "x")], "l int, b string, n string")
    right = spark.createDataFrame([(10, "p", "lapas"), (11, "p", "rizal"), (12, "p", "rizal"), (13, "q", "abc")], "r int, b string, n string")
    got = {r.l: (r.r, r.status) for r in resolve.exact_then_fuzzy(left, right, "l", "r", "b", "n", "n", 0.75).collect()}
    assert got == {1: (10, "found"), 2: (11, "exact"), 3: (13, "not_found"), 4: (None, "no_block")}
    near = resolve.nearest_in_block(spark.createDataFrame([(1, 0, 10.0), (2, 0, 99.0)], "l int, k int, x double"), spark.createDataFrame([(5, 0, 20.0), (4, 0, 0.0)], "r int, k int, y double"), "l", "r", "k", "x", "y", 13.0)
    assert [tuple(r) for r in near.collect()] == [(1, 4, 10.0)]
    mentions = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "m int, k string")
    towns = spark.createDataFrame([("x", "A", "City"), ("x", "B", "Town"), ("y", "A", "Town"), ("z", "A", "Town"), ("z", "B", "Town")], "k string, p string, level string")
    got = resolve.unique_candidate(mentions, towns, "m", "k", [F.col("level") == "City"]).select("m", "p").collect()
    assert sorted(map(tuple, got)) == [(1, "A"), (2, "A")]


def test_rules_and_rings(spark):
    r = [rules.Rule("one", "a", F.length("v") > 3), rules.Rule("two", "ab")]
    assert column(spark, ["ab", "abcd", "zz", None], lambda c: rules.first_match(c, r, "none")) == ["two", "one", "none", "none"]
    square = [[[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0], [0.0, 0.0]], [[1.0, 1.0], [1.0, 1.0], [1.0, 1.0]]]
    got = column(spark, square, geo.ring_centroid, "array<array<double>>")
    assert [tuple(round(x, 9) for x in g) for g in got] == [(2.0, 1.0, 8.0), (1.0, 1.0, 0.0)]


@pytest.mark.parametrize("closed", [True, False])
def test_term_join_equals_case(spark, closed):
    terms = [(1, dt.date(2000, 1, 1), dt.date(2000, 6, 1)), (2, dt.date(2000, 6, 2), dt.date(2003, 1, 1))]
    rows = spark.createDataFrame([(dt.date(1999, 12, 31) + dt.timedelta(days=k * 17),) for k in range(80)], "d date")
    table = spark.createDataFrame(terms, "n int, a date, b date")
    got = intervals.join_terms(rows, "d", table, "a", "b", closed=closed, days_per_bucket=100).select("d", "n").collect()
    want = rows.select("d", intervals.term_of(F.col("d"), terms, closed).alias("n")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_sources(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "no")
        z.writestr("x.csv", "id,name\n1,Ni\xf1o\n".encode("cp1252"))
    got = readers.read_zipped_csv(spark, str(tmp_path / "a.zip"), ["id", "name", "gone"]).collect()
    assert [tuple(r)[:3] for r in got] == [("1", "Niño", None)]
    (tmp_path / "t.toml").write_text('a = 1\n[b]\nc = ["x"]\n')
    assert '"c": ["x"]' in readers.read_toml(spark, str(tmp_path / "t.toml")).first()["json"]
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"properties":{"id":1},"geometry":null},{"properties":{"id":2},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,0]],[[9,9]]]}},{"properties":{"id":3},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0]]],[[[1,1]]]]}}]}')
    (tmp_path / "e.json").write_text('{"type":"GeometryCollection","geometries":[]}')
    got = readers.read_geojson(spark, str(tmp_path / "*.json")).collect()
    assert sorted(len(r.parts) for r in got) == [1, 2]
    page = spark.createDataFrame([(1, '<!-- <tr><td>no --><table><tr><th>h<tr class="x"><td>RA 1</td><td><a href="u.html">T</a></td></tr>')], "p int, h string")
    rows = readers.html_table_rows(page, "h", ["p"]).orderBy("row").collect()
    assert (rows[1].cells[0], rows[1].href) == ("RA 1", "u.html")
    readers.write_csv(spark.createDataFrame([(2, 'q"x'), (1, "y")], "a int, b string"), str(tmp_path / "out"), ["b", "a"], ["a"])
    back = readers.read_csv(spark, str(tmp_path / "out"), "b string, a string").collect()
    assert sorted(map(tuple, back)) == [('q"x', "2"), ("y", "1")]
    union = readers.union_years({"1": spark.createDataFrame([(1,)], "a int"), "2": spark.createDataFrame([(2, 3)], "a int, b int")})
    assert union.columns == ["a", "year", "b"]


def test_stream_of_days(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), "a"), (dt.datetime(2024, 1, 1, 6), "a"), (dt.datetime(2024, 1, 5, 0), "b")], "ts timestamp, event_type string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = daily.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("days").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(str, spark.table("days").collect())) == sorted(map(str, daily.daily_counts(rows).collect()))
