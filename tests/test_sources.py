"""Archives as a source, table functions, the sink by key, and nested records."""

import json
import zipfile

from pyspark.sql import functions as F
from tallyloom.plans import records
from tallyloom.sources import nested, readers, sinks


def test_archives_a_partition_a_member(spark, tmp_path):
    readers.register(spark)
    with zipfile.ZipFile(tmp_path / "2001.zip", "w") as z:
        z.writestr("a_old.csv", "id,name\n1,Ñandú\n".encode("latin-1"))
        z.writestr("b.csv", 'id,name,more\n2,"two\nlines",x\n3,"a ""q"" b"\n'.encode())
        z.writestr("read.me", "no")
    with zipfile.ZipFile(tmp_path / "2002.zip", "w") as z:
        z.writestr("c.CSV", "name,id\r\nNi\xf1o – €,4\r\n".encode("cp1252"))
        z.writestr("empty.csv", "")
        z.writestr("e.csv", "﻿id,name\n5,é\n".encode())
    (tmp_path / "other.txt").write_text("no")
    source = spark.read.format("zipcsv").option("encodings", json.dumps({"*_old.csv": "latin-1"}))
    table = source.schema("id string, name string, gone string, member string").load(str(tmp_path))
    assert table.rdd.getNumPartitions() == 5
    got = sorted(map(tuple, table.collect()))
    assert got == [("1", "Ñandú", None, "a_old.csv"), ("2", "two\nlines", None, "b.csv"), ("3", 'a "q" b', None, "b.csv"), ("4", "Niño – €", None, "c.CSV"), ("5", "é", None, "e.csv")]
    assert spark.read.format("zipcsv").option("encodings", '{"*_old.csv": "latin-1"}').load(str(tmp_path / "2001.zip")).columns == ["id", "name", "archive", "member"]
    assert spark.read.format("zipcsv").option("members", "*.none").schema("id string").load(str(tmp_path)).count() == 0


def test_table_function_equals_the_expression(spark):
    readers.register(spark)
    html = ['<!-- <tr><td>no --><TABLE><tr><th>h<TR class="x"><td>RA  1</td> <td><a href="u.html">T\n&nbsp;</a></td></tr>', "<tr>", "", "no rows", None, "<tr><td>a</td><td>b</td><td></td><a HREF = 'q'>"]
    pages = spark.createDataFrame(list(enumerate(html)), "p int, html string")
    expected = sorted(map(tuple, readers.html_table_rows(pages, "html", ["p"]).select("p", "row", "cells", "href").collect()))
    got = spark.sql("SELECT p, r.row, r.cells, r.href FROM {pages}, LATERAL table_rows(html, 'tr') r", pages=pages)
    assert sorted(map(tuple, got.collect())) == expected and len(expected) == 4


def test_upsert_is_idempotent(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v string, w int"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    held = lambda: sorted(map(tuple, sinks.read_table(spark, path, schema).select("k", "v", "w").collect()))
    sinks.upsert(frame((1, "a", 1), (9, "b", 2), (25, "c", None), (None, "x", 1)), path, "k", ["v", "w"], keys=10)
    assert held() == [(1, "a", 1), (9, "b", 2), (25, "c", None)]
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").glob("_range=2/*.parquet")}
    batch = frame((9, "B", 3), (-4, "n", 0), (1, None, None))
    for _ in range(2):
        origin = {r.k: r.origin for r in sinks.upsert(batch, path, "k", ["v", "w"], keys=10).collect()}
        assert held() == [(-4, "n", 0), (1, None, None), (9, "B", 3), (25, "c", None)]
    assert origin == {9: "fresh", -4: "fresh", 1: "fresh"}
    assert untouched == {f: f.stat().st_mtime_ns for f in (tmp_path / "t").glob("_range=2/*.parquet")} and untouched
    assert sinks.upsert(frame((2, "z", 1)), path, "k", ["v", "w"], keys=10).where("origin = 'cached'").count() == 2


def test_nested_bills_and_memberships(spark):
    def bill(**more):
        return json.dumps(more)

    acted = [{"action": "Filed"}, {"action": "Approved by the President", "date": "d1"}, {"action": "Republic Act No. 123", "date": "d2"}]
    docs = [
        bill(meta={"congress": 8, "bill_number": 1, "title": " T ", "congress_website_title": "W", "congress_website_author_codes": ["K1", "K2", "K1"]}, history=acted, status=[{"status": "a"}, {"status": "b", "date": "x"}], committees=[{"name": "C"}, {"name": "D"}]),
        bill(meta={"congress": 9, "long_title": "L", "congress_website_author_codes": []}, history=[], status=[], committees=[]), bill(meta={"congress": 10}), bill(),
        bill(history=[{"action": "republic act 77"}, {"action": None}, {"action": "lapsed into law"}, {"action": "became Republic Act 555, lapsed into law", "date": "d"}]), bill(history=[{"action": "Republic Act 77"}]), "no json", None,
    ]
    table = spark.createDataFrame(list(enumerate(docs)), "i int, j string")
    got = {r.i: r for r in nested.bills(table, "j", ["i"]).collect()}
    a = got[0]
    assert (a.congress, a.bill, a.title, a.long_title, a.author_code, a.n_authors, a.status, a.status_date, a.ra, a.ra_history_date, a.committee) == (8, 1, "T", "W", "K1", 2, "b", "x", 123, "d2", "C")
    assert all((got[i].author_code, got[i].n_authors, got[i].status, got[i].ra, got[i].committee) == (None, 0, None, None, None) for i in (1, 2, 3, 6, 7))
    assert got[1].long_title == "L" and (got[4].ra, got[4].ra_history_date) == (555, "d") and got[5].ra is None
    people = [
        json.dumps({"id": "p1", "first_name": "Ana", "last_name": "Cruz", "congress_website_author_keys": ["K1", "K9"], "memberships": [{"congress": 9, "subtype": "house"}, {"congress": 8, "subtype": "house"}, {"congress": 7, "subtype": "senate"}]}),
        json.dumps({"id": "p2", "last_name": "Lim", "congress_website_author_keys": ["K1"], "memberships": [{"congress": 8, "subtype": "house"}]}), json.dumps({"id": "p3"}),
    ]
    sat = records.memberships(nested.people(spark.createDataFrame(list(enumerate(people)), "o int, j string"), "j", "o"))
    assert sorted((r.key, r.name, r.congress) for r in sat.collect()) == [("K1", "Lim", 8), ("K9", "Ana Cruz", 8), ("K9", "Ana Cruz", 9)]
    joined = nested.bills(table, "j", ["i"]).join(sat, (F.col("author_code") == F.col("key")) & (sat.congress == F.lit(8)))
    assert [r.name for r in joined.collect()] == ["Lim"]
