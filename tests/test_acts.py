import datetime as dt

from tallyloom.plans import acts, people

D = dt.date


def test_facts(spark):
    text = (
        "REPUBLIC ACT No. 9000, June 22, 2001 Nineteenth Congress AN ACT H. No. 123 ... Be it enacted. The amount shall be taken from the current appropriations. House Bill No. 77 and S. B. No. 5 "
        "This Act was finally passed by the Senate and the House of Representatives on May 20, 2001 and Febr. 3, 2001. Approved: June 31, 2001 Approved: Sept. 1, 2001"
    )
    rows = spark.createDataFrame([(9000, text), (2, None), (3, "passed by the House on May 2, 1999 (Sgd.) on June 1, 1999. It lapsed into law on July 4, 1999")], "ra int, text string")
    got = {r.ra: r for r in acts.facts(rows).collect()}
    a = got[9000]
    assert (a.congress_text, a.hb, a.sb, a.lapsed, a.funding) == (19, [77, 123], [5], False, "current")
    assert (a.passed, a.signed_text, a.header_date) == ([D(2001, 2, 3), D(2001, 5, 20)], D(2001, 9, 1), D(2001, 6, 22))
    assert (got[2].n_words, got[2].passed, got[2].signed_text, got[2].funding) == (0, [], None, "none_stated")
    assert (got[3].passed, got[3].lapsed, got[3].signed_text) == ([D(1999, 5, 2)], True, D(1999, 7, 4))


def test_congress_ladder(spark):
    rows = [
        (1, D(1950, 1, 3), None, []), (2, D(1995, 8, 1), None, []), (3, D(1995, 8, 2), 10, []), (4, D(1995, 8, 3), None, [D(1995, 6, 1), D(1995, 9, 9)]), (5, D(1996, 1, 1), 3, []), (6, None, None, []), (7, D(1996, 5, 1), None, []), (8, None, None, []),
    ]
    given = spark.createDataFrame(rows, "ra int, date date, congress_text int, passed array<date>")
    house = spark.createDataFrame([(5, 10), (5, 10), (7, 9), (7, 10)], "ra int, congress int")
    got = {r.ra: (r.congress, r.congress_from) for r in acts.assign_congress(given, house, range_size=3).collect()}
    assert got == {
        1: (1, "approval date"), 2: (9, "act number"), 3: (10, "header"), 4: (9, "passage date"), 5: (10, "house record"), 6: (10, "neighbouring acts"), 7: (10, "approval date"), 8: (None, None),
    }


def test_neighbours_that_agree_on_nothing(spark):
    given = spark.createDataFrame([(1, None, None, []), (2, None, None, [])], "ra int, date date, congress_text int, passed array<date>")
    got = acts.assign_congress(given, spark.createDataFrame([], "ra int, congress int")).collect()
    assert {(r.ra, r.congress, r.congress_from) for r in got} == {(1, None, "neighbouring acts"), (2, None, "neighbouring acts")}


def test_floor(spark):
    schema = "doc string, kind string, congress int, bill int, history array<struct<action:string,date:date>>"
    records = [
        ("SB-13-1", "SB", 13, 1, [("Sponsorship speech of X", D(2005, 1, 1)), ("Interpellations of Y", D(2005, 1, 2)), ("Approved on third reading", D(2005, 2, 1)), ("Certified by the President", None), ("Republic Act No. 9001", D(2005, 3, 1))]),
        ("HB-13-2", "HB", 13, 2, [("Motion of Z to consider all the listed bills", D(2005, 1, 2)), ("Approved on Third Reading", D(2005, 2, 1))]), ("SB-13-3", "SB", 13, 3, [("Referred", D(2005, 1, 1)), ("Interpellations of Q", None)]),
    ]
    floor = acts.floor_records(spark.createDataFrame(records, schema))
    given = spark.createDataFrame([(9001, 13, [2], [3]), (9002, 13, [2], []), (9003, 12, [2], [])], "ra int, congress int, hb array<int>, sb array<int>")
    got = {r.ra: r for r in acts.floor_of_acts(given, floor).collect()}
    assert set(got) == {9001, 9002} and got[9001].docs == ["HB-13-2", "SB-13-1"] and got[9001].debate == [D(2005, 1, 2)]
    assert (got[9001].batch, got[9001].certified, got[9001].third_reading_with, got[9002].certified) == (True, True, 2, False)
    listed = spark.createDataFrame([(9001,), (9009,)], "ra int")
    assert {tuple(r) for r in acts.certified_by(acts.floor_of_acts(given, floor), listed).collect()} == {(9001, "both"), (9002, ""), (9009, "list")}


def test_winners_and_families(spark):
    persons = spark.createDataFrame(
        [("a", "Reyes", "Jose", "Cruz", [13, 14]), ("b", "Bernos", "Joseph", "", [13]), ("c", "Santos Jr.", "Ana", None, [13]), ("d", "Lim", "", None, [13]), ("e", "Tan", "Zoe", None, [13]), ("f", "Tan", "Yves", None, [13])],
        "id string, last string, first string, middle string, congresses array<int>",
    )
    rows = [
        (1, 2004, "REYES", "JOSEPH", "C", "P1"), (2, 2007, "REYES", "JOSE", "C", "P1"), (3, 2004, "BERNOS", "JB", "", "P2"), (4, 2004, "SANTOS", "ANA MARIA", "", "P3"), (5, 2004, "DE LIM", "X", "", "P4"), (6, 2004, "TAN", "QQ", "", "P5"), (7, 2001, "REYES", "PEDRO", "", "P1"),
    ]
    winners = spark.createDataFrame(rows, "wid int, year int, last string, first string, middle string, province string")
    matched = people.match_winners(persons, winners)
    assert {(r.id, r.congress): r.wid for r in matched.collect()} == {("a", 13): 1, ("a", 14): 2, ("b", 13): 3, ("c", 13): 4, ("d", 13): 5}
    top = spark.createDataFrame([(2004, "P3", "SANTOS", "BEN"), (2004, "P2", "BERNOS", "JB")], "year int, province string, last string, first string")
    got = {(r.id, r.congress): r.family_seat for r in people.family_seats(matched, winners, top).collect()}
    assert got == {("a", 13): True, ("a", 14): True, ("b", 13): False, ("c", 13): True, ("d", 13): False}
