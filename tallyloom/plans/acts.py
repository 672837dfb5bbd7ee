"""Facts in the text of an act, its Congress, and its days on the floor.

Whole texts are read; the published rules look for some facts in the head or the tail only.
Everything is JVM expressions, joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import windows
from ..operators.intervals import last_ended, term_of
from ..operators.rules import ladder
from ..operators.scratch import written
from .laws import CONGRESSES, congress_of

# --- fixed values ------------------------------------------------------------

ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
MISSPELT_ORDINALS = {"nineth": 9, "nineteeth": 19}
MONTH_STARTS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?"
_DATE = rf"{_MONTH}\s+\d{{1,2}}\s*,?\s*\d{{4}}"
HOUSE_BILL = r"(?iU)\b(?:house bill|h\.\s*b\.|h\.\s*no\.|h\.\s*bill)\s*(?:no\.?|nos\.?|number)?\s*([0-9]+)"
SENATE_BILL = r"(?iU)\b(?:senate bill|s\.\s*b\.|s\.\s*no\.|s\.\s*bill)\s*(?:no\.?|nos\.?|number)?\s*([0-9]+)"
LAPSED = r"(?iU)lapsed\s+into\s+law|became\s+law\s+without|without\s+(?:the\s+)?(?:executive\s+)?(?:approval|signature)\s+of\s+the\s+president|pursuant\s+to\s+(?:the\s+provisions\s+of\s+)?(?:section|sec\.)\s*27\s*\(1\)"
BUDGET = r"(?iU)general appropriations act|annual appropriations|included in the (?:annual )?(?:budget|appropriation)"
CURRENT = r"(?iU)(?:charged|taken) (?:against|from) the (?:current|existing|available)|out of any funds in the national treasury|current year'?s appropriations?|is hereby appropriated"
PASSED = r"(?iU)\b(?:finally\s+)?(?:passed|approved)\s+by\s+the\s+(?:senate|house)"
SIGNATURE = r"(?iU)\(sgd\.?\)|\bapproved\s*[:,]|lapsed\s+into\s+law|president\s+of\s+the\s+philippines"
APPROVED = rf"(?iU)(?:approved|lapsed\s+into\s+law\s+on)\s*[:,]?\s*({_DATE})"
FLOOR = (
    r"(?iU)^(omnibus\s+)?(co-?)?sponsorship speech|^interpellations?\b|^period of (interpellation|amendment|committee amendment|individual amendment)|^turno en contra|^manifestation|"
    r"^explanation of vote|^approved on (second|third) reading|^conference committee report.*approved by the senate|^motion of"
)
DEBATE = r"(?iU)^(interpellations? of|turno en contra)"
THIRD = r"(?iU)^approved on third reading"
BATCH = r"(?iU)^omnibus|^motion of .*\ball (the )?listed\b"
CERTIFIED = r"(?iU)certified (by the president|for (its )?immediate enactment)"
BECAME = r"(?iU)^\s*REPUBLIC\s+ACT\s+NO\.?\s*([0-9]{4,5})"
CONVENED = {2: "1950-01-23", 3: "1954-01-25", 4: "1958-01-27", 5: "1962-01-22", 6: "1966-01-24", 7: "1970-01-26"}
GRACE_DAYS, GRACE_FROM, FLOOR_FROM = 120, 9, 13

# --- text --------------------------------------------------------------------


def text_date(c: Column) -> Column:
    """The date in a short text that begins with a month's name; null if there is no such day."""
    parts = rf"(?i)({_MONTH})\s+(\d{{1,2}})\s*,?\s*(\d{{4}})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTH_STARTS]), F.lower(F.substring(F.regexp_extract(c, parts, 1), 1, 3)))
    day = F.concat_ws("-", F.regexp_extract(c, parts, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(c, parts, 2), 2, "0"))
    return F.try_to_date(day, "yyyy-MM-dd")


def _numbers(pattern: str, *texts: Column) -> Column:
    found = F.concat(*[F.regexp_extract_all(t, F.lit(pattern), 1) for t in texts])
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, lambda s: s.try_cast("int")))))


def passage_dates(tail: Column) -> Column:
    """Dates of the closing statement, up to the signatures: ascending, distinct."""
    at = F.regexp_instr(tail, F.lit(PASSED))
    part = F.when(at > 0, F.substring(tail, at, F.lit(700)))
    body = F.concat(F.substring(part, 1, 20), F.split(F.substring(part, 21, 680), SIGNATURE, 2)[0])
    found = F.transform(F.regexp_extract_all(body, F.lit(rf"(?iU)\b{_DATE}"), 0), text_date)
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(found, lambda d: d.isNotNull()))), F.array().cast("array<date>"))


def facts(acts: DataFrame) -> DataFrame:
    """``ra`` with what its ``text`` says: Congress, bills, lapse, funding, words, dates."""
    text = F.coalesce("text", F.lit(""))
    head, tail = F.substring(text, 1, 3000), F.when(F.length(text) > 6000, F.substring(text, -6000, 6000)).otherwise(text)
    number = {w: i for i, w in enumerate(ORDINALS, 1)} | {f"{i}{s}": i for i in range(1, 21) for s in ("st", "nd", "rd", "th")} | MISSPELT_ORDINALS
    word = F.lower(F.regexp_extract(head, r"(?iU)(?<![\w-])(" + "|".join(sorted(number, key=len, reverse=True)) + r")\s+congress\b", 1))
    dates = F.filter(F.transform(F.regexp_extract_all(tail, F.lit(APPROVED), 1), text_date), lambda d: d.isNotNull())
    own = F.concat(F.lit(r"(?iU)REPUBLIC\s+ACT\s+No\.?\s*"), F.col("ra").cast("string"), F.lit(rf"\s*,\s*({_DATE})"))
    return acts.select(
        "ra",
        F.create_map(*[F.lit(x) for pair in number.items() for x in pair])[word].alias("congress_text"),
        _numbers(HOUSE_BILL, tail, F.substring(head, 1, 1500)).alias("hb"),
        _numbers(SENATE_BILL, tail, F.substring(head, 1, 1500)).alias("sb"),
        tail.rlike(LAPSED).alias("lapsed"),
        ladder([(text.rlike(BUDGET), "gaa"), (text.rlike(CURRENT), "current")], "none_stated").alias("funding"),
        F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).alias("n_words"),
        passage_dates(tail).alias("passed"),
        F.try_element_at(dates, F.lit(-1)).alias("signed_text"),
        text_date(F.get(F.regexp_extract_all(head, own, 1), F.lit(0))).alias("header_date"),
    )


# --- Congress ----------------------------------------------------------------


def assign_congress(acts: DataFrame, house: DataFrame, range_size: int = 1000) -> DataFrame:
    """``ra``, ``congress``, ``congress_from``: the enacting Congress by the best evidence.

    ``acts``: ``ra`` (unique), ``date``, ``congress_text``, ``passed``; ``house``: ``ra``, ``congress`` of bills.
    Header, passage dates, a single Congress of the bills, approval date; then acts signed early in a term
    go to the one before if their number comes before its first act known otherwise; undated
    acts take their neighbours' where these agree.
    """
    one = house.groupBy("ra").agg(F.count_distinct("congress").alias("_k"), F.min("congress").alias("_house")).where("_k = 1").drop("_k")
    rows = acts.join(one, "ra", "left").withColumn("_by_date", congress_of(F.col("date")))
    passed = F.array_max(F.filter("passed", lambda d: F.col("date").isNull() | (d <= F.col("date"))))
    by_passage = F.coalesce(term_of(passed, CONGRESSES), last_ended(passed, CONGRESSES))
    header = F.col("congress_text").isNotNull() & (F.col("_by_date").isNull() | (F.abs(F.col("congress_text") - F.col("_by_date")) <= 1))
    rows = rows.withColumn("congress_from", ladder([(header, "header"), (by_passage.isNotNull(), "passage date"), (F.col("_house").isNotNull(), "house record"), (F.col("_by_date").isNotNull(), "approval date")]))
    rows = rows.withColumn("congress", F.when(F.col("congress_from") == "header", F.col("congress_text")).when(F.col("congress_from") == "passage date", by_passage).when(F.col("congress_from") == "house record", F.col("_house")).otherwise(F.col("_by_date")))
    first = rows.where("congress_from <> 'approval date'").groupBy("congress").agg(F.min("ra").alias("_first"))
    rows = rows.join(first, "congress", "left")
    dated = F.col("congress_from") == "approval date"
    convened = F.create_map(*[x for n, d in CONVENED.items() for x in (F.lit(n), F.lit(d).cast("date"))])[F.col("congress")]
    opening = F.create_map(*[x for n, a, _ in CONGRESSES for x in (F.lit(n), F.lit(a.isoformat()).cast("date"))])[F.col("congress")]
    before_session = dated & (F.col("date") < convened)
    by_number = dated & (F.col("congress") >= GRACE_FROM) & (F.col("date") <= F.date_add(opening, GRACE_DAYS)) & (F.col("ra") < F.coalesce("_first", F.lit(10**6)))
    source = F.when(F.coalesce(by_number & ~F.coalesce(before_session, F.lit(False)), F.lit(False)), "act number").otherwise(F.col("congress_from"))
    earlier = F.coalesce(before_session | by_number, F.lit(False))
    rows = rows.select("ra", F.when(earlier, F.col("congress") - 1).otherwise(F.col("congress")).alias("congress"), source.alias("congress_from"))
    filled = windows.neighbour_fill(rows, "ra", "congress", F.floor(F.col("ra") / range_size))
    # Neighbours that are both missing agree too, on nothing: then no act at all has a Congress.
    known = filled.agg(F.count("congress").alias("_known"))
    filled = filled.join(F.broadcast(known), F.lit(True))  # one row
    agreed = F.col("congress").isNull() & (F.col("filled").isNotNull() | (F.col("_known") == 0))
    return filled.select("ra", F.col("filled").alias("congress"), F.when(agreed, "neighbouring acts").otherwise(F.col("congress_from")).alias("congress_from"))


# --- floor -------------------------------------------------------------------


def floor_records(records: DataFrame) -> DataFrame:
    """One row a Senate record: distinct floor and debate days, last third reading, flags.

    ``records``: ``doc``, ``kind``, ``congress``, ``bill``, ``history`` (action, date). Certification
    counts without a date; all else needs one.
    """
    action = lambda h: F.trim(h["action"])
    days = lambda p: F.array_sort(F.array_distinct(F.transform(F.filter("history", lambda h: h["date"].isNotNull() & action(h).rlike(p)), lambda h: h["date"])))
    has = lambda p, undated: F.coalesce(F.exists("history", lambda h: action(h).rlike(p) & (F.lit(undated) | h["date"].isNotNull())), F.lit(False))
    acts = F.transform(F.filter("history", lambda h: h["action"].rlike(BECAME)), lambda h: F.regexp_extract(h["action"], BECAME, 1).cast("int"))
    return records.select("doc", "kind", "congress", "bill", days(FLOOR).alias("floor"), days(DEBATE).alias("debate"), F.array_max(days(THIRD)).alias("third"), has(BATCH, False).alias("batch"), has(CERTIFIED, True).alias("certified"), acts.alias("acts"))


def floor_of_acts(acts: DataFrame, floor: DataFrame) -> DataFrame:
    """Floor days of each act from the 13th Congress on: records that became it, and cited bills with floor days.

    ``acts``: ``ra``, ``congress``, ``hb``, ``sb``. Adds ``third_reading_with``, the acts of the same last third reading.
    """
    floor = written(floor)  # three branches read the records
    late = acts.where(F.col("congress") >= FLOOR_FROM)
    became = floor.select("doc", F.explode("acts").alias("ra")).join(late.select("ra"), "ra").select("ra", "doc")
    cited = late.select("ra", "congress", F.lit("SB").alias("kind"), F.explode("sb").alias("bill")).unionByName(late.select("ra", "congress", F.lit("HB").alias("kind"), F.explode("hb").alias("bill")))
    cited = cited.join(floor.where(F.size("floor") > 0).select("doc", "kind", "congress", "bill"), ["kind", "congress", "bill"]).select("ra", "doc")
    docs = became.unionByName(cited).distinct().join(floor, "doc")
    both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    out = docs.groupBy("ra").agg(F.array_sort(F.collect_set("doc")).alias("docs"), both("floor").alias("floor"), both("debate").alias("debate"), F.max("third").alias("third"), F.bool_or("batch").alias("batch"), F.bool_or("certified").alias("certified"))
    return written(windows.count_alike(out, "third", "third_reading_with"))


def certified_by(floor: DataFrame, listed: DataFrame) -> DataFrame:
    """Which source says that an act was certified: both, senate record, list, or blank."""
    both = floor.select("ra", "certified").join(listed.select("ra").distinct().withColumn("_listed", F.lit(True)), "ra", "full_outer")
    senate, other = F.coalesce("certified", F.lit(False)), F.coalesce("_listed", F.lit(False))
    return both.select("ra", ladder([(senate & other, "both"), (senate, "senate record"), (other, "list")], "").alias("certified_by"))
