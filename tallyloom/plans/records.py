"""Yearly records, links between records, shares over time, and words of pages."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.rules import half_open_bins, ladder
from ..operators.scratch import written

# --- fixed values ------------------------------------------------------------

PREFERRED = r"^(Approved by the President|Lapsed Into Law)"
FOUNDING = ("establish", "separate", "convert", "create")
BED_TITLE, ROAD_TITLE, CITY_TITLE = r"(?i)bed capacity|\bbeds?\b", "(?i)national (road|highway)", r"(?i)\bcity\b"
BARANGAY_TITLE = r"(?i)\b(barrios?|barangays?|sitios?)\b"
LINK = "https://lawphil.net/statutes/repacts/ra%s/ra_%s_%s.html"
GAP_END = (
    r"(?=\s*:\s*(?:REPUBLIC ACTS|PHILIPPINE LAWS)|\s+Be it enacted|\s+(?:Section|SECTION|Sec\.)\s*1\b|\s+[A-Z][a-z]+ (?:Tribune|Star|Times|Bulletin|Inquirer)"
    r"|\s+[0-9]+ O\.?G\.?|\s+REPUBLIC ACT NO)"
)

# --- links -------------------------------------------------------------------


def translate_code(rows: DataFrame, code: str, table: DataFrame, key: str, value: str, prefixes: dict[str, str]) -> DataFrame:
    """``value`` of a code in ``table`` (one row a ``key``): by the code, else by the code with its prefix changed."""
    plain = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    other = F.lit(None).cast("string")
    for old, new in prefixes.items():
        other = F.when(F.col(code).startswith(old), F.concat(F.lit(new), F.substring(F.col(code), len(old) + 1, 64))).otherwise(other)
    out = rows.withColumn("_o", other).join(plain, F.col(code) == F.col("_k"), "left").drop("_k").withColumnRenamed("_v", "_own")
    return out.join(plain, F.col("_o") == F.col("_k"), "left").withColumn(value, F.coalesce("_own", "_v")).drop("_o", "_k", "_own", "_v")


def preferred_bill(bills: DataFrame) -> DataFrame:
    """The bill of each act: the first whose status is a preferred one, else the first; its date only if preferred.

    ``bills``: ``ra``, ``ord`` (unique in an act), ``bill``, ``status``, ``date``.
    """
    good = F.coalesce(F.col("status").rlike(PREFERRED), F.lit(False))
    best = bills.groupBy("ra").agg(F.min_by(F.struct("bill", good.alias("good"), "date"), F.struct(~good, "ord")).alias("b"))
    return best.select("ra", F.col("b.bill").alias("bill"), F.when(F.col("b.good"), F.col("b.date")).alias("date"))


def authored_laws(laws: DataFrame, linked: DataFrame, bills: DataFrame, winners: DataFrame) -> DataFrame:
    """Act, bill, author and the author's winner of that Congress.

    Acts need a known bill with an author that isn't blank; without a winner the province is blank,
    ``district_rep`` is false and ``family_seat`` null. ``linked``: ``ra``, ``bill``; ``bills``: ``bill``, ``author``,
    ``congress``; ``winners``: ``author``, ``congress``, ``province``, ``district_rep``, ``family_seat``, one row each.
    """
    own = laws.select("ra").join(linked, "ra").join(bills.where("trim(author) <> ''"), "bill")
    out = own.join(winners, ["author", "congress"], "left")
    return out.select("ra", "bill", "author", "congress", F.coalesce("province", F.lit("")).alias("province"), F.coalesce("district_rep", F.lit(False)).alias("district_rep"), "family_seat")


def memberships(people: DataFrame) -> DataFrame:
    """A row for each author key and Congress of a person (C18): ``keys`` and ``congresses`` are arrays; of rows with a key the last by ``ord`` counts."""
    keyed = people.select("ord", "name", "congresses", F.explode(F.array_distinct("keys")).alias("key"))
    last = keyed.groupBy("key").agg(F.max_by(F.struct("name", "congresses"), "ord").alias("p"))
    return last.select("key", F.col("p.name").alias("name"), F.explode(F.array_sort(F.array_distinct("p.congresses"))).alias("congress"))


# --- yearly records ----------------------------------------------------------


def roll_up(rows: DataFrame, key: str, year: str, value: str, attributes: list[str], order: str | None = None) -> DataFrame:
    """One row a key: first and last year, a map of values by year, attributes of the last row.

    Of several rows of a year the last in ``order`` counts, for its value and its attributes; without ``order``
    a year has one row of a key (else the largest value counts).
    """
    last = F.struct(order, value) if order else F.struct(value)
    one = rows.groupBy(key, year).agg(F.max_by(F.struct(F.col(value).alias("_v"), F.struct(*attributes).alias("_a")), last).alias("_l")).select(key, year, "_l._v", "_l._a")
    out = one.groupBy(key).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(year, "_v")))).alias("by_year"), F.max_by("_a", year).alias("_a"))
    return out.select(key, "first_year", "last_year", "by_year", *[F.col(f"_a.{a}").alias(a) for a in attributes])


def place_points(towns: DataFrame, parts: DataFrame) -> DataFrame:
    """A point for each town: its own, else the mean of its barangays weighted by area.

    ``towns``: ``town``, ``x``, ``y`` (or null); ``parts``: ``town``, ``x``, ``y``, ``area``.
    """
    mean = parts.where("area > 0").groupBy("town").agg(*[(F.sum(F.col(c) * F.col("area")) / F.sum("area")).alias(f"_{c}") for c in ("x", "y")])
    names = towns.select("town").unionByName(parts.select("town")).distinct()
    out = names.join(towns, "town", "left").join(mean, "town", "left")
    own = F.col("x").isNotNull()
    return out.select("town", F.coalesce("x", "_x").alias("x"), F.when(own, F.col("y")).otherwise(F.col("_y")).alias("y"))


# --- shares and peaks --------------------------------------------------------


def kind(title: Column, category: Column, action: Column) -> Column:
    """The kind of act that is followed over time, the first that fits."""
    c, a = category, action
    school, hospital, lgu = c == "school", c == "hospital", c == "lgu"
    steps = [(school & a.isin(*FOUNDING), "new_schools"), (school & (a == "rename"), "school_names"), (c == "college", "colleges"), (hospital & title.rlike(BED_TITLE), "beds")]
    steps += [(hospital & a.isin("establish", "create"), "new_hospitals"), ((c == "road") & title.rlike(ROAD_TITLE), "national_roads"), (c == "franchise", "franchises"), (c == "holiday", "holidays")]
    steps += [(c == "court", "courts"), (lgu & title.rlike(BARANGAY_TITLE), "barangays"), (lgu & title.rlike(CITY_TITLE) & (a == "convert"), "cityhood")]
    return ladder([*steps, (c == "citizenship", "citizenship"), (c == "rename_place", "renamed_places")])


def one_in(part: Column, whole: Column) -> Column:
    """The n of "one in n", halves up; null without a part."""
    return F.when(part > 0, F.floor(whole / part + 0.5))


def difference_class(a: Column, b: Column, least: float = 0.1) -> Column:
    """Whether a is larger than b by more than ``least``, smaller, or about the same."""
    return ladder([(a - b > least, "more"), (a - b < -least, "less")], "same")


def bed_sums(matched: DataFrame, since: int = 2016) -> DataFrame:
    """Legislated and accredited beds of recent acts, and their ratio (A32): ``year``, ``beds_to``, ``registry_beds``."""
    both = matched.where((F.col("year") >= since) & F.col("beds_to").isNotNull() & F.col("registry_beds").isNotNull())
    out = both.agg(F.coalesce(F.sum("beds_to"), F.lit(0)).alias("legislated"), F.coalesce(F.sum("registry_beds"), F.lit(0)).alias("accredited"))
    return out.withColumn("ratio", F.col("accredited") / F.nullif(F.col("legislated"), F.lit(0)))


def enactment_rates(bills: DataFrame, first: int, last: int) -> DataFrame:
    """Share of bills enacted in a window of Congresses, local ones and all others."""
    inside = bills.where(F.col("congress").between(first, last)).withColumn("group", F.when(F.col("scope") == "local", "local").otherwise("other"))
    return inside.groupBy("group").agg(F.count("*").alias("filed"), F.count_if("enacted").alias("enacted")).withColumn("rate", F.col("enacted") / F.col("filed"))


def peak_and_after(months: DataFrame) -> DataFrame:
    """Totals of years from months ("yyyy-MM", ``n``): the peak year, the first of equals, and the most after it."""
    years = months.groupBy(F.substring("month", 1, 4).cast("int").alias("year")).agg(F.sum("n").alias("n"))
    peak = years.agg(F.max_by(F.struct("year", "n"), F.struct("n", -F.col("year"))).alias("p"))
    joined = years.join(F.broadcast(peak), F.lit(True))  # one row
    return joined.groupBy(F.col("p.year").alias("peak_year"), F.col("p.n").alias("peak")).agg(F.max(F.when(F.col("year") > F.col("p.year"), F.col("n"))).alias("after"))


# --- rows by place -----------------------------------------------------------


#: Rows of a range of ``row_index``.
RANGE_ROWS = 1_000_000


def row_index(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """``_row``: the place of each row in ``order`` (unique), from 0, without bringing all rows to one task.

    Rows are dealt to sorted ranges and written once, each with its range and its number there: bounds are drawn from a sample,
    so a second run of the same plan would cut the ranges elsewhere. Ranges grow with the rows (RANGE_ROWS each)
    unless their number is given; rows before a range are a running sum over one row a range.
    """
    spark = df.sparkSession
    if ranges is None:
        df = written(df)
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    # The id holds the number of the partition above 33 bits for the number in it.
    dealt = written(df.repartitionByRange(ranges, order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    placed = dealt.join(F.broadcast(starts), part == F.col("_part"))  # one row a range
    return placed.withColumn("_row", (F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_id", "_part", "_start")


def first_rows(df: DataFrame, order: str, k: int = 400) -> DataFrame:
    """The first k rows in order."""
    return df.orderBy(order).limit(k)


def last_reversed(df: DataFrame, order: str, k: int = 30) -> DataFrame:
    """The last k rows, the last one first."""
    return df.orderBy(F.desc(order)).limit(k)


def seeded_sample(df: DataFrame, order: str, k: int = 40, seed: int = 8) -> DataFrame:
    """k rows drawn without replacement by a seeded generator over places in order (O10), with ``draw``, the turn of each.

    The same rows in every run and for any partitioning: places are exact, and the generator draws among their number.
    """
    spark = df.sparkSession
    placed = written(row_index(df, order))
    n = placed.count()
    picks = random.Random(seed).sample(range(n), min(k, n))
    drawn = spark.createDataFrame(list(enumerate(picks)), "draw int, _row long")
    return placed.join(F.broadcast(drawn), "_row").drop("_row")  # k rows


def spread_marks(counts: DataFrame) -> DataFrame:
    """Slots of ``lit`` marks spread over ``slots`` places with a hashed shift (W14): a row a mark with ``j`` and ``slot``."""
    each = counts.where("lit > 0").withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("lit") - 1).cast("int"))))
    step = F.col("slots") / F.col("lit")
    slot = F.least(F.col("slots") - 1, F.floor(F.col("j") * step + geo.jitter(F.col("j") + 11) * step))
    return each.withColumn("slot", slot.cast("long"))


def page_buckets(missing: DataFrame, number: str, size: int = 100) -> DataFrame:
    """The index pages, from 1, on which numbers stand."""
    return missing.select((F.floor((F.col(number) - 1) / size) + 1).cast("int").alias("page")).distinct()


# --- words of pages ----------------------------------------------------------


def lines_of_words(words: DataFrame, height: float = 2.0) -> DataFrame:
    """Lines of words by position (S10, W6): ``page``, ``line`` and ``words`` (x0, text) from left to right.

    ``words``: ``page``, ``text``, ``x0``, ``top``. A line is the half-even rounding of ``top / height``.
    """
    line = F.bround(F.col("top") / height).cast("long")
    return words.groupBy("page", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("words"))


def cells_of_lines(lines: DataFrame, bins: list[tuple[str, float, float]], default: str = "sec") -> DataFrame:
    """The text of each column of a line: words whose x lies in the column's half-open range (C11)."""
    each = lines.select("page", "line", F.posexplode("words").alias("ord", "w")).withColumn("column", half_open_bins(F.col("w.x0"), bins, default))
    joined = each.groupBy("page", "line", "column").agg(F.array_sort(F.collect_list(F.struct("ord", "w.text"))).alias("t"))
    return joined.select("page", "line", "column", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


def beds_and_level(cell: Column) -> Column:
    """struct(``beds``, ``level``) of a cell like ``60LEVEL 2``."""
    apart = F.regexp_replace(cell, r"(\d)(LEVEL|INF)", "$1 $2")
    return F.struct(F.regexp_extract(apart, r"^\s*(\d*)", 1).alias("beds"), F.regexp_extract(apart, r"^\s*\d*\s*(.*)$", 1).alias("level"))


def level_fits(wants_high: Column, wants_elementary: Column, junior: Column, senior: Column, elementary: Column) -> Column:
    """Whether a school's levels are those that a title asks for."""
    return F.when(wants_high, junior | senior | ~elementary).when(wants_elementary, elementary).otherwise(F.lit(True))


# --- texts -------------------------------------------------------------------


def gap_title(text: Column, act: Column) -> Column:
    """The title of an act found by its own number, titles in capitals in sentence case."""
    pattern = F.concat(F.lit(r"(?sU)REPUBLIC ACT NO\.?\s*"), act.cast("string"), F.lit(r"\s*[-–—]\s*(.+?)" + GAP_END))
    found = F.trim(F.call_function("regexp_extract", text, pattern, F.lit(1)))
    sentence = F.concat(F.upper(F.substring(found, 1, 1)), F.lower(F.substring(found, 2, 1 << 20)))
    return F.when(found != "", F.when(found == F.upper(found), sentence).otherwise(found))


def example_text(title: Column, most: int = 219) -> Column:
    """A title as an example: cut at a second "an act", without a dangling clause, shortened with dots."""
    again = F.regexp_instr(title, F.lit(r"(?i)\S(?=an act\b)"))
    t = F.when(again > 21, F.substr(title, F.lit(1), again)).otherwise(title)
    t = F.regexp_replace(t, r"(Therefor|Thereof)\S*.*$", "$1")
    return F.when(F.length(t) >= most, F.regexp_replace(t, r"\s+\S*$", "...")).otherwise(t)


def link_of(code: Column, act: Column) -> Column:
    """The link of a code (T22): a year stands for the canonical one."""
    return F.when(code.rlike(r"^\d{4}$"), F.format_string(LINK, code, act.cast("string"), code)).otherwise(code)


def mart_views(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Temporary views of report documents (S18); names of those that exist."""
    found = []
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.json")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            spark.read.option("multiLine", True).json(f"{folder}/{name}.json").createOrReplaceTempView(name)
            found.append(name)
    return found
