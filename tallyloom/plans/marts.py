"""Report tables (M1-M13, A29, A30): each a function of the entity tables.

Inputs have the columns named in each docstring; outputs are small DataFrames, to be written by
:func:`tallyloom.sources.readers.as_document` or as CSV.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate, dedup
from . import records

# --- fixed values ------------------------------------------------------------

LAW_LINK = r"^https://lawphil\.net/statutes/repacts/ra(\d{4})/ra_\d+_\d{4}\.html$"
BATCH_DAY = 20
CONFIDENT = 0.9
SPECIAL_HOSPITAL = "(?i)mental|psychiatr|sanitari|leprosari"
FOUNDING = ("establish", "separate", "convert", "create")


def link_code(href: Column) -> Column:
    """The year of a canonical link as text, else the link itself."""
    year = F.regexp_extract(href, LAW_LINK, 1)
    return F.when(year != "", year).otherwise(F.coalesce(href, F.lit("")))


def law_rows(laws: DataFrame, towns: DataFrame) -> DataFrame:
    """One row an act for browsing (M1, M13): towns by name, code where unknown."""
    named = laws.select("ra", F.posexplode_outer("munis").alias("_p", "psgc10")).join(towns.select("psgc10", "name").distinct(), "psgc10", "left")
    listed = named.groupBy("ra").agg(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("name", "psgc10").alias("t")))).alias("_l"))
    out = laws.join(listed, "ra", "left")
    return out.select("ra", "date", F.coalesce("congress", F.lit(0)).alias("congress"), "category", "scope", "title", F.coalesce("lapsed", F.lit(False)).alias("lapsed"), F.array_join("provinces", "; ").alias("provinces"), F.array_join(F.transform("_l", lambda x: x["t"]), "; ").alias("towns"), link_code(F.col("href")).alias("link"))


def province_counts(laws: DataFrame) -> DataFrame:
    """Local acts by province, Congress and kind; an act in n provinces counts 1/n in each (M2)."""
    local = laws.where("scope = 'local' and size(provinces) > 0").withColumn("congress", F.coalesce("congress", F.lit(0)))
    return aggregate.fractional_count(local, "provinces", ["congress", "category"], "n").withColumn("n", F.bround("n", 3)).withColumnRenamed("member", "province")


def bill_funnel(bills: DataFrame, linked: DataFrame) -> DataFrame:
    """Bills filed and enacted by Congress and scope.

    ``bills``: ``congress``, ``bill``, ``scope``, ``ra``; ``linked``: ``congress`` and ``bill`` of bills that acts cite.
    """
    hit = linked.select("congress", "bill").distinct().withColumn("_hit", F.lit(True))
    both = bills.join(hit, ["congress", "bill"], "left")
    return both.groupBy("congress", "scope").agg(F.count("*").alias("filed"), F.count_if(F.col("_hit") | F.col("ra").isNotNull()).alias("enacted"))


def busiest_filing_day(bills: DataFrame) -> DataFrame:
    """The day with most bills of each Congress, the first of equals, and the total (M3)."""
    days = bills.where("date_filed is not null").groupBy("congress", "date_filed").agg(F.count("*").alias("n"))
    best = days.groupBy("congress").agg(F.max_by("date_filed", F.struct("n", -F.unix_date("date_filed"))).alias("date"), F.max("n").alias("bills"), F.sum("n").alias("total"))
    return best


def calendar(laws: DataFrame) -> dict[str, DataFrame]:
    """Days, big days, months, the share signed in batches, and lapsed acts by president (M4)."""
    dated = laws.where("date is not null")
    days = dated.groupBy(F.year("date").alias("year"), F.dayofyear("date").alias("doy")).agg(F.count("*").alias("n"))
    big = dated.groupBy("date").agg(F.count("*").alias("n"), F.min("ra").alias("_first")).orderBy(F.desc("n"), "_first").limit(12).drop("_first")
    share = aggregate.share_of_large_groups(dated, "date", BATCH_DAY, "share").select(F.bround("share", 3).alias("share"))
    lapsed = F.coalesce("lapsed", F.lit(False))
    by_president = laws.where("president is not null").groupBy("president").agg(F.count_if(lapsed).alias("lapsed"), F.count_if(lapsed & (F.col("scope") == "local")).alias("local"), F.count("*").alias("total"))
    return {"days": days, "big_days": big, "by_month": dated.groupBy(F.month("date").alias("month")).agg(F.count("*").alias("n")), "share_in_batches": share, "lapsed": by_president}


def hospital_beds(matched: DataFrame) -> DataFrame:
    """The latest confident act on beds of each hospital, by accredited minus legislated beds (M5).

    ``matched``: ``ra``, ``match``, ``match_score``, ``beds_to``, ``registry_name``, ``registry_beds``.
    """
    sure = matched.where((F.col("match") == "found") & (F.col("match_score") >= CONFIDENT) & F.col("beds_to").isNotNull() & ~F.col("registry_name").rlike(SPECIAL_HOSPITAL))
    latest = dedup.keep_last(sure, ["registry_name"], ["ra"])
    return latest.withColumn("gap", F.col("registry_beds") - F.col("beds_to")).orderBy("gap", "registry_name")


def school_levels(matched: DataFrame, first: int = 1987, last: int = 2023) -> DataFrame:
    """Acts that found schools, by action and kind of match (M6)."""
    return matched.where(F.col("year").between(first, last) & F.col("action").isin(*FOUNDING)).groupBy("action", "match").agg(F.count("*").alias("n"))


def school_existed(matched: DataFrame, since: int = 2019) -> DataFrame:
    """Recent acts whose school was already in the registry before (M6)."""
    recent = matched.where((F.col("year") >= since) & F.col("action").isin("establish", "separate", "convert") & F.col("match").isin("named", "annex"))
    before = F.coalesce(F.col("first_year") < F.col("year"), F.lit(False))
    establish = F.col("action") == "establish"
    return recent.agg(F.count("*").alias("recent"), F.count_if(before).alias("preexisting"), F.count_if(establish).alias("establish"), F.count_if(establish & before).alias("establish_preexisting"))


def term_counters(terms: DataFrame, bills: DataFrame, laws: DataFrame) -> DataFrame:
    """Bills and acts of each author and Congress, zero where none."""
    key = ["author", "congress"]
    local = F.count_if(F.col("scope") == "local")
    b = bills.groupBy(*key).agg(F.count("*").alias("bills_filed"), local.alias("local_bills_filed"))
    l = laws.groupBy(*key).agg(F.count("*").alias("laws_enacted"), local.alias("local_laws_enacted"))  # noqa: E741
    return terms.join(b, key, "left").join(l, key, "left").na.fill(0, ["bills_filed", "local_bills_filed", "laws_enacted", "local_laws_enacted"])


def family_summary(terms: DataFrame, order: str, value: str = "local_laws_enacted") -> DataFrame:
    """Family seats against others: n, mean, upper median, share of zeros and a bootstrap interval."""
    known = terms.where("family_seat is not null")
    interval = aggregate.bootstrap_ci(known.select("family_seat", value, order), ["family_seat"], value, order)
    out = aggregate.summary(known, ["family_seat"], value).join(interval.drop("n"), ["family_seat"])
    return out.select("family_seat", "n", *[F.bround(c, 3).alias(c) for c in ("mean", "lo", "hi", "zero_share")], "median")


def top_authors(laws: DataFrame, k: int = 25) -> DataFrame:
    """Authors with most local acts, ties to who comes first, with their most frequent province and kind."""
    by = laws.where("author is not null").groupBy("author").agg(F.count("*").alias("laws"), F.min("ra").alias("_first")).orderBy(F.desc("laws"), "_first").limit(k)
    mode = lambda c: aggregate.mode_first(laws.where(F.col(c).isNotNull()), ["author"], c, "ra", c).drop("n")
    return by.join(mode("province"), "author", "left").join(mode("category"), "author", "left").orderBy(F.desc("laws"), "_first").drop("_first")


def kinds_by_congress(laws: DataFrame, kind: Column) -> DataFrame:
    """Acts by kind and Congress with each Congress's total."""
    n = laws.where("congress is not null").groupBy("congress", kind.alias("kind")).agg(F.count("*").alias("n"))
    total = laws.where("congress is not null").groupBy("congress").agg(F.count("*").alias("total"))
    return n.join(total, "congress")


def effort_shares(efforts: DataFrame) -> DataFrame:
    """Acts, floor days and debate days by scope, and each scope's share."""
    by = efforts.groupBy("scope").agg(F.count("*").alias("n"), F.count_if("linked").alias("linked"), F.sum("floor_days").alias("floor_days"), F.sum("debate_days").alias("debate_days"), F.count_if(F.col("debate_days") > 0).alias("debated"))
    whole = by.agg(F.sum("n").alias("_n"), F.sum("debate_days").alias("_d"))
    return by.join(F.broadcast(whole), F.lit(True)).select("*", F.bround(F.col("n") / F.greatest("_n", F.lit(1)), 3).alias("share_laws"), F.bround(F.col("debate_days") / F.greatest("_d", F.lit(1)), 3).alias("share_debate")).drop("_n", "_d")


def citizenship_names(laws: DataFrame) -> DataFrame:
    """Who was granted citizenship: the title after its greedy head, whole where that misses."""
    name = F.regexp_replace("title", r"(?iU)^.*citizenship (to|upon|on)\s+", "")
    return laws.where("category = 'citizenship'").select("ra", F.year("date").alias("year"), name.alias("name"))


def headline(laws: DataFrame) -> DataFrame:
    """One row of totals, with the numbers missing from 1 to the largest."""
    return laws.agg(
        F.count("*").alias("n_laws"), F.count_if(F.col("scope") == "local").alias("n_local"), F.count_if(F.coalesce("lapsed", F.lit(False))).alias("n_lapsed"), F.min(F.year("date")).alias("first_year"), F.max(F.year("date")).alias("last_year"),
        F.count_if((F.col("scope") == "local") & (F.size("munis") > 0)).alias("local_in_town"), F.count_if((F.col("scope") == "local") & (F.size("provinces") > 0)).alias("local_placed"), (F.max("ra") - F.count_distinct("ra")).alias("n_missing"),
    )


def accuracy(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of hand labels met, for kind and scope."""
    both = predicted.join(labels.select("ra", F.col("category").alias("_label"), F.col("scope").alias("_scope")), "ra")
    return both.agg(F.count("*").alias("n"), *[F.bround(F.avg((F.col(a) == F.col(b)).cast("double")), 4).alias(a) for a, b in (("category", "_label"), ("scope", "_scope"))])


# --- what else the report documents hold (M3, M6, M7, M9) ---------------------


def daily_filings(bills: DataFrame, congresses: tuple[int, ...] = (17, 18, 19)) -> DataFrame:
    """Bills by day of filing in some Congresses (M3)."""
    return bills.where(F.col("date_filed").isNotNull() & F.col("congress").isin(*congresses)).groupBy("congress", "date_filed").agg(F.count("*").alias("n"))


def monthly_filings(bills: DataFrame) -> DataFrame:
    """Bills by month of filing ("yyyy-MM") and scope (M3)."""
    return bills.where("date_filed is not null").groupBy(F.date_format("date_filed", "yyyy-MM").alias("month"), "scope").agg(F.count("*").alias("n"))


def one_congress(bills: DataFrame, laws: DataFrame, congress: int = 8) -> DataFrame:
    """What a Congress received and passed, by scope: ``filed`` and ``laws`` (M3)."""
    of = lambda df, name: df.where(F.col("congress") == congress).groupBy("scope").agg(F.count("*").alias(name))
    return of(bills, "filed").join(of(laws, "laws"), "scope", "full_outer").na.fill(0, ["filed", "laws"])


def filed_examples(bills: DataFrame, order: str, congress: int = 8, k: int = 40, letters: int = 220) -> DataFrame:
    """Titles of k local bills of a Congress, drawn by a seeded generator from those in order (M3): ``draw`` and ``title``."""
    chosen = bills.where((F.col("congress") == congress) & (F.col("scope") == "local") & (F.col("title") != "")).select(order, "title")
    return records.seeded_sample(chosen, order, k).select("draw", F.substring("title", 1, letters).alias("title"))


def schools_by_congress(matched: DataFrame) -> DataFrame:
    """Acts on schools by Congress and action (M6)."""
    return matched.where("congress is not null").groupBy("congress", "action").agg(F.count("*").alias("n"))


def schools_not_found(matched: DataFrame, k: int = 400, first: int = 1987, last: int = 2023) -> DataFrame:
    """The first k founding acts whose school wasn't found, by act (M6)."""
    return matched.where(F.col("year").between(first, last) & F.col("action").isin(*FOUNDING) & (F.col("match") == "not_found")).orderBy("ra").limit(k)


def families_by_congress(terms: DataFrame, value: str = "local_laws_enacted") -> DataFrame:
    """Family seats and others of each Congress: n, mean, upper median, share of zeros, and the share of family seats (M7)."""
    known = terms.where("family_seat is not null")
    out = aggregate.summary(known, ["congress", "family_seat"], value)
    share = known.groupBy("congress").agg(F.avg(F.col("family_seat").cast("double")).alias("family_share"))
    return out.join(share, "congress").select("congress", "family_seat", "n", "median", *[F.bround(c, 3).alias(c) for c in ("mean", "zero_share", "family_share")])


def seats_histogram(terms: DataFrame, value: str = "local_laws_enacted", most: int = 12) -> DataFrame:
    """Terms by their acts, ``most`` or more as one bin, for family seats and others (M7)."""
    return terms.where("family_seat is not null").groupBy("family_seat", F.least(F.col(value), F.lit(most)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def effort_scopes(efforts: DataFrame) -> DataFrame:
    """Acts by scope with what the Senate spent on those that are linked, and the upper median of acts that shared a third reading (M9, A10).

    ``efforts``: ``scope``, ``linked``, ``floor_days``, ``debate_days``, ``certified``, ``batch``, ``third_with``.
    """
    on = lambda c: F.when(F.col("linked"), F.col(c))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    by = efforts.groupBy("scope").agg(F.count("*").alias("laws"), F.count_if("linked").alias("linked"), none(F.sum(on("floor_days"))).alias("floor_days"), none(F.sum(on("debate_days"))).alias("debate_days"), F.count_if(on("debate_days") > 0).alias("debated"), F.count_if("certified").alias("certified"), F.count_if(on("batch")).alias("batch"))
    middle = aggregate.upper_median(efforts.where("linked"), ["scope"], "third_with", "third_with_median")
    return by.join(middle, "scope", "left")


def effort_top(efforts: DataFrame, k: int = 12) -> DataFrame:
    """The k linked acts with most days of debate, then most floor days, then the first (M9)."""
    return efforts.where("linked").orderBy(F.desc("debate_days"), F.desc("floor_days"), "ra").limit(k)


def debated_local(efforts: DataFrame) -> DataFrame:
    """Local acts that were debated, by kind (M9)."""
    return efforts.where("scope = 'local' and debate_days > 0").groupBy("category").agg(F.count("*").alias("n"))


def biggest_third_day(efforts: DataFrame) -> DataFrame:
    """The day of third reading with most acts, of equals that of the first act (M9)."""
    days = efforts.where("third is not null").groupBy("third").agg(F.count("*").alias("n"), F.min("ra").alias("_first"))
    return days.agg(F.max_by(F.struct("third", "n"), F.struct("n", -F.col("_first"))).alias("d")).where("d is not null").select("d.*")
