"""Queries of the plans for acts, bills, places and people on tables made of the driver's, each with its SQL.

The entity tables are selections in expressions that Spark and DuckDB read alike, so that a query and
its SQL start from the same rows. Names that a title holds are put there by these expressions; where
what an operator must find is known that way, the SQL states it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text, titles
from ..operators import aggregate, graph, resolve, spatial
from ..sources import nested, readers
from . import acts, laws, marts, matching, people, places, records
from .analytics import query, table

MONTH_WORD = "CASE " + " ".join(f"WHEN month(o_orderdate) = {k} THEN '{m}'" for k, m in enumerate(dates.MONTHS, 1)) + " END"
ONES = text.UNITS[:20]
NUMBER_WORD = "CASE " + " ".join(f"WHEN p_size = {n} THEN '{ONES[n] if n < 20 else text.TENS[n // 10 - 2] + ('-' + ONES[n % 10] if n % 10 else '')}'" for n in range(1, 51)) + " END"
PART_TITLE = "concat(upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2), ' ', upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2))"

LAWS = {
    "ra": "o_orderkey + 1", "date": "CAST(o_orderdate AS DATE)", "congress": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE year(o_orderdate) - 1985 END",
    "category": "CASE o_orderkey % 5 WHEN 0 THEN 'school' WHEN 1 THEN 'road' WHEN 2 THEN 'citizenship' WHEN 3 THEN 'hospital' ELSE 'lgu' END",
    "action": "CASE o_orderkey % 4 WHEN 0 THEN 'establish' WHEN 1 THEN 'convert' WHEN 2 THEN 'rename' ELSE 'separate' END",
    "scope": "CASE WHEN o_orderkey % 3 = 0 THEN 'national' ELSE 'local' END",
    "title": "CASE o_orderkey % 5 WHEN 2 THEN concat('An Act Granting Philippine Citizenship to Person ', o_custkey) WHEN 1 THEN 'An Act Making a National Road of X' WHEN 3 THEN concat('An Act on ', CASE WHEN o_orderkey % 2 = 0 THEN 'Beds' ELSE 'Wards' END) ELSE 'An Act Making a City of Barangay X' END",
    "lapsed": "CASE o_orderstatus WHEN 'P' THEN true WHEN 'F' THEN false ELSE NULL END", "provinces": "split(concat('P', o_custkey % 7, ';Q', o_custkey % 5), ';')", "munis": "split(concat('M', o_custkey % 9), ';')",
    "href": "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'x' ELSE concat('https://lawphil.net/statutes/repacts/ra', year(o_orderdate), '/ra_', o_orderkey + 1, '_', year(o_orderdate), '.html') END",
    "president": "concat('P', o_custkey % 4)", "author": "concat('A', o_custkey % 40)", "province": "concat('P', o_custkey % 7)",
}
BILLS = {
    "congress": "l_linenumber", "bill": "l_orderkey", "scope": "CASE l_returnflag WHEN 'A' THEN 'local' WHEN 'N' THEN 'national' ELSE 'private' END", "ra": "CASE WHEN l_linestatus = 'F' THEN l_partkey END",
    "date_filed": "CAST(l_shipdate AS DATE)",
}
MATCHED = {
    "ra": "o_orderkey", "match": "CASE o_orderkey % 5 WHEN 0 THEN 'not_found' WHEN 1 THEN 'annex' ELSE 'found' END", "match_score": "(o_orderkey % 21) / 20.0E0", "beds_to": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 90 END",
    "registry_name": "concat(CASE WHEN o_custkey % 9 = 0 THEN 'Mental Hospital ' ELSE 'Hospital ' END, o_custkey)", "registry_beds": "o_custkey % 100", "year": "year(o_orderdate)",
    "action": "CASE o_orderkey % 4 WHEN 0 THEN 'establish' WHEN 1 THEN 'convert' WHEN 2 THEN 'rename' ELSE 'separate' END", "first_year": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 1990 + o_custkey % 12 END",
}
EFFORTS = {
    "ra": "o_orderkey", "scope": "CASE o_orderkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'private' ELSE 'national' END", "linked": "o_orderkey % 7 <> 0", "floor_days": "o_orderkey % 11", "debate_days": "CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 6 ELSE 0 END",
    "certified": "o_orderkey % 13 = 0", "batch": "o_orderkey % 5 = 0", "third": "CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderdate AS DATE) END", "third_with": "CASE WHEN o_orderkey % 9 > 0 THEN o_custkey % 50 END", "category": "concat('k', o_custkey % 8)",
}
TERMS = {"id": "c_custkey", "congress": "13 + c_custkey % 7", "family_seat": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 3 = 0 END", "local_laws_enacted": "c_nationkey % 15"}
ENTITIES = {"efforts": ("orders", EFFORTS), "terms": ("customer", TERMS), "laws": ("orders", LAWS), "bills": ("lineitem", BILLS), "matched": ("orders", MATCHED)}


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = ENTITIES[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def over(name: str, sql: str) -> str:
    source, columns = ENTITIES[name]
    return f"WITH {name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source}) {sql}"


# --- report tables -----------------------------------------------------------


@query(over("laws", "SELECT ra::BIGINT AS ra, strftime(date, '%Y-%m-%d') AS date, coalesce(congress, 0)::BIGINT AS congress, category, scope, title, coalesce(lapsed, false) AS lapsed, array_to_string(provinces, '; ') AS provinces, CASE WHEN substr(munis[1], 2)::INT < 5 THEN 'Town ' || munis[1] ELSE munis[1] END AS towns, CASE WHEN href IS NULL THEN '' WHEN href = 'x' THEN 'x' ELSE year(date)::VARCHAR END AS link FROM laws"))
def mart_laws(spark, sf_dir):
    towns = table(spark, sf_dir, "nation").where("n_nationkey < 5").selectExpr("concat('M', n_nationkey) AS psgc10", "concat('Town M', n_nationkey) AS name")
    out = marts.law_rows(entity(spark, sf_dir, "laws"), towns)
    return out.withColumns({"date": F.date_format("date", "yyyy-MM-dd"), "congress": F.col("congress").cast("long"), "ra": F.col("ra").cast("long")})


@query(over("laws", "SELECT province, congress, category, round(sum(0.5), 3)::DOUBLE AS n FROM (SELECT unnest(provinces) AS province, coalesce(congress, 0)::BIGINT AS congress, category FROM laws WHERE scope = 'local') GROUP BY ALL"))
def mart_provinces(spark, sf_dir):
    return marts.province_counts(entity(spark, sf_dir, "laws").drop("province")).withColumn("congress", F.col("congress").cast("long"))


@query(over("laws", "SELECT president, count(*) FILTER (coalesce(lapsed, false)) AS lapsed, count(*) FILTER (coalesce(lapsed, false) AND scope = 'local') AS local, count(*) AS total FROM laws GROUP BY 1"))
def mart_lapsed(spark, sf_dir):
    return marts.calendar(entity(spark, sf_dir, "laws"))["lapsed"]


@query(over("laws", "SELECT ra::BIGINT AS ra, year(date) AS year, regexp_replace(title, '^.*Citizenship to ', '') AS name FROM laws WHERE category = 'citizenship'"))
def mart_citizenship(spark, sf_dir):
    return marts.citizenship_names(entity(spark, sf_dir, "laws"))


@query(over("laws", "SELECT count(*) AS n_laws, count(*) FILTER (scope = 'local') AS n_local, count(*) FILTER (coalesce(lapsed, false)) AS n_lapsed, min(year(date)) AS first_year, max(year(date)) AS last_year, count(*) FILTER (scope = 'local' AND len(munis) > 0) AS local_in_town, count(*) FILTER (scope = 'local' AND len(provinces) > 0) AS local_placed, (max(ra) - count(DISTINCT ra))::BIGINT AS n_missing FROM laws"))
def mart_headline(spark, sf_dir):
    return marts.headline(entity(spark, sf_dir, "laws"))


@query(over("laws", """, top AS (SELECT author, count(*) AS laws, min(ra) AS f FROM laws GROUP BY 1 ORDER BY laws DESC, f LIMIT 25),
p AS (SELECT author, province, count(*) AS n, min(ra) AS f FROM laws GROUP BY ALL), c AS (SELECT author, category, count(*) AS n, min(ra) AS f FROM laws GROUP BY ALL),
pb AS (SELECT author, province FROM p QUALIFY row_number() OVER (PARTITION BY author ORDER BY n DESC, f) = 1), cb AS (SELECT author, category FROM c QUALIFY row_number() OVER (PARTITION BY author ORDER BY n DESC, f) = 1)
SELECT author, laws, province, category FROM top JOIN pb USING (author) JOIN cb USING (author)"""))
def mart_authors(spark, sf_dir):
    return marts.top_authors(entity(spark, sf_dir, "laws"))


_KIND = """CASE WHEN category = 'school' AND action IN ('establish', 'separate', 'convert', 'create') THEN 'new_schools' WHEN category = 'school' AND action = 'rename' THEN 'school_names' WHEN category = 'hospital' AND title LIKE '%Beds%' THEN 'beds'
WHEN category = 'hospital' AND action IN ('establish', 'create') THEN 'new_hospitals' WHEN category = 'road' THEN 'national_roads' WHEN category = 'lgu' THEN 'barangays' WHEN category = 'citizenship' THEN 'citizenship' END"""


@query(over("laws", f"SELECT congress::BIGINT AS congress, {_KIND} AS kind, count(*) AS n, (SELECT count(*) FROM laws t WHERE t.congress = l.congress) AS total FROM laws l WHERE congress IS NOT NULL GROUP BY congress, kind"))
def mart_kinds(spark, sf_dir):
    kind = records.kind(F.col("title"), F.col("category"), F.col("action"))
    return marts.kinds_by_congress(entity(spark, sf_dir, "laws"), kind).withColumn("congress", F.col("congress").cast("long"))


@query(over("laws", "SELECT count(*) AS n, round(avg((category = CASE WHEN ra % 4 = 0 THEN 'road' ELSE category END)::INT), 4) AS category, round(avg((scope = 'local')::INT), 4) AS scope FROM laws WHERE ra % 3 = 0"))
def mart_accuracy(spark, sf_dir):
    l = entity(spark, sf_dir, "laws")  # noqa: E741
    labels = l.where("ra % 3 = 0").selectExpr("ra", "CASE WHEN ra % 4 = 0 THEN 'road' ELSE category END AS category", "'local' AS scope")
    return marts.accuracy(l, labels)


@query(over("bills", ", hit AS (SELECT DISTINCT l_linenumber AS congress, l_orderkey AS bill FROM lineitem WHERE l_quantity > 40) SELECT b.congress, scope, count(*) AS filed, count(*) FILTER (h.bill IS NOT NULL OR ra IS NOT NULL) AS enacted FROM bills b LEFT JOIN hit h ON b.congress = h.congress AND b.bill = h.bill GROUP BY ALL"))
def mart_funnel(spark, sf_dir):
    linked = table(spark, sf_dir, "lineitem").where("l_quantity > 40").selectExpr("l_linenumber AS congress", "l_orderkey AS bill")
    return marts.bill_funnel(entity(spark, sf_dir, "bills"), linked)


@query(over("bills", ", d AS (SELECT congress, date_filed, count(*) AS n FROM bills GROUP BY ALL) SELECT congress, strftime(arg_max(date_filed, n * 100000 - datediff('day', DATE '1970-01-01', date_filed)), '%Y-%m-%d') AS date, max(n) AS bills, sum(n)::BIGINT AS total FROM d GROUP BY 1"))
def mart_filing_day(spark, sf_dir):
    return marts.busiest_filing_day(entity(spark, sf_dir, "bills")).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(over("matched", ", s AS (SELECT * FROM matched WHERE match = 'found' AND match_score >= 0.9 AND beds_to IS NOT NULL AND registry_name NOT LIKE 'Mental%') SELECT ra, registry_name, beds_to, registry_beds, registry_beds - beds_to AS gap FROM s QUALIFY row_number() OVER (PARTITION BY registry_name ORDER BY ra DESC) = 1"))
def mart_hospitals(spark, sf_dir):
    return marts.hospital_beds(entity(spark, sf_dir, "matched")).select("ra", "registry_name", "beds_to", "registry_beds", "gap")


@query(over("matched", "SELECT action, match, count(*) AS n FROM matched WHERE year BETWEEN 1987 AND 2023 AND action IN ('establish', 'separate', 'convert', 'create') GROUP BY ALL"))
def mart_schools(spark, sf_dir):
    return marts.school_levels(entity(spark, sf_dir, "matched"))


@query(over("matched", "SELECT count(*) AS recent, count(*) FILTER (coalesce(first_year < year, false)) AS preexisting, count(*) FILTER (action = 'establish') AS establish, count(*) FILTER (action = 'establish' AND coalesce(first_year < year, false)) AS establish_preexisting FROM matched WHERE year >= 1998 AND action IN ('establish', 'separate', 'convert') AND match IN ('named', 'annex')"))
def mart_schools_before(spark, sf_dir):
    return marts.school_existed(entity(spark, sf_dir, "matched"), since=1998)


@query(over("laws", """, t AS (SELECT DISTINCT 'A' || (c_custkey % 60)::VARCHAR AS author, 7 + c_custkey % 7 AS congress FROM customer), b AS (SELECT 'A' || (l_suppkey % 60)::VARCHAR AS author, l_linenumber + 6 AS congress, l_returnflag = 'A' AS loc FROM lineitem),
bc AS (SELECT author, congress, count(*) AS n, count(*) FILTER (loc) AS l FROM b GROUP BY 1, 2), lc AS (SELECT author, congress, count(*) AS n, count(*) FILTER (scope = 'local') AS l FROM laws GROUP BY 1, 2)
SELECT author, congress, coalesce(bc.n, 0) AS bills_filed, coalesce(bc.l, 0) AS local_bills_filed, coalesce(lc.n, 0) AS laws_enacted, coalesce(lc.l, 0) AS local_laws_enacted FROM t LEFT JOIN bc USING (author, congress) LEFT JOIN lc USING (author, congress)"""))
def mart_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "customer").selectExpr("concat('A', c_custkey % 60) AS author", "7 + c_custkey % 7 AS congress").distinct()
    bills = table(spark, sf_dir, "lineitem").selectExpr("concat('A', l_suppkey % 60) AS author", "l_linenumber + 6 AS congress", "CASE WHEN l_returnflag = 'A' THEN 'local' ELSE 'x' END AS scope")
    return marts.term_counters(terms, bills, entity(spark, sf_dir, "laws"))


@query(over("matched", """, e AS (SELECT CASE WHEN ra % 3 = 0 THEN 'national' ELSE 'local' END AS scope, ra % 2 = 0 AS linked, ra % 7 AS floor_days, ra % 5 AS debate_days FROM matched),
b AS (SELECT scope, count(*) AS n, count(*) FILTER (linked) AS linked, sum(floor_days)::BIGINT AS floor_days, sum(debate_days)::BIGINT AS debate_days, count(*) FILTER (debate_days > 0) AS debated FROM e GROUP BY 1)
SELECT *, round(n / sum(n) OVER (), 3) AS share_laws, round(debate_days / sum(debate_days) OVER (), 3) AS share_debate FROM b"""))
def mart_effort(spark, sf_dir):
    e = entity(spark, sf_dir, "matched").selectExpr("CASE WHEN ra % 3 = 0 THEN 'national' ELSE 'local' END AS scope", "ra % 2 = 0 AS linked", "ra % 7 AS floor_days", "ra % 5 AS debate_days")
    return marts.effort_shares(e)


# --- texts and titles --------------------------------------------------------


@query(f"""SELECT p_partkey, {PART_TITLE} || ' of the Island II' AS title_cased, p_name AS place, p_name AS person, p_name || ' national high school' AS school, p_name AS barangay, p_size::VARCHAR || CASE WHEN p_size BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
CASE WHEN length(p_name) <= 8 THEN p_name ELSE regexp_replace(substr(p_name, 1, 8), '\\s+\\S*$', '') || '...' END AS short, lpad(p_partkey::VARCHAR, 10, '0') AS code, p_size % 2 = 0 AS truthy, (1400 + p_size)::INT AS number, CASE WHEN p_partkey + 10 < 203 THEN (p_partkey + 10)::VARCHAR || ',203' WHEN p_partkey + 10 = 203 THEN '203' ELSE '203,' || (p_partkey + 10)::VARCHAR END AS cited FROM part""")
def text_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    c = F.col("p_name")
    say = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    cited = text.referenced_acts(say("An Act Amending Republic Act No. ", (F.col("p_partkey") + 10).cast("string"), " and Republic Act Numbered Two Hundred and Three, as Amended"))
    return p.select(
        "p_partkey", text.smart_title(F.upper(say(c, " of the island ii"))).alias("title_cased"), text.place_core(say("City of ", c, " (Capital)")).alias("place"), text.person_key(say("Atty. ", c, " Jr.")).alias("person"),
        matching.school_key(say(c, " NHS")).alias("school"), matching.barangay_key(say("Brgy. ", c, " (Pob.)")).alias("barangay"), text.ordinal(F.col("p_size")).alias("ordinal"),
        text.shorten(c, 8).alias("short"), text.pad_code(say(F.col("p_partkey").cast("string"), ".0")).alias("code"),
        text.truthy(F.when(F.col("p_size") % 2 == 0, " Yes ").otherwise("no")).alias("truthy"), text.words_to_int(F.expr(f"concat('Fourteen Hundred and ', {NUMBER_WORD}, ' pesos')")).alias("number"), F.array_join(cited, ",").alias("cited"),
    )


@query(f"""SELECT p_partkey, {PART_TITLE} || ' National High School' AS school, {PART_TITLE} || ' Memorial Hospital' AS hospital, {PART_TITLE} AS barangay, 'AN ACT FOR ' || upper(p_name) AS from_text, 'An Act for ' || p_name AS cleaned, 'An Act for ' || p_name AS chosen, 'index' AS source FROM part""")
def title_names(spark, sf_dir):
    name = F.expr(PART_TITLE)
    say = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    act = F.col("p_partkey") + 1
    page = say("[REPUBLIC ACT NO. ", act.cast("string"), ", June 22, 2001] AN ACT FOR ", F.upper("p_name"), " (Repealed by RA 7). Be it enacted by")
    index = say("An Act for ", F.col("p_name"), " (as amended by RA 5)")
    chosen = titles.chosen_title(index, F.lit(None).cast("string"), F.lit(False))
    return table(spark, sf_dir, "part").select(
        "p_partkey", titles.school_name(say("An Act Converting X into a School to be Known as the ", name, " National High School, Appropriating")).alias("school"),
        matching.hospital_name(say("An Act Increasing the Bed Capacity of the ", name, " Memorial Hospital in the City of Q, from Ten to Fifty")).alias("hospital"),
        matching.new_barangay(say("An Act Creating Barangay ", name, " in the Municipality of X")).alias("barangay"), titles.title_from_text(page, act).alias("from_text"),
        titles.clean_title(say("An Act for ", F.col("p_name"), ". Approved: June 1")).alias("cleaned"), chosen["title"].alias("chosen"), chosen["source"].alias("source"),
    )


@query(f"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d') AS loose, {MONTH_WORD} || ' ' || day(o_orderdate)::VARCHAR || ', ' || year(o_orderdate)::VARCHAR AS long FROM orders""")
def date_texts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    plain = F.expr(f"concat({MONTH_WORD}, ' ', day(o_orderdate), ', ', year(o_orderdate))")
    loose = F.expr(f"concat(upper(CASE WHEN month(o_orderdate) = 9 THEN 'Sept' ELSE substr({MONTH_WORD}, 1, 3) END), '.  ', day(o_orderdate), ' ', year(o_orderdate))")
    loose = F.regexp_replace(loose, "SEPT", "Sept")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return o.select("o_orderkey", iso(dates.parse_date(plain)).alias("day"), iso(dates.parse_date(loose)).alias("loose"), dates.long_date(F.to_date("o_orderdate")).alias("long"))


@query("""SELECT o_orderkey + 1 AS ra, 19 AS congress_text, (o_custkey + 5)::VARCHAR AS hb, (o_custkey + 7)::VARCHAR AS sb, false AS lapsed, CASE WHEN o_orderkey % 2 = 0 THEN 'current' ELSE 'none_stated' END AS funding, '2001-05-20' AS passed, '2001-06-21' AS signed_text, '2001-06-22' AS header_date FROM orders""")
def act_facts(spark, sf_dir):
    body = F.expr(
        "concat('REPUBLIC ACT No. ', o_orderkey + 1, ', June 22, 2001 Nineteenth Congress AN ACT FOR X. Be it enacted. ', CASE WHEN o_orderkey % 2 = 0 THEN 'The amount shall be taken from the current appropriations. ' ELSE '' END,"
        "'House Bill No. ', o_custkey + 5, ' and S. B. No. ', o_custkey + 7, ' This Act was finally passed by the Senate and the House of Representatives on May 20, 2001. Approved: June 21, 2001')"
    )
    found = acts.facts(table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("ra"), body.alias("text")))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return found.select("ra", "congress_text", F.array_join("hb", ",").alias("hb"), F.array_join("sb", ",").alias("sb"), "lapsed", "funding", F.array_join(F.transform("passed", iso), ",").alias("passed"), iso("signed_text").alias("signed_text"), iso("header_date").alias("header_date"))


@query("""SELECT page_id, 'Page ' || page_id::VARCHAR || ' & more' AS body FROM pages""")
def page_texts(spark, sf_dir):
    html = F.expr("concat('<html><script>var x = 1;</script><p>Page&nbsp;', page_id, ' &amp; <b>more</b></p><br/></html>')")
    return table(spark, sf_dir, "pages").select("page_id", text.html_text(html).alias("body"))


# --- places, facilities, people ----------------------------------------------

PROVINCES = ["Aklan", "Albay", "Batangas", "Bohol"]
PROVINCE_OF = "CASE s_suppkey % 4 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PROVINCES)) + " END"


def _gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    towns = table(spark, sf_dir, "supplier").selectExpr("concat('T', s_suppkey) AS psgc10", "concat('Villa', s_suppkey) AS name", f"{PROVINCE_OF} AS province", "'Municipality' AS level", "'' AS old_names")
    return places.gazetteer(towns)


@query(f"""WITH s AS (SELECT s_suppkey, {PROVINCE_OF} AS p FROM supplier), n AS (SELECT count(*) AS n FROM supplier)
SELECT c_custkey AS ra, CASE WHEN c_custkey % 3 = 0 THEN 'T' || s_suppkey ELSE '' END AS munis, p AS provinces, CASE WHEN c_custkey % 3 = 0 THEN 'muni' ELSE 'province' END AS level FROM customer, n JOIN s ON s.s_suppkey = c_custkey % n.n""")
def places_of_titles(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    n = s.count()
    titled = table(spark, sf_dir, "customer").withColumn("s_suppkey", F.col("c_custkey") % n).withColumn("p", F.expr(PROVINCE_OF))
    title = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("An Act in the Municipality of Villa"), "s_suppkey", F.lit(", Province of "), "p")).otherwise(F.concat(F.lit("An Act on Roads in the Province of "), "p"))
    rows = titled.select(F.col("c_custkey").alias("ra"), title.alias("title"), F.lit(1990).alias("year"))
    found = places.locate(rows, _gazetteer(spark, sf_dir), places.province_dimension(spark, PROVINCES))
    return found.select("ra", F.array_join("munis", ",").alias("munis"), F.array_join("provinces", ",").alias("provinces"), "level")


@query("""SELECT s_suppkey AS ra, CASE WHEN s_suppkey % 5 < 3 THEN 's' || s_suppkey END AS school_id, CASE WHEN s_suppkey % 5 = 4 THEN 'no_name' WHEN s_suppkey % 5 = 3 THEN 'not_found' ELSE 'named' END AS match FROM supplier""")
def match_schools(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    named = "CASE s_suppkey % 5 WHEN 4 THEN NULL WHEN 3 THEN 'Zyxwv Trade School' ELSE concat('Alpha', s_suppkey, ' Beta National High School') END"
    wanted = s.selectExpr("s_suppkey AS ra", "split(concat('T', s_suppkey), ';') AS munis", f"{named} AS target")
    schools = s.selectExpr("concat('s', s_suppkey) AS school_id", "concat('T', s_suppkey) AS muni", "split(concat('Alpha', s_suppkey, ' Beta NHS;Gamma HS'), ';') AS names")
    return matching.match_schools(wanted, schools, F.col("target")).select("ra", "school_id", "match")


@query("""SELECT s_suppkey AS ra, CASE WHEN s_suppkey % 4 < 2 THEN s_suppkey END AS hid, CASE WHEN s_suppkey % 4 < 2 THEN 'town' END AS level, CASE WHEN s_suppkey % 4 = 3 THEN 'no_name' WHEN s_suppkey % 4 = 2 THEN 'not_found' ELSE 'found' END AS match FROM supplier""")
def match_hospitals(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    named = "CASE s_suppkey % 4 WHEN 3 THEN 'An Act on Nothing' WHEN 2 THEN 'An Act Increasing the Bed Capacity of the Zyxwv Hospital in the City of Q' ELSE concat('An Act Increasing the Bed Capacity of the Quirino', s_suppkey, ' Memorial Hospital in the City of Q') END"
    wanted = s.selectExpr("s_suppkey AS ra", f"{named} AS title", "split(concat('T', s_suppkey), ';') AS munis", "split('Elsewhere', ';') AS provinces")
    registry = s.selectExpr("s_suppkey AS hid", "concat('Quirino', s_suppkey, ' Mem. Med. Center') AS name", "concat('Villa', s_suppkey) AS municipality", "'P' AS province", "'G' AS sector")
    towns = s.selectExpr("concat('T', s_suppkey) AS psgc10", "concat('villa', s_suppkey) AS town_key")
    found = matching.match_hospitals(wanted, registry, towns)
    return found.select("ra", F.when(F.col("match") == "found", F.col("hid")).alias("hid"), "level", "match")


@query("""WITH e AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'alpha' || (p_partkey // 3)::VARCHAR || ' district hospital' ELSE 'beta' || (p_partkey // 3)::VARCHAR || ' memorial hospital' END AS o,
CASE p_partkey % 3 WHEN 0 THEN 'beta' || (p_partkey // 3)::VARCHAR || ' memorial hospital' ELSE 'gamma' || (p_partkey // 3)::VARCHAR || ' medical center' END AS n FROM part WHERE p_partkey % 3 < 2)
SELECT o AS start, n AS name, 1 AS hop FROM e UNION ALL SELECT a.o, b.n, 2 FROM e a JOIN e b ON a.n = b.o""")
def later_names_of_titles(spark, sf_dir):
    title = """CASE p_partkey % 3 WHEN 0 THEN concat('An Act Renaming the Alpha', p_partkey div 3, ' District Hospital in the City of Q to Beta', p_partkey div 3, ' Memorial Hospital')
    WHEN 1 THEN concat('An Act Converting the Beta', p_partkey div 3, ' Memorial Hospital into a Center, to be known as the Gamma', p_partkey div 3, ' Medical Center, Appropriating Funds')
    ELSE concat('An Act Renaming the Delta', p_partkey, ' Hospital as the Delta', p_partkey, ' General Hospital') END"""
    wanted = table(spark, sf_dir, "part").selectExpr("p_partkey AS ra", f"{title} AS title", "'hospital' AS category")
    return graph.later_names(matching.rename_edges(wanted))


@query("""WITH t AS (SELECT s_suppkey AS psgc10, 'n' || s_suppkey::VARCHAR AS name, 'p' || (s_suppkey % 3)::VARCHAR AS p, s_suppkey % 17 = 0 AS metro, ['n' || s_suppkey::VARCHAR, 'o' || (s_suppkey % 10)::VARCHAR] AS keys FROM supplier), k AS (SELECT *, unnest(keys) AS k FROM t),
s AS (SELECT c_custkey AS school_id, CASE WHEN c_custkey % 2 = 0 THEN 'n' || (c_custkey % 40)::VARCHAR ELSE 'o' || (c_custkey % 10)::VARCHAR END AS town, 'p' || (c_custkey % 5)::VARCHAR AS q FROM customer), one AS (SELECT town, min(q) = max(q) AS o FROM s GROUP BY 1)
SELECT psgc10, school_id FROM k JOIN s ON k.k = s.town JOIN one USING (town) WHERE o OR q = p OR contains(q, k) OR metro QUALIFY rank() OVER (PARTITION BY psgc10 ORDER BY k <> name, k) = 1""")
def schools_of_towns(spark, sf_dir):
    towns = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS psgc10", "concat('n', s_suppkey) AS name", "concat('p', s_suppkey % 3) AS province", "s_suppkey % 17 = 0 AS metro", "array(concat('o', s_suppkey % 10), concat('n', s_suppkey)) AS keys")
    schools = table(spark, sf_dir, "customer").selectExpr("c_custkey AS school_id", "CASE WHEN c_custkey % 2 = 0 THEN concat('n', c_custkey % 40) ELSE concat('o', c_custkey % 10) END AS town", "concat('p', c_custkey % 5) AS province")
    return matching.town_schools(towns, schools)


@query("""SELECT s_suppkey AS ra, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE 'San Roque' || s_suppkey END AS new_barangay, CASE s_suppkey % 3 WHEN 0 THEN 'found' WHEN 1 THEN 'not_found' ELSE 'no_name' END AS match, CASE WHEN s_suppkey % 3 = 0 THEN 'San Roque' || s_suppkey || ' (Pob.)' END AS census_name FROM supplier""")
def match_barangays(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    title = "CASE WHEN s_suppkey % 3 = 2 THEN 'An Act Creating Certain Barangays' ELSE concat('An Act Creating Barangay San Roque', s_suppkey, ' in the Municipality of X') END"
    wanted = s.selectExpr("s_suppkey AS ra", f"{title} AS title", "'lgu' AS category", "split(concat('T', s_suppkey), ';') AS munis")
    census = s.selectExpr("concat('T', s_suppkey) AS muni", "CASE WHEN s_suppkey % 3 = 0 THEN concat('San Roque', s_suppkey, ' (Pob.)') ELSE 'Malipayon' END AS barangay")
    return matching.match_barangays(wanted, census).select("ra", "new_barangay", "match", "census_name")


@query("""SELECT 'p' || c_custkey AS id, 13 AS congress, c_custkey * 2 AS wid, c_custkey % 3 = 0 OR c_custkey % 3 = 1 AS family_seat FROM customer""")
def winners_and_families(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    persons = c.selectExpr("concat('p', c_custkey) AS id", "concat('Reyes', c_custkey) AS last", "'Jose' AS first", "'Cruz' AS middle", "array(13) AS congresses")
    winners = c.selectExpr("c_custkey * 2 AS wid", "2004 AS year", "concat('REYES', c_custkey) AS last", "'JOSE' AS first", "'C' AS middle", "concat('P', c_custkey) AS province")
    earlier = c.where("c_custkey % 3 = 0").selectExpr("c_custkey * 2 + 1 AS wid", "2001 AS year", "concat('REYES', c_custkey) AS last", "'PEDRO' AS first", "'C' AS middle", "concat('P', c_custkey) AS province")
    every = winners.unionByName(earlier)
    top = c.where("c_custkey % 3 = 1").selectExpr("2004 AS year", "concat('P', c_custkey) AS province", "concat('REYES', c_custkey) AS last", "'BEN' AS first")
    matched = people.match_winners(persons, every)
    return matched.join(people.family_seats(matched, every, top), ["id", "congress"])


# --- records -----------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'own' WHEN o_custkey % 3 = 1 THEN 'moved' END AS name FROM orders""")
def code_translation(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat(CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END, o_custkey % 10) AS code")
    known = spark.range(10).selectExpr("concat('A', id) AS k", "'own' AS name").unionByName(spark.range(10).selectExpr("concat('X', id) AS k", "'moved' AS name"))
    return records.translate_code(rows, "code", known, "k", "name", {"B": "X"}).select("o_orderkey", "name")


@query("""WITH b AS (SELECT l_partkey AS ra, l_orderkey * 10 + l_linenumber AS ord, l_returnflag = 'R' AS good, strftime(l_shipdate, '%Y-%m-%d') AS d FROM lineitem), u AS (SELECT ra, ord, max(good) AS good, max(d) AS d FROM b GROUP BY ALL)
SELECT ra, ord AS bill, CASE WHEN good THEN d END AS date FROM u QUALIFY row_number() OVER (PARTITION BY ra ORDER BY good DESC, ord) = 1""")
def preferred_bills(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS ra", "l_orderkey * 10 + l_linenumber AS ord", "CASE WHEN l_returnflag = 'R' THEN 'Lapsed Into Law' ELSE 'Pending' END AS status", "date_format(l_shipdate, 'yyyy-MM-dd') AS date")
    rows = rows.groupBy("ra", "ord").agg(F.min("status").alias("status"), F.max("date").alias("date")).withColumn("bill", F.col("ord"))
    return records.preferred_bill(rows)


@query("""WITH w AS (SELECT c_custkey % 50 AS a, 10 AS congress, min(c_nationkey) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL) SELECT o_orderkey AS ra, o_custkey AS bill, 'A' || (o_custkey % 50)::VARCHAR AS author, 10 AS congress, coalesce('P' || n::VARCHAR, '') AS province, n IS NOT NULL AS district_rep, CASE WHEN n IS NOT NULL THEN n > 10 END AS family_seat FROM orders LEFT JOIN w ON w.a = o_custkey % 50 WHERE o_custkey % 50 <> 7""")
def authors_of_laws(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    linked = o.selectExpr("o_orderkey AS ra", "o_custkey AS bill")
    bills = o.select(F.col("o_custkey").alias("bill")).distinct().selectExpr("bill", "CASE WHEN bill % 50 = 7 THEN ' ' ELSE concat('A', bill % 50) END AS author", "10 AS congress")
    w = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").groupBy(F.expr("c_custkey % 50").alias("a")).agg(F.min("c_nationkey").alias("n"))
    winners = w.selectExpr("concat('A', a) AS author", "10 AS congress", "concat('P', n) AS province", "true AS district_rep", "n > 10 AS family_seat")
    return records.authored_laws(linked.select("ra"), linked, bills, winners)


@query("""WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, max(o_orderkey) AS v, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY ALL) SELECT o_custkey, min(y) AS first_year, max(y) AS last_year, string_agg(y::VARCHAR || ':' || v::VARCHAR, ',' ORDER BY y) AS by_year, arg_max(s, y) AS o_orderstatus FROM y GROUP BY 1""")
def yearly_roll_up(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    out = records.roll_up(rows, "o_custkey", "y", "o_orderkey", ["o_orderstatus"])
    pairs = F.transform(F.map_entries("by_year"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return out.withColumn("by_year", F.array_join(pairs, ","))


@query("""WITH t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS x FROM supplier), m AS (SELECT l_suppkey, sum(l_quantity * l_extendedprice) / sum(l_extendedprice) AS x FROM lineitem GROUP BY 1) SELECT coalesce(s_suppkey, l_suppkey) AS town, round(coalesce(t.x, m.x), 4) AS x FROM t FULL JOIN m ON s_suppkey = l_suppkey""")
def town_points(spark, sf_dir):
    towns = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS town", "CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS x", "CASE WHEN s_suppkey % 2 = 0 THEN 1.0D END AS y")
    parts = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS town", "l_quantity AS x", "l_tax AS y", "l_extendedprice AS area")
    return records.place_points(towns, parts).select("town", F.round("x", 4).alias("x"))


@query("""WITH y AS (SELECT year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT y, n FROM y ORDER BY n DESC, y LIMIT 1) SELECT p.y::INT AS peak_year, p.n AS peak, (SELECT max(y.n) FROM y WHERE y.y > p.y) AS after FROM p""")
def peak_year(spark, sf_dir):
    months = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return records.peak_and_after(months)


@query(over("bills", "SELECT CASE WHEN scope = 'local' THEN 'local' ELSE 'other' END AS \"group\", count(*) AS filed, count(*) FILTER (ra IS NOT NULL) AS enacted, count(*) FILTER (ra IS NOT NULL) / count(*) AS rate FROM bills WHERE congress BETWEEN 2 AND 5 GROUP BY 1"))
def enactment_rate(spark, sf_dir):
    return records.enactment_rates(entity(spark, sf_dir, "bills").withColumn("enacted", F.col("ra").isNotNull()), 2, 5)


@query(over("matched", "SELECT sum(beds_to)::BIGINT AS legislated, sum(registry_beds)::BIGINT AS accredited, sum(registry_beds) / sum(beds_to) AS ratio FROM matched WHERE year >= 1997 AND beds_to IS NOT NULL"))
def beds_built(spark, sf_dir):
    return records.bed_sums(entity(spark, sf_dir, "matched"), 1997)


@query("""WITH n AS (SELECT o_custkey % 100 AS g, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1) SELECT g, CASE WHEN f > 0 THEN floor(n / f + 0.5)::BIGINT END AS one_in, CASE WHEN f / n - o / n > 0.1 THEN 'more' WHEN f / n - o / n < -0.1 THEN 'less' ELSE 'same' END AS difference FROM n""")
def shares_compared(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.expr("o_custkey % 100").alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    return n.select("g", records.one_in(F.col("f"), F.col("n")).alias("one_in"), records.difference_class(F.col("f") / F.col("n"), F.col("o") / F.col("n")).alias("difference"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 400")
def first_orders(spark, sf_dir):
    return records.first_rows(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 30")
def last_orders(spark, sf_dir):
    return records.last_reversed(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("""WITH m AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) SELECT o_orderkey, r AS place FROM m""")
def places_in_order(spark, sf_dir):
    return records.row_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").withColumnRenamed("_row", "place")


@query()
def seeded_sample(spark, sf_dir):
    return records.seeded_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("""WITH m AS (SELECT DISTINCT o_custkey AS n FROM orders), g AS (SELECT range AS n FROM range(1, (SELECT max(n) + 1 FROM m)) WHERE range NOT IN (SELECT n FROM m)) SELECT DISTINCT ((n - 1) // 100 + 1)::INT AS page FROM g""")
def missing_pages(spark, sf_dir):
    have = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    top = have.agg(F.max("o_custkey")).first()[0] or 0
    return records.page_buckets(spark.range(1, top + 1).join(have, F.col("id") == F.col("o_custkey"), "left_anti"), "id")


@query("""WITH w AS (SELECT c_custkey // 10 AS page, 'w' || c_custkey::VARCHAR AS text, (c_custkey * 37) % 300 AS x0, round_even((c_custkey % 10) * 3 / 2.0, 0)::BIGINT AS line FROM customer) SELECT page, line, CASE WHEN x0 < 100 THEN 'name' WHEN x0 < 200 THEN 'town' ELSE 'sec' END AS "column", string_agg(text, ' ' ORDER BY x0, text) AS text FROM w GROUP BY ALL""")
def words_to_cells(spark, sf_dir):
    words = table(spark, sf_dir, "customer").selectExpr("c_custkey div 10 AS page", "concat('w', c_custkey) AS text", "(c_custkey * 37) % 300 AS x0", "(c_custkey % 10) * 3.0D AS top")
    return records.cells_of_lines(records.lines_of_words(words), [("name", 0, 100), ("town", 100, 200)])


@query("""SELECT p_partkey, p_size::VARCHAR AS beds, 'LEVEL ' || (p_size % 3)::VARCHAR AS level, CASE WHEN p_size % 3 = 0 THEN p_size % 2 = 0 OR p_size % 5 <> 0 WHEN p_size % 3 = 1 THEN p_size % 5 = 0 ELSE true END AS fits, 'An act to x' || p_partkey::VARCHAR AS gap, 'An Act for ' || p_name || ' Therefor' AS example,
'https://lawphil.net/statutes/repacts/ra1999/ra_' || p_partkey::VARCHAR || '_1999.html' AS link FROM part""")
def record_texts(spark, sf_dir):
    n = F.col("p_size")
    cell = F.concat(n.cast("string"), F.lit("LEVEL "), (n % 3).cast("string"))
    both = records.beds_and_level(cell)
    gap = F.concat(F.lit("x REPUBLIC ACT NO. "), F.col("p_partkey").cast("string"), F.lit(" - AN ACT TO X"), F.col("p_partkey").cast("string"), F.lit(" Be it enacted"))
    fits = records.level_fits(n % 3 == 0, n % 3 == 1, n % 2 == 0, F.lit(False), n % 5 == 0)
    return table(spark, sf_dir, "part").select(
        "p_partkey", both["beds"].alias("beds"), both["level"].alias("level"), fits.alias("fits"), records.gap_title(gap, F.col("p_partkey")).alias("gap"),
        records.example_text(F.concat(F.lit("An Act for "), "p_name", F.lit(" Therefor, and so on"))).alias("example"), records.link_of(F.lit("1999"), F.col("p_partkey")).alias("link"),
    )


@query("""WITH c AS (SELECT n_nationkey AS g, n_nationkey + 3 AS lit, 100 + n_nationkey * 7 AS slots FROM nation), e AS (SELECT g, lit, slots, unnest(range(lit)) AS j FROM c), h AS (SELECT *, sin((j + 11) * 12.9898 + 78.233) * 43758.5453 AS v, slots / lit AS step FROM e) SELECT g, j::INT AS j, least(slots - 1, floor(j * step + (v - floor(v)) * step))::BIGINT AS slot FROM h""")
def spread_marks(spark, sf_dir):
    counts = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS g", "n_nationkey + 3 AS lit", "100 + n_nationkey * 7 AS slots")
    return records.spread_marks(counts).select("g", "j", "slot")


@query("""SELECT 'k' || c_custkey::VARCHAR AS key, c_name AS name, unnest([c_nationkey, c_nationkey + 1]) AS congress FROM customer UNION ALL SELECT 'n' || c_nationkey::VARCHAR, arg_max(c_name, c_custkey), unnest([c_nationkey, c_nationkey + 1]) FROM customer GROUP BY c_nationkey""")
def memberships(spark, sf_dir):
    people_ = table(spark, sf_dir, "customer").selectExpr("c_custkey AS ord", "c_name AS name", "array(c_nationkey + 1, c_nationkey) AS congresses", "array(concat('k', c_custkey), concat('n', c_nationkey)) AS keys")
    return records.memberships(people_)


@query("""SELECT o_orderkey + 1 AS ra, o_custkey % 50 + 10 AS beds_from, 100 AS beds_to, 'hospital' AS category, 'increase' AS action FROM orders""")
def beds_of_titles(spark, sf_dir):
    title = F.expr("concat('An Act Increasing the Bed Capacity of the Luna Hospital from ', o_custkey % 50 + 10, ' to One Hundred (100) Beds')")
    found = laws.classify(table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("ra"), title.alias("title")))
    return found.select("ra", F.col("beds_from").cast("long").alias("beds_from"), "beds_to", "category", "action")


# --- places on a plane (J23, O13) --------------------------------------------

#: A shape with a notch, moved and stretched qy nation; every second has a hole.
_SHAPE = [(0, 0), (60, 10), (80, 70), (40, 40), (10, 90)]
_CENTRE = "CAST(n_nationkey % 5 * 100 AS DOUBLE)", "CAST(n_nationkey div 5 * 100 AS DOUBLE)"
_POINT = "CAST(c_custkey * 37 % 5000 AS DOUBLE) / 10", "CAST(c_custkey * 91 % 5000 AS DOUBLE) / 10"
_TRIANGLE = [(20, 20), (30, 20), (30, 30)]
_RING = lambda points, k: "array(" + ", ".join(f"array({_CENTRE[0]} + {x} * {k}, {_CENTRE[1]} + {y} * {k})" for x, y in [*points, points[0]]) + ")"
_SCALE = "(1 + n_nationkey % 3 * 0.5D)"
_SHAPES = f"CASE WHEN n_nationkey % 2 = 0 THEN array({_RING(_SHAPE, _SCALE)}, {_RING(_TRIANGLE, _SCALE)}) ELSE array({_RING(_SHAPE, _SCALE)}) END"
_EDGES = "e AS (SELECT n_nationkey, (n_nationkey % 5 * 100)::DOUBLE AS cx, (n_nationkey // 5 * 100)::DOUBLE AS cy, 1 + n_nationkey % 3 * 0.5::DOUBLE AS k, px, py, qx, qy FROM nation JOIN (VALUES " + ", ".join(
    f"({hole}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for hole, ring in ((0, _SHAPE), (1, _TRIANGLE)) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)
) + ") v(hole, px, py, qx, qy) ON hole = 0 OR n_nationkey % 2 = 0), s AS (SELECT n_nationkey, cx + px * k AS px, cy + py * k AS py, cx + qx * k AS qx, cy + qy * k AS qy FROM e)"
_CROSSED = "(py > y) <> (qy > y) AND x < px + (qx - px) * (y - py) / (qy - py)"


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey", f"{_SHAPES} AS rings")


@query(f"""WITH {_EDGES}, c AS (SELECT c_custkey, (c_custkey * 37 % 5000)::DOUBLE / 10 AS x, (c_custkey * 91 % 5000)::DOUBLE / 10 AS y FROM customer)
SELECT c_custkey, n_nationkey FROM c, s WHERE {_CROSSED} GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def points_in_polygons(spark, sf_dir):
    points = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_POINT[0]} AS x", f"{_POINT[1]} AS y")
    return spatial.containing(points, _shapes(spark, sf_dir), "x", "y", "n_nationkey", 50.0).select("c_custkey", "n_nationkey")


@query("""WITH c AS (SELECT c_custkey, (c_custkey * 37 % 5000)::DOUBLE / 10 AS x, (c_custkey * 91 % 5000)::DOUBLE / 10 AS y FROM customer), s AS (SELECT s_suppkey, (s_suppkey * 53 % 2000)::DOUBLE / 10 AS sx, (s_suppkey * 71 % 5000)::DOUBLE / 10 AS sy FROM supplier),
g AS (SELECT c_custkey, s_suppkey, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS gap FROM c, s) SELECT c_custkey, arg_min(s_suppkey, (gap, s_suppkey)) AS s_suppkey, round(min(gap), 6) AS gap FROM g GROUP BY 1""")
def nearest_sites(spark, sf_dir):
    points = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_POINT[0]} AS x", f"{_POINT[1]} AS y")
    sites = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "CAST(s_suppkey * 53 % 2000 AS DOUBLE) / 10 AS x", "CAST(s_suppkey * 71 % 5000 AS DOUBLE) / 10 AS y")
    return spatial.nearest(points, sites, "c_custkey", "s_suppkey", 10.0).withColumn("gap", F.round("gap", 6))


@query(f"""WITH {_EDGES}, b AS (SELECT n_nationkey, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM s GROUP BY 1),
h AS (SELECT c_custkey, c_nationkey, j, sin((c_custkey * 31 + j * 7.1::DOUBLE) * 12.9898::DOUBLE + 78.233::DOUBLE) * 43758.5453::DOUBLE AS u, sin((c_custkey * 17 + j * 3.3::DOUBLE) * 12.9898::DOUBLE + 78.233::DOUBLE) * 43758.5453::DOUBLE AS v FROM customer, range(60) r(j)),
t AS (SELECT c_custkey, c_nationkey, j, x0 + (u - floor(u)) * (x1 - x0) AS x, y0 + (v - floor(v)) * (y1 - y0) AS y FROM h JOIN b ON n_nationkey = c_nationkey),
i AS (SELECT c_custkey, j, any_value(x) AS x, any_value(y) AS y FROM t JOIN s ON n_nationkey = c_nationkey AND {_CROSSED} GROUP BY 1, 2 HAVING count(*) % 2 = 1)
SELECT c_custkey, min(j)::INTEGER AS tried, round(arg_min(x, j), 4) AS x, round(arg_min(y, j), 4) AS y FROM i GROUP BY 1""")
def drawn_points(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(_shapes(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", spatial.drawn_point(F.col("rings"), F.col("c_custkey")).alias("p")).select("c_custkey", "p.tried", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


# --- sources (S12, C12, C18) -------------------------------------------------

_LINK_ROWS = r"""WITH p AS (SELECT page_id, regexp_split_to_array(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?i)<li[^>]*>') AS p FROM pages), e AS (SELECT page_id, unnest(range(2, len(p) + 1)) AS i, unnest(p[2:]) AS part FROM p)
SELECT page_id, (i - 1)::INTEGER AS row, md5(trim(regexp_replace(regexp_replace(part, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS cell, regexp_extract(part, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1) AS href FROM e"""


@query(_LINK_ROWS)
def link_rows(spark, sf_dir):
    rows = readers.html_table_rows(table(spark, sf_dir, "pages"), "html", ["page_id"], "li")
    return rows.select("page_id", "row", F.md5(F.array_join("cells", "|")).alias("cell"), "href")


@query(_LINK_ROWS)
def link_rows_lateral(spark, sf_dir):
    readers.register(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return spark.sql("SELECT page_id, r.row, md5(array_join(r.cells, '|')) AS cell, r.href FROM {pages}, LATERAL table_rows(html, 'li') r", pages=pages)


_SAID = "CASE o_orderkey % 4 WHEN 0 THEN 'Approved by the President' WHEN 1 THEN 'Read' ELSE 'Lapsed into law' END"


@query("""WITH l AS (SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS author, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, o_custkey, year(o_orderdate) - 1991 AS congress, author, n, o_orderkey % 5 <> 0 AS has_codes, o_orderkey % 7 AS h, o_orderkey % 4 AS a FROM orders JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey AS bill, congress::INTEGER AS congress, CASE WHEN has_codes THEN 'K' || author END AS author_code, (CASE WHEN has_codes THEN n ELSE 0 END)::INTEGER AS n_authors, CASE WHEN h = 1 THEN NULL WHEN h = 2 THEN 'Filed' ELSE 'Law' END AS status,
CASE WHEN h NOT IN (1, 2) AND a <> 1 THEN (o_orderkey % 90000 + 1000)::INTEGER END AS ra, CASE WHEN o_orderkey % 3 = 1 THEN 'Local' END AS committee, CASE WHEN has_codes AND s_suppkey IS NOT NULL THEN 'Ana S' || s_suppkey END AS member
FROM o LEFT JOIN supplier ON s_suppkey = author AND s_suppkey % 3 = congress % 3""")
def nested_bills(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("l"))
    o = table(spark, sf_dir, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("codes", F.transform("l", lambda x: F.concat(F.lit("K"), x["l_suppkey"].cast("string"))))
    entry = "named_struct('action', {}, 'date', '2001-01-01')"
    history = f"CASE o_orderkey % 7 WHEN 1 THEN NULL WHEN 2 THEN slice(array({entry.format(chr(39) + 'x' + chr(39))}), 1, 0) ELSE array({entry.format(chr(39) + 'Read' + chr(39))}, {entry.format(_SAID)}, {entry.format('concat(' + chr(39) + 'Republic Act ' + chr(39) + ', o_orderkey % 90000 + 1000)')}) END"
    status = "CASE o_orderkey % 7 WHEN 1 THEN slice(array(named_struct('status', 'x')), 1, 0) WHEN 2 THEN array(named_struct('status', 'Filed')) ELSE array(named_struct('status', 'Filed'), named_struct('status', 'Law')) END"
    committees = "CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN array(named_struct('name', 'Local'), named_struct('name', 'Other')) ELSE slice(array(named_struct('name', 'x')), 1, 0) END"
    meta = "named_struct('congress', year(o_orderdate) - 1991, 'bill_number', o_orderkey, 'congress_website_author_codes', CASE WHEN o_orderkey % 5 <> 0 THEN codes WHEN o_orderkey % 2 = 0 THEN slice(codes, 1, 0) END)"
    documents = o.selectExpr(f"to_json(named_struct('meta', {meta}, 'history', {history}, 'status', {status}, 'committees', {committees}, 'more', 1)) AS json")
    persons = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "to_json(named_struct('id', s_suppkey, 'last_name', concat('S', s_suppkey), 'first_name', 'Ana', 'congress_website_author_keys', array(concat('K', s_suppkey)), 'memberships', transform(filter(sequence(0, 12), c -> c % 3 = s_suppkey % 3), c -> named_struct('congress', c, 'subtype', 'house')))) AS json")
    sat = records.memberships(nested.people(persons, "json", "s_suppkey")).select(F.col("key").alias("author_code"), "congress", F.col("name").alias("member"))
    found = nested.bills(documents, "json").join(sat, ["author_code", "congress"], "left")
    return found.select("bill", "congress", "author_code", "n_authors", "status", "ra", "committee", "member")


# --- rivals, ties and misses (J11, J13, J15, J17, J18, C8, C10, C13) ---------


@query("""WITH n AS (SELECT c_nationkey, c_custkey::VARCHAR AS a, s_suppkey::VARCHAR AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey) SELECT c_nationkey AS nation, a AS customer, b AS supplier FROM n WHERE contains(a, b) OR contains(b, a)""")
def contained_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS nation", "CAST(c_custkey AS STRING) AS customer")
    s = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS nation", "CAST(s_suppkey AS STRING) AS supplier")
    return resolve.contained_either_way(c, s, "customer", "supplier", "nation")


# A town has a hospital twice under one name, a private one and one of another name; a province has one elsewhere of
# the same name, and two of a nearly equal name stand far away.
@query("""WITH k AS (SELECT c_custkey, c_custkey % 6 AS k FROM customer)
SELECT c_custkey AS ra, CASE k WHEN 0 THEN 'a' || c_custkey WHEN 1 THEN 'e' || c_custkey WHEN 2 THEN 'f' || c_custkey END AS hid, CASE k WHEN 0 THEN 'town' WHEN 1 THEN 'province' WHEN 2 THEN 'national' END AS level,
CASE WHEN k < 3 THEN 'found' WHEN k = 3 THEN 'no_name' WHEN k = 4 THEN 'not_found' ELSE 'no_place' END AS match FROM k""")
def hospital_stages(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    own = "concat('Quirino', c_custkey, ' Lopez')"
    wanted = c.selectExpr("c_custkey AS ra", f"CASE c_custkey % 6 WHEN 3 THEN 'An Act on Nothing' WHEN 4 THEN 'An Act Increasing the Beds of the Zyxwv Hospital in the City of Q' WHEN 5 THEN 'An Act Increasing the Beds of the Zyxwv Hospital in the City of Q' ELSE concat('An Act Increasing the Beds of the ', {own}, ' Memorial Hospital in the City of Q') END AS title", "CASE WHEN c_custkey % 6 IN (2, 5) THEN split('none', ';') ELSE split(concat('T', c_custkey), ';') END AS munis", "CASE WHEN c_custkey % 6 IN (2, 5) THEN split('Nowhere', ';') ELSE split(concat('P', c_custkey), ';') END AS provinces")
    rows = [
        ("a", f"concat({own}, ' Memorial Hospital')", "concat('Villa', c_custkey)", "'R'", "'G'", "c_custkey % 6 = 0"), ("b", f"concat({own}, ' Memorial Hospital')", "concat('Villa', c_custkey)", "'R'", "'G'", "c_custkey % 6 = 0"),
        ("0", f"concat({own}, ' Memorial Hospital')", "concat('Villa', c_custkey)", "'R'", "'P'", "true"), ("d", "'Other General Hospital'", "concat('Villa', c_custkey)", "'R'", "'G'", "c_custkey % 6 NOT IN (2, 5)"),
        ("e", f"concat({own}, ' Memorial Hospital')", "'Far'", "concat('P', c_custkey)", "'G'", "c_custkey % 6 = 1"), ("f", f"concat({own}, ' Memorial Hospital')", "'Far'", "'S'", "'G'", "c_custkey % 6 = 2"), ("g", f"concat({own}, ' Mem. Hospitall')", "'Far'", "'S'", "'G'", "c_custkey % 6 = 2"),
    ]
    registry = reduce(DataFrame.unionByName, [c.where(keep).selectExpr(f"concat('{h}', c_custkey) AS hid", f"{name} AS name", f"{town} AS municipality", f"{province} AS province", f"{sector} AS sector") for h, name, town, province, sector, keep in rows])
    towns = c.selectExpr("concat('T', c_custkey) AS psgc10", "concat('villa', c_custkey) AS town_key")
    found = matching.match_hospitals(wanted, registry, towns)
    return found.select("ra", F.when(F.col("match") == "found", F.col("hid")).alias("hid"), "level", "match")


# A town has an elementary and two high schools of one name, an annex, and a school known by its barangay alone.
@query("""WITH k AS (SELECT s_suppkey, s_suppkey % 7 AS k FROM supplier)
SELECT s_suppkey AS ra, CASE k WHEN 0 THEN 'h1-' || s_suppkey WHEN 1 THEN 'e-' || s_suppkey WHEN 2 THEN 'x-' || s_suppkey WHEN 3 THEN 'b-' || s_suppkey END AS school_id,
CASE WHEN k < 2 THEN 'named' WHEN k = 2 THEN 'annex' WHEN k = 3 THEN 'barangay' WHEN k = 4 THEN 'not_found' WHEN k = 5 THEN 'no_name' ELSE 'no_town' END AS match FROM k""")
def school_stages(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    target = "CASE s_suppkey % 7 WHEN 0 THEN 'Luna National High School' WHEN 1 THEN 'Luna Elementary School' WHEN 2 THEN 'Mabinni National High School' WHEN 4 THEN 'Zyxwv Trade School' WHEN 6 THEN 'Luna School' END"
    wanted = s.selectExpr("s_suppkey AS ra", "CASE WHEN s_suppkey % 7 = 6 THEN split('none', ';') ELSE split(concat('T', s_suppkey), ';') END AS munis", "CASE s_suppkey % 7 WHEN 3 THEN 'An Act Separating a High School in Barangay San Isidro, T' ELSE 'An Act on a School' END AS title", "'separate' AS action", f"{target} AS target")
    rows = [("h2", "Luna NHS", "Pob", "false, true"), ("e", "Luna ES", "Pob", "true, false"), ("h1", "Luna National HS", "Pob", "false, true"), ("x", "Mabini NHS - Annex", "Pob", "false, true"), ("b", "Rizal NHS", "San Isidro II", "false, true"), ("a", "Rizal CS", "San Isidro II", "true, false")]
    schools = reduce(DataFrame.unionByName, [s.selectExpr(f"concat('{i}-', s_suppkey) AS school_id", "concat('T', s_suppkey) AS muni", f"split('{name}', ';') AS names", f"'{name}' AS name", f"'{barangay}' AS barangay", f"{levels.split(', ')[0]} AS offers_es", f"{levels.split(', ')[1]} AS offers_jhs") for i, name, barangay, levels in rows])
    return matching.match_schools(wanted, schools, F.col("target")).select("ra", "school_id", "match")


_ENTRY = "CASE l_returnflag WHEN 'A' THEN 'Approved on Third Reading' WHEN 'N' THEN 'Interpellations of Senator X' ELSE CASE WHEN l_linestatus = 'O' THEN 'Certified by the President' ELSE 'Read' END END"


@query(f"""WITH h AS (SELECT l_orderkey AS doc, {_ENTRY} AS a, l_shipdate::DATE AS d FROM lineitem),
r AS (SELECT doc, list_sort(list(DISTINCT d) FILTER (a LIKE 'App%' OR a LIKE 'Int%')) AS f, list_sort(list(DISTINCT d) FILTER (a LIKE 'Int%')) AS e, max(d) FILTER (a LIKE 'App%') AS t, bool_or(a LIKE 'Cert%') AS c FROM h GROUP BY 1),
x AS (SELECT o_orderkey AS doc, o_orderkey % 997 + 9000 AS ra FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT o_orderkey, (o_orderkey + 1) % 997 + 9000 FROM orders JOIN r ON doc = o_orderkey AND len(f) > 0 WHERE o_orderkey % 5 = 0),
j AS (SELECT ra, string_agg(DISTINCT doc::VARCHAR, ',' ORDER BY doc::VARCHAR) AS docs, list_distinct(flatten(list(f))) AS f, list_distinct(flatten(list(e))) AS e, max(t) AS t, bool_or(c) AS c FROM x JOIN r USING (doc) GROUP BY 1)
SELECT ra, docs, coalesce(len(f), 0)::INTEGER AS floor_days, coalesce(len(e), 0)::INTEGER AS debate_days, strftime(t, '%Y-%m-%d') AS third, CASE WHEN t IS NOT NULL THEN count(*) OVER (PARTITION BY t) END AS third_reading_with, CASE WHEN c AND ra % 4 = 0 THEN 'both' WHEN c THEN 'senate record' WHEN ra % 4 = 0 THEN 'list' ELSE '' END AS certified_by FROM j""")
def floor_of_acts(spark, sf_dir):
    entry = F.struct(F.expr(_ENTRY).alias("action"), F.to_date("l_shipdate").alias("date"))
    history = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(entry).alias("history"))
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(history, F.col("o_orderkey") == F.col("l_orderkey"))
    became = F.array(F.struct(F.concat(F.lit("Republic Act No. "), (F.col("o_orderkey") % 997 + 9000).cast("string")).alias("action"), F.lit(None).cast("date").alias("date")))
    senate = o.select(F.col("o_orderkey").alias("doc"), F.lit("SB").alias("kind"), F.lit(14).alias("congress"), F.col("o_orderkey").alias("bill"), F.when(F.col("o_orderkey") % 3 == 0, F.concat("history", became)).otherwise(F.col("history")).alias("history"))
    cites = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "(o_orderkey + 1) % 997 + 9000 AS ra").where("o_orderkey % 5 = 0").groupBy("ra").agg(F.collect_set("o_orderkey").alias("sb"))
    numbers = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 997 + 9000 AS ra").distinct()
    none = F.array().cast("array<bigint>")
    wanted = numbers.join(cites, "ra", "full_outer").select("ra", F.lit(14).alias("congress"), none.alias("hb"), F.coalesce("sb", none).alias("sb"))
    found = acts.floor_of_acts(wanted, acts.floor_records(senate))
    by = acts.certified_by(found.select("ra", "certified"), found.where("ra % 4 = 0").select("ra"))
    return found.join(by, "ra").select("ra", F.array_join(F.array_sort(F.transform("docs", lambda d: d.cast("string"))), ",").alias("docs"), F.size("floor").alias("floor_days"), F.size("debate").alias("debate_days"), F.date_format("third", "yyyy-MM-dd").alias("third"), "third_reading_with", "certified_by")


# Acts whose header agrees with their date, or is a slip of the pen, or that have nothing but bills or neighbours.
@query("""WITH o AS (SELECT o_orderkey AS ra, o_orderdate::DATE AS d, (o_orderdate::DATE >= DATE '1995-07-23')::INTEGER + (o_orderdate::DATE >= DATE '1998-07-01')::INTEGER + 9 AS by_date, o_orderkey % 4 AS k FROM orders WHERE o_orderdate BETWEEN DATE '1992-12-01' AND DATE '1995-04-30' OR o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1998-04-30')
SELECT ra, (CASE WHEN k = 3 THEN 9 + ra % 2 ELSE by_date END)::INTEGER AS congress, CASE k WHEN 0 THEN 'header' WHEN 1 THEN 'passage date' WHEN 2 THEN 'approval date' ELSE 'house record' END AS congress_from FROM o""")
def congress_of_acts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderdate BETWEEN DATE '1992-12-01' AND DATE '1995-04-30' OR o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1998-04-30'")
    day = "CAST(o_orderdate AS DATE)"
    own = f"CASE WHEN {day} >= DATE '1995-07-23' THEN 10 ELSE 9 END"
    wanted = o.selectExpr("o_orderkey AS ra", f"CASE WHEN o_orderkey % 4 <> 3 THEN {day} END AS date", f"CASE o_orderkey % 4 WHEN 0 THEN {own} WHEN 1 THEN 3 WHEN 2 THEN 19 END AS congress_text", f"CASE WHEN o_orderkey % 4 = 1 THEN array(date_sub({day}, 20), date_add({day}, 900)) ELSE CAST(array() AS ARRAY<DATE>) END AS passed")
    house = o.where("o_orderkey % 4 = 3").selectExpr("o_orderkey AS ra", "CAST(9 + o_orderkey % 2 AS INT) AS congress").unionByName(o.where("o_orderkey % 4 = 2").selectExpr("o_orderkey AS ra", "explode(array(9, 10)) AS congress"))
    return acts.assign_congress(wanted, house)


# --- remainders of the report tables (M3, M6, M7, M9, P9) ---------------------


@query(over("bills", "SELECT strftime(date_filed, '%Y-%m') AS month, scope, count(*) AS n FROM bills GROUP BY ALL"))
def mart_monthly(spark, sf_dir):
    return marts.monthly_filings(entity(spark, sf_dir, "bills"))


@query(over("bills", "SELECT congress, strftime(date_filed, '%Y-%m-%d') AS day, count(*) AS n FROM bills WHERE congress IN (2, 3) GROUP BY ALL"))
def mart_daily(spark, sf_dir):
    return marts.daily_filings(entity(spark, sf_dir, "bills"), (2, 3)).select("congress", F.date_format("date_filed", "yyyy-MM-dd").alias("day"), "n")


@query(f"WITH b AS ({over('bills', 'SELECT scope, count(*) AS filed FROM bills WHERE congress + 5 = 10 GROUP BY 1')}), l AS ({over('laws', 'SELECT scope, count(*) AS laws FROM laws WHERE congress = 10 GROUP BY 1')}) SELECT scope, coalesce(filed, 0) AS filed, coalesce(laws, 0) AS laws FROM b FULL JOIN l USING (scope)")
def mart_one_congress(spark, sf_dir):
    return marts.one_congress(entity(spark, sf_dir, "bills").withColumn("congress", F.col("congress") + 5), entity(spark, sf_dir, "laws"), 10)


@query()
def mart_examples(spark, sf_dir):
    return marts.filed_examples(entity(spark, sf_dir, "laws"), "ra", 12)


@query(over("matched", "SELECT year % 20 AS congress, action, count(*) AS n FROM matched GROUP BY ALL"))
def mart_schools_by_congress(spark, sf_dir):
    return marts.schools_by_congress(entity(spark, sf_dir, "matched").withColumn("congress", F.col("year") % 20))


@query(over("matched", "SELECT ra, year FROM matched WHERE year BETWEEN 1987 AND 2023 AND action IN ('establish', 'separate', 'convert', 'create') AND match = 'not_found' ORDER BY ra LIMIT 400"))
def mart_schools_not_found(spark, sf_dir):
    return marts.schools_not_found(entity(spark, sf_dir, "matched")).select("ra", "year")


@query(over("terms", "SELECT congress, family_seat, count(*) AS n, list_sort(list(local_laws_enacted))[(count(*) // 2 + 1)::BIGINT] AS median, round_even(avg(local_laws_enacted), 3) AS mean, round_even(avg(CASE WHEN local_laws_enacted = 0 THEN 1.0::DOUBLE ELSE 0 END), 3) AS zero_share, round_even(any_value(s), 3) AS family_share FROM (SELECT *, avg(CASE WHEN family_seat THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY congress) AS s FROM terms WHERE family_seat IS NOT NULL) GROUP BY 1, 2"))
def mart_families(spark, sf_dir):
    return marts.families_by_congress(entity(spark, sf_dir, "terms"))


@query()
def mart_family_summary(spark, sf_dir):
    return marts.family_summary(entity(spark, sf_dir, "terms"), "id")


@query(over("terms", "SELECT family_seat, least(local_laws_enacted, 12)::BIGINT AS bin, count(*) AS n FROM terms WHERE family_seat IS NOT NULL GROUP BY ALL"))
def mart_seats_histogram(spark, sf_dir):
    return marts.seats_histogram(entity(spark, sf_dir, "terms"))


@query(over("efforts", "SELECT scope, count(*) AS laws, count(*) FILTER (linked) AS linked, (sum(floor_days) FILTER (linked))::BIGINT AS floor_days, (sum(debate_days) FILTER (linked))::BIGINT AS debate_days, count(*) FILTER (linked AND debate_days > 0) AS debated, count(*) FILTER (certified) AS certified, count(*) FILTER (linked AND batch) AS batch, (list_sort(list(third_with) FILTER (linked AND third_with IS NOT NULL)))[(count(third_with) FILTER (linked) // 2 + 1)::BIGINT] AS third_with_median FROM efforts GROUP BY 1"))
def mart_effort_scopes(spark, sf_dir):
    return marts.effort_scopes(entity(spark, sf_dir, "efforts"))


@query(over("efforts", "SELECT ra, debate_days, floor_days FROM efforts WHERE linked ORDER BY debate_days DESC, floor_days DESC, ra LIMIT 12"))
def mart_effort_top(spark, sf_dir):
    return marts.effort_top(entity(spark, sf_dir, "efforts")).select("ra", "debate_days", "floor_days")


@query(over("efforts", "SELECT category, count(*) AS n FROM efforts WHERE scope = 'local' AND debate_days > 0 GROUP BY 1"))
def mart_debated_local(spark, sf_dir):
    return marts.debated_local(entity(spark, sf_dir, "efforts"))


@query(over("efforts", "SELECT strftime(third, '%Y-%m-%d') AS third, count(*) AS n FROM efforts WHERE third IS NOT NULL GROUP BY 1 ORDER BY n DESC, min(ra) LIMIT 1"))
def mart_third_day(spark, sf_dir):
    return marts.biggest_third_day(entity(spark, sf_dir, "efforts")).select(F.date_format("third", "yyyy-MM-dd").alias("third"), "n")


@query("SELECT l_orderkey, sum(trunc(l_quantity)::BIGINT + trunc(l_tax * 100)::BIGINT)::BIGINT AS total FROM lineitem GROUP BY 1")
def pattern_totals(spark, sf_dir):
    texts = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("string").alias("g1_quantity"), (F.col("l_tax") * 100).cast("string").alias("g2_tax"), F.lit("n/a").alias("g3_none"), F.lit("9").alias("other"))
    return aggregate.row_totals(texts, r"^g\d+_", "total").groupBy("l_orderkey").agg(F.sum("total").alias("total"))
