"""Queries of the operators on the driver's tables, each with its SQL.

Every query reads whole tables through ``spark.read.parquet`` and composes operators of
this package; filters and columns reach the scans.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import aggregate, dedup, graph, intervals, provenance, resolve, rules, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


# --- calendar (M4, A6, O2, D2) -----------------------------------------------


@query("SELECT year(l_shipdate) AS y, dayofyear(l_shipdate) AS doy, count(*) AS n FROM lineitem GROUP BY ALL")
def calendar_days(spark, sf_dir):
    days = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("y"), F.dayofyear("l_shipdate").alias("doy"))
    return days.groupBy("y", "doy").agg(F.count("*").alias("n"))


@query("SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, day LIMIT 12")
def calendar_big_days(spark, sf_dir):
    days = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count("*").alias("n"))
    return days.select(iso("d").alias("day"), "n").orderBy(F.desc("n"), "day").limit(12)


@query("SELECT month(l_shipdate) AS m, count(*) AS n FROM lineitem GROUP BY ALL")
def calendar_by_month(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.month("l_shipdate").alias("m")).agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT l_shipdate::DATE AS d, count(*) AS n FROM lineitem GROUP BY 1) SELECT round_even(coalesce(sum(CASE WHEN n >= 20 THEN n ELSE 0 END) / sum(n), 0), 3)::DOUBLE AS share FROM d")
def batch_day_share(spark, sf_dir):
    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    return aggregate.share_of_large_groups(days, "d", 20, "share").select(F.bround("share", 3).alias("share"))


@query("SELECT y, m, n, max(n) OVER (PARTITION BY y) AS best FROM (SELECT year(l_shipdate) AS y, month(l_shipdate) AS m, count(*) AS n FROM lineitem GROUP BY ALL)")
def busiest_month(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")).agg(F.count("*").alias("n"))
    return n.withColumn("best", F.max("n").over(Window.partitionBy("y")))


@query("SELECT y, m AS peak, n FROM (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL) QUALIFY rank() OVER (PARTITION BY y ORDER BY n DESC) = 1")
def peak_month_tied(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    best = n.groupBy(F.col("y").alias("y2")).agg(F.max("n").alias("top"))
    return n.join(best, (F.col("y") == F.col("y2")) & (F.col("n") == F.col("top")), "left_semi").select("y", F.col("m").alias("peak"), "n")


# --- intervals (J6, J7) ------------------------------------------------------

TERMS = [
    (1, date(1992, 1, 1), date(1993, 6, 30)), (2, date(1993, 7, 1), date(1995, 2, 15)),
    (3, date(1995, 4, 1), date(1996, 12, 31)), (4, date(1997, 1, 1), date(1998, 3, 31)), (5, date(2001, 1, 1), date(2030, 12, 31)),
]
_TERM_SQL = "(VALUES " + ", ".join(f"({n}, DATE '{a}', DATE '{b}')" for n, a, b in TERMS) + ") AS t(term, a, b)"


@query(f"SELECT o_orderkey, (SELECT min(term) FROM {_TERM_SQL} WHERE o_orderdate::DATE BETWEEN a AND b)::INTEGER AS term FROM orders")
def interval_term_closed(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", intervals.term_of(F.to_date("o_orderdate"), TERMS).alias("term"))


@query(f"SELECT o_orderkey, (SELECT min(term) FROM {_TERM_SQL} WHERE o_orderdate::DATE >= a AND o_orderdate::DATE < b)::INTEGER AS term FROM orders")
def interval_term_halfopen(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", intervals.term_of(F.to_date("o_orderdate"), TERMS, closed=False).alias("term"))


@query(f"SELECT o_orderkey, coalesce((SELECT min(term) FROM {_TERM_SQL} WHERE o_orderdate::DATE BETWEEN a AND b), (SELECT max_by(term, b) FROM {_TERM_SQL} WHERE b < o_orderdate::DATE))::INTEGER AS term FROM orders")
def asof_prev_term(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", intervals.term_or_last(F.to_date("o_orderdate"), TERMS).alias("term"))


@query(f"SELECT o_orderkey, term FROM orders LEFT JOIN {_TERM_SQL} ON o_orderdate::DATE BETWEEN a AND b")
def interval_join_table(spark, sf_dir):
    terms = spark.createDataFrame([(n, a, b) for n, a, b in TERMS], "term int, a date, b date")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return intervals.join_terms(rows, "d", terms, "a", "b").select("o_orderkey", "term")


# --- counting (A1-A5, J3) ----------------------------------------------------


@query("""SELECT o_orderpriority AS grp, count(*) AS filed, count(*) FILTER (WHERE o_orderstatus = 'F') AS enacted_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS enacted_o,
count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS with_lines FROM orders GROUP BY 1""")
def funnel_by_group(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().withColumn("has", F.lit(True))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    s = F.col("o_orderstatus")
    return o.groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count("*").alias("filed"), F.count_if(s == "F").alias("enacted_f"), F.count_if(s == "O").alias("enacted_o"), F.count_if("has").alias("with_lines"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), n AS (SELECT l_orderkey, count(*) AS k FROM s GROUP BY 1)
SELECT l_suppkey AS member, round(sum(1.0::DOUBLE / k), 6) AS weight FROM s JOIN n USING (l_orderkey) GROUP BY 1""")
def fractional_counts(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("members"))
    return aggregate.fractional_count(sets, "members", [], "weight").select("member", F.round("weight", 6).alias("weight"))


@query("SELECT o_orderstatus AS s, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM orders), 3)::DOUBLE AS share FROM orders GROUP BY 1")
def share_of_total(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy()), 3))


@query("SELECT count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, round(max(o_totalprice), 2) AS top FROM orders")
def headline_stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.agg(
        F.count("*").alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers"), F.count_if(F.col("o_orderstatus") == "P").alias("n_p"),
        iso(F.min("o_orderdate")).alias("first_day"), iso(F.max("o_orderdate")).alias("last_day"), F.round(F.max("o_totalprice"), 2).alias("top"),
    )


@query("""SELECT c_mktsegment AS seg, count(o_orderkey) AS filed, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def counters_zero_filled(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("a"), F.count_if(F.col("o_orderstatus") == "F").alias("b"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy(F.col("c_mktsegment").alias("seg")).agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(y) for x, y in (("a", "filed"), ("b", "done"), ("u", "urgent"))])


# --- which row stays (A9, J4, J5, W1) ----------------------------------------


@query("SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.round("o_totalprice", 2).alias("price"))
    return dedup.keep_last(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "price")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_per_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return dedup.keep_first(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def dedup_keep_first(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")  # noqa: E741
    return dedup.keep_first(l, ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query("""SELECT l_orderkey, min(l_linenumber - 1)::INTEGER AS pos, arg_min(l_partkey, (l_linenumber, l_partkey)) AS p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 10 GROUP BY 1""")
def array_probe_first_hit(spark, sf_dir):
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(lines, lambda x: F.struct((x["l_linenumber"] - 1).alias("at"), x["l_partkey"].alias("p"))).alias("parts"))
    wanted = table(spark, sf_dir, "part").where("p_size <= 10").select("p_partkey")
    each = lists.select("l_orderkey", F.explode("parts").alias("x")).select("l_orderkey", F.col("x.at").alias("pos"), F.col("x.p").alias("p_partkey"))
    return each.join(wanted, "p_partkey").groupBy("l_orderkey").agg(F.min("pos").alias("pos"), F.min_by("p_partkey", F.struct("pos", "p_partkey")).alias("p_partkey"))


@query("SELECT * FROM (SELECT unnest(range(1, (SELECT max(l_orderkey) FROM lineitem) + 1)) AS l_orderkey) WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_ids(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey")  # noqa: E741
    high = l.agg(F.max("l_orderkey")).first()[0] or 0
    return dedup.missing_numbers(l, "l_orderkey", 1, high)


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey")  # noqa: E741
    return table(spark, sf_dir, "orders").select("o_orderkey").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("SELECT o_orderkey, (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) OR o_orderstatus = 'P' AS flag FROM orders")
def semi_flag(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct().withColumn("hit", F.lit(True))
    o = table(spark, sf_dir, "orders").join(r, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", (F.coalesce("hit", F.lit(False)) | (F.col("o_orderstatus") == "P")).alias("flag"))


@query("""WITH l AS (SELECT l_orderkey, min(l_shipdate) FILTER (WHERE l_returnflag = 'R') AS r, max(l_shipdate) AS s FROM lineitem GROUP BY 1)
SELECT o_orderkey, strftime(coalesce(r, s, o_orderdate), '%Y-%m-%d') AS day, CASE WHEN r IS NOT NULL THEN 'returned line' WHEN s IS NOT NULL THEN 'last line' WHEN o_orderdate IS NOT NULL THEN 'order' END AS source FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def coalesce_provenance(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("r"), F.max("l_shipdate").alias("s"))  # noqa: E741
    o = table(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    best = provenance.coalesce_from([("returned line", F.col("r")), ("last line", F.col("s")), ("order", F.col("o_orderdate"))])
    return o.select("o_orderkey", best.alias("b")).select("o_orderkey", iso("b.value").alias("day"), F.col("b.source").alias("source"))


# --- aggregates --------------------------------------------------------------


@query("""WITH n AS (SELECT l_suppkey, l_shipdate, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM (SELECT l_suppkey, month(l_shipdate) AS l_shipdate, l_orderkey, l_linenumber FROM lineitem) GROUP BY 1, 2)
SELECT l_suppkey, l_shipdate::INTEGER AS month, n FROM n QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, f) = 1""")
def group_mode_first_tie(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", F.month("l_shipdate").alias("mo"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))  # noqa: E741
    return aggregate.mode_first(l, ["l_suppkey"], "mo", "ord", "month").select("l_suppkey", "month", "n")


@query("""WITH n AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1, 2) SELECT p_brand, p_type AS best, n FROM n QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) = 1""")
def argmax_group(spark, sf_dir):
    return aggregate.mode_first(table(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey"), ["p_brand"], "p_type", "p_partkey", "best")


_LINES = "WITH n AS (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def _lines_per_order(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(_LINES + " SELECT o_orderstatus, list_sort(list(n))[(count(*) // 2 + 1)::BIGINT] AS median FROM n GROUP BY 1")
def upper_median(spark, sf_dir):
    return aggregate.upper_median(_lines_per_order(spark, sf_dir), ["o_orderstatus"], "n", "median")


@query(_LINES + " SELECT o_orderstatus, count(*) AS n, round(avg(n), 6) AS mean, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS zero_share, list_sort(list(n))[(count(*) // 2 + 1)::BIGINT] AS median FROM n GROUP BY 1")
def describe_groups(spark, sf_dir):
    s = aggregate.summary(_lines_per_order(spark, sf_dir), ["o_orderstatus"], "n")
    return s.select("o_orderstatus", "n", F.round("mean", 6).alias("mean"), F.round("zero_share", 6).alias("zero_share"), "median")


@query(_LINES + " SELECT least(n, 5) AS bin, count(*) AS n FROM n GROUP BY 1")
def clipped_hist(spark, sf_dir):
    return aggregate.clipped_histogram(_lines_per_order(spark, sf_dir), "n", 5)


@query(_LINES + " SELECT round_even(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 3)::DOUBLE AS zero_share FROM n")
def zero_share(spark, sf_dir):
    return _lines_per_order(spark, sf_dir).agg(F.bround(F.avg((F.col("n") == 0).cast("double")), 3).alias("zero_share"))


@query()
def bootstrap_ci(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return aggregate.bootstrap_ci(c, ["c_mktsegment"], "c_acctbal", "c_custkey")


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_shipdate::DATE) AS same_day FROM lineitem")
def same_day_with(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("d"))  # noqa: E741
    return windows.count_alike(l, "d", "same_day").drop("d")


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k FROM documents) SELECT doc_id, count(*) OVER (PARTITION BY k) AS copies FROM t QUALIFY count(*) OVER (PARTITION BY k) > 1""")
def duplicate_titles(spark, sf_dir):
    k = F.md5(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")))
    d = table(spark, sf_dir, "documents").select("doc_id", k.alias("k"))
    return windows.count_alike(d, "k", "copies").where("copies > 1").select("doc_id", "copies")


@query("""SELECT name, round(v, 2) AS total FROM (SELECT sum(l_quantity) AS l_quantity, sum(l_discount) AS l_discount, sum(l_tax) AS l_tax FROM lineitem) UNPIVOT (v FOR name IN (l_quantity, l_discount, l_tax))""")
def unpivot_sum(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    columns = [c for c in l.columns if c in ("l_quantity", "l_discount", "l_tax")]
    return aggregate.sum_columns(l.select(columns), columns, "name", "v").select("name", F.round("v", 2).alias("total"))


@query("""SELECT n_name, count(o_orderkey) AS n, CASE WHEN count(DISTINCT c_custkey) > 0 THEN round(count(o_orderkey) / count(DISTINCT c_custkey) * 100000, 3) END AS rate FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def rate_per_capita(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    by = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.sum("k").alias("n"), F.count("*").alias("people"))
    j = table(spark, sf_dir, "nation").join(by, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return j.select("n_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(aggregate.rate(F.coalesce("n", F.lit(0)), F.col("people")), 3).alias("rate"))


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, [1/6, 2/6, 3/6, 4/6, 5/6]) AS e FROM customer WHERE c_acctbal > 0)
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN (c_acctbal >= e[1])::INT + (c_acctbal >= e[2])::INT + (c_acctbal >= e[3])::INT + (c_acctbal >= e[4])::INT + (c_acctbal >= e[5])::INT END::BIGINT AS bin FROM customer, q""")
def quantile_bins(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    edges = aggregate.quantiles(c.where("c_acctbal > 0"), "c_acctbal", [k / 6 for k in range(1, 6)])
    return c.select("c_custkey", F.when(F.col("c_acctbal") > 0, windows.threshold_bin(F.col("c_acctbal"), edges)).alias("bin"))


@query("SELECT o_custkey, n, (n >= 2)::BIGINT + (n >= 5)::BIGINT + (n >= 12)::BIGINT + (n >= 30)::BIGINT + (n >= 80)::BIGINT AS bin FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def threshold_bins(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.withColumn("bin", windows.threshold_bin(F.col("n"), [2, 5, 12, 30, 80]))


@query("SELECT l_returnflag AS kind, CASE WHEN l_linestatus IN ('O') THEN 'open' ELSE 'closed' END AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
def merged_status_counts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.when(F.col("l_linestatus") == "O", "open").otherwise("closed").alias("status"))  # noqa: E741
    return l.groupBy("kind", "status").agg(F.count("*").alias("n"))


# --- order-dependent ---------------------------------------------------------

_HOLES = "CASE WHEN event_id % 7 NOT IN (2, 3) THEN event_type END"


@query(f"""WITH e AS (SELECT event_id, {_HOLES} AS v FROM events),
w AS (SELECT event_id, v, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM e)
SELECT event_id, coalesce(v, CASE WHEN a = b THEN a END) AS filled, CASE WHEN v IS NOT NULL THEN 'own' WHEN a = b THEN 'neighbours' END AS fill_source FROM w""")
def neighbour_fill(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", f"{_HOLES} AS v")
    return windows.neighbour_fill(e, "event_id", "v", F.floor(F.col("event_id") / 512)).select("event_id", "filled", "fill_source")


@query("""SELECT event_id, event_type = 'purchase' OR coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'purchase', FALSE) AS near FROM events""")
def lag_event_match(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return windows.this_or_previous(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", "near", ranges=F.to_date("ts")).select("event_id", "near")


@query("""SELECT event_id, last_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM events""")
def heading_ffill(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("value") > 50, F.col("event_id")).alias("h"))
    return windows.forward_fill(e, ["user_id"], ["ts", "event_id"], "h", "heading", ranges=F.to_date("ts")).select("event_id", "heading")


@query("""SELECT user_id, bool_or(event_type = 'purchase') AS bought, bool_or(event_type = 'click' AND value > 90) AS big_click, max(value) FILTER (WHERE event_type = 'view') AS top_view FROM events GROUP BY 1""")
def event_flags(spark, sf_dir):
    t = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(t == "purchase").alias("bought"), F.bool_or((t == "click") & (F.col("value") > 90)).alias("big_click"), F.max(F.when(t == "view", F.col("value"))).alias("top_view"))


@query("SELECT user_id, event_type, count(DISTINCT ts::DATE) AS days, strftime(min(ts), '%Y-%m-%d') AS first_day FROM events GROUP BY 1, 2")
def effort_days(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_distinct(F.to_date("ts")).alias("days"), iso(F.min("ts")).alias("first_day"))


@query("""SELECT DISTINCT a.c_custkey FROM (SELECT c_custkey, c_nationkey, c_mktsegment, year(o_orderdate) AS y FROM customer JOIN orders ON c_custkey = o_custkey) a
JOIN (SELECT c_custkey, c_nationkey, c_mktsegment, year(o_orderdate) AS y FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 400000) b
ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey <> b.c_custkey AND b.y IN (a.y - 1, a.y - 2)""")
def self_join_lagged(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_totalprice")
    both = c.join(o, F.col("c_custkey") == F.col("o_custkey"))
    key = ["c_nationkey", "c_mktsegment", "y"]
    big = both.where("o_totalprice > 400000").select(*key, "c_custkey").distinct()
    # One or two customers of each key tell whether another than oneself is there.
    ends = big.groupBy(*key).agg(F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"))
    ends = ends.withColumn("y", F.explode(F.array(F.col("y") + 1, F.col("y") + 2)))
    own = both.select(*key, "c_custkey").distinct()
    return own.join(ends, key).where((F.col("lo") != F.col("c_custkey")) | (F.col("hi") != F.col("c_custkey"))).select("c_custkey").distinct()


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS nth FROM orders""")
def occurrence_index(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return windows.occurrence(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "nth", ranges=F.year("o_orderdate")).drop("o_orderdate")


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey, i % 3 AS col, i // 3 AS row FROM r""")
def stack_rank(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", "o_orderdate")
    return windows.stack(o, ["o_orderpriority", "o_custkey"], ["o_orderdate", "o_orderkey"], 3, ranges=F.year("o_orderdate")).select("o_orderkey", "col", "row")


@query("""WITH s AS (SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT f, s, round(n / sum(n) OVER (PARTITION BY f), 6) AS share, round(coalesce(sum(n) OVER (PARTITION BY f ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY f), 6) AS "offset" FROM s""")
def stacked_offsets(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s")).agg(F.count("*").alias("n"))
    return windows.running_share(n, ["f"], ["s"], "n").select("f", "s", F.round("share", 6).alias("share"), F.round("offset", 6).alias("offset"))


@query("""SELECT strftime(d, '%Y-%m-%d') AS day, count(event_id) AS n FROM (SELECT unnest(generate_series(DATE '2023-12-20', DATE '2024-02-17', INTERVAL 1 DAY))::DATE AS d) LEFT JOIN events ON ts::DATE = d GROUP BY 1""")
def calendar_spine(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    spine = windows.day_spine(spark, "2023-12-20", 60)
    return spine.join(n, F.col("day") == F.col("d"), "left").select(iso("day").alias("day"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# --- top and search (O2-O8) --------------------------------------------------


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY n DESC, total DESC, o_custkey LIMIT 12")
def topk_debate(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return n.orderBy(F.desc("n"), F.desc("total"), "o_custkey").limit(12)


@query("""WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)
(SELECT 'top' AS side, c_nationkey, n FROM n ORDER BY n DESC, c_nationkey LIMIT 8) UNION ALL (SELECT 'bottom', c_nationkey, n FROM n ORDER BY n, c_nationkey LIMIT 8)""")
def top_bottom_rank(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "c_nationkey").limit(8).select(F.lit("top").alias("side"), "c_nationkey", "n")
    return top.unionByName(n.orderBy("n", "c_nationkey").limit(8).select(F.lit("bottom").alias("side"), "c_nationkey", "n"))


@query("""SELECT p_name, count(*) AS n, CASE WHEN starts_with(lower(p_name), 're') THEN 0 ELSE 1 END AS tier FROM part WHERE contains(lower(p_name), 're') GROUP BY p_name ORDER BY tier, n DESC, p_name LIMIT 12""")
def prefix_search(spark, sf_dir):
    name = F.lower("p_name")
    found = table(spark, sf_dir, "part").where(name.contains("re")).groupBy("p_name").agg(F.count("*").alias("n"))
    return found.withColumn("tier", F.when(F.lower("p_name").startswith("re"), 0).otherwise(1)).orderBy("tier", F.desc("n"), "p_name").limit(12)


@query("""SELECT p_brand, p_partkey, round(p_retailprice, 2) AS price FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3""")
def top_per_group(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return p.withColumn("_r", F.row_number().over(w)).where("_r <= 3").select("p_brand", "p_partkey", F.round("p_retailprice", 2).alias("price"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND year(o_orderdate) BETWEEN 1995 AND 2030 AND o_orderstatus = 'O'")
def era_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") == "O"))
    return o.where(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp"), F.lit("2030-12-31 23:59:59.999999").cast("timestamp"))).select("o_orderkey", "o_custkey")


# --- rules and text ----------------------------------------------------------

def _doc_rules() -> list[rules.Rule]:
    return [
        rules.Rule("notice", r"(?i)all rights reserved", F.length("text") < 1200),
        rules.Rule("permissive", r"(?i)apache|mit license|bsd"),
        rules.Rule("license", r"(?i)licen[sc]e|copyright"),
        rules.Rule("shouting", r"[A-Z]{5,}"),
        rules.Rule("phone", r"[0-9]{3}-[0-9]{4}"),
        rules.Rule("english", r"(?i)\bthe\b", F.length("text") > 300),
    ]


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)all rights reserved') AND length(text) < 1200 THEN 'notice' WHEN regexp_matches(text, '(?i)apache|mit license|bsd') THEN 'permissive'
WHEN regexp_matches(text, '(?i)licen[sc]e|copyright') THEN 'license' WHEN regexp_matches(text, '[A-Z]{5,}') THEN 'shouting' WHEN regexp_matches(text, '[0-9]{3}-[0-9]{4}') THEN 'phone'
WHEN regexp_matches(text, '(?i)(^|[^a-zA-Z0-9_])the($|[^a-zA-Z0-9_])') AND length(text) > 300 THEN 'english' ELSE 'other' END AS kind FROM documents""")
def rule_classifier(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.first_match(F.col("text"), _doc_rules(), "other").alias("kind"))


@query(r"""SELECT p_partkey, coalesce(CASE WHEN regexp_matches(p_name, '^[a-m]') THEN 'early' WHEN regexp_matches(p_name, '^[n-r]') THEN 'middle' END, CASE WHEN regexp_matches(p_name, 'green|red') THEN 'colour' END, 'other') AS verb FROM part""")
def action_verb(spark, sf_dir):
    name = F.col("p_name")
    first = rules.first_match(name, [rules.Rule("early", "^[a-m]"), rules.Rule("middle", "^[n-r]")])
    second = rules.first_match(name, [rules.Rule("colour", "green|red")])
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(first, second, F.lit("other")).alias("verb"))


@query("""SELECT year(o_orderdate) AS y, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_orderstatus = 'F' THEN 'filled' WHEN o_totalprice > 200000 THEN 'large' ELSE 'other' END AS kind, count(*) AS n FROM orders GROUP BY 1, 2""")
def kind_by_period(spark, sf_dir):
    kind = rules.ladder([(F.col("o_orderpriority").startswith("1"), "urgent"), (F.col("o_orderstatus") == "F", "filled"), (F.col("o_totalprice") > 200000, "large")], "other")
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), kind.alias("kind")).agg(F.count("*").alias("n"))


@query(r"""SELECT count(*) AS n, round_even(avg(((length(text) > 400)::INT = quality)::INT), 4)::DOUBLE AS accuracy FROM labels JOIN documents USING (doc_id)""")
def classifier_accuracy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") > 400).cast("int").alias("pred"))
    both = table(spark, sf_dir, "labels").select("doc_id", "quality").join(d, "doc_id")
    return both.agg(F.count("*").alias("n"), F.bround(F.avg((F.col("pred") == F.col("quality")).cast("double")), 4).alias("accuracy"))


@query(r"""SELECT doc_id, m FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]{3})-([0-9]{4})', 0)) AS m FROM documents)""")
def regexp_findall_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9]{3})-([0-9]{4})"), 0)).alias("m"))


@query(r"""SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ')) AS n, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ')) AS digest FROM pages""")
def strip_tags(spark, sf_dir):
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\n\r]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query(r"""SELECT page_id, n, cell FROM (SELECT page_id, unnest(range(1, len(p) + 1)) AS n, unnest(list_transform(p, lambda x: trim(regexp_replace(x, '<[^>]*>', ' ', 'g'), ' '))) AS cell FROM (SELECT page_id, string_split(html, '</p>') AS p FROM pages)) WHERE cell <> ''""")
def html_rows(spark, sf_dir):
    cells = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "</p>", -1)).alias("i", "c"))
    out = cells.select("page_id", (F.col("i") + 1).cast("long").alias("n"), F.trim(F.regexp_replace("c", "<[^>]*>", " ")).alias("cell"))
    return out.where("cell <> ''")


@query("""SELECT try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1""")
def json_prop_count(spark, sf_dir):
    k = F.expr("try_cast(get_json_object(props, '$.k') as bigint)")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


# --- resolution --------------------------------------------------------------


@query()
def fuzzy_block_match(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    left = p.where("p_partkey % 2 = 0").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("left_id"))
    right = p.where("p_partkey % 2 = 1").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("right_id"))
    return resolve.exact_then_fuzzy(left, right, "left_id", "right_id", "p_brand", "p_name", "p_name", 0.86, least_length=4)


@query("""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) > 6)) AS w FROM documents), b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) > 6)) AS w FROM benchmark)
SELECT doc_id, item_id, count(*) AS shared FROM (SELECT doc_id, unnest(w) AS x FROM t) JOIN (SELECT item_id, unnest(w) AS x FROM b) USING (x) GROUP BY 1, 2 HAVING count(*) >= 5""")
def token_overlap_match(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 6)
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("dw"))
    b = table(spark, sf_dir, "benchmark").select("item_id", words.alias("bw"))
    return resolve.token_overlap(d, b, "doc_id", "item_id", "dw", "bw", least=5)


@query("""WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer), s AS (SELECT s_suppkey, s_nationkey FROM supplier),
j AS (SELECT c_custkey, s_suppkey, count(*) OVER (PARTITION BY c_custkey) AS n FROM c JOIN s ON c_nationkey = s_nationkey) SELECT c_custkey, s_suppkey FROM j WHERE n = 1""")
def unique_candidate_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    return resolve.unique_candidate(c, s, "c_custkey", "k", []).select("c_custkey", "s_suppkey")


@query("""SELECT c_custkey, arg_min(s_suppkey, (abs(c_acctbal - s_acctbal), s_suppkey)) AS s_suppkey, round(min(abs(c_acctbal - s_acctbal)), 4) AS gap FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE abs(c_acctbal - s_acctbal) <= 500 GROUP BY 1""")
def nearest_in_block(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), "c_acctbal")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), "s_acctbal")
    return resolve.nearest_in_block(c, s, "c_custkey", "s_suppkey", "k", "c_acctbal", "s_acctbal", 500.0).select("c_custkey", "s_suppkey", F.round("gap", 4).alias("gap"))


@query("SELECT l_orderkey, l_linenumber, coalesce(p_name, l_partkey::VARCHAR) AS name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey")
def lookup_or_code(spark, sf_dir):
    names = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("code"))  # noqa: E741
    return resolve.name_or_code(l, "code", names, "name").select("l_orderkey", "l_linenumber", "name")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS o, p_partkey - p_partkey % 97 + (p_partkey % 97 * 7 + 3) % 97 AS n FROM part WHERE p_partkey % 97 <> (p_partkey % 97 * 7 + 3) % 97),
r(s, n, h) AS (SELECT o, n, 1 FROM e UNION ALL SELECT r.s, e.n, r.h + 1 FROM r JOIN e ON r.n = e.o WHERE r.h < 4)
SELECT s AS start, n AS name, min(h)::INTEGER AS hop FROM r WHERE s <> n GROUP BY 1, 2""")
def rename_closure(spark, sf_dir):
    edges = table(spark, sf_dir, "part").selectExpr("p_partkey AS old", "p_partkey - p_partkey % 97 + (p_partkey % 97 * 7 + 3) % 97 AS new")
    return graph.later_names(edges, 4)


# --- geometry and jitter -----------------------------------------------------


@query("""SELECT p_partkey, round((x0 + x1) / 2.0::DOUBLE, 6) AS x, round((y0 + y1) / 2.0::DOUBLE, 6) AS y, round(((x1 - x0) * (y1 - y0))::DOUBLE, 6) AS area FROM (SELECT p_partkey, p_partkey % 17 AS x0, p_partkey % 17 + p_size AS x1, p_partkey % 11 AS y0, p_partkey % 11 + 2 AS y1 FROM part)""")
def ring_centroid(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "double(p_partkey % 17) x0", "double(p_partkey % 17 + p_size) x1", "double(p_partkey % 11) y0", "double(p_partkey % 11 + 2) y1")
    ring = F.array(*[F.array(F.col(a), F.col(b)) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    c = p.select("p_partkey", geo.ring_centroid(ring).alias("c"))
    return c.select("p_partkey", *[F.round(F.col(f"c.{k}"), 6).alias(k) for k in ("x", "y", "area")])


@query("""SELECT o_orderkey, round(v - floor(v), 6) AS h, ['a', 'b', 'c', 'd'][(floor((v - floor(v)) * 4)::INT % 4) + 1] AS pick FROM (SELECT o_orderkey, sin(o_orderkey * 12.9898::DOUBLE + 78.233::DOUBLE) * 43758.5453::DOUBLE AS v FROM orders)""")
def hash_pick(spark, sf_dir):
    h = geo.jitter(F.col("o_orderkey"))
    pick = F.element_at(F.array(*[F.lit(x) for x in ("a", "b", "c", "d")]), (F.floor(h * 4) % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(h, 6).alias("h"), pick.alias("pick"))


# --- sets (U1-U5) ------------------------------------------------------------


@query("""SELECT 'order' AS source, count(*) AS n FROM orders UNION ALL SELECT 'line', count(*) FROM lineitem UNION ALL SELECT 'event', count(*) FROM events""")
def union_with_source(spark, sf_dir):
    parts = [(n, table(spark, sf_dir, t).select(F.lit(n).alias("source"))) for n, t in (("order", "orders"), ("line", "lineitem"), ("event", "events"))]
    out = parts[0][1].unionByName(parts[1][1]).unionByName(parts[2][1])
    return out.groupBy("source").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT l_suppkey, list(DISTINCT l_returnflag) AS f, list(DISTINCT l_linestatus) AS s FROM lineitem GROUP BY 1) SELECT l_suppkey, array_to_string(list_sort(list_distinct(list_concat(f, s))), ',') AS both, array_to_string(list_sort(list_filter(f, lambda x: NOT list_contains(['N'], x))), ',') AS without_n, list_has_any(f, ['R']) AS returned FROM a""")
def set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_returnflag").alias("f"), F.collect_set("l_linestatus").alias("s"))
    return a.select(
        "l_suppkey", F.array_join(F.array_sort(F.array_union("f", "s")), ",").alias("both"), F.array_join(F.array_sort(F.array_except("f", F.array(F.lit("N")))), ",").alias("without_n"),
        F.arrays_overlap("f", F.array(F.lit("R"))).alias("returned"),
    )
