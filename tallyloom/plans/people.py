"""Representatives against winners of elections, and seats kept in a family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import person_key
from ..operators.resolve import contained_either_way
from ..operators.scratch import written

#: The election that filled a Congress.
ELECTIONS = {12: 2001, 13: 2004, 14: 2007, 15: 2010, 16: 2013, 17: 2016, 18: 2019, 19: 2022, 20: 2025}


def _words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != "")


def match_winners(persons: DataFrame, winners: DataFrame) -> DataFrame:
    """``id``, ``congress``, ``wid``: the winner that a member of a Congress was.

    ``persons``: ``id``, ``last``, ``first``, ``middle``, ``congresses``; ``winners``: ``wid`` (in order), ``year``, ``last``,
    ``first``, ``middle``. Blocks are (year, surname), and for people without an equal surname (year) with one
    surname containing the other. A shared first name or first three letters decides; else the only
    winner of that surname if nobody else of it sat and middle names agree; else, without a first name, the only candidate.
    """
    split = F.create_map(*[F.lit(x) for pair in ELECTIONS.items() for x in pair])
    p = persons.select("id", person_key(F.col("last")).alias("last"), person_key(F.col("first")).alias("first"), person_key(F.col("middle")).alias("middle"), F.explode("congresses").alias("congress"))
    sharing = p.groupBy("last", "congress").agg(F.count_distinct("id").alias("namesakes"))
    p = p.join(sharing, ["last", "congress"]).withColumn("year", split[F.col("congress")]).where("year is not null")
    w = winners.select("wid", "year", person_key(F.col("last")).alias("wlast"), person_key(F.col("first")).alias("wfirst"), person_key(F.col("middle")).alias("wmiddle"))
    p, w = written(p), written(w)  # keys are made once
    exact = p.join(w.withColumnRenamed("year", "_y"), (F.col("year") == F.col("_y")) & (F.col("last") == F.col("wlast"))).drop("_y").withColumn("exact", F.lit(True))
    rest = p.join(exact.select("id", "congress").distinct(), ["id", "congress"], "left_anti").where("last <> ''")
    # Surnames that contain each other meet by their rarest run of letters, one row a surname.
    rest = written(rest)
    both = exact
    if not rest.isEmpty():
        pairs = contained_either_way(rest, w, "last", "wlast", "year")
        both = exact.unionByName(rest.join(pairs, ["year", "last"]).join(w, ["year", "wlast"]).withColumn("exact", F.lit(False)))
    mine, theirs = _words(F.col("first")), _words(F.col("wfirst"))
    starts = lambda a: F.transform(a, lambda x: F.substring(x, 1, 3))
    first = F.arrays_overlap(mine, theirs) | F.arrays_overlap(starts(mine), starts(theirs))
    own = F.array_union(_words(F.col("middle")), mine)
    other = _words(F.col("wmiddle"))
    initials = F.exists(other, lambda x: (F.length(x) == 1) & F.exists(own, lambda y: y.startswith(x)))
    middle = (F.size(_words(F.col("middle"))) == 0) | (F.size(other) == 0) | F.arrays_overlap(other, own) | initials
    n = both.groupBy("id", "congress").agg(F.count("*").alias("_n"))
    both = both.join(n, ["id", "congress"])
    rank = F.when(first, 0).when(F.col("exact") & (F.col("_n") == 1) & (F.col("namesakes") == 1) & middle, 1).when((F.col("_n") == 1) & (F.size(mine) == 0), 2)
    good = both.withColumn("_rank", rank).where("_rank is not null")
    return written(good.groupBy("id", "congress").agg(F.min(F.struct("_rank", "wid")).alias("_b")).select("id", "congress", F.col("_b.wid").alias("wid")))


def family_seats(matched: DataFrame, winners: DataFrame, top: DataFrame) -> DataFrame:
    """``id``, ``congress``, ``family_seat`` of matched members.

    True if in the same province and election someone of the surname with another first name won a ``top``
    office (``year``, ``province``, ``last``, ``first``), or someone of the surname won the House there one or two
    elections before, other than by the member's own earlier terms (as matched).
    """
    w = winners.select("wid", "year", person_key(F.col("province")).alias("prov"), person_key(F.col("last")).alias("sn"), person_key(F.col("first")).alias("fn"))
    m = matched.join(w, "wid")
    t = top.select("year", person_key(F.col("province")).alias("prov"), person_key(F.col("last")).alias("sn"), person_key(F.col("first")).alias("_fn"))
    now = m.join(t, ["year", "prov", "sn"]).where("fn <> _fn").select("id", "congress").distinct()
    before = w.select(F.col("wid").alias("_old"), F.explode(F.array(F.col("year") + 3, F.col("year") + 6)).alias("year"), "prov", "sn")
    own = matched.select("id", F.col("wid").alias("_old"), F.col("congress").alias("_c"))
    earlier = m.join(before, ["year", "prov", "sn"]).join(own, ["id", "_old"], "left")
    earlier = earlier.where(F.col("_c").isNull() | ~F.col("_c").between(F.col("congress") - 2, F.col("congress") - 1)).select("id", "congress").distinct()
    hit = now.unionByName(earlier).distinct().withColumn("_hit", F.lit(True))
    return matched.select("id", "congress").join(hit, ["id", "congress"], "left").select("id", "congress", F.coalesce("_hit", F.lit(False)).alias("family_seat"))
