"""Entity resolution: exact, then fuzzy inside blocks.

A fuzzy comparison is only ever made inside an equality on a block key or an index of letter pairs, after exact
matches are taken out by an equi-join and where bounds inside the JVM leave it open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import most_ratio, numbered, ro_ratio, runs
from .scratch import written


def bounded(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """Pairs of texts with ``_most``, the largest ratio that they can have (bags of both as ``_l1``, ``_l2``, ``_r1``, ``_r2``)."""
    common = lambda k: F.size(F.array_intersect(f"_l{k}", f"_r{k}"))
    return pairs.withColumn("_most", most_ratio(F.length(one) + F.length(other), common(1), common(2))).drop("_l1", "_l2", "_r1", "_r2")


def with_bags(df: DataFrame, name: str, side: str) -> DataFrame:
    """Letters and pairs of letters of a name, numbered among their equals, as ``_<side>1`` and ``_<side>2``."""
    held = df.withColumns({f"_runs{k}": runs(F.col(name), k) for k in (1, 2)})  # in a column of their own, so that they are made once
    return held.withColumns({f"_{side}{k}": numbered(F.col(f"_runs{k}")) for k in (1, 2)}).drop("_runs1", "_runs2")


def worth_comparing(pairs: DataFrame, left_id: str) -> tuple[DataFrame, DataFrame]:
    """The pair of each left row with the largest bound, with its ``score``, and the other pairs whose bound reaches that score.

    ``pairs``: ``left_id``, ``_rid``, ``_ln``, ``_rn``, ``_most``. All others are below the best ratio of their left row.
    """
    row = F.struct("_rid", "_rn", "_ln", "_most")
    first = pairs.groupBy(left_id).agg(F.min_by(row, F.struct(-F.col("_most"), F.col("_rid"))).alias("_p")).select(left_id, "_p.*").withColumn("score", ro_ratio("_rn", "_ln"))
    reached = first.select(left_id, F.col("_rid").alias("_done"), F.col("score").alias("_least"))
    return first, pairs.join(reached, left_id).where((F.col("_rid") != F.col("_done")) & (F.col("_most") >= F.col("_least"))).drop("_done", "_least")


def exact_then_fuzzy(left: DataFrame, right: DataFrame, left_id: str, right_id: str, block: str, left_name: str, right_name: str, least: float, least_length: int = 0) -> DataFrame:
    """The best right row of each left row inside its block.

    Returns ``left_id``, ``right_id``, ``score`` and ``status``: ``exact`` (score 1),
    ``found`` (score at ``least`` or more, unrounded), ``not_found`` (the closest is
    given all the same) or ``no_block``. Of equal scores the smallest right id counts.

    Exact names are settled by an equi-join. For the others bounds of the ratio are taken inside the JVM, the pair of a left row with the
    largest bound is compared first, and only pairs whose bound reaches that ratio are compared in Python: no other can be the best.
    """
    r = right.select(block, F.col(right_name).alias("_rn"), F.col(right_id).alias("_rid"))
    l = left.select(left_id, block, F.col(left_name).alias("_ln"))  # noqa: E741
    exact = l.join(r, (l[block] == r[block]) & (F.col("_ln") == F.col("_rn"))).groupBy(left_id).agg(F.min("_rid").alias("_rid")).withColumn("score", F.lit(1.0))
    rest = l.join(exact.select(left_id), left_id, "left_anti").where(F.length("_ln") >= least_length)
    near = bounded(with_bags(rest, "_ln", "l").join(with_bags(r.where("_rn is not null"), "_rn", "r"), block), "_ln", "_rn").select(left_id, "_rid", "_ln", "_rn", "_most")
    first, others = worth_comparing(near, left_id)
    scored = first.select(left_id, "_rid", "score").unionByName(others.select(left_id, "_rid", ro_ratio("_rn", "_ln").alias("score")))
    best = scored.groupBy(left_id).agg(F.min_by(F.struct("_rid", "score"), F.struct(-F.col("score"), F.col("_rid"))).alias("_best")).select(left_id, "_best.*")
    out = l.select(left_id, block).join(exact.withColumn("_exact", F.lit(True)).unionByName(best.withColumn("_exact", F.lit(False))), left_id, "left")
    blocks = r.select(block).distinct().withColumn("_has", F.lit(True))
    status = F.when(F.col("_exact"), "exact").when(F.col("score") >= least, "found").when(F.col("_has"), "not_found").otherwise("no_block")
    return out.join(blocks, block, "left").select(left_id, F.col("_rid").alias(right_id), "score", status.alias("status"))


def alike_candidates(left: DataFrame, right: DataFrame, left_name: str, right_name: str, least: float) -> DataFrame:
    """Pairs of distinct names whose ratio may be ``least`` or more (above 2/3), with ``_most``; no pair that is is missed.

    An index over all names, without blocks. By lengths and ``least`` two such names share many pairs of letters (the
    bound of ``most_ratio``); so they meet in one of the rarest pairs of each, as many as its own share may lack, plus one. Names so short that nothing need be
    shared meet by being short. Frequent pairs of letters are in hardly any such prefix.
    """
    if not 2 / 3 < least <= 1:
        raise ValueError("least must be above 2/3")

    def sides(df: DataFrame, name: str, side: str) -> DataFrame:
        return with_bags(df.where(F.col(name).isNotNull()).select(F.col(name).alias(f"_{side}n")).distinct(), f"_{side}n", side)

    l, r = written(sides(left, left_name, "l")), written(sides(right, right_name, "r"))  # noqa: E741
    often = r.select(F.explode("_r2").alias("_t")).groupBy("_t").agg(F.count("*").alias("_n"))
    # 3 * matches <= pairs + length + 1 with matches >= least * length / 2, and the partner no shorter than least / (2 - least) of this.
    share = lambda n: F.ceil(n * (1 + least / (2 - least)) * (1.5 * least - 1) - 1 - 1e-9)
    short = int(1 / (1.5 * least - 1)) + 1  # the sum of the lengths of two names that need not share a pair is below this

    def keys(df: DataFrame, side: str) -> DataFrame:
        runs = df.select(f"_{side}n", F.explode(f"_{side}2").alias("_t")).join(often, "_t", "left")
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_t"))), lambda x: x["_t"])
        n = F.length(f"_{side}n")
        need = F.greatest(share(n), F.lit(1))
        rare = runs.groupBy(f"_{side}n").agg(ordered.alias("_o")).select(f"_{side}n", F.explode(F.slice("_o", F.lit(1), F.greatest(F.size("_o") - need + 1, F.lit(1)).cast("int"))).alias("_t"))
        return rare.unionByName(df.where(n <= short).select(f"_{side}n", F.lit("").alias("_t")))

    met = keys(l, "l").join(keys(r, "r"), "_t").select("_ln", "_rn").distinct()
    return bounded(met.join(l, "_ln").join(r, "_rn"), "_ln", "_rn").where(F.col("_most") >= least)


def alike(left: DataFrame, right: DataFrame, left_name: str, right_name: str, least: float) -> DataFrame:
    """(``left_name``, ``right_name``, ``ratio``) of all pairs of distinct names with a ratio of ``least`` or more."""
    pairs = alike_candidates(left, right, left_name, right_name, least)
    return pairs.select(F.col("_ln").alias(left_name), F.col("_rn").alias(right_name), ro_ratio("_ln", "_rn").alias("ratio")).where(F.col("ratio") >= least)


def contained_either_way(left: DataFrame, right: DataFrame, left_name: str, right_name: str, block: str, width: int = 3) -> DataFrame:
    """(``block``, ``left_name``, ``right_name``) of distinct names of a block of which one contains the other; empty names have no partner.

    All runs of ``width`` letters of the shorter name are in the longer one. So the rarest of a name (itself, if it is shorter than that) meets the
    runs of the names that may contain it, in both directions, and containment is tested on what has met.
    """

    def names(df: DataFrame, name: str, to: str) -> DataFrame:
        return df.where(F.col(name) != "").select(F.col(block).alias("_b"), F.col(name).alias(to)).distinct()

    l, r = names(left, left_name, "_l"), names(right, right_name, "_r")  # noqa: E741

    def inside(small: DataFrame, s: str, large: DataFrame, g: str) -> DataFrame:
        there = F.array_distinct(F.concat(*[runs(F.col(g), k) for k in range(1, width + 1)]))
        there = large.select("_b", g, F.explode(there).alias("_t"))
        often = there.groupBy("_b", "_t").agg(F.count("*").alias("_n"))
        own = F.when(F.length(s) < width, F.array(F.col(s))).otherwise(runs(F.col(s), width))
        # A run that no longer name has rules the name out.
        counted = small.select("_b", s, F.explode(F.array_distinct(own)).alias("_t")).join(often, ["_b", "_t"], "left")
        rarest = counted.groupBy("_b", s).agg(F.min_by("_t", F.struct(F.coalesce("_n", F.lit(0)), "_t")).alias("_t"))
        return rarest.join(there, ["_b", "_t"]).where(F.contains(g, s)).select("_b", "_l", "_r")

    both = inside(l, "_l", r, "_r").unionByName(inside(r, "_r", l, "_l")).distinct()
    return both.select(F.col("_b").alias(block), F.col("_l").alias(left_name), F.col("_r").alias(right_name))


def unique_candidate(mentions: DataFrame, candidates: DataFrame, mention_id: str, key: str, narrow: list[Column]) -> DataFrame:
    """The candidate of a mention if exactly one is left.

    ``narrow`` are conditions tried in turn: each keeps the candidates that satisfy it
    if more than one was left before and any does.

    Candidates are counted by key first, so mentions that have one meet that one, and pairs are
    made only of the others, and only if a condition may tell their candidates apart.
    """
    n = candidates.groupBy(key).agg(F.count("*").alias("_n"))
    total = mentions.select(mention_id, key).join(n, key).groupBy(mention_id).agg(F.sum("_n").alias("_n"))
    sure = mentions.join(total.where("_n = 1").select(mention_id), mention_id, "left_semi").join(candidates, key)
    if not narrow:
        return sure
    both = mentions.join(total.where("_n > 1").select(mention_id), mention_id, "left_semi").join(candidates, key)
    for k, condition in enumerate(narrow):
        both = both.withColumn("_ok", F.coalesce(condition, F.lit(False)))
        n = both.groupBy(mention_id).agg(F.count("*").alias("_n"), F.count_if("_ok").alias("_m"))
        both = both.drop("_n", "_m").join(n, mention_id).where((F.col("_n") == 1) | (F.col("_m") == 0) | F.col("_ok")).drop("_n", "_m", "_ok")
    one = both.groupBy(mention_id).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return sure.unionByName(both.join(one, mention_id, "left_semi").select(*sure.columns))


def nearest_in_block(left: DataFrame, right: DataFrame, left_id: str, right_id: str, block: str, left_at: str, right_at: str, most: float) -> DataFrame:
    """The right row of the block nearest on a line, within ``most``; ties to the smaller id.

    Positions are cut into cells of width ``most``. Both sides of a cell are sorted together and each left
    row looks at the right positions just below and above it, in its own cell or at the near end
    of the next ones, so work grows with the rows and not with their pairs.
    Rows without a position or a block have no neighbour.
    """
    cell = F.floor(F.col("_at") / most)
    right_rows = right.where(F.col(right_at).isNotNull() & F.col(block).isNotNull())
    r = right_rows.groupBy(F.col(block).alias("_b"), F.col(right_at).alias("_at")).agg(F.min(right_id).alias("_rid")).withColumn("_cell", cell)
    point = F.struct("_at", "_rid")
    ends = r.groupBy("_b", "_cell").agg(F.max(point).alias("_end"), F.min(point).alias("_start"))
    l = left.where(F.col(left_at).isNotNull() & F.col(block).isNotNull()).select(F.col(left_id).alias("_lid"), F.col(block).alias("_b"), F.col(left_at).alias("_at"))  # noqa: E741
    both = r.withColumn("_mine", F.lit(False)).unionByName(l.withColumns({"_cell": cell, "_mine": F.lit(True)}), allowMissingColumns=True)
    w = Window.partitionBy("_b", "_cell")
    last = F.last(F.when(~F.col("_mine"), point), ignorenulls=True)
    # From above by the opposite order: a frame that ends at the last row would be summed anew for each row.
    below = last.over(w.orderBy("_at", "_mine").rowsBetween(Window.unboundedPreceding, 0))
    above = last.over(w.orderBy(F.desc("_at"), "_mine").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumns({"_p0": below, "_p1": above}).where("_mine")
    placed = placed.join(ends.select("_b", (F.col("_cell") + 1).alias("_cell"), F.col("_end").alias("_p2")), ["_b", "_cell"], "left")
    placed = placed.join(ends.select("_b", (F.col("_cell") - 1).alias("_cell"), F.col("_start").alias("_p3")), ["_b", "_cell"], "left")
    gaps = [F.when(F.col(p).isNotNull(), F.struct(F.abs(F.col("_at") - F.col(f"{p}._at")).alias("gap"), F.col(f"{p}._rid").alias("rid"))) for p in ("_p0", "_p1", "_p2", "_p3")]
    best = placed.select("_lid", F.array_min(F.array(*gaps)).alias("_best")).where(F.col("_best.gap") <= most)
    return best.groupBy("_lid").agg(F.min("_best").alias("_best")).select(F.col("_lid").alias(left_id), F.col("_best.rid").alias(right_id), F.col("_best.gap").alias("gap"))


def token_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_tokens: str, right_tokens: str, least: int = 1) -> DataFrame:
    """(left, right, shared): numbers of distinct tokens in common, where ``least`` or more are.

    Rows of one id count as one, ids and tokens that are null as none. Two sets with ``least`` tokens in common share one of
    the n - least + 1 tokens of each that fewest left rows have, so only those meet in the join, and
    the frequent tokens, whose pairs are many, don't; whole sets then give the numbers.
    """
    held = lambda df, i, t: df.select(F.col(i).alias("_id"), F.explode(F.array_distinct(t)).alias("_t")).where("_id is not null and _t is not null")
    b = held(right, right_id, right_tokens).distinct()
    # Tokens that only one side has can't be shared; they go before the first exchange where the right side's are few.
    a = held(left, left_id, left_tokens).join(b.select("_t").distinct(), "_t", "left_semi").distinct()
    if least <= 1:
        return a.withColumnRenamed("_id", left_id).join(b.withColumnRenamed("_id", right_id), "_t").groupBy(left_id, right_id).agg(F.count("*").alias("shared"))
    often = a.groupBy("_t").agg(F.count("*").alias("_n"))

    def sets(x: DataFrame, name: str) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda s: s["_t"])
        return x.join(often, "_t").groupBy(F.col("_id").alias(name)).agg(ordered.alias("_set")).where(F.size("_set") >= least)

    l, r = sets(a, left_id), sets(b, right_id)  # noqa: E741
    rare = F.explode(F.slice("_set", F.lit(1), F.size("_set") - least + 1)).alias("_t")
    pairs = l.select(left_id, rare).join(r.select(right_id, rare), "_t").select(left_id, right_id).distinct()
    met = pairs.join(l.withColumnRenamed("_set", "_ls"), left_id).join(r.withColumnRenamed("_set", "_rs"), right_id)
    return met.select(left_id, right_id, F.size(F.array_intersect("_ls", "_rs")).cast("long").alias("shared")).where(F.col("shared") >= least)


def name_or_code(df: DataFrame, code: str, names: DataFrame, name: str) -> DataFrame:
    """The name of a code, or the code itself."""
    return df.join(names, code, "left").withColumn(name, F.coalesce(name, code))
