"""Aggregates beyond the built-in ones."""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import join_by_keys


def fractional_count(df: DataFrame, members: str, group: list[str], name: str) -> DataFrame:
    """Each row counts 1/n for each of its n members (A4)."""
    each = df.withColumn("_w", 1.0 / F.size(members)).withColumn("member", F.explode(members))
    return each.groupBy("member", *group).agg(F.sum("_w").alias(name))


def mode_first(df: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """The most frequent value of each key; ties go to the one seen first in ``order``.

    Two map-side aggregates: no key's rows are gathered.
    """
    n = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = F.max_by(F.struct(F.col(value).alias(name), F.col("_n").alias("n")), F.struct("_n", -F.col("_first"))).alias("_best")
    return n.groupBy(*keys).agg(best).select(*keys, "_best.*")


def share_of_large_groups(df: DataFrame, key: str, least: int, name: str) -> DataFrame:
    """Share of rows in groups of ``least`` rows or more; 0 for an empty table."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum(F.when(F.col("n") >= least, F.col("n")).otherwise(0)) / F.sum("n"), F.lit(0.0)).alias(name))


#: Keys with more values than this are narrowed before their values are ranked.
FEW_VALUES = 5000
#: Half the width of the stretch of ranks that is left of such a key, and the accuracy of the sketch that finds it.
STRETCH, ACCURACY = 0.001, 20_000


def order_statistics(df: DataFrame, keys: list[str], value: str, places: dict[str, tuple[float, Column]]) -> DataFrame:
    """Exact values at places of each key's sorted values (A10, A13): a column for each item of ``places``.

    A place is its share of the key's values (0 to 1) and its number from 0 as an expression of
    ``_total``, their count; the number must lie within one of ``share * _total``. Null values don't count; a key without others has no row.

    No key's values meet in one task: a sketch (map-side combined) gives two values around
    each place, at 1/1000 of the ranks to either side, well beyond its error of 1/20000; values below are only
    counted, and a window ranks the distinct values between, a 500th of the key's at most
    unless the key has few.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    shares = sorted({max(0.0, min(1.0, s + d)) for s, _ in places.values() for d in (-STRETCH, STRETCH)})
    sketch = F.percentile_approx("_v", F.array(*[F.lit(s) for s in shares]), ACCURACY)
    ends = rows.groupBy(*keys).agg(F.count("*").alias("_total"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), sketch.alias("_at"))

    def stretch(name: str) -> Column:
        share, number = places[name]
        low, high = (shares.index(max(0.0, min(1.0, share + d))) for d in (-STRETCH, STRETCH))
        few = F.col("_total") <= FEW_VALUES
        return F.struct(F.lit(name).alias("name"), number.cast("long").alias("number"), F.when(few, F.col("_least")).otherwise(F.col("_at")[low]).alias("low"), F.when(few, F.col("_most")).otherwise(F.col("_at")[high]).alias("high"))

    ends = ends.select(*keys, F.array(*[stretch(n) for n in places]).alias("_places"))
    met = join_by_keys(rows, ends, keys, "inner") if keys else rows.crossJoin(F.broadcast(ends))  # without keys, one row
    # The values of a stretch by value; those below it as one null.
    met = met.select(*keys, "_v", F.explode("_places").alias("_p")).where(F.col("_v") <= F.col("_p.high"))
    inside = F.when(F.col("_v") >= F.col("_p.low"), F.col("_v"))
    n = met.groupBy(*keys, F.col("_p.name").alias("_name"), F.col("_p.number").alias("_number"), inside.alias("_v")).agg(F.count("*").alias("_n"))
    so_far = F.sum("_n").over(Window.partitionBy(*keys, "_name").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    here = n.withColumn("_to", so_far).where((F.col("_to") > F.col("_number")) & (F.col("_to") - F.col("_n") <= F.col("_number")))
    return here.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places])


def upper_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The element at place n div 2 of the key's sorted values."""
    return order_statistics(df, keys, value, {name: (0.5, F.floor(F.col("_total") / 2))})


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Exact quantiles of a whole column, interpolated between the two nearest places; empty without values (A10)."""
    places = {}
    for i, s in enumerate(shares):
        exact = (F.col("_total") - 1) * s
        places |= {f"_low{i}": (s, F.floor(exact)), f"_high{i}": (s, F.ceil(exact))}
    found = order_statistics(df, [], value, places).first()
    total = df.where(F.col(value).isNotNull()).count()
    if not total:
        return []
    between = [((total - 1) * s) % 1 for s in shares]
    return [float(found[f"_low{i}"]) + (float(found[f"_high{i}"]) - float(found[f"_low{i}"])) * b for i, b in enumerate(between)]


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``n``, ``mean``, ``median`` (upper) and ``zero_share`` by key (A10)."""
    basic = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) == 0).cast("double")).alias("zero_share"))
    return join_by_keys(basic, upper_median(df, keys, value, "median"), keys, "inner")


#: Picks of a stretch of draws, and numbers that are generated at once.
PICKS, BLOCK = 4_000_000, 1 << 20


def _generator(state: tuple) -> np.random.RandomState:
    out = np.random.RandomState()
    out.set_state(("MT19937", np.asarray(state[:-1], dtype=np.uint32), state[-1]))
    return out


def _raw(generator: np.random.RandomState, n: int) -> np.ndarray:
    """The next n outputs of the generator, 32 bits each."""
    return generator.randint(0, 1 << 32, n, dtype=np.uint32)


def draw_states(seed: int, n: int, draws: int, stretch: int) -> Iterator[tuple[int, int, bytes]]:
    """(first draw, number of draws, state of the generator there) of stretches of draws of n picks each.

    A pick takes outputs until their upper bits are below n, so where a draw begins depends on all before it. Outputs are counted, not used.
    """
    generator, shift = _generator(random.Random(seed).getstate()[1]), 32 - n.bit_length()
    for first in range(0, draws, stretch):
        some = min(stretch, draws - first)
        state = generator.get_state()
        yield first, some, np.append(state[1], np.uint32(state[2])).astype("<u4").tobytes()
        left = some * n
        while left:
            before = generator.get_state()
            good = np.flatnonzero(_raw(generator, min(BLOCK, 2 * left + 64)) >> shift < n)
            if len(good) >= left:  # go back to the output after the last pick
                generator.set_state(before)
                _raw(generator, int(good[left - 1]) + 1)
                left = 0
            else:
                left -= len(good)


def picks(state: bytes, n: int) -> Iterator[np.ndarray]:
    """Draws of n picks below n, from a state on."""
    held = np.frombuffer(state, dtype="<u4")
    generator, shift, rest = _generator((*held[:-1].tolist(), int(held[-1]))), 32 - n.bit_length(), np.zeros(0, np.uint32)
    while True:
        while len(rest) < n:
            found = _raw(generator, max(1024, min(BLOCK, 2 * n))) >> shift
            rest = np.concatenate([rest, found[found < n]])
        yield rest[:n]
        rest = rest[n:]


def bootstrap_ci(df: DataFrame, keys: list[str], value: str, order: str, seed: int = 7, draws: int = 2000, low: int = 50, high: int = 1949, tasks: int = 8) -> DataFrame:
    """Percentile interval of the mean by a seeded bootstrap (A11): ``n``, ``lo``, ``hi``.

    Values are taken in ``order`` (unique in a key) and drawn with one generator reseeded for each key, ``random.Random(seed)`` picking ``randrange(n)``, so
    results are to the bit those of one loop. The draws of a key run in up to ``tasks`` tasks: one pass over the generator's outputs, which needs
    only the key's count, notes its state where each stretch of draws begins, and a task goes on from there. Each of these tasks holds the key's values, 8 bytes each.
    Null values don't count; a key without others has no row.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(order).alias("_order"), F.col(value).cast("double").alias("_value"))

    def scout(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                n = int(row[-1])
                stretch = max(1, min(-(-draws // tasks), PICKS // n))
                found = [(*row[:-1], n, some, i % tasks, state) for i, (_, some, state) in enumerate(draw_states(seed, n, draws, stretch))]
                yield pd.DataFrame(found, columns=[*keys, "_n", "_some", "_task", "_state"])

    def means(key, values: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        held = values.sort_values("_order")["_value"].to_numpy()
        out = []
        for some, state in zip(states["_some"], states["_state"], strict=True):
            out += [sum(held[p].tolist()) / len(held) for p, _ in zip(picks(state, len(held)), range(some))]
        return pd.DataFrame([[*key[: len(keys)], len(held), m] for m in out], columns=[*keys, "n", "mean"])

    states = rows.groupBy(*keys).agg(F.count("*").alias("_n")).mapInPandas(scout, f"{fields}, _n long, _some long, _task int, _state binary")
    copies = rows.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    found = copies.groupBy(*keys, "_task").cogroup(states.groupBy(*keys, "_task")).applyInPandas(means, f"{fields}, n long, mean double")
    ranked = found.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list("mean")).alias("_m"))
    return ranked.select(*keys, "n", F.col("_m")[low].alias("lo"), F.col("_m")[high].alias("hi"))


def clipped_histogram(df: DataFrame, value: str, most: int) -> DataFrame:
    """Counts of ``least(value, most)``."""
    return df.groupBy(F.least(F.col(value), F.lit(most)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def sum_columns(df: DataFrame, columns: Iterable[str], name: str, value: str) -> DataFrame:
    """One row a column with the sum of its values (A20, P9), by a single aggregate and an unpivot."""
    columns = list(columns)
    one = df.agg(*[F.sum(F.expr(f"try_cast(`{c}` as double)")).alias(c) for c in columns])
    return one.unpivot([], columns, name, value)


def row_totals(df: DataFrame, pattern: str, name: str) -> DataFrame:
    """``name``: the sum of a row's columns whose names match ``pattern``, each cut to a whole number; blanks and what isn't a number count nothing.

    Columns are chosen by their names when the plan is built, so tables with other columns of the kind need no change.
    """
    found = [c for c in df.columns if re.search(pattern, c)]
    return df.withColumn(name, reduce(add, [F.expr(f"coalesce(try_cast(try_cast(`{c}` as double) as bigint), 0)") for c in found], F.lit(0).cast("long")))


def rate(n: Column, population: Column, scale: int = 100_000) -> Column:
    """n for each ``scale`` of population; null without population."""
    return F.when(population > 0, n / population * scale)


def top_tied(df: DataFrame, value: str) -> DataFrame:
    """All rows that tie for the largest value (A31), without a global sort."""
    best = df.agg(F.max(value).alias("_best"))
    return df.join(F.broadcast(best), F.col(value) == F.col("_best"), "left_semi")


def half_even(c: Column, digits: int) -> Column:
    """Banker's rounding."""
    return F.bround(c, digits)
