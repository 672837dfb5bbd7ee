"""Bounded closures of rename graphs and of splits in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def later_names(edges: DataFrame, hops: int = 4) -> DataFrame:
    """(``start``, ``name``, ``hop``): names reachable over at most ``hops`` renames.

    ``edges`` has ``old`` and ``new``; a name comes once, at its least hop, and
    cycles end where they began. Each hop is an equi-join of the names reached by the hop before,
    whose exchange is shared with the union, so no hop is computed twice; the least hop is one aggregate.
    """
    pair = edges.select("old", "new").where("old <> new").distinct()
    front = pair.select(F.col("old").alias("start"), F.col("new").alias("name"))
    every = front.withColumn("hop", F.lit(1))
    for hop in range(2, hops + 1):
        front = front.join(pair, F.col("name") == F.col("old")).select("start", F.col("new").alias("name")).where("start <> name").distinct()
        every = every.unionByName(front.withColumn("hop", F.lit(hop)))
    return every.groupBy("start", "name").agg(F.min("hop").alias("hop"))


Split = tuple[str, str, int]


def successors(splits: list[Split], name: str, year: int | None, defunct: frozenset[str] = frozenset(), always: dict[str, list[str]] | None = None) -> list[str]:
    """What a place named in a year has become, in order of discovery.

    Itself, unless it is ``defunct``, and what was split off after that year, and so on
    from the later of both years; without a year every split applies. ``always`` lists
    parts that belong to a name in any year. A defunct place named after all its splits
    stands for all its parts. ``splits`` is a small dimension in code.
    """
    out, todo, seen = [], [(name, year)], set()
    while todo:
        place, since = todo.pop(0)
        if place in seen:
            continue
        seen.add(place)
        if place not in defunct:
            out.append(place)
        parts = [(child, split) for parent, child, split in splits if parent == place and (since is None or since < split)]
        todo += [(child, None if since is None else max(since, split)) for child, split in parts]
        todo += [(child, since) for child in (always or {}).get(place, [])]
        if place in defunct and not parts and place not in (always or {}):
            todo += [(child, since) for parent, child, _ in splits if parent == place]
    return out


def successor_table(splits: list[Split], names: list[str], years: list[int | None], **options) -> list[tuple[str, int | None, list[str]]]:
    """The closure for every name and year, as rows of a dimension to broadcast."""
    return [(n, y, successors(splits, n, y, **options)) for n in names for y in years]
