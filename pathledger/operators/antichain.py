"""Paths of which none lies inside another, taken in the order of their ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathledger.functions import paths
from pathledger.operators.held import held

#: How many paths a report proposes to look at next.
NEXT_PATHS = 3


def _chained(a: Column, b: Column) -> Column:
    """Whether one of two different paths lies inside the other."""
    return paths.strictly_under_t(a, b) | paths.strictly_under_t(b, a)


def next_paths(ranked: DataFrame, scope: list[str] | None = None, limit: int = NEXT_PATHS) -> DataFrame:
    """The paths to look at next, for each value of the columns ``scope``: ranked's rows with ``position`` from 1.

    ranked: path (bytes), depth, rank (unique within its scope). The first is the deepest path inside the one ranked first (ties: the longest, then the
    last in byte order), or that itself; then each next by rank that lies in no chain with one taken before.

    A round takes one row of each scope by an aggregation with partial sums and drops that row's chain by a join on the scope, so no
    step compares paths pairwise; there are ``limit`` rounds, whatever the number of rows.
    """
    scope = scope or []
    t = paths.to_text(F.col("path"))
    rows = held(ranked.withColumn("_t", t))

    def joined(left: DataFrame, chosen: DataFrame) -> DataFrame:
        return left.join(chosen, scope) if scope else left.join(F.broadcast(chosen), F.lit(True))  # without a scope: one row

    top = rows.groupBy(*scope).agg(F.min_by(F.struct("_t", "rank"), "rank").alias("_top"))
    inside = paths.strictly_under_t(F.col("_t"), F.col("_top._t"))
    deepest = F.max_by(F.struct("_t", "rank"), F.struct("depth", F.length("path"), "path"))
    pick = joined(rows, top).filter(inside | (F.col("rank") == F.col("_top.rank"))).groupBy(*scope).agg(deepest.alias("_pick"))
    picks = []
    for k in range(1, limit + 1):
        pick = held(pick.filter("_pick is not null"))
        picks.append(pick.withColumn("position", F.lit(k)))
        if k < limit:
            rest = joined(rows, pick).filter((F.col("rank") != F.col("_pick.rank")) & ~_chained(F.col("_t"), F.col("_pick._t"))).drop("_pick")
            rows = rest if k == limit - 1 else held(rest)
            pick = rows.groupBy(*scope).agg(F.min_by(F.struct("_t", "rank"), "rank").alias("_pick"))
    taken = reduce(DataFrame.unionByName, picks).select(*scope, F.col("_pick.rank").alias("rank"), "position")
    return ranked.join(taken, [*scope, "rank"]).select(*ranked.columns, "position")
