"""Change-only validity intervals: compress, promote and expand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathledger.model import STATE_COLUMNS


def _state(columns: list[str], of: DataFrame | None = None) -> Column:
    return F.struct(*[(of[c] if of is not None else F.col(c)) for c in columns])


def bound_places(bounds: DataFrame, ids: DataFrame) -> DataFrame:
    """root_path, bound, place, next, total for each distinct bound (root_path, bound): how many ids of its root are smaller, the first that isn't, and all.

    ids: root_path and id. Bounds are ids of snapshots, so there are as many at most as a root has had snapshots; these alone are sorted.
    """
    b = bounds.filter("bound is not null").distinct().select("root_path", F.col("bound").alias("at"), F.lit(None).cast("long").alias("id"))
    both = b.unionByName(ids.select("root_path", F.col("id").alias("at"), F.col("id").cast("long").alias("id")).distinct())
    w = Window.partitionBy("root_path").orderBy("at")
    below, above = w.rangeBetween(Window.unboundedPreceding, -1), w.rangeBetween(0, Window.unboundedFollowing)
    got = both.select("root_path", "at", "id", F.count("id").over(below).alias("place"), F.min("id").over(above).alias("next"), F.count("id").over(Window.partitionBy("root_path")).alias("total"))
    return got.filter("id is null").select("root_path", F.col("at").alias("bound"), "place", "next", "total")


def snapshot_state(intervals: DataFrame, diagnostics: DataFrame, snapshots: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """The rows of each snapshot: complete ones out of intervals, others out of diagnostics.

    An interval's bounds become places in the order of its root's asked snapshots, by joins on (root, bound); its places are then
    counted out and joined to snapshots by (root, place). So an interval gives just the rows that it has, and those
    that hold no asked snapshot none. candidates (root_path, path): only these paths, filtered before anything is counted out.
    """
    s = snapshots.select(F.col("id").alias("snapshot_id"), "root_path", "status")
    complete = s.filter("status = 'complete'").select("root_path", F.col("snapshot_id").alias("id"))
    if candidates is not None:
        intervals, diagnostics = (df.join(candidates.select("root_path", "path").distinct(), ["root_path", "path"], "left_semi") for df in (intervals, diagnostics))
    bounds = intervals.select("root_path", F.explode(F.array("valid_from_snapshot_id", "valid_to_snapshot_id")).alias("bound"))
    places = bound_places(bounds, complete)
    low = places.select("root_path", F.col("bound").alias("valid_from_snapshot_id"), F.col("place").alias("_low"), F.col("total").alias("_total"))
    high = places.select("root_path", F.col("bound").alias("valid_to_snapshot_id"), F.col("place").alias("_high"))
    placed = intervals.join(low, ["root_path", "valid_from_snapshot_id"]).join(high, ["root_path", "valid_to_snapshot_id"], "left").withColumn("_high", F.coalesce("_high", "_total"))
    order = complete.select("root_path", F.col("id").alias("snapshot_id"), (F.row_number().over(Window.partitionBy("root_path").orderBy("id")) - 1).cast("long").alias("_place"))
    held = placed.filter("_low < _high").withColumn("_place", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1))).join(order, ["root_path", "_place"])
    other = diagnostics.join(s.filter("status <> 'complete'").select("snapshot_id", F.col("root_path").alias("_root")), "snapshot_id").withColumn("root_path", F.col("_root"))
    columns = ["snapshot_id", "root_path", "path", *[c for c in STATE_COLUMNS if c in intervals.columns]]
    return held.select(columns).unionByName(other.select(columns))


def compress(state: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Intervals of equal state over each root's complete snapshots in the order of their ids.

    An interval ends at the first complete snapshot of its root in which the path is gone or differs.
    """
    columns = [c for c in STATE_COLUMNS if c in state.columns]
    order = snapshots.filter("status = 'complete'").select(F.col("id").alias("snapshot_id"), "root_path")
    by_root = Window.partitionBy("root_path").orderBy("snapshot_id")
    order = order.select("snapshot_id", "root_path", F.row_number().over(by_root).alias("rank"), F.lead("snapshot_id").over(by_root).alias("after"))
    rows = state.drop("root_path").join(order, "snapshot_id") if "root_path" in state.columns else state.join(order, "snapshot_id")
    w = Window.partitionBy("root_path", "path").orderBy("rank")
    now = _state(columns)
    fresh = F.lag("rank").over(w).isNull() | (F.lag("rank").over(w) != F.col("rank") - 1) | ~F.lag(now).over(w).eqNullSafe(now)
    rows = rows.withColumn("island", F.sum(fresh.cast("int")).over(w))
    out = rows.groupBy("root_path", "path", "island").agg(
        F.min("snapshot_id").alias("valid_from_snapshot_id"), F.max_by(F.struct("after"), "rank").alias("end"), F.min_by(now, "rank").alias("s")
    )
    return out.select("root_path", "path", "valid_from_snapshot_id", F.col("end.after").alias("valid_to_snapshot_id"), *[F.col(f"s.{c}").alias(c) for c in columns])


def promote(intervals: DataFrame, rows: DataFrame, root_path: str, snapshot_id: int) -> DataFrame:
    """Intervals after one more complete snapshot of a root: gone paths close, changed ones
    close and open, new ones open, equal ones stay. Promoting a snapshot again changes nothing."""
    columns = [c for c in STATE_COLUMNS if c in intervals.columns]
    mine = (F.col("root_path") == root_path) & F.col("valid_to_snapshot_id").isNull()
    rest, active = intervals.filter(~mine), intervals.filter(mine)
    new = rows.select("path", _state(columns).alias("new"))
    old = active.select("path", "valid_from_snapshot_id", _state(columns).alias("old"))
    both = old.join(new, "path", "full_outer")
    same = F.col("old").eqNullSafe(F.col("new"))
    here = F.lit(snapshot_id).cast("long")
    kept = both.filter(F.col("old").isNotNull()).select(
        F.lit(root_path).alias("root_path"), "path", "valid_from_snapshot_id", F.when(same, F.lit(None).cast("long")).otherwise(here).alias("valid_to_snapshot_id"), *[F.col(f"old.{c}").alias(c) for c in columns]
    )
    opened = both.filter(F.col("new").isNotNull() & ~same).select(
        F.lit(root_path).alias("root_path"), "path", here.alias("valid_from_snapshot_id"), F.lit(None).cast("long").alias("valid_to_snapshot_id"), *[F.col(f"new.{c}").alias(c) for c in columns]
    )
    return rest.select(kept.columns).unionByName(kept).unionByName(opened)
