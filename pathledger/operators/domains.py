"""Totals of storage domains that don't overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.functions import paths
from pathledger.operators.grouping import with_domain
from pathledger.operators.held import held


def domain_totals(state: DataFrame, snapshots: DataFrame, mounts: DataFrame) -> DataFrame:
    """Indexed bytes of each storage domain over the given snapshots.

    A row whose nearest indexed ancestor lies on another domain (or on none, or that has no such
    ancestor) bounds its domain: it adds there and takes away from the ancestor's. Totals below zero show as
    zero with a flag. Rows on no mount count once for the root's domain, or else the first.
    """
    keys = ["snapshot_id", "path"]
    s = snapshots.select(F.col("id").alias("snapshot_id"), F.col("root_path").alias("snapshot_root"), "status", "finished_at")
    rows = held(with_domain(held(state.join(s, "snapshot_id")), mounts))  # read by each step
    up = paths.with_ancestors(rows.select(*keys), "path", "above")
    near = up.join(rows.select("snapshot_id", F.col("path").alias("above"), F.col("domain").alias("above_domain")), ["snapshot_id", "above"])
    near = near.groupBy(*keys).agg(F.max_by(F.struct("above_domain"), F.length("above")).alias("near"))
    rows = rows.join(near, keys, "left").withColumn("above_domain", F.col("near.above_domain"))
    edges = rows.filter(F.col("domain").isNotNull() & ~F.col("domain").eqNullSafe(F.col("above_domain")))
    plus = edges.select("domain", "disk_bytes", "apparent_bytes", F.struct("snapshot_root", "snapshot_id", "status", "finished_at", F.decode("mount.mount_point", "UTF-8").alias("point")).alias("seen"))
    minus = edges.filter("above_domain is not null").select(F.col("above_domain").alias("domain"), (-F.col("disk_bytes")).alias("disk_bytes"), (-F.col("apparent_bytes")).alias("apparent_bytes"), F.lit(None).cast(plus.schema["seen"].dataType).alias("seen"))
    put = lambda f: F.sort_array(F.collect_set(f"seen.{f}"))
    totals = plus.unionByName(minus).groupBy("domain").agg(
        F.sum("disk_bytes").alias("raw_disk"), F.sum("apparent_bytes").alias("raw_apparent"), put("snapshot_root").alias("roots"), put("point").alias("mount_points"),
        put("snapshot_id").alias("snapshot_ids"), put("status").alias("statuses"), F.min("seen.finished_at").alias("finished_min"), F.max("seen.finished_at").alias("finished_max"),
    )
    visible = rows.filter("domain is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("visible_path_count"))
    lost = rows.filter("domain is null").groupBy("snapshot_id", "snapshot_root").agg(F.count(F.lit(1)).alias("n"))
    own = lost.withColumn("path", paths.to_bytes(F.col("snapshot_root")))
    first = rows.filter("domain is not null").groupBy("snapshot_id").agg(F.min("domain").alias("lowest"))
    unknown = with_domain(own, mounts).join(first, "snapshot_id", "left").groupBy(F.coalesce("domain", "lowest").alias("domain")).agg(F.sum("n").alias("unknown_path_count"))
    zero = F.lit(0).cast("long")
    out = totals.join(visible, "domain", "left").join(unknown, "domain", "left")
    return out.select(
        "domain", F.greatest("raw_disk", zero).alias("disk_bytes"), F.greatest("raw_apparent", zero).alias("apparent_bytes"), ((F.col("raw_disk") < 0) | (F.col("raw_apparent") < 0)).alias("clamped"),
        "raw_disk", "roots", "mount_points", "snapshot_ids", "statuses", "finished_min", "finished_max", F.coalesce("visible_path_count", zero).alias("visible_path_count"), F.coalesce("unknown_path_count", zero).alias("unknown_path_count"),
    ).orderBy(F.desc("raw_disk"), "domain")
