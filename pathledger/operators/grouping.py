"""Labels of groups, and the storage that a path lies on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.functions import paths
from pathledger.model import parse_grouping


def first_mounts(mounts: DataFrame) -> DataFrame:
    """One mount for each snapshot and mount point: the first that was recorded."""
    return mounts.groupBy("snapshot_id", "mount_point").agg(F.min_by(F.struct("seq", "major_minor", "root", "mount_point", "filesystem_type", "mount_source"), "seq").alias("m"))


def longest_prefix(rows: DataFrame, mounts: DataFrame) -> DataFrame:
    """rows (snapshot_id, path, ...) with ``mount``: the mount whose point is the longest path at or above theirs; null if none.

    Ancestors are exploded and joined by equality; one row for each distinct (snapshot, path) is looked up.
    """
    keys = ["snapshot_id", "path"]
    asked = paths.with_ancestors(rows.select(*keys).distinct(), "path", "_above", proper=False)
    m = first_mounts(mounts).withColumnRenamed("mount_point", "_above")
    found = asked.join(m, ["snapshot_id", "_above"]).groupBy(*keys).agg(F.max_by("m", F.length("_above")).alias("mount"))
    return rows.join(found, keys, "left")


def with_domain(rows: DataFrame, mounts: DataFrame) -> DataFrame:
    m = F.col("mount")
    return longest_prefix(rows, mounts).withColumn("domain", F.when(m.isNotNull(), paths.domain_key(m["major_minor"], m["root"], m["filesystem_type"], m["mount_source"])))


def with_group(rows: DataFrame, group_by: str, mounts: DataFrame | None = None) -> DataFrame:
    """rows (snapshot_id, root_path, path, ...) with group_kind, group_key and group_warning.

    Paths outside their root, or on no known mount, have no group but a warning.
    """
    parse_grouping(group_by)
    t, root = paths.to_text(F.col("path")), F.col("root_path")
    inside = paths.under_t(t, root)
    outside = F.when(~inside, "path_outside_root")
    if group_by == "root":
        key, warning, out = root, outside, rows
    elif group_by == "top-level-subtree":
        key, warning, out = paths.top_segment_t(t, root), outside, rows
    else:
        out = with_domain(rows, mounts)
        key = F.decode(F.col("mount.mount_point"), "UTF-8") if group_by == "mount" else F.col("domain")
        warning = F.coalesce(outside, F.when(F.col("mount").isNull(), "unknown_mount"))
    out = out.withColumn("group_warning", warning)
    out = out.withColumn("group_key", F.when(F.col("group_warning").isNull(), key)).withColumn("group_kind", F.when(F.col("group_warning").isNull(), F.lit(group_by)))
    return out.drop("mount", "domain")


def group_summary(rows: DataFrame) -> DataFrame:
    """Rows and changes of each group, largest first."""
    got = rows.groupBy("group_kind", "group_key").agg(F.count(F.lit(1)).alias("row_count"), F.sum("disk_delta").alias("disk_delta"), F.sum("apparent_delta").alias("apparent_delta"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return got.orderBy(F.desc("disk_delta"), F.desc("apparent_delta"), blank("group_kind"), blank("group_key"))


def classification_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("classification").agg(F.count(F.lit(1)).alias("row_count"))


def frontier_totals(frontier: DataFrame) -> DataFrame:
    """Changes by kind over the rows shown."""
    return frontier.groupBy("classification").agg(F.sum("disk_delta").alias("disk_delta"), F.sum("apparent_delta").alias("apparent_delta"))


def snapshot_summaries(snapshots: DataFrame, state: DataFrame, limit: int) -> DataFrame:
    """Snapshots, newest first, with counts of their rows and the sizes of their root's row."""
    from pathledger.functions.values import seconds_between
    from pathledger.operators.selection import decoded

    root = (F.col("depth") == 0) & F.col("parent_path").isNull()
    per = state.groupBy(F.col("snapshot_id").alias("id")).agg(
        F.count(F.lit(1)).alias("path_count"), F.sum(F.col("collapsed").cast("long")).alias("collapsed_count"), F.sum(F.col("error").isNotNull().cast("long")).alias("error_count"),
        F.max(F.when(root, F.struct("disk_bytes", "apparent_bytes", "file_count", "dir_count"))).alias("r"),
    )
    out = decoded(snapshots).join(per, "id", "left").withColumn("processing_seconds", seconds_between(F.col("started_at"), F.col("finished_at")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = out.orderBy(F.coalesce("finished_at", "started_at").desc(), F.desc("id")).limit(limit)
    return out.select("id", "root_path", "status", "started_at", "finished_at", zero("path_count"), zero("collapsed_count"), zero("error_count"), F.col("r.disk_bytes").alias("disk_bytes"), F.col("r.apparent_bytes").alias("apparent_bytes"), F.col("r.file_count").alias("file_count"), F.col("r.dir_count").alias("dir_count"), "processing_seconds")
