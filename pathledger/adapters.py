"""Snapshot cubes out of the star-schema tables, in DataFrames and as SQL for oracles.

Orders give quarterly snapshots of /region/nation/segment with exact sums of cents; events
give daily ones of /event type/user group. Folding, statuses, mounts and capacity follow rules on ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathledger.functions import paths
from pathledger.model import MOUNTS

# Fixed values: (seq, mount id, major:minor, mount point, kind, source); the last repeats a point and must not win.
MOUNT_ROWS = [
    (1, 21, "8:1", "/", "ext4", "/dev/root"), (2, 22, "8:16", "/ASIA", "xfs", "/dev/asia"),
    (3, 23, "8:32", "/EUROPE/FRANCE", "xfs", "/dev/france"), (4, 24, "8:99", "/ASIA", "tmpfs", "late"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(price: str):  # noqa: ANN201
    return F.round(F.col(price) * 100).cast("bigint")


def order_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State rows of the quarterly cube; nations of some names fold in even quarters."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    id_ = ((F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate")).cast("long")
    leaves = rows.groupBy(id_.alias("snapshot_id"), F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/"), "c_mktsegment").alias("leaf")).agg(F.sum(cents("o_totalprice")).alias("disk"), F.count(F.lit(1)).alias("n"))
    return _summed(leaves, lambda t, d: (d == 2) & (F.length(t) % 5 == 0) & (F.col("snapshot_id") % 2 == 0))


def _summed(leaves: DataFrame, folds) -> DataFrame:  # noqa: ANN001
    up = leaves.withColumn("t", F.explode(paths.ancestors_t(F.col("leaf"), proper=False)))
    s = up.groupBy("snapshot_id", "t").agg(F.sum("disk").alias("disk_bytes"), F.sum("n").alias("file_count"), F.sum((F.col("leaf") != F.col("t")).cast("long")).alias("dir_count"))
    depth, up_t = paths.depth_t(F.col("t")), paths.parent_t(F.col("t"))
    s = s.withColumns({"depth": depth, "up": up_t}).withColumn("folded", folds(F.col("t"), F.col("depth")))
    s = s.filter(~F.coalesce(folds(F.col("up"), F.col("depth") - 1), F.lit(False)))
    null = lambda kind: F.lit(None).cast(kind)
    return s.select(
        "snapshot_id", F.lit("/").alias("root_path"), paths.to_bytes(F.col("t")).alias("path"), paths.to_bytes(F.col("up")).alias("parent_path"), F.col("depth").cast("int").alias("depth"), (F.col("file_count") * 4096).alias("apparent_bytes"),
        "disk_bytes", "file_count", "dir_count", null("string").alias("error"), F.col("folded").alias("collapsed"), F.when(F.col("folded"), "known_noise").alias("collapse_reason"), F.when(F.col("folded"), F.col("dir_count")).alias("collapsed_dirs"), null("binary").alias("top_child_path"), null("bigint").alias("top_child_disk_bytes"),
    )


def event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State rows of the daily cube."""
    e = table(spark, sf_dir, "events")
    leaf = F.concat(F.lit("/"), "event_type", F.lit("/u"), (F.col("user_id") % 10).cast("string"))
    leaves = e.groupBy(F.dayofmonth("ts").cast("long").alias("snapshot_id"), leaf.alias("leaf")).agg(F.sum(cents("value")).alias("disk"), F.count(F.lit(1)).alias("n"))
    return _summed(leaves, lambda t, d: F.lit(False))


def snapshots_of(state: DataFrame, daily: bool = False) -> DataFrame:
    """A snapshot for each id in a state: every 9th partial, every 13th failed."""
    ids = state.select(F.col("snapshot_id").alias("id")).distinct()
    if daily:
        day = F.concat(F.lit("2024-01-"), F.lpad(F.col("id").cast("string"), 2, "0"))
    else:
        day = F.concat((F.floor((F.col("id") - 1) / 4) + 1995).cast("string"), F.lit("-"), F.lpad((((F.col("id") - 1) % 4 + 1) * 3).cast("string"), 2, "0"), F.lit("-28"))
    at = lambda time: F.concat(day, F.lit(time))
    status = F.when(F.col("id") % 13 == 0, "failed").when(F.col("id") % 9 == 0, "partial").otherwise("complete")
    null = F.lit(None).cast("string")
    return ids.select("id", at("T11:00:00Z").alias("started_at"), at("T12:00:00Z").alias("finished_at"), F.lit("/").alias("root_path"), status.alias("status"), null.alias("notes"), null.alias("error"))


def mounts_of(snapshots: DataFrame) -> DataFrame:
    spark = snapshots.sparkSession
    rows = [(seq, id_, 1, mm, bytearray(b"/"), bytearray(p.encode()), kind, source) for seq, id_, mm, p, kind, source in MOUNT_ROWS]
    m = spark.createDataFrame(rows, MOUNTS.replace("snapshot_id long, ", ""))
    return snapshots.select(F.col("id").alias("snapshot_id")).join(F.broadcast(m), F.lit(True))


def filesystems_of(state: DataFrame, mounts: DataFrame) -> DataFrame:
    """Capacity samples of the first three mounts: what their path holds and some; every 10th fails on one."""
    m = mounts.filter("seq <= 3")
    rows = m.join(state.select("snapshot_id", F.col("path").alias("mount_point"), "disk_bytes"), ["snapshot_id", "mount_point"])
    bad = (F.col("snapshot_id") % 10 == 0) & (F.col("seq") == 2)
    ok = lambda c: F.when(~bad, c)
    used = F.col("disk_bytes") + F.col("snapshot_id") * 1000
    return rows.select(
        "seq", "snapshot_id", "mount_id", "major_minor", "root", "mount_point", "filesystem_type", "mount_source", ok(used * 2).alias("total_bytes"), ok(used).alias("used_bytes"), ok(used).alias("free_bytes"), ok(used - 100).alias("available_bytes"),
        F.when(bad, "statvfs failed").alias("capture_error"), F.lit(None).cast("string").alias("created_at"),
    )


_TREE = """
tree AS (
  SELECT snapshot_id, '/' AS path, NULL AS parent_path, 0 AS depth, disk, n, 1 AS below FROM leaf
  UNION ALL SELECT snapshot_id, '/' || a, '/', 1, disk, n, 1 FROM leaf
  {two}
  UNION ALL SELECT snapshot_id, {leaf}, {leaf_up}, {leaf_depth}, disk, n, 0 FROM leaf
), summed AS (
  SELECT snapshot_id, path, parent_path, depth, CAST(sum(disk) AS BIGINT) AS disk_bytes, CAST(sum(n) AS BIGINT) AS file_count, CAST(sum(n) * 4096 AS BIGINT) AS apparent_bytes, CAST(sum(below) AS BIGINT) AS dir_count FROM tree GROUP BY ALL
)"""
_SNAPSHOTS = """
snaps AS (
  SELECT id, {day} || 'T11:00:00Z' AS started_at, {day} || 'T12:00:00Z' AS finished_at, '/' AS root_path, CASE WHEN id % 13 = 0 THEN 'failed' WHEN id % 9 = 0 THEN 'partial' ELSE 'complete' END AS status
  FROM (SELECT DISTINCT snapshot_id AS id FROM state)
)"""
#: CTEs state and snaps of the quarterly cube.
ORDERS_SQL = (
    """leaf AS (
  SELECT CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) AS BIGINT) AS snapshot_id, r_name AS a, n_name AS b, c_mktsegment AS c, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS disk, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
),"""
    + _TREE.format(two="UNION ALL SELECT snapshot_id, '/' || a || '/' || b, '/' || a, 2, disk, n, 1 FROM leaf", leaf="'/' || a || '/' || b || '/' || c", leaf_up="'/' || a || '/' || b", leaf_depth=3)
    + """, state AS (
  SELECT *, depth = 2 AND length(path) % 5 = 0 AND snapshot_id % 2 = 0 AS collapsed FROM summed WHERE NOT coalesce(depth = 3 AND length(parent_path) % 5 = 0 AND snapshot_id % 2 = 0, false)
),"""
    + _SNAPSHOTS.format(day="CAST((id - 1) // 4 + 1995 AS VARCHAR) || '-' || lpad(CAST(((id - 1) % 4 + 1) * 3 AS VARCHAR), 2, '0') || '-28'")
)
#: The same of the daily cube.
EVENTS_SQL = (
    """leaf AS (
  SELECT CAST(day(ts) AS BIGINT) AS snapshot_id, event_type AS a, 'u' || CAST(user_id % 10 AS VARCHAR) AS b, sum(CAST(round(value * 100) AS BIGINT)) AS disk, count(*) AS n FROM events GROUP BY ALL
),"""
    + _TREE.format(two="", leaf="'/' || a || '/' || b", leaf_up="'/' || a", leaf_depth=2)
    + ", state AS (SELECT *, false AS collapsed FROM summed),"
    + _SNAPSHOTS.format(day="'2024-01-' || lpad(CAST(id AS VARCHAR), 2, '0')")
)
MOUNTS_SQL = "mounts(seq, mm, point, kind, source) AS (VALUES " + ", ".join(f"({s}, '{mm}', '{p}', '{k}', '{src}')" for s, _, mm, p, k, src in MOUNT_ROWS) + ")"
