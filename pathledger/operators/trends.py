"""Trends of paths and of filesystems over the retained snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathledger.functions.paths import domain_key
from pathledger.functions.values import utc

JUMP_SHARE, CLEAN_SHARE, STEADY_SHARE, STEADY_LOSS, MATERIAL_SHARE = 0.75, 0.5, 0.6, 0.2, 0.01


def trend_metrics(samples: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """samples: root_path, path, snapshot_id, finished_at (timestamp), disk_bytes, apparent_bytes.
    expected: root_path, expected (how many samples a root has). Absent samples are missing, not zero.

    One shuffle on (root, path) feeds all windows and the aggregation.
    """
    keys = ["root_path", "path"]
    w = Window.partitionBy(*keys)
    o = w.orderBy("finished_at", "snapshot_id")
    rows = samples.withColumn("delta", F.col("disk_bytes") - F.lag("disk_bytes").over(o)).withColumn("peak", F.max("disk_bytes").over(w))
    material = F.greatest(F.lit(1).cast("long"), (F.col("peak") * F.lit(MATERIAL_SHARE)).cast("long"))
    rows = rows.withColumn("material", material)
    at = F.struct("finished_at", "snapshot_id")
    up = F.when(F.col("delta") > 0, F.col("delta")).otherwise(0)
    down = F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0)
    grew = F.col("delta") >= F.col("material")
    got = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), F.min_by("disk_bytes", at).alias("start_bytes"), F.max_by("disk_bytes", at).alias("end_bytes"), F.sum(up).alias("gross_growth"), F.sum(down).alias("gross_loss"),
        F.max("peak").alias("peak_bytes"), F.max("material").alias("material"), F.min("finished_at").alias("first_observed_at"), F.min(F.when(F.col("disk_bytes") > 0, F.col("finished_at"))).alias("first_nonzero_at"),
        F.max(F.when(grew, F.col("finished_at"))).alias("last_growth_at"), F.max("finished_at").alias("last_observed_at"), F.coalesce(F.stddev_pop("delta"), F.lit(0.0)).alias("volatility"),
        F.coalesce(F.max("delta"), F.lit(0)).alias("most"), F.count("delta").alias("steps"), F.sum(F.when(grew, 1).otherwise(0)).alias("grown"), F.sort_array(F.collect_list(F.struct("finished_at", "snapshot_id", "disk_bytes", "apparent_bytes"))).alias("samples"),
    )
    got = got.withColumn("net", F.col("end_bytes") - F.col("start_bytes"))
    days = (F.unix_micros("last_observed_at") - F.unix_micros("first_observed_at")) / 86_400e6
    got = got.withColumn("daily_slope", F.when((F.col("sample_count") >= 3) & (days > 0), F.col("net") / days))
    if expected is None:
        got = got.withColumn("missing_count", F.lit(0).cast("long"))
    else:
        got = got.join(expected, "root_path", "left").withColumn("missing_count", F.greatest(F.lit(0).cast("long"), F.coalesce("expected", "sample_count") - F.col("sample_count"))).drop("expected")
    plus, minus, least, net = F.col("gross_growth"), F.col("gross_loss"), F.col("material"), F.col("net")
    shape = (
        F.when(F.col("sample_count") < 3, "unknown_insufficient_samples")
        .when((plus < least) & (minus < least), "stable_large")
        .when((plus > 0) & (minus >= F.lit(CLEAN_SHARE) * plus) & (F.col("peak_bytes") > F.col("end_bytes")) & (net <= plus - minus), "grow_then_clean")
        .when(F.col("most") >= F.lit(JUMP_SHARE) * plus, "one_time_jump")
        .when((net >= least) & (plus >= least) & (F.col("grown") / F.col("steps") >= F.lit(STEADY_SHARE)) & (minus <= F.lit(STEADY_LOSS) * plus), "steady_growth")
        .when(plus >= least, "bursty_growth")
        .otherwise("stable_large")
    )
    return got.withColumn("shape", shape).drop("most", "steps", "grown", "material")


def candidates(state: DataFrame, last: DataFrame, limit: int) -> DataFrame:
    """The largest paths of each root in its last snapshot (snapshot_id in last), roots themselves left out."""
    w = Window.partitionBy("root_path").orderBy(F.desc("disk_bytes"), F.desc("apparent_bytes"), F.desc("depth"), "path")
    rows = state.join(last.select("snapshot_id"), "snapshot_id", "left_semi").filter((F.col("depth") > 0) & ((F.col("disk_bytes") > 0) | (F.col("apparent_bytes") > 0)))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).select("root_path", "path")


def path_trends(state: DataFrame, snapshots: DataFrame, limit: int, candidate_limit: int | None = None) -> DataFrame:
    """Trends of paths over the given snapshots (of trend_snapshots), most gross growth first."""
    s = snapshots.select(F.col("id").alias("snapshot_id"), utc(F.col("finished_at")).alias("finished_at"), "root_path", F.col("finished_at").alias("text"))
    expected = s.groupBy("root_path").agg(F.count(F.lit(1)).alias("expected"))
    rows = state
    if candidate_limit is not None:
        last = s.groupBy("root_path").agg(F.max_by("snapshot_id", F.struct("text", "snapshot_id")).alias("snapshot_id"))
        rows = rows.join(candidates(state, last, candidate_limit), ["root_path", "path"], "left_semi")
    samples = rows.select("snapshot_id", "path", "disk_bytes", "apparent_bytes").join(s.drop("text"), "snapshot_id")
    return trend_metrics(samples, expected).orderBy(F.desc("gross_growth"), F.desc("net"), "root_path", "path").limit(limit)


def pressure_trends(filesystems: DataFrame, snapshots: DataFrame, limit: int) -> DataFrame:
    """First and last known usage of each storage domain, in the order of roots, then times."""
    s = snapshots.select(F.col("id").alias("snapshot_id"), "root_path", F.col("finished_at").alias("at"))
    expected = s.groupBy("root_path").agg(F.count(F.lit(1)).alias("expected"))
    rows = filesystems.join(s, "snapshot_id").withColumn("key", domain_key(F.col("major_minor"), F.col("root"), F.col("filesystem_type"), F.col("mount_source")))
    order = F.struct("root_path", "at", "snapshot_id", "seq")
    known = lambda c, f: f(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v"))))["v"]
    got = rows.groupBy("key").agg(
        F.min_by("mount_point", order).alias("mount_point"), F.min_by("root_path", order).alias("root_path"), F.count(F.lit(1)).alias("sample_count"),
        known("used_bytes", F.min).alias("first_used"), known("used_bytes", F.max).alias("last_used"), known("available_bytes", F.min).alias("first_available"), known("available_bytes", F.max).alias("last_available"),
        F.count("capture_error").alias("error_count"), known("capture_error", F.max).alias("latest_error"),
    )
    got = got.withColumn("used_delta", F.col("last_used") - F.col("first_used")).withColumn("available_delta", F.col("last_available") - F.col("first_available"))
    got = got.join(expected, "root_path", "left").withColumn("missing_count", F.greatest(F.lit(0).cast("long"), F.col("expected") - F.col("sample_count")))
    return got.orderBy(F.coalesce("used_delta", F.lit(0).cast("long")).desc(), "key", "mount_point").limit(limit)
