"""Tiers of retention, new bounds of intervals, and removal of what nothing refers to."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathledger.functions.values import utc
from pathledger.model import RetentionPolicy
from pathledger.operators.intervals import bound_places
from pathledger.operators.selection import decoded


def retained(snapshots: DataFrame, now: datetime, policy: RetentionPolicy | None = None) -> DataFrame:
    """The snapshots to keep: all complete ones of some days, the last of each UTC day of some more, the last of
    each month always; others for some hours after their end, or else their start."""
    policy = policy or RetentionPolicy()
    at = utc(F.col("finished_at"))
    moment = F.timestamp_micros(F.lit(int(now.timestamp() * 1_000_000)))
    within = lambda t, seconds: F.unix_micros(t) >= F.unix_micros(moment) - seconds * 1_000_000
    rows = decoded(snapshots).withColumn("t", at)
    done = rows.filter((F.col("status") == "complete") & F.col("t").isNotNull())
    last = lambda *by: F.row_number().over(Window.partitionBy("root_path", *by).orderBy(F.desc("t"), F.desc("id"))) == 1
    day, month = F.to_date("t"), F.trunc("t", "month")
    keep = within(F.col("t"), policy.all_days * 86_400) | (F.col("of_day") & within(F.col("t"), policy.daily_days * 86_400)) | F.col("of_month")
    complete = done.withColumn("of_day", last(day)).withColumn("of_month", last(month)).filter(keep).select("id")
    open_ = rows.filter(F.col("status") != "complete").filter(within(F.coalesce("t", utc(F.col("started_at"))), policy.incomplete_hours * 3600)).select("id")
    return complete.unionByName(open_)


def rebound(intervals: DataFrame, kept: DataFrame) -> DataFrame:
    """Intervals over the retained complete snapshots (root_path, id) alone: those that cover none go, the others
    begin with the first they cover and end at the first retained one at or after their end.

    The distinct bounds of a root and its retained ids are sorted together once; intervals get their new bounds by joins on (root, bound)."""
    bounds = intervals.select("root_path", F.explode(F.array("valid_from_snapshot_id", "valid_to_snapshot_id")).alias("bound"))
    places = bound_places(bounds, kept).select("root_path", "bound", "next")
    low = places.toDF("root_path", "valid_from_snapshot_id", "_low")
    high = places.toDF("root_path", "valid_to_snapshot_id", "_high")
    rows = intervals.join(low, ["root_path", "valid_from_snapshot_id"]).join(high, ["root_path", "valid_to_snapshot_id"], "left")
    covers = F.col("_low").isNotNull() & (F.col("valid_to_snapshot_id").isNull() | (F.col("_low") < F.col("valid_to_snapshot_id")))
    rows = rows.filter(covers).drop("valid_from_snapshot_id", "valid_to_snapshot_id")
    return rows.withColumnsRenamed({"_low": "valid_from_snapshot_id", "_high": "valid_to_snapshot_id"}).select(intervals.columns)


def orphan_paths(known: DataFrame, *references: tuple[DataFrame, str]) -> DataFrame:
    """Paths (column path) that no column of the references holds."""
    used = None
    for df, column in references:
        one = df.select(F.col(column).alias("path")).filter("path is not null")
        used = one if used is None else used.unionByName(one)
    return known.join(used, "path", "left_anti") if used is not None else known


def without(df: DataFrame, kept: DataFrame, id_column: str) -> DataFrame:
    """Rows whose snapshot is kept."""
    return df.join(kept.select(F.col("id").alias(id_column)), id_column, "left_semi")


def storage_report(files: DataFrame, size: Column | None = None) -> DataFrame:
    """Files and bytes of a table (the result of spark.read.format('binaryFile') without its content)."""
    return files.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum(F.col("length") if size is None else size), F.lit(0)).alias("byte_count"))
