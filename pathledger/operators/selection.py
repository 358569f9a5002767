"""Which snapshots a question is about."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathledger.functions.values import status, utc
from pathledger.model import USABLE, ReportError


def decoded(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("status", status(F.col("status"), F.col("finished_at")))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The last usable snapshot of each root, by the text of its time, then id."""
    w = Window.partitionBy("root_path").orderBy(F.coalesce("finished_at", "started_at").desc(), F.desc("id"))
    return decoded(snapshots).filter(F.col("status").isin(USABLE)).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").orderBy("root_path")


def select_snapshots(snapshots: DataFrame, selector: str = "latest") -> DataFrame:
    """latest, or a snapshot's id whatever its status."""
    if selector == "latest":
        got = latest_snapshots(snapshots)
        if not got.limit(1).count():
            raise ReportError("no_usable_snapshots", "no complete or partial snapshots")
        return got
    if not selector.isdigit():
        raise ReportError("invalid_snapshot_id", f"not a snapshot id: {selector!r}")
    got = decoded(snapshots).filter(F.col("id") == int(selector))
    if not got.limit(1).count():
        raise ReportError("snapshot_not_found", f"no snapshot {selector}")
    return got


def resolve_pairs(snapshots: DataFrame, since_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, warnings). A root's current snapshot is its last usable one; its baseline the last of the
    others at or before that time less since, or else the oldest. Both by UTC time, then id."""
    rows = decoded(snapshots).withColumn("t", utc(F.col("finished_at")))
    good = rows.filter(F.col("status").isin(USABLE) & F.col("t").isNotNull())
    key = F.struct("t", "id", "status")
    per = good.groupBy("root_path").agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("current"))
    others = good.join(per.filter("n >= 2").select("root_path", "current"), "root_path").filter(F.col("id") != F.col("current.id"))
    cutoff = F.timestamp_micros(F.unix_micros("current.t") - since_seconds * 1_000_000)
    pairs = others.groupBy("root_path", "current").agg(F.max(F.when(F.col("t") <= cutoff, key)).alias("before"), F.min(key).alias("oldest"))
    base = F.coalesce("before", "oldest")
    pairs = pairs.select(
        "root_path", base["id"].alias("baseline_snapshot_id"), F.col("current.id").alias("current_snapshot_id"), base["t"].alias("baseline_at"), F.col("current.t").alias("current_at"),
        F.col("before").isNull().alias("short"), ((base["status"] == "partial") | (F.col("current.status") == "partial")).alias("partial"),
    )
    w = lambda df, code, id_: df.select(F.lit(code).alias("code"), "root_path", id_.cast("long").alias("snapshot_id"))
    none = F.lit(None)
    warnings = (
        w(rows.filter("status = 'running'"), "running_snapshot_excluded", F.col("id"))
        .unionByName(w(rows.filter("status = 'failed'"), "failed_snapshot_excluded", F.col("id")))
        .unionByName(w(rows.filter(F.col("status").isin(USABLE) & F.col("t").isNull()), "invalid_snapshot_timestamp", F.col("id")))
        .unionByName(w(rows.select("root_path").distinct().join(per.filter("n >= 2"), "root_path", "left_anti"), "insufficient_same_root_snapshots", none))
        .unionByName(w(pairs.filter("short"), "baseline_before_since_unavailable", F.col("baseline_snapshot_id")))
        .unionByName(w(pairs.filter("partial"), "partial_snapshot", F.col("current_snapshot_id")))
        .distinct()
    )
    return pairs.drop("short", "partial"), warnings


def trend_snapshots(snapshots: DataFrame, since_seconds: int) -> DataFrame:
    """Usable snapshots of each root in the window before its last, and the last one before the window."""
    good = decoded(snapshots).filter(F.col("status").isin(USABLE)).withColumn("t", utc(F.col("finished_at"))).filter(F.col("t").isNotNull())
    w = Window.partitionBy("root_path")
    good = good.withColumn("cutoff", F.timestamp_micros(F.unix_micros(F.max("t").over(w)) - since_seconds * 1_000_000))
    old = F.max(F.when(F.col("t") <= F.col("cutoff"), F.struct("finished_at", "id"))).over(w)
    return good.withColumn("edge", old).filter((F.col("t") >= F.col("cutoff")) | (F.col("id") == F.col("edge.id"))).drop("cutoff", "edge")
