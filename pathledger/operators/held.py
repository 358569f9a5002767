"""Rows that several steps read, computed once into the folder that all machines share; and their places in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a side that is broadcast without a look at its bytes; for rows of a few numbers and a path.
FEW = 10_000
#: Rows of a range of an order, on average, at most.
RANGE = 500_000


def held(df: DataFrame) -> DataFrame:
    """df as a checkpoint in spark.checkpoint.dir; where that is unset (tests), beside the warehouse."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        conf = df.sparkSession.conf
        sc.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_held")
    return df.checkpoint(eager=True)


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, marked for a broadcast if it has, counted, at most ``most`` rows. Rows that are read again should be held."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ranges(df: DataFrame) -> int:
    """How many ranges df is sorted in: more rows, more ranges, so that a task's rows don't grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE))


def numbered(df: DataFrame, name: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """df with the place of each row (from 1) in an order, for each value of the columns ``within``.

    Rows are sorted in ranges of the order, spread over the tasks. A row's place is its place in its range after the
    counts of the ranges before; only a count for each range and group is ordered in one place.
    """
    within = within or []
    parts = ranges(df)
    at = F.monotonically_increasing_id()
    rows = held(df.repartitionByRange(parts, *within, *order).sortWithinPartitions(*within, *order).withColumn("_at", at))
    rows = rows.withColumn("_range", F.shiftright("_at", 33)).withColumn("_own", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")
    counts = rows.groupBy("_range", *within).agg(F.count(F.lit(1)).alias("_n"), F.min("_own").alias("_low"))
    run = F.sum("_n").over(Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    starts = counts.select("_range", *within, (run - F.col("_n") - F.col("_low")).alias("_start"))
    on = F.lit(True)
    named = starts.withColumnsRenamed({c: f"_{c}" for c in ["_range", *within]})
    for c in ["_range", *within]:
        on = on & rows[c].eqNullSafe(named[f"_{c}"])
    return rows.join(named, on).select(*df.columns, (F.col("_start") + F.col("_own") + 1).cast("long").alias(name))


def carried(df: DataFrame, marks: dict[str, Column], order: str, within: list[str]) -> DataFrame:
    """df with the last value that is not null of each mark, in an order, at or before each row, for each value of the columns ``within``.

    Rows lie in ranges of the order over the tasks, so one value of ``within`` can be of any size. Each range carries its own values
    forward; what the ranges before hand on comes from one row for each range and group.
    """
    parts = ranges(df)
    keys = ["_range", *within]
    rows = held(df.withColumns(marks).repartitionByRange(parts, *within, order).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys).agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), F.col(order))).alias(m) for m in marks])
    ends = ends.select(*[F.col(k).alias(f"_k{k}") for k in keys], *[F.last(m, True).over(before).alias(f"_before_{m}") for m in marks])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k{k}"))
    got = rows.select(*df.columns, "_range", *[F.last(m, True).over(own).alias(m) for m in marks]).join(ends, on)
    return got.select(*df.columns, *[F.coalesce(m, f"_before_{m}").alias(m) for m in marks])
