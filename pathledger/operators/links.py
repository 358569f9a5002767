"""A limit on the inodes with several names that one walk may remember."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.functions import paths
from pathledger.operators.held import few, held, numbered


def link_limit(entries: DataFrame, cap: int) -> DataFrame:
    """entries (root_path, path, kind, nlink, device, inode) with over and skipped.

    A walk in depth-first order, siblings in byte order, remembers the first ``cap`` inodes of files with several names in each root. A file
    with another such inode is over the limit: it counts no disk bytes, and its directory is given up there, so what comes after it in that directory, with all below, is
    skipped. No new inode is remembered from then on, so the first cap inodes are those of the whole walk.

    The last inode that fits is found from counts of sorted ranges; directories alone are exploded to those above them. Entries are read twice, and
    held once they are known to be over; where a side of directories is small it's broadcast.
    """
    key = paths.traversal_key(F.col("path"))
    linked = (F.col("kind") == "file") & (F.col("nlink") > 1)
    rows = entries.withColumn("_key", key).withColumn("_up", F.when(F.col("path") != paths.to_bytes(F.col("root_path")), paths.parent(F.col("path"))))
    firsts = held(rows.filter(linked).groupBy("root_path", "device", "inode").agg(F.min("_key").alias("_first")))
    limits = numbered(firsts.select("root_path", "_first"), "_n", ["_first"], ["root_path"]).filter(F.col("_n") == cap).select("root_path", F.col("_first").alias("_last"))
    late = firsts.join(limits, "root_path").filter(F.col("_first") > F.col("_last")) if cap > 0 else firsts
    late = late.select("root_path", "device", "inode", F.lit(True).alias("_late"))
    rows = held(rows.join(late, ["root_path", "device", "inode"], "left").withColumn("_over", F.coalesce(linked & F.col("_late"), F.lit(False))).drop("_late"))
    frames = few(held(rows.filter("_over").groupBy("root_path", "_up").agg(F.min("_key").alias("_stop"))))
    # a directory is skipped if it, or one above it, comes after the stop of the directory that holds that one
    t = paths.to_text(F.col("path"))
    chain = rows.filter((F.col("kind") == "directory") & F.col("_up").isNotNull()).select("root_path", "path", F.explode(paths.ancestors_t(t, proper=False)).alias("_a"))
    chain = chain.withColumn("_up", paths.to_bytes(paths.parent_t(F.col("_a")))).withColumn("_key", paths.traversal_key(paths.to_bytes(F.col("_a"))))
    gone = few(held(chain.join(frames, ["root_path", "_up"]).filter(F.col("_key") > F.col("_stop")).select("root_path", F.col("path").alias("_up"), F.lit(True).alias("_gone")).distinct()))
    own = gone.withColumnRenamed("_up", "path").withColumnRenamed("_gone", "_self")
    rows = rows.join(frames, ["root_path", "_up"], "left").join(gone, ["root_path", "_up"], "left").join(own, ["root_path", "path"], "left")
    after = F.coalesce(F.col("_key") > F.col("_stop"), F.lit(False)) & (F.col("kind") != "directory")
    skipped = F.col("_gone").isNotNull() | F.col("_self").isNotNull() | after
    return rows.withColumn("skipped", skipped).withColumn("over", F.col("_over") & ~F.col("skipped")).select(*entries.columns, "over", "skipped")


def abandoned(entries: DataFrame) -> DataFrame:
    """root_path, directory, path of the first file over the limit in each directory that was given up (entries of :func:`link_limit`); any makes a snapshot partial."""
    over = entries.filter("over").groupBy("root_path", paths.parent(F.col("path")).alias("directory"))
    return over.agg(F.min_by("path", paths.traversal_key(F.col("path"))).alias("path"))
