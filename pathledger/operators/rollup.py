"""Subtree sums of a file inventory: hard links once, folded directories, evidence of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.functions import paths
from pathledger.functions.values import error_kind
from pathledger.operators.held import held


def counted_entries(entries: DataFrame) -> DataFrame:
    """entries with disk_bytes, apparent_bytes, files, dirs and hardlink to be summed up.

    Of the names of one inode only the first in the order of a walk has disk bytes: linked files count
    none, and each inode adds a row at its first name that counts nothing else. So only files with
    several names are grouped, in map-side combinable minima.
    """
    linked = (F.col("kind") == "file") & (F.col("nlink") > 1)
    sized = F.col("kind").isin("file", "link", "directory")
    zero, is_dir = F.lit(0).cast("long"), F.col("kind") == "directory"
    own = entries.select(
        "root_path", "path", "kind", "error", F.when(sized & ~linked, F.col("blocks") * 512).otherwise(zero).alias("disk_bytes"), F.when(sized, F.col("size")).otherwise(zero).alias("apparent_bytes"),
        (~is_dir).cast("long").alias("files"), is_dir.cast("long").alias("dirs"), linked.cast("long").alias("hardlink"),
    )
    first = F.min(F.struct(paths.traversal_key(F.col("path")).alias("key"), "blocks")).alias("first")
    shared = entries.filter(linked).groupBy("root_path", "device", "inode").agg(first)
    return own.unionByName(shared.select(
        "root_path", paths.traversed(F.col("first.key")).alias("path"), F.lit("file").alias("kind"), F.lit(None).cast("string").alias("error"), (F.col("first.blocks") * 512).alias("disk_bytes"), *[zero.alias(c) for c in ("apparent_bytes", "files", "dirs", "hardlink")]
    ))


def subtree_sums(entries: DataFrame) -> DataFrame:
    """A state row for each directory: sizes with its own, files and directories below, the largest child.

    Files are summed by their directory first, in numbers alone, so that they needn't be sorted; only directories are carried to those above them,
    and held there.
    """
    is_dir = F.col("kind") == "directory"
    t, sizes = paths.to_text(F.col("path")), ["apparent_bytes", "disk_bytes", "files", "dirs", "hardlink"]
    rows = counted_entries(entries.filter(t.startswith(F.col("root_path")))).withColumn("path", F.when(is_dir, F.col("path")).otherwise(paths.parent(F.col("path"))))
    direct = rows.filter("path is not null").groupBy("root_path", "path").agg(
        *[F.sum(c).alias(c) for c in sizes], F.max(is_dir).alias("here")
    )
    failed = rows.filter(is_dir & F.col("error").isNotNull()).groupBy("root_path", "path").agg(F.max(error_kind(F.col("error"))).alias("raw_error"), F.max("error").alias("error_name"))
    direct = direct.join(failed, ["root_path", "path"], "left")
    up = paths.with_ancestors(direct, "path", "above", proper=False).filter(paths.under_t(paths.to_text(F.col("above")), F.col("root_path")))
    self_ = F.col("above") == F.col("path")
    sums = up.groupBy("root_path", F.col("above").alias("path")).agg(
        F.sum("apparent_bytes").alias("apparent_bytes"), F.sum("disk_bytes").alias("disk_bytes"), F.sum("files").alias("file_count"), F.sum(F.when(~self_, F.col("dirs")).otherwise(0)).alias("dir_count"), F.sum("hardlink").alias("hardlink_count"),
        F.max(F.when(self_, F.col("raw_error"))).alias("raw_error"), F.max(self_ & F.col("here")).alias("here"), F.max(F.when(self_, F.col("error_name"))).alias("error_name"),
    ).filter("here")
    at_root = t == F.col("root_path")
    rel = paths.relative_t(t, F.col("root_path"))
    out = held(sums).withColumns({"parent_path": F.when(~at_root, paths.parent(F.col("path"))), "depth": F.when(at_root, 0).otherwise(F.size(F.split(rel, "/")))})
    largest = F.min(F.struct((-F.col("disk_bytes")).alias("less"), F.col("path").alias("p"))).alias("top")
    child = out.filter("parent_path is not null").groupBy("root_path", F.col("parent_path").alias("path")).agg(F.count(F.lit(1)).alias("direct_directories"), largest)
    out = out.join(child, ["root_path", "path"], "left")
    return out.select(
        "root_path", "path", "parent_path", "depth", "apparent_bytes", "disk_bytes", "file_count", "dir_count", F.when(F.col("error_name").isNotNull(), F.col("raw_error")).alias("error"),
        F.col("top.p").alias("top_child_path"), (-F.col("top.less")).alias("top_child_disk_bytes"), F.coalesce("direct_directories", F.lit(0).cast("long")).alias("direct_directories"), "hardlink_count",
    )


def collapse(dirs: DataFrame, names: list[str], direct_directories: int, never: list[str] = ()) -> DataFrame:
    """Directories with known noisy names or too many directories fold; the uppermost on a path wins
    and rows below go. Protected paths, and those around them, don't fold."""
    t = paths.to_text(F.col("path"))
    free = (F.col("depth") > 0) & ~paths.protected_t(t, list(never))
    reason = F.when(free & F.element_at(F.split(t, "/"), -1).isin(list(names) or [""]), "known_noise").when(free & (F.col("direct_directories") >= direct_directories), "fan_out")
    rows = dirs.withColumn("collapse_reason", reason)
    folds = rows.filter("collapse_reason is not null").select("root_path", F.col("path").alias("above"))
    low = paths.with_ancestors(rows.select("root_path", "path"), "path", "above").join(folds, ["root_path", "above"], "left_semi").select("root_path", "path").distinct()
    kept = rows.join(low, ["root_path", "path"], "left_anti")
    on = F.col("collapse_reason").isNotNull()
    return kept.withColumns({
        "collapsed": on, "collapsed_dirs": F.when(on, F.col("dir_count")), "top_child_path": F.when(on, F.col("top_child_path")), "top_child_disk_bytes": F.when(on, F.col("top_child_disk_bytes")),
    })


def evidence(errors: DataFrame, folds: DataFrame) -> DataFrame:
    """Counts of kinds of errors (root_path, path, kind) below each folded directory, as a sorted text."""
    up = paths.with_ancestors(errors, "path", "above", proper=False).join(folds.select("root_path", F.col("path").alias("above")), ["root_path", "above"], "left_semi")
    per = up.groupBy("root_path", "above", "kind").agg(F.count(F.lit(1)).alias("n"))
    parts = F.sort_array(F.collect_list(F.struct("kind", "n")))
    return per.groupBy("root_path", F.col("above").alias("path")).agg(F.array_join(F.transform(parts, lambda p: F.concat(p.kind, F.lit("="), p.n.cast("string"))), ", ").alias("evidence"))
