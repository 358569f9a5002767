"""Which directories a walk goes into: mount policy, one file system, mount and directory cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.functions import paths
from pathledger.functions.values import mount_reason, mount_verdict

SIGNATURE = ["major_minor", "mount_root", "mount_point"]


def descend_verdicts(dirs: DataFrame, one_filesystem: bool = False, included: list[str] | None = None, skipped: list[str] | None = None, skip_overlay: bool = True, skip_namespace: bool = True) -> DataFrame:
    """root_path, path, verdict, reason for each directory.

    dirs: root_path, path, device, inode and the mount of each (mount_id, filesystem_type, SIGNATURE; null where none is known). A directory isn't entered if its
    mount is skipped, its device isn't its root's (one_filesystem), its mount is that of a directory above though its parent's is another,
    or a directory above has its device and inode. What lies below one that isn't entered is unreached.

    The directories above come by exploded paths and an equality join, so all levels are judged at once.
    """
    t = paths.to_text(F.col("path"))
    sign = F.when(F.col("mount_id").isNotNull(), F.struct(*SIGNATURE))
    own = dirs.select("root_path", t.alias("t"), "path", "device", "inode", "mount_id", "filesystem_type", sign.alias("sign"))
    up = own.select("root_path", "t", "device", "inode", "mount_id", "sign", F.explode(paths.ancestors_t(F.col("t"))).alias("a")).filter(paths.under_t(F.col("a"), F.col("root_path")))
    above = own.select("root_path", F.col("t").alias("a"), F.struct("device", "inode", "mount_id", "sign").alias("o"))
    met = up.join(above, ["root_path", "a"]).groupBy("root_path", "t").agg(
        F.max(F.when(F.col("a") == F.col("root_path"), F.col("o.device"))).alias("root_device"), F.max_by(F.struct("o.mount_id", "o.sign"), F.length("a")).alias("parent"),
        F.max((F.col("o.mount_id") == F.col("mount_id")) | (F.col("o.sign") == F.col("sign"))).alias("mount_met"), F.max((F.col("o.device") == F.col("device")) & (F.col("o.inode") == F.col("inode"))).alias("met"),
    )
    rows = own.join(met, ["root_path", "t"], "left")
    policy = F.when(F.col("mount_id").isNull(), "included").otherwise(mount_verdict(F.col("filesystem_type"), included or [], skipped or [], skip_overlay, skip_namespace))
    same = F.coalesce((F.col("mount_id") == F.col("parent.mount_id")) & (F.col("sign") == F.col("parent.sign")), F.lit(False))
    verdict = (
        F.when(F.col("t") == F.col("root_path"), "root").when(~policy.startswith("included"), policy).when(F.lit(one_filesystem) & (F.col("device") != F.col("root_device")), "separate_filesystem")
        .when(F.col("mount_id").isNotNull() & ~same & F.coalesce("mount_met", F.lit(False)), "mount_cycle").when(F.coalesce("met", F.lit(False)), "directory_cycle").otherwise(policy)
    )
    rows = rows.withColumn("verdict", verdict)
    enters = F.col("verdict").isin("root", "included", "included_filesystem")
    closed = rows.filter(~enters).select("root_path", F.col("t").alias("a"))
    lost = up.select("root_path", "t", "a").join(closed, ["root_path", "a"], "left_semi").select("root_path", "t").distinct().withColumn("lost", F.lit(True))
    rows = rows.join(lost, ["root_path", "t"], "left").withColumn("verdict", F.when(F.col("lost"), "unreached").otherwise(F.col("verdict")))
    s = lambda c: F.col(c).cast("string")
    # The reasons that reports give.
    reason = (
        F.when(F.col("verdict").isin("root", "unreached"), None)
        .when(F.col("verdict") == "separate_filesystem", F.concat(F.lit("separate filesystem skipped by one-filesystem policy (root st_dev "), s("root_device"), F.lit(", child st_dev "), s("device"), F.lit(")")))
        .when(F.col("verdict") == "mount_cycle", F.concat(F.lit("bind mount cycle detected for mount_id "), s("mount_id")))
        .when(F.col("verdict") == "directory_cycle", F.concat(F.lit("bind mount cycle detected for device/inode "), s("device"), F.lit(":"), s("inode")))
        .otherwise(mount_reason(F.col("filesystem_type"), F.col("verdict")))
    )
    return rows.select("root_path", "path", "verdict", reason.alias("reason"))
