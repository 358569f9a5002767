"""What changed between two snapshots of each root."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathledger.functions import paths
from pathledger.model import ReportError
from pathledger.operators.held import few, held

COLLAPSE = ["collapsed", "collapse_reason", "collapsed_dirs", "top_child_path", "top_child_disk_bytes"]


def snapshot_diff(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each (root, path) of either snapshot, for all pairs at once.

    Missing sides count 0. error falls back to the baseline; what tells of folding doesn't where
    the current row exists. A deleted path below a folded current directory is only hidden.
    The rows of both sides are picked in one pass over state and meet in one shuffle by (root, path).
    """
    ends = ["baseline_snapshot_id", "current_snapshot_id"]
    keys = ["root_path", *ends, "path"]
    p = held(pairs.select("root_path", *ends))
    asked = few(p.withColumn("snapshot_id", F.explode(F.array_distinct(F.array(*ends)))))
    own = F.struct(*[c for c in state.columns if c not in ("root_path", "path", "snapshot_id")])
    side = lambda end: F.max(F.when(F.col("snapshot_id") == F.col(end), own))
    both = state.join(asked, ["root_path", "snapshot_id"]).repartition(*keys).groupBy(*keys).agg(side(ends[0]).alias("b"), side(ends[1]).alias("c"))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    pd, cd, pa, ca = zero(F.col("b.disk_bytes")), zero(F.col("c.disk_bytes")), zero(F.col("b.apparent_bytes")), zero(F.col("c.apparent_bytes"))
    kind = (
        F.when(F.col("b").isNull(), "created").when(F.col("c").isNull(), "deleted").when(cd > pd, "grown").when(cd < pd, "shrunk").when(ca > pa, "grown").when(ca < pa, "shrunk").otherwise("unchanged")
    )
    folds = [F.when(F.col("c").isNotNull(), F.col(f"c.{x}")).otherwise(F.col(f"b.{x}")).alias(x) for x in COLLAPSE]
    rows = both.select(
        *keys, F.coalesce("c.parent_path", "b.parent_path").alias("parent_path"), F.coalesce("c.depth", "b.depth").alias("depth"), kind.alias("classification"),
        pd.alias("previous_disk_bytes"), cd.alias("current_disk_bytes"), (cd - pd).alias("disk_delta"), pa.alias("previous_apparent_bytes"), ca.alias("current_apparent_bytes"), (ca - pa).alias("apparent_delta"),
        F.coalesce("c.error", "b.error").alias("error"), *folds, F.coalesce("c.collapsed", F.lit(False)).alias("folded_now"),
    )
    now = few(p.withColumn("snapshot_id", F.col(ends[1])))
    folded = state.filter("collapsed").select("root_path", "snapshot_id", F.col("path").alias("above")).join(now, ["root_path", "snapshot_id"]).select(*keys[:3], "above")
    hidden = paths.with_ancestors(rows.filter("classification = 'deleted'").select(*keys), "path", "above").join(folded, [*keys[:3], "above"], "left_semi").select(*keys).distinct().withColumn("hidden", F.lit(True))
    out = rows.join(hidden, keys, "left")
    return out.withColumn("classification", F.when(F.col("hidden"), "hidden_by_collapse").otherwise(F.col("classification"))).drop("hidden", "folded_now")


def ordered(diff: DataFrame) -> DataFrame:
    return diff.orderBy(F.desc("disk_delta"), F.desc("depth"), "path")


def deleted_rows(diff: DataFrame, limit: int) -> DataFrame:
    return diff.filter("classification = 'deleted'").orderBy(F.desc("previous_disk_bytes"), "path").limit(limit)


def top_rows(state: DataFrame, snapshot_ids: DataFrame, limit: int) -> DataFrame:
    """The largest paths of each snapshot (column snapshot_id of snapshot_ids), with rank."""
    w = Window.partitionBy("snapshot_id").orderBy(F.desc("disk_bytes"), "path")
    return state.join(snapshot_ids.select("snapshot_id"), "snapshot_id", "left_semi").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def explain_rows(diff: DataFrame, target: bytes) -> DataFrame:
    """The rows of a path and all below it; if it isn't there, the deepest folded directory above it."""
    t = target.decode("latin-1")
    p = paths.to_text(F.col("path"))
    near = held(diff.filter(paths.under_t(p, F.lit(t)) | (F.col("collapsed") & paths.strictly_under_t(F.lit(t), p))))
    here = near.filter(p == t).limit(1).count()
    if here:
        return near.filter(paths.under_t(p, F.lit(t))).orderBy("depth", "path")
    above = near.filter(F.col("collapsed") & paths.strictly_under_t(F.lit(t), p)).orderBy(F.desc("depth"), F.desc("path")).limit(1)
    if not above.count():
        raise ReportError("path_not_indexed", f"no such path: {t}")
    return above
