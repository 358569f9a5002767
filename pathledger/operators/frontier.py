"""The smallest set of paths that explains growth, and breakdowns of one path.

Both are set operations: ancestors are exploded once and joined by equality, so no step
compares paths pairwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathledger.functions import paths
from pathledger.functions.values import reason_text
from pathledger.model import DOMINANCE
from pathledger.operators.held import held

SCOPE = ["root_path", "baseline_snapshot_id", "current_snapshot_id"]


def growth_frontier(diff: DataFrame) -> DataFrame:
    """Created or grown rows left after pruning, with counts of what each stands for.

    A row is dominated if a candidate below it has DOMINANCE of its growth; its best descendant (most
    growth, then deepest, then first path) counts it. Of the others, those below another are covered
    by the uppermost of these, which counts them.
    """
    keys = [*SCOPE, "path"]
    rows = held(diff.filter(F.col("classification").isin("created", "grown") & (F.col("disk_delta") > 0)))  # read by each step
    low = rows.select(*SCOPE, F.col("path").alias("low_path"), F.col("disk_delta").alias("low_delta"), F.col("depth").alias("low_depth"))
    pairs = paths.with_ancestors(low, "low_path", "path").join(rows.select(*keys, "disk_delta"), keys)
    enough = pairs.filter(F.col("low_delta").cast("double") >= F.lit(DOMINANCE) * F.col("disk_delta"))
    best = Window.partitionBy(*keys).orderBy(F.desc("low_delta"), F.desc("low_depth"), "low_path")  # the first alone leaves each task
    dominated = held(enough.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(*keys, "low_path"))
    ups = dominated.groupBy(*SCOPE, F.col("low_path").alias("path")).agg(F.count(F.lit(1)).alias("suppressed_ancestor_count"))
    left = rows.join(dominated.select(*keys), keys, "left_anti")
    above = paths.with_ancestors(left.select(*SCOPE, F.col("path").alias("low_path")), "low_path", "path").join(left.select(*keys, "depth"), keys)
    cover = held(above.groupBy(*SCOPE, "low_path").agg(F.min_by("path", F.length("path")).alias("path")))
    downs = cover.groupBy(*keys).agg(F.count(F.lit(1)).alias("suppressed_descendant_count"))
    kept = left.join(cover.select(*SCOPE, F.col("low_path").alias("path")), keys, "left_anti")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = kept.join(ups, keys, "left").join(downs, keys, "left")
    out = out.select(*diff.columns, zero("suppressed_ancestor_count"), zero("suppressed_descendant_count"))
    return out.withColumn("reason", reason_text(F.col("suppressed_ancestor_count"), F.col("suppressed_descendant_count")))


def explain_breakdown(rows: DataFrame, target: bytes, limit: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """(shown, residual) of the diff rows at and below a path of one pair.

    Immediate children by growth, each followed by its descendants down to depth levels below the
    target; at most limit rows. residual: the target's change without the shown children's.
    rows are read several times: explain_rows holds them.
    """
    t = target.decode("latin-1")
    p = paths.to_text(F.col("path"))
    extra = ["target_delta", "target_apparent", "target_depth"]
    goal = rows.filter(p == t).select(F.col("disk_delta").alias("target_delta"), F.col("apparent_delta").alias("target_apparent"), F.col("depth").alias("target_depth"))
    below = rows.filter((p != t) & (F.col("classification") != "unchanged")).join(F.broadcast(goal), F.lit(True))
    if depth == 0:
        return below.limit(0).drop(*extra).withColumn("position", F.lit(0)), goal.select(F.col("target_delta").alias("residual"), F.col("target_apparent").alias("apparent_residual"))
    below = below.withColumn("level", F.col("depth") - F.col("target_depth")).filter((F.col("level") >= 1) & (F.col("level") <= F.lit(max(1, depth))))
    below = below.withColumn("child", F.when(F.col("level") == 1, p).otherwise(F.element_at(paths.ancestors_t(p, proper=False), -F.col("level").cast("int"))))
    # each child shows itself first, so no more than limit children and limit rows matter: both windows see that many
    order = [F.desc("disk_delta"), F.desc("apparent_delta"), F.col("path")]
    first = below.filter("level = 1").orderBy(*order).limit(limit)
    ranks = first.select("child", F.row_number().over(Window.partitionBy("root_path").orderBy(*order)).alias("child_rank"))
    place = ["child_rank", "level", "path"]
    some = below.join(F.broadcast(ranks), "child").orderBy(*place).limit(limit)
    shown = some.withColumn("position", F.row_number().over(Window.partitionBy("root_path").orderBy(*place)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    part = shown.filter("level = 1").agg(total("disk_delta").alias("part"), total("apparent_delta").alias("apparent_part"))
    left = goal.join(part, F.lit(True)).select((F.col("target_delta") - F.col("part")).alias("residual"), (F.col("target_apparent") - F.col("apparent_part")).alias("apparent_residual"))
    return shown.drop("child", "child_rank", "level", *extra), left


def contributor_roles(trends: DataFrame) -> DataFrame:
    """Ranked paths (root_path, path, rank) with the nearest better-ranked path above and their role."""
    keys = ["root_path", "path"]
    up = paths.with_ancestors(trends.select("root_path", F.col("path").alias("low"), F.col("rank").alias("low_rank")), "low", "path").join(trends.select(*keys, "rank"), keys)
    near = up.filter(F.col("rank") < F.col("low_rank")).groupBy("root_path", F.col("low").alias("path")).agg(F.max_by(F.struct("path", "rank"), F.length("path")).alias("above"))
    heads = near.select("root_path", F.col("above.path").alias("path")).distinct().withColumn("has_below", F.lit(True))
    out = trends.join(near, keys, "left").join(heads, keys, "left")
    below, above = F.coalesce("has_below", F.lit(False)), F.col("above").isNotNull()
    role = F.when(above & below, "intermediate").when(above, "leaf").when(below, "ancestor").otherwise("standalone")
    return out.select(*trends.columns, F.col("above.path").alias("chain_parent"), role.alias("role"))
