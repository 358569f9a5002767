"""Indexed totals against what filesystems report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.functions.paths import strictly_under_t
from pathledger.functions.values import ratio
from pathledger.model import MATERIAL_BYTES, MATERIAL_RATIO


def df_index(totals: DataFrame, usage: DataFrame) -> DataFrame:
    """totals: of domain_totals. usage: domain, mount_point, total_bytes, free_bytes, capture_error.

    Unattributed bytes are used but not indexed; over-indexed ones the reverse. A mount of an overlay
    that indexed nothing is another name of its storage, and has neither (if its capacity is known).
    """
    zero = F.lit(0).cast("long")
    rows = totals.join(usage, "domain", "left").withColumn("stat_available", F.col("total_bytes").isNotNull() & F.col("capture_error").isNull())
    used = F.when(F.col("stat_available"), F.col("total_bytes") - F.col("free_bytes"))
    rows = rows.withColumn("used_bytes", used)
    alias = F.col("domain").endswith("|overlay|overlay") & (F.col("mount_point") != "/") & (F.col("disk_bytes") == 0)
    over = F.greatest(F.col("disk_bytes") - F.col("used_bytes"), zero)
    under = F.greatest(F.col("used_bytes") - F.col("disk_bytes"), zero)
    known = F.col("stat_available")
    rows = rows.withColumns({
        "accounting_alias": known & F.coalesce(alias, F.lit(False)), "unattributed_bytes": F.when(known, F.when(alias, zero).otherwise(under)), "over_indexed_bytes": F.when(known, F.when(alias, zero).otherwise(over)),
        "used_ratio": F.when(known, ratio(F.col("used_bytes"), F.col("total_bytes"))), "scope_extends": (F.size("roots") > 0) & F.forall("roots", lambda r: strictly_under_t(r, F.col("mount_point"))),
    })
    rows = rows.withColumns({"unattributed_ratio": ratio(F.col("unattributed_bytes"), F.col("used_bytes")), "over_indexed_ratio": ratio(F.col("over_indexed_bytes"), F.col("used_bytes"))})
    material = lambda b, r: F.coalesce((F.col(b) >= MATERIAL_BYTES) & (F.col(r) >= F.lit(MATERIAL_RATIO)), F.lit(False))
    under_m, over_m = material("unattributed_bytes", "unattributed_ratio"), material("over_indexed_bytes", "over_indexed_ratio")
    full = ~F.col("scope_extends") & ~F.array_contains("statuses", "partial")
    hints = F.array_compact(F.array(
        F.when(~known, "filesystem_stat_unavailable"), F.when(under_m, "unattributed_usage"), F.when(under_m & F.col("scope_extends"), "filesystem_scope_extends_beyond_indexed_roots"),
        F.when(under_m & full, "deleted_open_file_suspected"), F.when(over_m, "over_indexed_skew"), F.when(F.array_contains("statuses", "partial"), "partial_snapshot_evidence"), F.when(F.col("clamped"), "indexed_total_clamped_negative"),
    ))
    return rows.withColumn("hints", hints)


def ranked_sections(rows: DataFrame, limit: int) -> DataFrame:
    """Those with known usage first, by unattributed bytes, then key."""
    return rows.orderBy(F.desc("stat_available"), F.coalesce("unattributed_bytes", F.lit(-1).cast("long")).desc(), "domain").limit(limit)


def pressure_sections(rows: DataFrame, limit: int = 4) -> DataFrame:
    """The sections that a summary shows."""
    blank = lambda c, v: F.coalesce(c, v).desc()
    none, no_share = F.lit(-1).cast("long"), F.lit(-1.0)
    return rows.filter(~F.col("accounting_alias")).orderBy(F.desc("stat_available"), blank("unattributed_bytes", none), blank("used_ratio", no_share), blank("over_indexed_bytes", none), "domain").limit(limit)


def section_totals(shown: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    total = lambda c: F.coalesce(F.sum(c), zero).alias(c)
    return shown.agg(F.count(F.lit(1)).alias("section_count"), total("used_bytes"), total("disk_bytes"), total("unattributed_bytes"), total("over_indexed_bytes"), F.coalesce(F.sum((~F.col("stat_available")).cast("long")), zero).alias("unavailable_count"))
