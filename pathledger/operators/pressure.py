"""A short summary of storage pressure: facts, checks and hints of each filesystem, in a fixed order and within limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathledger.functions.values import decimals
from pathledger.model import MATERIAL_BYTES, MATERIAL_RATIO

# Limits of a summary, and the share of a filesystem from which it counts as near its capacity.
MAX_SECTIONS, MAX_ITEMS, MAX_CHECKS, NEAR_CAPACITY = 4, 5, 5, 0.85
# What a reader can run to check a fact. All only read.
DF, INDEX, OPEN, DOCKER = "df -h", "df-vs-index --json", "deleted-open-files --json", "docker-enrichment --json"


def said(pattern: str, *values: Column) -> Column:
    """A pattern with a value for each {}; null if one is."""
    parts = pattern.split("{}")
    return F.concat(F.lit(parts[0]), *[x for v, p in zip(values, parts[1:], strict=True) for x in (v.cast("string"), F.lit(p))])


def taken(*pairs: tuple[Column, Column]) -> Column:
    """The values whose condition holds, in order; null values are left out."""
    return F.array_compact(F.array(*[F.when(when, value) for when, value in pairs]))


def with_ladder(rows: DataFrame, items: int = MAX_ITEMS) -> DataFrame:
    """rows (of reconcile.df_index, with growth, open_bytes, reclaim) with facts, next_checks, hints and truncated.

    An explanation is chosen in this order: no capacity known, material unattributed bytes, bytes indexed in excess, near
    capacity. Facts keep their order and repeats; of equal checks the first stays. Both are cut to ``items``, and truncated tells
    of any cut (of checks before repeats go).
    """
    zero = F.lit(0).cast("long")
    known, under, over = F.col("stat_available"), F.coalesce("unattributed_bytes", zero), F.coalesce("over_indexed_bytes", zero)
    enough = (under >= MATERIAL_BYTES) & (F.coalesce("unattributed_ratio", F.lit(0.0)) >= F.lit(MATERIAL_RATIO))
    gap = known & (under > 0) & enough
    skew = known & ~gap & (over > 0)
    full = known & ~gap & ~skew & F.coalesce(F.col("used_ratio") >= F.lit(NEAR_CAPACITY), F.lit(False))
    wide = gap & F.coalesce("scope_extends", F.lit(False))
    part = gap & F.coalesce(F.exists("statuses", lambda s: s != "complete"), F.lit(False))
    held_open = gap & ((~wide & ~part) | (F.coalesce("open_bytes", zero) > 0))
    growth, reclaim = F.col("growth"), F.col("reclaim")
    # Texts of facts.
    facts = taken(
        (~known, said("evidence: live filesystem stat unavailable ({}); indexed totals shown without a df comparison", F.coalesce("capture_error", F.lit("unavailable")))),
        (known, said("evidence: df used {} bytes vs indexed visible {} bytes", F.col("used_bytes"), F.col("disk_bytes"))),
        (known, said("evidence: filesystem usage ratio {}", decimals(F.col("used_ratio"), 3))),
        (gap, said("likely reason: {} bytes of filesystem usage are not attributed to indexed directories", under)),
        (wide, F.lit("likely reason: indexed roots cover only part of the filesystem; the remainder may be outside scanned scope")),
        (part, F.lit("likely reason: selected snapshot evidence is non-complete; remainder cannot confirm deleted-open files alone")),
        (held_open, F.lit("likely reason: deleted-but-open files may still hold the missing space")),
        (skew, said("evidence: indexed totals exceed df used by {} bytes (snapshot skew or stale index)", over)),
        (full, F.lit("next check: filesystem is near capacity; consider evaluating an upgrade, data migration, or older-disk repurposing")),
        (growth > 0, said("evidence: recent growth {} bytes from report frontier", growth)),
        (reclaim.isNotNull(), said("evidence: docker {} reclaimable {} bytes", reclaim["category"], reclaim["bytes"])),
    )
    checks = taken((~known, F.lit(DF)), (~known, F.lit(INDEX)), (gap, F.lit(INDEX)), (held_open, F.lit(OPEN)), (skew, F.lit(INDEX)), (reclaim.isNotNull(), F.lit(DOCKER)))
    hint = lambda code, *run: F.struct(F.lit(code).alias("code"), F.array(*map(F.lit, run)).alias("next_checks"))
    hints = taken(
        (~known, hint("filesystem_stat_unavailable", DF, INDEX)), (gap, hint("unattributed_usage", INDEX, DOCKER)), (wide, hint("filesystem_scope_extends_beyond_indexed_roots", INDEX)),
        (part, hint("partial_snapshot_evidence", OPEN)), (held_open, hint("deleted_open_file_suspected", OPEN)), (skew, hint("over_indexed_skew", INDEX)), (full, hint("capacity_pressure", INDEX)),
    )
    out = rows.withColumns({"_facts": facts, "_checks": checks, "hints": hints})
    cut = (F.size("_facts") > items) | (F.size("_checks") > items)
    return out.withColumns({"facts": F.slice("_facts", 1, items), "next_checks": F.slice(F.array_distinct("_checks"), 1, items), "truncated": cut}).drop("_facts", "_checks")


def with_context(found: DataFrame, growth: DataFrame | None = None, open_totals: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """found (of reconcile.df_index) with what other reports know.

    growth: group_key (a storage domain), disk_delta; keys may repeat. open_totals: total_bytes of deleted files held open. categories:
    category, reclaimable_bytes, position; the first with something to reclaim is mentioned.
    """
    zero = F.lit(0).cast("long")
    out = found
    if growth is not None:
        sums = growth.filter("group_key is not null").groupBy(F.col("group_key").alias("domain")).agg(F.sum("disk_delta").alias("_growth"))
        out = out.join(sums, "domain", "left")
    out = out.withColumn("growth", F.coalesce("_growth", zero) if growth is not None else zero).drop("_growth")
    # aggregates without keys: one row each
    if open_totals is not None:
        out = out.join(F.broadcast(open_totals.agg(F.sum("total_bytes").alias("open_bytes"))), F.lit(True))
    else:
        out = out.withColumn("open_bytes", F.lit(None).cast("long"))
    if categories is not None:
        first = categories.filter("reclaimable_bytes <> 0").agg(F.min_by(F.struct("category", F.col("reclaimable_bytes").alias("bytes")), "position").alias("reclaim"))
        return out.join(F.broadcast(first), F.lit(True))
    return out.withColumn("reclaim", F.lit(None).cast("struct<category:string,bytes:bigint>"))


def ranked(rows: DataFrame, limit: int) -> DataFrame:
    """The first sections of a summary, with their rank: by known capacity, unattributed bytes, share used, excess; ties by domain."""
    least = lambda c: F.coalesce(F.col(c).cast("double") if c == "used_ratio" else F.col(c), F.lit(0)).desc()
    order = [F.desc("stat_available"), least("unattributed_bytes"), least("used_ratio"), least("over_indexed_bytes"), F.col("domain")]
    some = rows.filter(~F.col("accounting_alias")).orderBy(*order).limit(limit)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))  # at most limit rows


def pressure_summary(
    found: DataFrame, growth: DataFrame | None = None, open_totals: DataFrame | None = None, categories: DataFrame | None = None, *, sections: int = MAX_SECTIONS, items: int = MAX_ITEMS
) -> tuple[DataFrame, DataFrame]:
    """(sections, summary) of reconcile.df_index's rows and what other reports know.

    sections: at most ``sections`` rows with rank, facts, next_checks, hints, truncated. summary: one row with next_checks (at most
    MAX_CHECKS, the first of equal ones, in the order of sections), hint_codes and truncated_sections. No rows: an empty summary.
    """
    some = ranked(found, sections + 1)
    shown = with_ladder(with_context(some, growth, open_totals, categories), items)
    each = F.sort_array(F.collect_list(F.when(F.col("rank") <= sections, F.struct("rank", "next_checks", "hints"))))
    flat = lambda f: F.flatten(F.transform("_all", lambda s: s[f]))
    summary = shown.agg(each.alias("_all"), (F.count(F.lit(1)) > sections).alias("truncated_sections"))
    summary = summary.select(F.slice(F.array_distinct(flat("next_checks")), 1, MAX_CHECKS).alias("next_checks"), F.transform(flat("hints"), lambda h: h["code"]).alias("hint_codes"), "truncated_sections")
    return shown.filter(F.col("rank") <= sections), summary
