"""Whole questions: each plans one set of jobs for all roots and gives plain values for programs."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathledger.functions import paths
from pathledger.functions.values import confidence, parse_since
from pathledger.model import ReportError, parse_depth, parse_grouping, parse_limit
from pathledger.operators import antichain, diff, domains, frontier, grouping, pressure, reconcile, selection, trends
from pathledger.sources.store import Store


@contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Stop the jobs started inside, and only these, when time is up.

    Jobs carry a tag of their own. A watchdog goes on cancelling after the time, as a report starts its jobs one after another.
    """
    sc, tag, late, done = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        wait = seconds
        while not done.wait(wait):
            late.set()
            sc.cancelJobsWithTag(tag)
            wait = 0.2

    sc.addJobTag(tag)
    sc.setInterruptOnCancel(True)
    watchdog = threading.Thread(target=watch, daemon=True)
    watchdog.start()
    try:
        yield
    except Exception:
        if late.is_set():
            raise ReportError("query_timeout", f"stopped after {seconds:g} s") from None
        raise
    finally:
        done.set()
        watchdog.join()
        sc.removeJobTag(tag)


def timed(report):  # noqa: ANN001, ANN201
    """A report under the deadline of its Reports, if there is one."""

    @wraps(report)
    def run(self: Reports, *args: object, **more: object) -> dict:
        if self.seconds is None:
            return report(self, *args, **more)
        with deadline(self.spark, self.seconds):
            return report(self, *args, **more)

    return run


def plain(value: object) -> object:
    """Values for JSON: bytes become hex, rows become objects."""
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows_of(df: DataFrame) -> list[dict]:
    return [plain(r) for r in df.collect()]


def to_json(payload: dict) -> str:
    return json.dumps(payload, sort_keys=True) + "\n"


def error_payload(e: ReportError) -> dict:
    return {"error": {"code": e.code, "message": e.message, **e.details}}


class Reports:
    """The commands over a store; a report that takes longer than ``seconds`` (if given) stops with the error query_timeout."""

    def __init__(self, store: Store, seconds: float | None = None):
        self.store, self.spark, self.seconds = store, store.spark, seconds

    def _pairs(self, since: str) -> tuple[DataFrame, list[dict]]:
        pairs, warnings = selection.resolve_pairs(self.store.table("snapshots"), parse_since(since))
        told = rows_of(warnings.orderBy("code", "root_path", "snapshot_id"))
        if not pairs.limit(1).count():
            raise ReportError("no_snapshot_pairs", "no root has two usable snapshots", warnings=told)
        return pairs, told

    def _diff(self, since: str, group_by: str) -> tuple[DataFrame, DataFrame, list[dict]]:
        parse_grouping(group_by)
        pairs, warnings = self._pairs(since)
        wanted = pairs.select(F.explode(F.array("baseline_snapshot_id", "current_snapshot_id")).alias("id"))
        state = self.store.state(self.store.table("snapshots").join(wanted, "id", "left_semi"))
        d = diff.snapshot_diff(state, pairs).withColumn("snapshot_id", F.col("current_snapshot_id"))
        d = grouping.with_group(d, group_by, self.store.table("mounts")).persist()
        told = d.filter("group_warning is not null").select(F.col("group_warning").alias("code"), "root_path", F.hex("path").alias("path")).distinct().limit(1000)
        return pairs, d, warnings + rows_of(told)

    @timed
    def top(self, selector: str = "latest", limit: object = None, group_by: str = "root") -> dict:
        n = parse_limit(limit)
        chosen = selection.select_snapshots(self.store.table("snapshots"), selector)
        rows = diff.top_rows(self.store.state(chosen), chosen.select(F.col("id").alias("snapshot_id")), n)
        return {"snapshots": rows_of(chosen), "rows": rows_of(grouping.with_group(rows, parse_grouping(group_by), self.store.table("mounts")).orderBy("snapshot_id", "rank"))}

    @timed
    def snapshots(self, limit: object = 10) -> dict:
        s = self.store.table("snapshots")
        return {"snapshots": rows_of(grouping.snapshot_summaries(s, self.store.state(), parse_limit(limit)))}

    @timed
    def diff(self, since: str = "24h", limit: object = None, group_by: str = "root") -> dict:
        n = parse_limit(limit)
        pairs, d, warnings = self._diff(since, group_by)
        front = diff.ordered(frontier.growth_frontier(d)).limit(n)
        return {"pairs": rows_of(pairs), "frontier": rows_of(front), "classification_counts": rows_of(grouping.classification_counts(d)), "warnings": warnings}

    @timed
    def report(self, since: str = "24h", limit: object = None, group_by: str = "root", usage: DataFrame | None = None) -> dict:
        n = parse_limit(limit)
        pairs, d, warnings = self._diff(since, group_by)
        front = diff.ordered(frontier.growth_frontier(d)).limit(n).persist()
        out = {
            "pairs": rows_of(pairs), "frontier": rows_of(front), "frontier_totals": rows_of(grouping.frontier_totals(front)), "deleted": rows_of(diff.deleted_rows(d, n)),
            "classification_counts": rows_of(grouping.classification_counts(d)), "groups": rows_of(grouping.group_summary(d)), "warnings": warnings,
        }
        if usage is not None:
            out["pressure"] = self._pressure(self._df_index(usage), grouping.group_summary(d) if group_by == "storage-domain" else None)
        return out

    @timed
    def deleted(self, since: str = "24h", limit: object = None) -> dict:
        n = parse_limit(limit)
        pairs, d, warnings = self._diff(since, "root")
        return {"pairs": rows_of(pairs), "deleted": rows_of(diff.deleted_rows(d, n)), "warnings": warnings}

    @timed
    def explain_path(self, path: bytes, since: str = "24h", limit: object = None, depth: object = None) -> dict:
        n, levels = parse_limit(limit), parse_depth(depth)
        pairs, d, warnings = self._diff(since, "root")
        roots = [r for r in pairs.collect() if path == r["root_path"].encode() or path.startswith(r["root_path"].rstrip("/").encode() + b"/")]
        if len(roots) != 1:
            raise ReportError(*(("path_outside_roots", "no root holds this path") if not roots else ("ambiguous_root", "several roots hold this path")))
        rows = diff.explain_rows(d.filter(F.col("root_path") == roots[0]["root_path"]), path)
        shown, rest = frontier.explain_breakdown(rows, path, n, levels)
        left = rest.first()
        return {"target": rows_of(rows.filter(F.col("path") == F.lit(path))), "children": rows_of(shown.orderBy("position")), "residual": left[0] if left else None, "apparent_residual": left[1] if left else None, "warnings": warnings}

    def _df_index(self, usage: DataFrame) -> DataFrame:
        chosen = selection.select_snapshots(self.store.table("snapshots"))
        return reconcile.df_index(domains.domain_totals(self.store.state(chosen), chosen, self.store.table("mounts")), usage).persist()

    def _pressure(self, found: DataFrame, growth: DataFrame | None = None, open_totals: DataFrame | None = None, categories: DataFrame | None = None) -> dict:
        sections, summary = pressure.pressure_summary(found, growth, open_totals, categories)
        shown = sections.orderBy("rank").select("rank", "domain", "mount_point", "stat_available", "used_bytes", "disk_bytes", "unattributed_bytes", "over_indexed_bytes", "used_ratio", "growth", "statuses", "facts", "next_checks", "hints", "truncated")
        return {"sections": rows_of(shown)} | rows_of(summary)[0]

    @timed
    def df_vs_index(self, usage: DataFrame, limit: object = None, open_totals: DataFrame | None = None, categories: DataFrame | None = None) -> dict:
        """usage: as reconcile.df_index takes it, from sources.inventory.capacity or elsewhere; open_totals, categories: as pressure.with_context does."""
        found = self._df_index(usage)
        shown = reconcile.ranked_sections(found, parse_limit(limit))
        out = {"sections": rows_of(shown), "summary": rows_of(reconcile.section_totals(shown))[0], "pressure": self._pressure(found, None, open_totals, categories)}
        found.unpersist()
        return out

    @timed
    def investigate(self, since: str = "14d", limit: object = None, usage: DataFrame | None = None) -> dict:
        """Trends with their chains and the confidence in them, what to look at next, and what the samples can't show; roots only if there is nothing else."""
        n, window = parse_limit(limit), parse_since(since)
        s = selection.trend_snapshots(self.store.table("snapshots"), window)
        found = trends.path_trends(self.store.state(s), s, n * 5, max(n * 25, 100)).withColumn("confidence", confidence(F.col("sample_count"), F.col("missing_count")))
        ranked = [(k, r) for k, r in enumerate(found.collect(), 1)]
        below = [(k, r) for k, r in ranked if bytes(r["path"]).decode("latin-1") != r["root_path"]] or ranked
        below = below[:n]
        keys = self.spark.createDataFrame([(r["root_path"], bytearray(r["path"]), k) for k, r in below], "root_path string, path binary, rank long")
        roles = {(r["root_path"], bytes(r["path"])): r["role"] for r in frontier.contributor_roles(keys).collect()}
        rows = [plain(r) | {"rank": k, "role": roles[r["root_path"], bytes(r["path"])]} for k, r in below]
        proposed = antichain.next_paths(keys.withColumn("depth", paths.depth_t(paths.to_text(F.col("path"))))).orderBy("position").collect()
        out = {
            "contributors": rows, "filesystems": rows_of(trends.pressure_trends(self.store.table("filesystems"), s, n)), "next_paths": [bytes(r["path"]).decode("utf-8", "surrogateescape") for r in proposed],
        }
        codes: list[str] = []
        if usage is not None:
            index = self._df_index(usage)
            out["pressure"] = self._pressure(index)
            codes = out["pressure"]["hint_codes"]
            index.unpersist()
        partial = {r["id"] for r in s.filter("status = 'partial'").select("id").collect()}
        spots = [
            ("missing_path_samples", any(r["missing_count"] > 0 for _, r in below)), ("partial_snapshot_evidence", any(x["snapshot_id"] in partial for _, r in below for x in r["samples"])), ("current_index_gap", bool(codes)),
        ]
        return out | {"blind_spots": [{"code": code} | ({"hint_codes": codes} if code == "current_index_gap" else {}) for code, there in spots if there]}

    def prune(self, now, policy=None) -> dict:  # noqa: ANN001
        return self.store.prune(now, policy)

    def vacuum(self) -> dict:
        return self.store.vacuum()
