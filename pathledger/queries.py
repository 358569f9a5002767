"""The engine's queries over the driver's tables, and their SQL oracles."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathledger import adapters as ad
from pathledger.functions import paths, values
from pathledger.operators import antichain, descend, dictionary, diff, domains, frontier, grouping, intervals, links, pressure, reconcile, retention, rollup, selection, trends
from pathledger.operators.held import held
from pathledger.sources import parsers

SINCE = 366 * 86_400
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def text(c: str | Column) -> Column:
    return F.decode(F.col(c) if isinstance(c, str) else c, "UTF-8")


def orders_cube(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    state = held(ad.order_state(spark, sf))
    return state, held(ad.snapshots_of(state))


def orders_diff(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    state, snaps = orders_cube(spark, sf)
    pairs, _ = selection.resolve_pairs(snaps, SINCE)
    return state, snaps, diff.snapshot_diff(state, pairs)


PAIRS_SQL = """usable AS (SELECT *, CAST(finished_at AS TIMESTAMPTZ) AS t FROM snaps WHERE status IN ('complete', 'partial')),
cur AS (SELECT * FROM usable ORDER BY t DESC, id DESC LIMIT 1),
base AS (SELECT u.* FROM usable u, cur WHERE u.id <> cur.id AND u.t <= cur.t - INTERVAL 366 DAY ORDER BY u.t DESC, u.id DESC LIMIT 1)"""
DIFF_SQL = (
    ad.ORDERS_SQL + ",\n" + PAIRS_SQL + """,
b AS (SELECT state.* FROM state, base WHERE snapshot_id = base.id), c AS (SELECT state.* FROM state, cur WHERE snapshot_id = cur.id),
raw AS (
  SELECT path, coalesce(c.depth, b.depth) AS depth, coalesce(c.parent_path, b.parent_path) AS parent_path, coalesce(b.disk_bytes, 0) AS previous_disk_bytes, coalesce(c.disk_bytes, 0) AS current_disk_bytes,
         coalesce(c.disk_bytes, 0) - coalesce(b.disk_bytes, 0) AS disk_delta, coalesce(c.apparent_bytes, 0) - coalesce(b.apparent_bytes, 0) AS apparent_delta,
         CASE WHEN b.depth IS NULL THEN 'created' WHEN c.depth IS NULL THEN 'deleted' WHEN c.disk_bytes > b.disk_bytes THEN 'grown' WHEN c.disk_bytes < b.disk_bytes THEN 'shrunk'
              WHEN c.apparent_bytes > b.apparent_bytes THEN 'grown' WHEN c.apparent_bytes < b.apparent_bytes THEN 'shrunk' ELSE 'unchanged' END AS cls,
         coalesce(c.collapsed, b.collapsed) AS collapsed, coalesce(c.collapsed, false) AS folded_now
  FROM b FULL OUTER JOIN c USING (path)
), diff AS (
  SELECT *, CASE WHEN cls = 'deleted' AND EXISTS (SELECT 1 FROM raw f WHERE f.folded_now AND starts_with(raw.path, f.path || '/')) THEN 'hidden_by_collapse' ELSE cls END AS classification FROM raw
)"""
)
FRONTIER_SQL = """cand AS (SELECT * FROM diff WHERE classification IN ('created', 'grown') AND disk_delta > 0),
anc AS (SELECT a.path AS up, a.disk_delta AS up_delta, a.depth AS up_depth, d.path AS low, d.disk_delta AS low_delta, d.depth AS low_depth FROM cand a JOIN cand d ON a.path <> d.path AND (a.path = '/' OR starts_with(d.path, a.path || '/'))),
best AS (SELECT up, low FROM anc WHERE CAST(low_delta AS DOUBLE) >= CAST(0.95 AS DOUBLE) * up_delta QUALIFY row_number() OVER (PARTITION BY up ORDER BY low_delta DESC, low_depth DESC, low) = 1),
survivors AS (SELECT * FROM cand WHERE path NOT IN (SELECT up FROM best)),
cover AS (SELECT low, up FROM anc WHERE up IN (SELECT path FROM survivors) AND low IN (SELECT path FROM survivors) QUALIFY row_number() OVER (PARTITION BY low ORDER BY up_depth) = 1),
front AS (
  SELECT s.*, (SELECT count(*) FROM best WHERE low = s.path) AS suppressed_ancestor_count, (SELECT count(*) FROM cover WHERE up = s.path) AS suppressed_descendant_count
  FROM survivors s WHERE path NOT IN (SELECT low FROM cover)
)"""


@query(f"WITH {DIFF_SQL} SELECT path, parent_path, depth, classification, previous_disk_bytes, current_disk_bytes, disk_delta, apparent_delta, collapsed FROM diff")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    _, _, d = orders_diff(spark, sf)
    return d.select(text("path").alias("path"), text("parent_path").alias("parent_path"), "depth", "classification", "previous_disk_bytes", "current_disk_bytes", "disk_delta", "apparent_delta", "collapsed")


@query(f"WITH {ad.ORDERS_SQL}, {PAIRS_SQL} SELECT '/' AS root_path, base.id AS baseline_snapshot_id, cur.id AS current_snapshot_id FROM base, cur")
def snapshot_pairs(spark: SparkSession, sf: str) -> DataFrame:
    _, snaps = orders_cube(spark, sf)
    return selection.resolve_pairs(snaps, SINCE)[0].select("root_path", "baseline_snapshot_id", "current_snapshot_id")


@query(f"WITH {ad.ORDERS_SQL} SELECT 'failed_snapshot_excluded' AS code, '/' AS root_path, id AS snapshot_id FROM snaps WHERE status = 'failed' UNION ALL SELECT 'partial_snapshot', '/', id FROM (SELECT * FROM snaps WHERE status <> 'failed' ORDER BY id DESC LIMIT 1) WHERE status = 'partial'")
def pair_warnings(spark: SparkSession, sf: str) -> DataFrame:
    _, snaps = orders_cube(spark, sf)
    return selection.resolve_pairs(snaps, SINCE)[1]


@query(f"WITH {DIFF_SQL}, {FRONTIER_SQL} SELECT row_number() OVER (ORDER BY disk_delta DESC, depth DESC, path) AS rank, path, classification, disk_delta, suppressed_ancestor_count, suppressed_descendant_count, CASE WHEN suppressed_ancestor_count > 0 AND suppressed_descendant_count > 0 THEN 'dominates near-duplicate ancestors while hiding lower-signal descendants' WHEN suppressed_ancestor_count > 0 THEN 'dominates near-duplicate ancestors' WHEN suppressed_descendant_count > 0 THEN 'suppresses lower-signal descendants' ELSE 'highest-signal growth target' END AS reason FROM front ORDER BY rank LIMIT 20")
def growth_frontier(spark: SparkSession, sf: str) -> DataFrame:
    _, _, d = orders_diff(spark, sf)
    top = diff.ordered(frontier.growth_frontier(d)).limit(20)
    w = Window.partitionBy("root_path").orderBy(F.desc("disk_delta"), F.desc("depth"), "path")
    return top.select(F.row_number().over(w).cast("long").alias("rank"), text("path").alias("path"), "classification", "disk_delta", "suppressed_ancestor_count", "suppressed_descendant_count", "reason")


@query(f"WITH {ad.ORDERS_SQL}, latest AS (SELECT id FROM snaps WHERE status <> 'failed' ORDER BY finished_at DESC, id DESC LIMIT 1) SELECT row_number() OVER (ORDER BY disk_bytes DESC, path) AS rank, path, disk_bytes, split_part(path, '/', 2) AS seg, CASE WHEN path = '/' THEN '.' ELSE split_part(path, '/', 2) END AS group_key FROM state, latest WHERE snapshot_id = id ORDER BY rank LIMIT 20")
def top_rows(spark: SparkSession, sf: str) -> DataFrame:
    state, snaps = orders_cube(spark, sf)
    latest = selection.latest_snapshots(snaps).select(F.col("id").alias("snapshot_id"))
    got = grouping.with_group(diff.top_rows(state, latest, 20), "top-level-subtree")
    return got.select(F.col("rank").cast("long").alias("rank"), text("path").alias("path"), "disk_bytes", F.split_part(text("path"), F.lit("/"), F.lit(2)).alias("seg"), "group_key")


@query(f"WITH {ad.ORDERS_SQL}, per AS (SELECT snapshot_id AS id, count(*) AS path_count, count(*) FILTER (collapsed) AS collapsed_count, max(disk_bytes) FILTER (depth = 0) AS disk_bytes, max(file_count) FILTER (depth = 0) AS file_count FROM state GROUP BY 1) SELECT id, status, path_count, collapsed_count, disk_bytes, file_count, CAST(3600.0 AS DOUBLE) AS processing_seconds FROM snaps JOIN per USING (id) ORDER BY finished_at DESC, id DESC LIMIT 10")
def snapshot_summaries(spark: SparkSession, sf: str) -> DataFrame:
    state, snaps = orders_cube(spark, sf)
    return grouping.snapshot_summaries(snaps, state, 10).select("id", "status", "path_count", "collapsed_count", "disk_bytes", "file_count", "processing_seconds")


@query(f"WITH {DIFF_SQL} SELECT path, previous_disk_bytes FROM diff WHERE classification = 'deleted' ORDER BY 2 DESC, 1 LIMIT 20")
def deleted_rows(spark: SparkSession, sf: str) -> DataFrame:
    return diff.deleted_rows(orders_diff(spark, sf)[2], 20).select(text("path").alias("path"), "previous_disk_bytes")


@query(
    f"""WITH {DIFF_SQL}, below AS (SELECT *, depth - 1 AS level, CASE depth WHEN 2 THEN path ELSE parent_path END AS child FROM diff WHERE starts_with(path, '/ASIA/') AND classification <> 'unchanged'),
ranks AS (SELECT child, row_number() OVER (ORDER BY disk_delta DESC, apparent_delta DESC, path) AS r FROM below WHERE level = 1)
SELECT row_number() OVER (ORDER BY r, level, path) AS position, path, disk_delta FROM below JOIN ranks USING (child) ORDER BY position LIMIT 12"""
)
def explain_path(spark: SparkSession, sf: str) -> DataFrame:
    shown, _ = frontier.explain_breakdown(diff.explain_rows(orders_diff(spark, sf)[2], b"/ASIA"), b"/ASIA", 12, 2)
    return shown.select(F.col("position").cast("long").alias("position"), text("path").alias("path"), "disk_delta")


@query(
    f"""WITH {DIFF_SQL}, below AS (SELECT * FROM diff WHERE starts_with(path, '/ASIA/') AND depth = 2 AND classification <> 'unchanged' ORDER BY disk_delta DESC, apparent_delta DESC, path LIMIT 3)
SELECT CAST((SELECT disk_delta FROM diff WHERE path = '/ASIA') - coalesce(sum(disk_delta), 0) AS BIGINT) AS residual, CAST((SELECT apparent_delta FROM diff WHERE path = '/ASIA') - coalesce(sum(apparent_delta), 0) AS BIGINT) AS apparent_residual FROM below"""
)
def explain_residual(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.explain_breakdown(diff.explain_rows(orders_diff(spark, sf)[2], b"/ASIA"), b"/ASIA", 3, 1)[1]


LPM_SQL = "CASE WHEN path = '/ASIA' OR starts_with(path, '/ASIA/') THEN '8:16|/|xfs|/dev/asia' WHEN path = '/EUROPE/FRANCE' OR starts_with(path, '/EUROPE/FRANCE/') THEN '8:32|/|xfs|/dev/france' ELSE '8:1|/|ext4|/dev/root' END"


def _current_groups(spark: SparkSession, sf: str, by: str) -> DataFrame:
    state, snaps, d = orders_diff(spark, sf)
    return grouping.with_group(held(d.withColumn("snapshot_id", F.col("current_snapshot_id"))), by, ad.mounts_of(snaps))


@query(f"WITH {DIFF_SQL} SELECT path, {LPM_SQL} AS group_key FROM diff")
def storage_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _current_groups(spark, sf, "storage-domain").select(text("path").alias("path"), "group_key")


@query(f"WITH {DIFF_SQL} SELECT 'storage-domain' AS group_kind, {LPM_SQL} AS group_key, count(*) AS row_count, CAST(sum(disk_delta) AS BIGINT) AS disk_delta, CAST(sum(apparent_delta) AS BIGINT) AS apparent_delta FROM diff GROUP BY 2")
def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.group_summary(_current_groups(spark, sf, "storage-domain"))


@query(f"WITH {DIFF_SQL} SELECT classification, count(*) AS row_count FROM diff GROUP BY 1")
def classification_counts(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.classification_counts(orders_diff(spark, sf)[2])


@query(f"WITH {DIFF_SQL}, {FRONTIER_SQL}, shown AS (SELECT * FROM front ORDER BY disk_delta DESC, depth DESC, path LIMIT 5) SELECT classification, CAST(sum(disk_delta) AS BIGINT) AS disk_delta, CAST(sum(apparent_delta) AS BIGINT) AS apparent_delta FROM shown GROUP BY 1")
def frontier_totals(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.frontier_totals(diff.ordered(frontier.growth_frontier(orders_diff(spark, sf)[2])).limit(5))


TOTALS_SQL = f"""{ad.ORDERS_SQL}, latest AS (SELECT id FROM snaps WHERE status <> 'failed' ORDER BY finished_at DESC, id DESC LIMIT 1),
lab AS (SELECT state.*, {LPM_SQL} AS domain FROM state, latest WHERE snapshot_id = id),
near AS (SELECT l.path, a.domain AS up FROM lab l JOIN lab a ON l.path <> a.path AND (a.path = '/' OR starts_with(l.path, a.path || '/')) QUALIFY row_number() OVER (PARTITION BY l.path ORDER BY length(a.path) DESC) = 1),
edge AS (SELECT lab.*, up FROM lab LEFT JOIN near USING (path) WHERE up IS NULL OR up <> domain),
raw AS (SELECT domain, sum(disk_bytes) AS d, sum(apparent_bytes) AS a FROM (SELECT domain, disk_bytes, apparent_bytes FROM edge UNION ALL SELECT up, -disk_bytes, -apparent_bytes FROM edge WHERE up IS NOT NULL) GROUP BY 1),
totals AS (SELECT domain, CAST(greatest(d, 0) AS BIGINT) AS disk_bytes, CAST(greatest(a, 0) AS BIGINT) AS apparent_bytes, (SELECT count(*) FROM lab WHERE lab.domain = raw.domain) AS visible_path_count FROM raw)"""


def _totals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    state, snaps = orders_cube(spark, sf)
    mounts = ad.mounts_of(snaps)
    return domains.domain_totals(state, selection.latest_snapshots(snaps), mounts), ad.filesystems_of(state, mounts), selection.latest_snapshots(snaps)


@query(f"WITH {TOTALS_SQL} SELECT * FROM totals")
def storage_domain_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(spark, sf)[0].select("domain", "disk_bytes", "apparent_bytes", "visible_path_count")


@query(
    f"""WITH {TOTALS_SQL}, {ad.MOUNTS_SQL}, use AS (SELECT mm || '|/|' || kind || '|' || source AS domain, point, disk_bytes + id * 1000 AS used, seq, id FROM mounts JOIN state ON state.path = point JOIN latest ON snapshot_id = latest.id WHERE seq <= 3),
j AS (SELECT totals.*, CASE WHEN id % 10 = 0 AND seq = 2 THEN NULL ELSE used END AS used FROM totals LEFT JOIN use USING (domain))
SELECT domain, disk_bytes, used AS used_bytes, greatest(used - disk_bytes, 0) AS unattributed_bytes, greatest(disk_bytes - used, 0) AS over_indexed_bytes, CASE WHEN used <> 0 THEN greatest(used - disk_bytes, 0) / CAST(used AS DOUBLE) END AS unattributed_ratio,
       used IS NOT NULL AS stat_available FROM j"""
)
def df_vs_index(spark: SparkSession, sf: str) -> DataFrame:
    totals, fs, latest = _totals(spark, sf)
    usage = fs.join(latest.select(F.col("id").alias("snapshot_id")), "snapshot_id").select(
        paths.domain_key(F.col("major_minor"), F.col("root"), F.col("filesystem_type"), F.col("mount_source")).alias("domain"), text("mount_point").alias("mount_point"), "total_bytes", "free_bytes", "capture_error"
    )
    return reconcile.ranked_sections(reconcile.df_index(totals, usage), 20).select("domain", "disk_bytes", "used_bytes", "unattributed_bytes", "over_indexed_bytes", "unattributed_ratio", "stat_available")


TREND_SQL = f"""{ad.EVENTS_SQL}, good AS (SELECT *, CAST(finished_at AS TIMESTAMPTZ) AS t FROM snaps WHERE status <> 'failed'), cut AS (SELECT max(t) - INTERVAL 20 DAY AS c FROM good),
sel AS (SELECT good.* FROM good, cut WHERE t >= c UNION SELECT * EXCLUDE (c) FROM (SELECT good.*, c FROM good, cut WHERE t <= c ORDER BY finished_at DESC, id DESC LIMIT 1)),
s AS (SELECT path, id, t, disk_bytes, disk_bytes - lag(disk_bytes) OVER (PARTITION BY path ORDER BY t, id) AS delta, max(disk_bytes) OVER (PARTITION BY path) AS peak FROM state JOIN sel ON snapshot_id = id),
m AS (SELECT *, greatest(1, CAST(trunc(peak * CAST(0.01 AS DOUBLE)) AS BIGINT)) AS mat FROM s),
g AS (SELECT path, count(*) AS n, arg_min(disk_bytes, t) AS a, arg_max(disk_bytes, t) AS z, coalesce(sum(delta) FILTER (delta > 0), 0) AS plus, coalesce(-sum(delta) FILTER (delta < 0), 0) AS minus, max(peak) AS peak, max(mat) AS mat, coalesce(max(delta), 0) AS most,
        count(delta) AS steps, count(*) FILTER (delta >= mat) AS grown, max(t) FILTER (delta >= mat) AS last_growth, coalesce(stddev_pop(delta), 0) AS vol, epoch_us(max(t)) - epoch_us(min(t)) AS us FROM m GROUP BY path),
tr AS (SELECT path, n AS sample_count, CAST(greatest(0, (SELECT count(*) FROM sel) - n) AS BIGINT) AS missing_count, CAST(z - a AS BIGINT) AS net, CAST(plus AS BIGINT) AS gross_growth, CAST(minus AS BIGINT) AS gross_loss, peak AS peak_bytes,
        CASE WHEN n >= 3 AND us > 0 THEN round((z - a) / (us / 86400e6), 3) END AS daily_slope, round(vol, 3) AS volatility, CAST(last_growth AT TIME ZONE 'UTC' AS VARCHAR) AS last_growth,
        CASE WHEN n < 3 THEN 'unknown_insufficient_samples' WHEN plus < mat AND minus < mat THEN 'stable_large' WHEN plus > 0 AND minus >= CAST(0.5 AS DOUBLE) * plus AND peak > z AND z - a <= plus - minus THEN 'grow_then_clean' WHEN most >= CAST(0.75 AS DOUBLE) * plus THEN 'one_time_jump'
             WHEN z - a >= mat AND plus >= mat AND grown / CAST(steps AS DOUBLE) >= CAST(0.6 AS DOUBLE) AND minus <= CAST(0.2 AS DOUBLE) * plus THEN 'steady_growth' WHEN plus >= mat THEN 'bursty_growth' ELSE 'stable_large' END AS shape FROM g)"""


def _event_trends(spark: SparkSession, sf: str, limit: int, candidates: int | None = None) -> DataFrame:
    state = ad.event_state(spark, sf)
    sel = selection.trend_snapshots(ad.snapshots_of(state, daily=True), 20 * 86_400)
    return trends.path_trends(state, sel, limit, candidates)


@query(f"WITH {TREND_SQL} SELECT * FROM tr ORDER BY gross_growth DESC, net DESC, path LIMIT 40")
def path_trends(spark: SparkSession, sf: str) -> DataFrame:
    got = _event_trends(spark, sf, 40)
    return got.select(text("path").alias("path"), "sample_count", "missing_count", "net", "gross_growth", "gross_loss", "peak_bytes", F.round("daily_slope", 3).alias("daily_slope"), F.round("volatility", 3).alias("volatility"), F.col("last_growth_at").cast("string").alias("last_growth"), "shape")


@query(
    f"WITH {TREND_SQL}, last AS (SELECT id FROM sel ORDER BY finished_at DESC, id DESC LIMIT 1), cand AS (SELECT path FROM state, last WHERE snapshot_id = id AND depth > 0 AND (disk_bytes > 0 OR apparent_bytes > 0) ORDER BY disk_bytes DESC, apparent_bytes DESC, depth DESC, path LIMIT 15) "
    "SELECT path, net, gross_growth, shape FROM tr WHERE path IN (SELECT path FROM cand) ORDER BY gross_growth DESC, net DESC, path LIMIT 10"
)
def candidate_trends(spark: SparkSession, sf: str) -> DataFrame:
    return _event_trends(spark, sf, 10, 15).select(text("path").alias("path"), "net", "gross_growth", "shape")


@query(
    f"""WITH {ad.ORDERS_SQL}, {ad.MOUNTS_SQL}, f AS (SELECT mm || '|/|' || kind || '|' || source AS key, id, finished_at, CASE WHEN id % 10 = 0 AND seq = 2 THEN NULL ELSE disk_bytes + id * 1000 END AS used FROM mounts JOIN state ON path = point JOIN snaps ON snapshot_id = id AND status <> 'failed' WHERE seq <= 3)
SELECT key, count(*) AS sample_count, CAST(arg_max(used, finished_at) FILTER (used IS NOT NULL) - arg_min(used, finished_at) FILTER (used IS NOT NULL) AS BIGINT) AS used_delta, count(*) FILTER (used IS NULL) AS error_count FROM f GROUP BY key"""
)
def pressure_trends(spark: SparkSession, sf: str) -> DataFrame:
    state, snaps = orders_cube(spark, sf)
    good = selection.decoded(snaps).filter(F.col("status") != "failed")
    return trends.pressure_trends(ad.filesystems_of(state, ad.mounts_of(snaps)), good, 20).select("key", "sample_count", "used_delta", "error_count")


INTERVAL_SQL = f"""{ad.EVENTS_SQL}, ord AS (SELECT id, row_number() OVER (ORDER BY id) AS rank, lead(id) OVER (ORDER BY id) AS after FROM snaps WHERE status = 'complete'),
q AS (SELECT path, id, rank, after, disk_bytes // 2000000 AS v FROM state JOIN ord ON snapshot_id = id),
chg AS (SELECT *, CASE WHEN lag(rank) OVER w = rank - 1 AND lag(v) OVER w = v THEN 0 ELSE 1 END AS fresh FROM q WINDOW w AS (PARTITION BY path ORDER BY rank)),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY rank) AS island FROM chg),
iv AS (SELECT path, min(id) AS valid_from_snapshot_id, arg_max(after, rank) FILTER (true) AS x, max(rank) AS r, min(v) AS disk_bytes FROM isl GROUP BY path, island)"""


def _coarse(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes in coarse steps, so that versions repeat."""
    state = ad.event_state(spark, sf)
    snaps = ad.snapshots_of(state, daily=True)
    coarse = state.select("snapshot_id", "root_path", "path", F.floor(F.col("disk_bytes") / 2_000_000).alias("disk_bytes"))
    return coarse, snaps, intervals.compress(coarse, snaps)


@query(f"WITH {INTERVAL_SQL} SELECT path, valid_from_snapshot_id, (SELECT after FROM ord WHERE rank = r) AS valid_to_snapshot_id, disk_bytes FROM iv")
def interval_compress(spark: SparkSession, sf: str) -> DataFrame:
    return _coarse(spark, sf)[2].select(text("path").alias("path"), "valid_from_snapshot_id", "valid_to_snapshot_id", "disk_bytes")


@query(f"WITH {ad.EVENTS_SQL} SELECT snapshot_id, path, disk_bytes // 2000000 AS disk_bytes FROM state JOIN snaps ON id = snapshot_id")
def interval_expand(spark: SparkSession, sf: str) -> DataFrame:
    coarse, snaps, iv = _coarse(spark, sf)
    return intervals.snapshot_state(iv, coarse, snaps).select("snapshot_id", text("path").alias("path"), "disk_bytes")


@query(f"WITH {INTERVAL_SQL} SELECT path, valid_from_snapshot_id, (SELECT after FROM ord WHERE rank = r) AS valid_to_snapshot_id, disk_bytes FROM iv")
def interval_promote(spark: SparkSession, sf: str) -> DataFrame:
    """The last complete snapshot promoted onto the intervals of those before it."""
    coarse, snaps, _ = _coarse(spark, sf)
    last = snaps.filter("status = 'complete'").agg(F.max("id")).first()[0] or 0
    iv = intervals.compress(coarse, snaps.filter(F.col("id") < last))
    return intervals.promote(iv, coarse.filter(F.col("snapshot_id") == last), "/", last).select(text("path").alias("path"), "valid_from_snapshot_id", "valid_to_snapshot_id", "disk_bytes")


NOW = datetime(2024, 1, 31, tzinfo=UTC)
KEPT_SQL = f"""{ad.EVENTS_SQL}, k AS (
  SELECT id FROM snaps WHERE status = 'complete' AND (CAST(finished_at AS TIMESTAMPTZ) >= TIMESTAMPTZ '2024-01-31 00:00:00+00' - INTERVAL 72 HOUR OR CAST(finished_at AS TIMESTAMPTZ) >= TIMESTAMPTZ '2024-01-31 00:00:00+00' - INTERVAL 240 HOUR OR id = (SELECT max(id) FROM snaps WHERE status = 'complete'))
  UNION ALL SELECT id FROM snaps WHERE status <> 'complete' AND CAST(finished_at AS TIMESTAMPTZ) >= TIMESTAMPTZ '2024-01-31 00:00:00+00' - INTERVAL 24 HOUR
)"""


def _kept(snaps: DataFrame) -> DataFrame:
    from pathledger.model import RetentionPolicy

    return retention.retained(snaps, NOW, RetentionPolicy(3, 10, 24))


@query(f"WITH {KEPT_SQL} SELECT id FROM k")
def retention_keep(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(ad.snapshots_of(ad.event_state(spark, sf), daily=True))


@query(
    f"""WITH {KEPT_SQL}, {INTERVAL_SQL.split(', ord AS', 1)[1].join(['ord AS', ''])}, full_iv AS (SELECT path, valid_from_snapshot_id AS f, (SELECT after FROM ord WHERE rank = r) AS t, disk_bytes FROM iv), done AS (SELECT k.id FROM k JOIN snaps USING (id) WHERE status = 'complete')
SELECT path, (SELECT min(id) FROM done WHERE id >= f AND (t IS NULL OR id < t)) AS valid_from_snapshot_id, (SELECT min(id) FROM done WHERE id >= t) AS valid_to_snapshot_id, disk_bytes FROM full_iv WHERE EXISTS (SELECT 1 FROM done WHERE id >= f AND (t IS NULL OR id < t))"""
)
def retention_rebound(spark: SparkSession, sf: str) -> DataFrame:
    _, snaps, iv = _coarse(spark, sf)
    done = snaps.filter("status = 'complete'").join(_kept(snaps), "id", "left_semi").select("root_path", "id")
    return retention.rebound(iv, done).select(text("path").alias("path"), "valid_from_snapshot_id", "valid_to_snapshot_id", "disk_bytes")


@query("SELECT c_custkey AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def orphan_paths(spark: SparkSession, sf: str) -> DataFrame:
    o = ad.table(spark, sf, "orders")
    known = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("path"))
    return retention.orphan_paths(known, (o.filter("o_orderstatus = 'F'"), "o_custkey"), (o.filter("o_orderpriority = '1-URGENT'"), "o_custkey"))


def _line_files(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as files named by part and order in directories of suppliers; a part's lines share an inode."""
    li = ad.table(spark, sf, "lineitem")
    name = F.concat(F.lit("/s"), (F.col("l_suppkey") % 20).cast("string"), F.lit("/q"), (F.col("l_suppkey") % 3).cast("string"), F.lit("/f"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    files = li.select(name.alias("t"), F.col("l_quantity").cast("long").alias("size"), F.col("l_quantity").cast("long").alias("blocks"), F.col("l_partkey").alias("inode"))
    dirs = paths.directories_t(files, "t").select("t", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("blocks"), F.lit(0).cast("long").alias("inode"), F.lit("directory").alias("kind"))
    rows = files.withColumn("kind", F.lit("file")).unionByName(dirs)
    return rows.select(F.lit("/").alias("root_path"), paths.to_bytes(F.col("t")).alias("path"), "kind", "size", "blocks", F.when(F.col("kind") == "file", 2).otherwise(1).cast("long").alias("nlink"), F.lit(1).cast("long").alias("device"), "inode", F.lit(None).cast("string").alias("error"))


FILES_SQL = """f AS (SELECT '/s' || CAST(l_suppkey % 20 AS VARCHAR) AS d1, '/q' || CAST(l_suppkey % 3 AS VARCHAR) AS d2, '/f' || CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) AS nm, CAST(trunc(l_quantity) AS BIGINT) AS size, l_partkey AS inode FROM lineitem),
l AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY inode ORDER BY replace(d1 || d2 || nm, '/', chr(1))) = 1 THEN size * 512 ELSE 0 END AS disk FROM f),
up AS (SELECT '/' AS path, * FROM l UNION ALL SELECT d1, * FROM l UNION ALL SELECT d1 || d2, * FROM l),
dirs AS (SELECT path, CAST(sum(size) AS BIGINT) AS apparent_bytes, CAST(sum(disk) AS BIGINT) AS disk_bytes, count(*) AS file_count, CASE WHEN path = '/' THEN count(DISTINCT d1) + count(DISTINCT d1 || d2) WHEN path = d1 THEN count(DISTINCT d2) ELSE 0 END AS dir_count FROM (SELECT *, d1 AS x FROM up) GROUP BY path, CASE WHEN path = '/' THEN NULL ELSE d1 END)"""
FILES_SQL = FILES_SQL.replace("CASE WHEN path = '/' THEN count(DISTINCT d1) + count(DISTINCT d1 || d2) WHEN path = d1 THEN count(DISTINCT d2) ELSE 0 END AS dir_count FROM (SELECT *, d1 AS x FROM up) GROUP BY path, CASE WHEN path = '/' THEN NULL ELSE d1 END", "CASE WHEN path = '/' THEN count(DISTINCT d1) + count(DISTINCT d1 || d2) WHEN path NOT LIKE '%/q%' THEN count(DISTINCT d2) ELSE 0 END AS dir_count FROM up GROUP BY path")


@query(f"WITH {FILES_SQL} SELECT path, apparent_bytes, disk_bytes, file_count, dir_count FROM dirs")
def subtree_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.subtree_sums(_line_files(spark, sf)).select(text("path").alias("path"), "apparent_bytes", "disk_bytes", "file_count", "dir_count")


@query(f"WITH {FILES_SQL}, top AS (SELECT path, disk_bytes, CASE WHEN path LIKE '%/q%' THEN split_part(path, '/q', 1) ELSE '/' END AS up FROM dirs WHERE path <> '/') SELECT up AS path, path AS top_child, disk_bytes AS top_child_disk_bytes FROM top QUALIFY row_number() OVER (PARTITION BY up ORDER BY disk_bytes DESC, path) = 1")
def top_children(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.subtree_sums(_line_files(spark, sf)).filter("top_child_path is not null").select(text("path").alias("path"), text("top_child_path").alias("top_child"), "top_child_disk_bytes")


@query(f"WITH {FILES_SQL} SELECT path, CASE WHEN path LIKE '/s1_' OR path IN ('/s2') THEN 'fan_out' END AS collapse_reason, disk_bytes FROM dirs WHERE path NOT LIKE '/s1_/q%' AND path NOT LIKE '/s2/q%'".replace("path LIKE '/s1_' OR path IN ('/s2')", "path IN (SELECT path FROM dirs WHERE path <> '/' AND path <> '/s3' AND dir_count >= 3)").replace("path NOT LIKE '/s1_/q%' AND path NOT LIKE '/s2/q%'", "split_part(path, '/q', 1) = path OR split_part(path, '/q', 1) NOT IN (SELECT path FROM dirs WHERE path <> '/' AND path <> '/s3' AND dir_count >= 3)"))
def collapsed_directories(spark: SparkSession, sf: str) -> DataFrame:
    got = rollup.collapse(rollup.subtree_sums(_line_files(spark, sf)), ["none"], 3, ["/s3"])
    return got.select(text("path").alias("path"), "collapse_reason", "disk_bytes")


@query("SELECT page_id, url, CASE WHEN regexp_matches(rtrim(url, '/'), '/') THEN regexp_extract(rtrim(url, '/'), '^(.*)/[^/]*$', 1) END AS parent, len(string_split(url, '/')) AS parts, starts_with(url, 'https://') AS secure, lower(hex(encode(url))) AS hexed FROM pages".replace("hex(encode(url))", "hex(CAST(url AS BLOB))"))
def path_functions(spark: SparkSession, sf: str) -> DataFrame:
    p = ad.table(spark, sf, "pages").withColumn("b", F.encode("url", "UTF-8"))
    t = paths.to_text(F.col("b"))
    return p.select("page_id", "url", text(paths.parent(F.col("b"))).alias("parent"), F.size(paths.ancestors_t(t, proper=False)).cast("long").alias("parts"), paths.under_t(t, F.lit("https:/")).alias("secure"), paths.hex_path(F.col("b")).alias("hexed"))


_UNITS = "['B', 'kB', 'MB', 'GB', 'KiB', 'MiB']"
_FACTORS = "[1, 1000, 1000000, 1000000000, 1024, 1048576]"


@query(f"SELECT o_orderkey, CAST(trunc(round(o_totalprice, 2) * ({_FACTORS})[CAST(o_orderkey % 6 AS INT) + 1]) AS BIGINT) AS parsed FROM orders")
def size_texts(spark: SparkSession, sf: str) -> DataFrame:
    o = ad.table(spark, sf, "orders")
    unit = F.element_at(F.array(*map(F.lit, ("B", "kB", "MB", "GB", "KiB", "MiB"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    written = F.concat(F.round("o_totalprice", 2).cast("decimal(20,2)").cast("string"), unit, F.when(F.col("o_orderkey") % 2 == 0, " (60%)").otherwise(""))
    return o.select("o_orderkey", values.parse_size(written).alias("parsed"))


@query(
    "SELECT o_orderkey, CASE WHEN b < 1024 THEN b::VARCHAR || ' B' WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1f MiB', b / 1048576.0) ELSE printf('%.1f GiB', b / 1073741824.0) END AS human FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * (o_orderkey % 100) AS b FROM orders)"
)
def human_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return ad.table(spark, sf, "orders").select("o_orderkey", values.humanize_bytes(ad.cents("o_totalprice") * (F.col("o_orderkey") % 100)).alias("human"))


@query("SELECT event_type AS category, count(*) AS entry_count, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_bytes, CAST(sum(CASE WHEN user_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE 0 END) AS BIGINT) AS reclaimable_bytes FROM events GROUP BY 1")
def cache_usage(spark: SparkSession, sf: str) -> DataFrame:
    e = ad.table(spark, sf, "events")
    line = F.concat(F.lit('{"ID": "'), F.col("event_id").cast("string"), F.lit('", "Size": "'), F.get_json_object("props", "$.k"), F.lit('", "Reclaimable": "'), (F.col("user_id") % 2 == 0).cast("string"), F.lit('"}'))
    rows = parsers.cache_entries(e.select("event_type", line.alias("value")))
    size = F.coalesce("size_bytes", F.lit(0).cast("long"))
    return rows.groupBy(F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("entry_count"), F.sum(size).alias("total_bytes"), F.sum(F.when(F.col("reclaimable"), size).otherwise(0)).alias("reclaimable_bytes"))


@query("SELECT o_custkey AS pid, 'u' || CAST(o_custkey % 7 AS VARCHAR) AS command, CAST(o_orderkey AS VARCHAR) AS fd, CAST(round(o_totalprice) AS BIGINT) AS size_bytes, '/d/' || CAST(o_orderkey AS VARCHAR) AS path FROM orders")
def open_files(spark: SparkSession, sf: str) -> DataFrame:
    o = ad.table(spark, sf, "orders")
    one = F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit("\0tREG\0s"), F.round("o_totalprice").cast("bigint").cast("string"), F.lit("\0n/d/"), F.col("o_orderkey").cast("string"), F.lit(" (deleted)\0\n"))
    per = o.groupBy("o_custkey").agg(F.array_join(F.collect_list(one), "").alias("files"))
    value = F.concat(F.lit("p"), F.col("o_custkey").cast("string"), F.lit("\0cu"), (F.col("o_custkey") % 7).cast("string"), F.lit("\0\n"), "files")
    return parsers.open_files(per.select(F.col("o_custkey").alias("output"), value.alias("value"))).select("pid", "command", "fd", "size_bytes", "path")


_MOUNT_KINDS = ["ext4", "xfs", "overlay", "autofs", "bpf", "cgroup", "mqueue", *values.SKIPPED_FILESYSTEMS]
# Spelt out, so that the oracle doesn't follow the list it checks.
_SKIPPED_SQL = "('proc', 'sysfs', 'devtmpfs', 'devpts', 'tmpfs', 'cgroup2', 'pstore', 'securityfs', 'debugfs', 'tracefs', 'configfs', 'fusectl')"


@query(
    f"""WITH s AS (SELECT *, {_MOUNT_KINDS!r}[CAST(s_suppkey % {len(_MOUNT_KINDS)} AS INT) + 1] AS kind FROM supplier)
SELECT s_suppkey AS mount_id, s_nationkey AS parent_id, '/m ntA#\\9/' || s_name AS mount_point, kind AS filesystem_type, CASE WHEN kind = 'overlay' THEN 'skipped_overlay' WHEN kind = 'nsfs' THEN 'skipped_nsfs' WHEN kind IN {_SKIPPED_SQL} THEN 'skipped_filesystem' ELSE 'included' END AS verdict,
       CASE WHEN kind IN ('overlay', 'nsfs') THEN kind || ' mount skipped by default' WHEN kind IN {_SKIPPED_SQL} THEN kind || ' skipped by default mount policy' ELSE kind || ' included' END AS reason, s_suppkey % 3 = 0 AS in_scope FROM s"""
)
def mount_tables(spark: SparkSession, sf: str) -> DataFrame:
    s = ad.table(spark, sf, "supplier")
    kind = F.element_at(F.array(*map(F.lit, _MOUNT_KINDS)), (F.col("s_suppkey") % len(_MOUNT_KINDS) + 1).cast("int"))
    line = F.concat(F.col("s_suppkey").cast("string"), F.lit(" "), F.col("s_nationkey").cast("string"), F.lit(" 8:1 / /m\\040nt\\101\\043\\1349/"), F.replace(F.col("s_name"), F.lit(" "), F.lit("\\040")), F.lit(" rw,nosuid shared:1 - "), kind, F.lit(" /dev/x rw"))
    got = parsers.parse_mountinfo(s.select(line.alias("value")))
    verdict = values.mount_verdict(F.col("filesystem_type"), [], [])
    point = F.when(F.col("mount_id") % 3 == 0, F.concat(F.lit("/srv/"), F.col("mount_id").cast("string"))).otherwise("/srvx")
    return got.select(
        "mount_id", F.col("parent_id").cast("int").alias("parent_id"), text("mount_point").alias("mount_point"), "filesystem_type", verdict.alias("verdict"), values.mount_reason(F.col("filesystem_type"), verdict).alias("reason"),
        values.mount_in_scope(point, F.col("mount_id"), "/srv", None).alias("in_scope"),
    )


@query(
    """WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 9000 AS BIGINT) AS s, CAST(round(o_totalprice * 100) AS BIGINT) AS n, o_orderkey % 5 AS k, o_orderkey % 2 AS m FROM orders)
SELECT o_orderkey, CASE WHEN s < 60 THEN printf('%.1fs', CAST(s AS DOUBLE)) WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm' || CAST(s % 60 AS VARCHAR) || 's' ELSE CAST(s // 3600 AS VARCHAR) || 'h' || CAST(s % 3600 // 60 AS VARCHAR) || 'm' || CAST(s % 60 AS VARCHAR) || 's' END AS duration,
       CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 1000000 THEN printf('%.1fk', n / 1e3) WHEN n < 1000000000 THEN printf('%.1fM', n / 1e6) ELSE printf('%.1fB', n / 1e9) END AS counted,
       CASE WHEN k >= 3 AND m = 0 THEN 'high' WHEN k >= 2 THEN 'medium' ELSE 'low' END AS confidence, CASE k WHEN 0 THEN 'permission_denied' WHEN 1 THEN 'missing_path' WHEN 2 THEN 'not_a_directory' ELSE 'os_error' END AS error_kind,
       CASE WHEN k = 0 AND m = 0 THEN 'running' WHEN k = 0 THEN 'failed' ELSE 'complete' END AS status, CASE WHEN s > 0 THEN round((10000 - s) * 8.0 / s, 6) END AS eta_seconds,
       CASE WHEN k % 2 = 0 THEN greatest(s - 600, 0) ELSE s END AS age_seconds FROM o"""
)
def value_functions(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    s, k, m = key % 9000, key % 5, key % 2
    names = F.element_at(F.array(*map(F.lit, ("PermissionError", "FileNotFoundError", "NotADirectoryError", "OSError", "Other"))), (k + 1).cast("int"))
    start = F.timestamp_seconds(F.lit(1_700_000_000).cast("long"))
    return ad.table(spark, sf, "orders").select(
        "o_orderkey", values.humanize_duration(s.cast("double")).alias("duration"), values.humanize_count(ad.cents("o_totalprice")).alias("counted"), values.confidence(k, m).alias("confidence"), values.error_kind(names).alias("error_kind"),
        values.status(F.when(k == 0, "failed").otherwise("complete"), F.when(m == 1, "x")).alias("status"), F.round(values.eta_seconds(s.cast("double"), F.lit(10000.0), F.lit(8.0)), 6).alias("eta_seconds"),
        values.age_seconds(F.timestamp_seconds(F.unix_seconds(start) + s), F.timestamp_seconds(F.unix_seconds(start) + F.when(k % 2 == 0, 600).otherwise(0))).alias("age_seconds"),
    )


@query(f"WITH {TREND_SQL}, r AS (SELECT row_number() OVER (ORDER BY gross_growth DESC, net DESC, path) AS rank, path FROM tr WHERE path <> '/' ORDER BY rank LIMIT 30), up AS (SELECT l.path, l.rank, max_by(a.path, length(a.path)) FILTER (a.rank < l.rank) AS chain_parent FROM r l LEFT JOIN r a ON starts_with(l.path, a.path || '/') GROUP BY 1, 2) SELECT path, rank, chain_parent, CASE WHEN chain_parent IS NOT NULL AND path IN (SELECT chain_parent FROM up) THEN 'intermediate' WHEN chain_parent IS NOT NULL THEN 'leaf' WHEN path IN (SELECT chain_parent FROM up WHERE chain_parent IS NOT NULL) THEN 'ancestor' ELSE 'standalone' END AS role FROM up")
def contributors(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("root_path").orderBy(F.desc("gross_growth"), F.desc("net"), "path")
    ranked = _event_trends(spark, sf, 1000).filter(text("path") != "/").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 30")
    return frontier.contributor_roles(ranked.select("root_path", "path", "rank")).select(text("path").alias("path"), "rank", text("chain_parent").alias("chain_parent"), "role")


@query("""WITH d AS (
  SELECT '/c' || CAST(o_custkey AS VARCHAR) AS path, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + 1 AS BIGINT) AS f, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS disk_bytes FROM orders GROUP BY ALL
), iv AS (SELECT *, lead(f) OVER (PARTITION BY path ORDER BY f) AS t FROM d), ids AS (SELECT unnest(range(1, 2557)) AS id)
SELECT CAST(id AS BIGINT) AS snapshot_id, count(*) AS paths, CAST(sum(disk_bytes) AS BIGINT) AS disk_bytes FROM ids JOIN iv ON f <= id AND (t IS NULL OR id < t) WHERE id % 3 <> 0 GROUP BY id""")
def interval_days(spark: SparkSession, sf: str) -> DataFrame:
    """One root and thousands of snapshots: each customer's last order as its state, counted out for two of three days."""
    day = (F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")) + 1).cast("long")
    rows = ad.table(spark, sf, "orders").groupBy(F.concat(F.lit("/c"), F.col("o_custkey").cast("string")).cast("binary").alias("path"), day.alias("valid_from_snapshot_id")).agg(F.max(ad.cents("o_totalprice")).alias("disk_bytes"))
    after = F.lead("valid_from_snapshot_id").over(Window.partitionBy("path").orderBy("valid_from_snapshot_id"))
    iv = rows.withColumn("root_path", F.lit("/")).withColumn("valid_to_snapshot_id", after)
    snaps = spark.range(1, 2557).filter("id % 3 <> 0").select("id", F.lit("/").alias("root_path"), F.lit("complete").alias("status"))
    none = iv.limit(0).select(F.lit(0).cast("long").alias("snapshot_id"), "root_path", "path", "disk_bytes")
    return intervals.snapshot_state(iv, none, snaps).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("paths"), F.sum("disk_bytes").alias("disk_bytes"))


@query("""WITH a AS (SELECT DISTINCT '/c' || CAST(o_custkey AS VARCHAR) AS path FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT DISTINCT '/c' || CAST(o_custkey AS VARCHAR) AS path FROM orders UNION SELECT '/p' || CAST(l_partkey AS VARCHAR) FROM lineitem)
SELECT row_number() OVER (ORDER BY path) AS id, path FROM a
UNION ALL SELECT (SELECT count(*) FROM a) + row_number() OVER (ORDER BY path), path FROM b WHERE path NOT IN (SELECT path FROM a)""")
def path_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Ids after two batches of paths and the first batch again."""
    o = ad.table(spark, sf, "orders")
    path = lambda df, c, k: df.select(F.concat(F.lit(f"/{k}"), F.col(c).cast("string")).cast("binary").alias("path"))
    first, all_ = path(o.filter("o_orderstatus = 'F'"), "o_custkey", "c"), path(o, "o_custkey", "c").unionByName(path(ad.table(spark, sf, "lineitem"), "l_partkey", "p"))
    got = spark.createDataFrame([], dictionary.SCHEMA)
    for batch in (first, all_, first):
        got = dictionary.extend(got, batch)
    return got.select("id", text("path").alias("path"))


_DIR_MOUNTS = [(0, "8:0", "ext4", "/"), (1, "8:1", "xfs", "/x"), (2, "8:1", "xfs", "/x"), (3, "0:3", "tmpfs", "/t"), (4, "8:4", "ext4", "/y")]
_DIRS_SQL = """c AS (SELECT c_custkey AS k, n_nationkey AS n, n_regionkey AS r, c_custkey % 50 AS b FROM customer JOIN nation ON c_nationkey = n_nationkey),
dirs AS (
  SELECT '/' AS path, CAST(NULL AS VARCHAR) AS up, 0 AS device, 0 AS inode, 0 AS mount_id
  UNION SELECT '/r' || r, '/', r % 2, 100 + r, r % 3 FROM c
  UNION SELECT '/r' || r || '/n' || n, '/r' || r, r % 2, 200 + n, CASE WHEN n % 3 = 0 THEN n % 5 ELSE r % 3 END FROM c
  UNION SELECT '/r' || r || '/n' || n || '/b' || b, '/r' || r || '/n' || n, CASE WHEN b % 9 = 0 THEN 1 ELSE r % 2 END, CASE WHEN b % 10 = 0 THEN 100 + r ELSE 1000 + n * 50 + b END, CASE WHEN b % 4 = 0 THEN b % 5 WHEN b % 4 = 1 THEN NULL ELSE 4 END FROM c
  UNION SELECT '/r' || r || '/n' || n || '/b' || b || '/k' || k, '/r' || r || '/n' || n || '/b' || b, r % 2, CASE WHEN k % 11 = 0 THEN 200 + n ELSE 10000 + k END, CASE WHEN k % 7 = 0 THEN 4 WHEN k % 7 = 1 THEN 0 END FROM c
), m(mount_id, mm, kind, point) AS (VALUES """ + ", ".join(f"({i}, '{mm}', '{k}', '{p}')" for i, mm, k, p in _DIR_MOUNTS) + """),
e AS (SELECT dirs.*, kind, CASE WHEN kind IS NOT NULL THEN mm || point END AS sign FROM dirs LEFT JOIN m USING (mount_id))"""


@query(f"""WITH RECURSIVE {_DIRS_SQL}, walk AS (
  SELECT path, 'root' AS verdict, CAST(NULL AS VARCHAR) AS reason, true AS ok, device AS root_device, mount_id, sign, [mount_id] AS ids, [sign] AS signs, [device || ':' || inode] AS keys FROM e WHERE path = '/'
  UNION ALL
  SELECT path, verdict, CASE verdict WHEN 'skipped_filesystem' THEN kind || ' skipped by default mount policy' WHEN 'separate_filesystem' THEN 'separate filesystem skipped by one-filesystem policy (root st_dev ' || root_device || ', child st_dev ' || device || ')'
           WHEN 'mount_cycle' THEN 'bind mount cycle detected for mount_id ' || mount_id WHEN 'directory_cycle' THEN 'bind mount cycle detected for device/inode ' || device || ':' || inode ELSE coalesce(kind || ' included', 'no mount classification available') END,
         verdict = 'included', root_device, mount_id, sign, list_append(ids, mount_id), list_append(signs, sign), list_append(keys, device || ':' || inode)
  FROM (SELECT e.*, root_device, ids, signs, keys, CASE WHEN kind = 'tmpfs' THEN 'skipped_filesystem' WHEN e.device <> root_device THEN 'separate_filesystem'
      WHEN e.mount_id IS NOT NULL AND NOT coalesce(e.mount_id = walk.mount_id AND e.sign = walk.sign, false) AND (list_contains(ids, e.mount_id) OR list_contains(signs, e.sign)) THEN 'mount_cycle'
      WHEN list_contains(keys, e.device || ':' || e.inode) THEN 'directory_cycle' ELSE 'included' END AS verdict FROM walk JOIN e ON e.up = walk.path WHERE walk.ok)
)
SELECT e.path, coalesce(verdict, 'unreached') AS verdict, reason FROM e LEFT JOIN walk USING (path)""")
def descend_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Each directory of a tree of customers with its verdict, over mounts that repeat and inodes that come again below themselves."""
    return descend.descend_verdicts(_customer_dirs(spark, sf), one_filesystem=True).select(text("path").alias("path"), "verdict", "reason")


def _customer_dirs(spark: SparkSession, sf: str) -> DataFrame:
    c = ad.table(spark, sf, "customer").join(ad.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("c_custkey").cast("long").alias("k"), F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"), (F.col("c_custkey") % 50).cast("long").alias("b"))
    levels = [
        ("concat('/r', r)", "r % 2", "100 + r", "r % 3"), ("concat('/r', r, '/n', n)", "r % 2", "200 + n", "if(n % 3 = 0, n % 5, r % 3)"),
        ("concat('/r', r, '/n', n, '/b', b)", "if(b % 9 = 0, 1, r % 2)", "if(b % 10 = 0, 100 + r, 1000 + n * 50 + b)", "case b % 4 when 0 then b % 5 when 1 then null else 4 end"),
        ("concat('/r', r, '/n', n, '/b', b, '/k', k)", "r % 2", "if(k % 11 = 0, 200 + n, 10000 + k)", "case k % 7 when 0 then 4 when 1 then 0 end"),
    ]
    rows = spark.createDataFrame([("/", 0, 0, 0)], "t string, device long, inode long, mount_id long")
    for t, device, inode, mount in levels:
        rows = rows.unionByName(c.selectExpr(f"{t} as t", f"cast({device} as long) as device", f"cast({inode} as long) as inode", f"cast({mount} as long) as mount_id").distinct())
    m = spark.createDataFrame([(i, mm, k, bytearray(b"/"), bytearray(p.encode())) for i, mm, k, p in _DIR_MOUNTS], "mount_id long, major_minor string, filesystem_type string, mount_root binary, mount_point binary")
    return rows.join(F.broadcast(m), "mount_id", "left").select(F.lit("/").alias("root_path"), paths.to_bytes(F.col("t")).alias("path"), "device", "inode", "mount_id", "filesystem_type", "major_minor", "mount_root", "mount_point")


LINK_CAP = 500


@query(f"""WITH f AS (
  SELECT '/s' || l_suppkey % 20 AS d1, CASE WHEN l_linenumber = 1 AND l_orderkey % 5 = 0 THEN NULL ELSE '/q' || l_suppkey % 3 END AS d2, '/f' || l_orderkey || '.' || l_linenumber AS nm, l_partkey AS inode, l_orderkey % 4 = 0 AS lone FROM lineitem
), e AS (
  SELECT d1, coalesce(d1 || d2, d1) AS up, d1 || coalesce(d2, '') || nm AS path, replace(d1 || coalesce(d2, '') || nm, '/', chr(1)) AS key, inode, lone FROM f
), firsts AS (SELECT inode, min(key) AS first FROM e WHERE NOT lone GROUP BY inode),
late AS (SELECT inode FROM (SELECT *, row_number() OVER (ORDER BY first) AS n FROM firsts) WHERE n > {LINK_CAP}),
o AS (SELECT *, NOT lone AND inode IN (SELECT inode FROM late) AS over FROM e), stops AS (SELECT up, min(key) AS stop FROM o WHERE over GROUP BY up),
s AS (SELECT o.*, coalesce(key > own.stop, false) OR (o.up <> d1 AND coalesce(replace(o.up, '/', chr(1)) > top.stop, false)) AS skipped FROM o LEFT JOIN stops own ON own.up = o.up LEFT JOIN stops top ON top.up = d1)
SELECT up AS directory, count(*) FILTER (NOT skipped) AS seen, count(*) FILTER (skipped) AS skipped, min(path) FILTER (over AND NOT skipped) AS stopped_at FROM s GROUP BY up""")
def link_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as files whose parts are inodes; beyond LINK_CAP inodes directories are given up."""
    li = ad.table(spark, sf, "lineitem")
    low = F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 5 == 0), "").otherwise(F.concat(F.lit("/q"), (F.col("l_suppkey") % 3).cast("string")))
    t = F.concat(F.lit("/s"), (F.col("l_suppkey") % 20).cast("string"), low, F.lit("/f"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    files = li.select(t.alias("t"), F.when(F.col("l_orderkey") % 4 == 0, 1).otherwise(2).cast("long").alias("nlink"), F.col("l_partkey").cast("long").alias("inode"), F.lit("file").alias("kind"))
    dirs = paths.directories_t(files, "t").select("t", F.lit(1).cast("long").alias("nlink"), F.lit(0).cast("long").alias("inode"), F.lit("directory").alias("kind"))
    rows = files.unionByName(dirs).select(F.lit("/").alias("root_path"), paths.to_bytes(F.col("t")).alias("path"), "kind", "nlink", F.lit(1).cast("long").alias("device"), "inode")
    got = links.link_limit(rows, LINK_CAP)
    stops = links.abandoned(got).select(text("directory").alias("directory"), text("path").alias("stopped_at"))
    sums = got.filter("kind = 'file'").groupBy(text(paths.parent(F.col("path"))).alias("directory")).agg(F.count_if(~F.col("skipped")).alias("seen"), F.count_if("skipped").alias("skipped"))
    return sums.join(stops, "directory", "left").select("directory", "seen", "skipped", "stopped_at")


# Filesystems out of suppliers: what they hold, which part of them is indexed and what they report follow rules on ids.
_FS_SQL = """h AS (SELECT l_suppkey AS s, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) * 1000 AS BIGINT) AS held, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber WHEN l_returnflag = 'A' THEN -l_linenumber ELSE 0 END) AS BIGINT) AS grown FROM lineitem GROUP BY 1),
x AS (SELECT s, '8:' || s || CASE WHEN s % 11 = 0 THEN '|/|overlay|overlay' ELSE '|/|ext4|/dev/s' || s END AS domain, CASE WHEN s % 11 = 0 THEN 0 ELSE held END AS disk, held * (6 + s % 7) // 8 AS used, s % 13 <> 0 AND s % 17 <> 0 AS known, CASE WHEN s % 13 <> 0 AND s % 17 = 0 THEN 'statvfs failed' END AS failed,
      s % 4 = 0 AS wide, s % 5 = 0 AS part, CASE WHEN s % 3 = 0 THEN 0 ELSE grown END AS growth FROM h),
y AS (SELECT *, used * (20 + s % 9) // 20 AS total, s % 11 = 0 AND known AS alias, CASE WHEN NOT known THEN 0 WHEN s % 11 = 0 THEN 0 ELSE greatest(used - disk, 0) END AS under, CASE WHEN NOT known OR s % 11 = 0 THEN 0 ELSE greatest(disk - used, 0) END AS over FROM x),
z AS (SELECT *, known AND under > 0 AND under >= 1073741824 AND under / CAST(used AS DOUBLE) >= 0.05 AS gap, CASE WHEN known AND total <> 0 THEN used / CAST(total AS DOUBLE) END AS share FROM y WHERE NOT alias)"""
_LADDER_SQL = """c AS (SELECT min_by(l_returnflag, l_returnflag) AS category, arg_min(r, l_returnflag) AS r FROM (SELECT l_returnflag, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_quantity END) AS BIGINT) AS r FROM lineitem GROUP BY 1) WHERE r <> 0),
o AS (SELECT {open} AS open_bytes {of}),
w AS (SELECT z.*, NOT gap AND known AND over > 0 AS skew, gap AND ((NOT wide AND NOT part) OR coalesce(open_bytes, 0) > 0) AS held_open, category, r FROM z, c, o),
f AS (SELECT *, list_filter([CASE WHEN NOT known THEN 'evidence: live filesystem stat unavailable (' || coalesce(failed, 'unavailable') || '); indexed totals shown without a df comparison' END,
  CASE WHEN known THEN 'evidence: df used ' || used || ' bytes vs indexed visible ' || disk || ' bytes' END, CASE WHEN known THEN printf('evidence: filesystem usage ratio %.3f', share) END,
  CASE WHEN gap THEN 'likely reason: ' || under || ' bytes of filesystem usage are not attributed to indexed directories' END, CASE WHEN gap AND wide THEN 'likely reason: indexed roots cover only part of the filesystem; the remainder may be outside scanned scope' END,
  CASE WHEN gap AND part THEN 'likely reason: selected snapshot evidence is non-complete; remainder cannot confirm deleted-open files alone' END, CASE WHEN held_open THEN 'likely reason: deleted-but-open files may still hold the missing space' END,
  CASE WHEN skew THEN 'evidence: indexed totals exceed df used by ' || over || ' bytes (snapshot skew or stale index)' END,
  CASE WHEN known AND NOT gap AND NOT skew AND share >= CAST(0.85 AS DOUBLE) THEN 'next check: filesystem is near capacity; consider evaluating an upgrade, data migration, or older-disk repurposing' END,
  CASE WHEN growth > 0 THEN 'evidence: recent growth ' || growth || ' bytes from report frontier' END, 'evidence: docker ' || category || ' reclaimable ' || r || ' bytes'], lambda x: x IS NOT NULL) AS fs,
  list_filter([CASE WHEN NOT known THEN 'df -h' END, CASE WHEN NOT known OR gap OR skew THEN 'df-vs-index --json' END, CASE WHEN held_open THEN 'deleted-open-files --json' END, 'docker-enrichment --json'], lambda x: x IS NOT NULL) AS cs,
  list_filter([CASE WHEN NOT known THEN 'filesystem_stat_unavailable' END, CASE WHEN gap THEN 'unattributed_usage' END, CASE WHEN gap AND wide THEN 'filesystem_scope_extends_beyond_indexed_roots' END, CASE WHEN gap AND part THEN 'partial_snapshot_evidence' END, CASE WHEN held_open THEN 'deleted_open_file_suspected' END,
  CASE WHEN skew THEN 'over_indexed_skew' END, CASE WHEN known AND NOT gap AND NOT skew AND share >= CAST(0.85 AS DOUBLE) THEN 'capacity_pressure' END], lambda x: x IS NOT NULL) AS hs FROM w)"""


def _supplier_filesystems(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections of df_index, growth by domain, reclaimable sizes by category)."""
    rows = ad.table(spark, sf, "lineitem")
    line = F.col("l_linenumber").cast("long")
    grown = F.when(F.col("l_returnflag") == "R", line).when(F.col("l_returnflag") == "A", -line).otherwise(0)
    s = rows.groupBy(F.col("l_suppkey").alias("s")).agg((F.sum(ad.cents("l_extendedprice")) * 1000).alias("held"), F.sum(grown).alias("disk_delta"))
    n, every = F.col("s").cast("string"), lambda k: F.col("s") % k == 0
    s = s.withColumn("domain", F.concat(F.lit("8:"), n, F.when(every(11), "|/|overlay|overlay").otherwise(F.concat(F.lit("|/|ext4|/dev/s"), n))))
    point = F.concat(F.lit("/m"), n)
    totals = s.select(
        "domain", F.when(every(11), F.lit(0).cast("long")).otherwise(F.col("held")).alias("disk_bytes"), F.array(F.when(every(4), F.concat(point, F.lit("/x"))).otherwise(point)).alias("roots"),
        F.when(every(5), F.array(F.lit("complete"), F.lit("partial"))).otherwise(F.array(F.lit("complete"))).alias("statuses"), F.lit(False).alias("clamped"),
    )
    usage = s.withColumn("used", F.expr("held * (6 + s % 7) div 8")).withColumn("total", F.expr("used * (20 + s % 9) div 20")).filter(~every(13)).select(
        "domain", point.alias("mount_point"), F.when(~every(17), F.col("total")).alias("total_bytes"), F.when(~every(17), F.col("total") - F.col("used")).alias("free_bytes"), F.when(every(17), "statvfs failed").alias("capture_error")
    )
    growth = s.filter(~every(3)).select(F.col("domain").alias("group_key"), "disk_delta")
    categories = rows.groupBy(F.col("l_returnflag").alias("category")).agg(F.sum(F.when(F.col("l_returnflag") == "A", 0).otherwise(F.col("l_quantity"))).cast("long").alias("reclaimable_bytes")).withColumn("position", F.col("category"))
    return reconcile.df_index(totals, usage), growth, categories


@query(f"WITH {_FS_SQL}, {_LADDER_SQL.format(open='CAST(NULL AS BIGINT)', of='')} SELECT domain, array_to_string(fs[1:5], chr(10)) AS facts, array_to_string(cs[1:5], chr(10)) AS next_checks, array_to_string(hs, chr(10)) AS hints, len(fs) > 5 AS truncated FROM f")
def pressure_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What is said of each filesystem, before the shortest summary is chosen."""
    found, growth, categories = _supplier_filesystems(spark, sf)
    rows = pressure.with_ladder(pressure.with_context(found.filter(~F.col("accounting_alias")), growth, None, categories))
    return rows.select("domain", F.array_join("facts", "\n").alias("facts"), F.array_join("next_checks", "\n").alias("next_checks"), F.array_join("hints.code", "\n").alias("hints"), "truncated")


@query(
    f"""WITH {_FS_SQL}, {_LADDER_SQL.format(open="CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT)", of="FROM lineitem")}
SELECT row_number() OVER (ORDER BY known DESC, under DESC, coalesce(share, 0) DESC, over DESC, domain) AS rank, domain, array_to_string(fs[1:5], chr(10)) AS facts, array_to_string(cs[1:5], chr(10)) AS next_checks, array_to_string(hs, chr(10)) AS hints, len(fs) > 5 AS truncated FROM f ORDER BY rank LIMIT 4"""
)
def pressure_summary(spark: SparkSession, sf: str) -> DataFrame:
    found, growth, categories = _supplier_filesystems(spark, sf)
    held_open = ad.table(spark, sf, "lineitem").agg(F.count(F.when(F.col("l_returnflag") == "N", 1)).alias("total_bytes"))
    rows, _ = pressure.pressure_summary(found, growth, held_open, categories)
    return rows.select(F.col("rank").cast("long").alias("rank"), "domain", F.array_join("facts", "\n").alias("facts"), F.array_join("next_checks", "\n").alias("next_checks"), F.array_join("hints.code", "\n").alias("hints"), "truncated")


_CHAINED_SQL = "(r.path <> {0}.path AND ({0}.path = '/' OR starts_with(r.path, {0}.path || '/') OR r.path = '/' OR starts_with({0}.path, r.path || '/')))"


@query(
    f"""WITH {ad.ORDERS_SQL}, r AS (SELECT snapshot_id, path, depth, row_number() OVER (PARTITION BY snapshot_id ORDER BY disk_bytes % 1009, path) AS rank FROM state), t AS (SELECT * FROM r WHERE rank = 1),
p1 AS (SELECT r.* FROM r JOIN t ON r.snapshot_id = t.snapshot_id AND (r.rank = 1 OR (r.path <> t.path AND (t.path = '/' OR starts_with(r.path, t.path || '/')))) QUALIFY row_number() OVER (PARTITION BY r.snapshot_id ORDER BY r.depth DESC, length(r.path) DESC, r.path DESC) = 1),
p2 AS (SELECT r.* FROM r JOIN p1 USING (snapshot_id) WHERE r.rank <> p1.rank AND NOT {_CHAINED_SQL.format("p1")} QUALIFY row_number() OVER (PARTITION BY r.snapshot_id ORDER BY r.rank) = 1),
p3 AS (SELECT r.* FROM r JOIN p1 USING (snapshot_id) JOIN p2 USING (snapshot_id) WHERE r.rank <> p1.rank AND r.rank <> p2.rank AND NOT {_CHAINED_SQL.format("p1")} AND NOT {_CHAINED_SQL.format("p2")} QUALIFY row_number() OVER (PARTITION BY r.snapshot_id ORDER BY r.rank) = 1)
SELECT snapshot_id, rank, path, 1 AS position FROM p1 UNION ALL SELECT snapshot_id, rank, path, 2 FROM p2 UNION ALL SELECT snapshot_id, rank, path, 3 FROM p3"""
)
def next_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The paths to look at next in each snapshot; ranks are spread, so that chains differ."""
    state, _ = orders_cube(spark, sf)
    rank = F.row_number().over(Window.partitionBy("snapshot_id").orderBy(F.col("disk_bytes") % 1009, "path"))
    got = antichain.next_paths(state.select("snapshot_id", "path", "depth", rank.cast("long").alias("rank")), ["snapshot_id"])
    return got.select("snapshot_id", "rank", text("path").alias("path"), "position")
