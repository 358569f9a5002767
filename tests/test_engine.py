"""Known cases of the snapshot engine."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pathledger.functions import paths, values
from pathledger.model import ReportError, RetentionPolicy, parse_depth, parse_limit
from pathledger.operators import diff, domains, frontier, grouping, intervals, reconcile, retention, rollup, selection, trends

STATE = "snapshot_id long, root_path string, path binary, parent_path binary, depth int, apparent_bytes long, disk_bytes long, file_count long, dir_count long, error string, collapsed boolean, collapse_reason string, collapsed_dirs long, top_child_path binary, top_child_disk_bytes long"


def up(p):
    return None if p in (b"/", b"") else (p.rsplit(b"/", 1)[0] or b"/")


def state(spark, rows, root="/srv"):
    """(snapshot, path, disk[, apparent[, collapsed]])"""
    out = []
    for r in rows:
        sid, p, disk, apparent, folded = (*r, *(r[2], False)[len(r) - 3 :])
        p = p if isinstance(p, bytes) else p.encode()
        depth = 0 if p == root.encode() else p.count(b"/") - (root.rstrip("/").count("/"))
        out.append((sid, root, bytearray(p), bytearray(up(p)) if depth and up(p) else None, depth, apparent, disk, 0, 0, None, folded, None, None, None, None))
    return spark.createDataFrame(out, STATE)


def snapshots(spark, rows):
    """(id, root, status, finished_at)"""
    return spark.createDataFrame([(i, f, f, root, s, None, None) for i, root, s, f in rows], "id long, started_at string, finished_at string, root_path string, status string, notes string, error string")


def pair(spark, a, b, root="/srv"):
    return spark.createDataFrame([(root, a, b)], "root_path string, baseline_snapshot_id long, current_snapshot_id long")


BEFORE = {"/srv": 200, "/srv/grow": 40, b"/srv/bad-\xff-dir": 10, "/srv/same": 30, "/srv/gone": 20, "/srv/shrink": 60}
AFTER = {"/srv": 255, "/srv/grow": 90, b"/srv/bad-\xff-dir": 55, "/srv/new": 25, "/srv/same": 30, "/srv/shrink": 10}


def test_diff_classes_and_order(spark):
    s = state(spark, [(1, p, d) for p, d in BEFORE.items()] + [(2, p, d) for p, d in AFTER.items()])
    got = [(bytes(r["path"]), r["classification"], r["disk_delta"]) for r in diff.ordered(diff.snapshot_diff(s, pair(spark, 1, 2))).collect()]
    assert got == [
        (b"/srv", "grown", 55), (b"/srv/grow", "grown", 50), (b"/srv/bad-\xff-dir", "grown", 45), (b"/srv/new", "created", 25), (b"/srv/same", "unchanged", 0), (b"/srv/gone", "deleted", -20), (b"/srv/shrink", "shrunk", -50)
    ]
    top = diff.top_rows(s, spark.createDataFrame([(2,)], "snapshot_id long"), 3).orderBy("rank").collect()
    assert [bytes(r["path"]) for r in top] == [b"/srv", b"/srv/grow", b"/srv/bad-\xff-dir"]


def test_pairs_share_snapshots_and_sides(spark):
    s = state(spark, [(1, "/srv", 10), (1, "/srv/a", 4), (2, "/srv", 12), (2, "/srv/b", 3), (3, "/srv", 12), (3, "/srv/a", 5), (3, "/srv/b", 1)])
    pairs = pair(spark, 1, 2).union(pair(spark, 2, 3)).union(pair(spark, 2, 2)).union(pair(spark, 1, 9)).union(pair(spark, 1, 2, "/other"))
    d = diff.snapshot_diff(s, pairs).collect()
    got = {(r["baseline_snapshot_id"], r["current_snapshot_id"], bytes(r["path"])): (r["classification"], r["disk_delta"]) for r in d}
    assert len(d) == len(got) and {r["root_path"] for r in d} == {"/srv"}
    assert got == {
        (1, 2, b"/srv"): ("grown", 2), (1, 2, b"/srv/a"): ("deleted", -4), (1, 2, b"/srv/b"): ("created", 3),
        (2, 3, b"/srv"): ("unchanged", 0), (2, 3, b"/srv/a"): ("created", 5), (2, 3, b"/srv/b"): ("shrunk", -2),
        (2, 2, b"/srv"): ("unchanged", 0), (2, 2, b"/srv/b"): ("unchanged", 0), (1, 9, b"/srv"): ("deleted", -10), (1, 9, b"/srv/a"): ("deleted", -4),
    }
    assert diff.snapshot_diff(s.limit(0), pairs).count() == 0 and diff.snapshot_diff(s, pairs.limit(0)).count() == 0


def test_deleted_below_a_folded_directory_is_hidden(spark):
    s = state(spark, [(1, "/srv", 200), (1, "/srv/cache", 80), (1, "/srv/cache/packages", 60), (1, "/srv/gone", 20), (2, "/srv", 100), (2, "/srv/cache", 80, 80, True)])
    d = diff.snapshot_diff(s, pair(spark, 1, 2))
    kinds = {bytes(r["path"]): r["classification"] for r in d.collect()}
    assert kinds[b"/srv/cache/packages"] == "hidden_by_collapse" and kinds[b"/srv/gone"] == "deleted"
    assert [bytes(r["path"]) for r in diff.deleted_rows(d, 9).collect()] == [b"/srv/gone"]
    assert [bytes(r["path"]) for r in diff.explain_rows(d, b"/srv/cache/other").collect()] == [b"/srv/cache"]
    with pytest.raises(ReportError, match="no such path"):
        diff.explain_rows(d, b"/srv/absent")


def grown(spark, rows):
    """(root, baseline, current, path, delta)"""
    data = [(r, a, b, bytearray(p.encode()), 0 if p == "/" else p.count("/"), "grown" if d > 0 else "shrunk", d, d) for r, a, b, p, d in rows]
    return spark.createDataFrame(data, "root_path string, baseline_snapshot_id long, current_snapshot_id long, path binary, depth int, classification string, disk_delta long, apparent_delta long")


def test_frontier_cases(spark):
    rows = [("/", 1, 2, p, d) for p, d in (("/", 100), ("/var", 96), ("/var/lib/containerd", 20), ("/var/log", -10), ("/tmp", 60))]
    got = diff.ordered(frontier.growth_frontier(grown(spark, rows))).collect()
    assert [(bytes(r["path"]), r["suppressed_ancestor_count"], r["suppressed_descendant_count"]) for r in got] == [(b"/var", 1, 1), (b"/tmp", 0, 0)]
    rows = [("/srv", 10, 11, "/srv", 100), ("/srv", 10, 12, "/srv/cache", 120), ("/var", 10, 11, "/var", 120)]
    assert [bytes(r["path"]) for r in diff.ordered(frontier.growth_frontier(grown(spark, rows))).collect()] == [b"/srv/cache", b"/var", b"/srv"]


def greedy(rows):
    """The frontier by its plain rule, row after row."""
    cand = sorted(((d, p) for p, d in rows if d > 0), key=lambda x: (-x[0], -(0 if x[1] == "/" else x[1].count("/")), x[1]))
    above = lambda a, p: a != p and (a == "/" or p.startswith(a + "/"))
    gone, ups = set(), {}
    for d, p in cand:
        low = [(e, q) for e, q in cand if above(p, q) and e >= 0.95 * d]
        if low:
            gone.add(p)
            ups[low[0][1]] = ups.get(low[0][1], 0) + 1
    kept, downs = [], {}
    for d, p in cand:
        if p in gone:
            continue
        over = [q for e, q in kept if above(q, p) and d < 0.95 * e]
        if over:
            downs[over[0]] = downs.get(over[0], 0) + 1
        else:
            kept.append((d, p))
    return {(p, ups.get(p, 0), downs.get(p, 0)) for _, p in kept}


def test_frontier_is_the_greedy_one_on_random_trees(spark):
    rng = random.Random(8)
    rows, trees = [], {}
    for k in range(40):
        names = {"/"} | {"/" + "/".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 9))}
        trees[k] = [(p, rng.choice([-5, 1, 20, 95, 96, 100, 100])) for p in sorted(names)]
        rows += [("/", k, 0, p, d) for p, d in trees[k]]
    got = {}
    for r in frontier.growth_frontier(grown(spark, rows)).collect():
        got.setdefault(r["baseline_snapshot_id"], set()).add((bytes(r["path"]).decode(), r["suppressed_ancestor_count"], r["suppressed_descendant_count"]))
    for k in trees:
        assert got.get(k, set()) == greedy(trees[k]), trees[k]


@pytest.mark.parametrize(("extra", "limit", "depth", "want", "left"), [
    ([("/srv/cache/b", 40)], 1, 2, ["/srv/cache/a"], 60), ([("/srv/cache/b", 40)], 9, 0, [], 160), ([("/srv/cache/b", 80), ("/srv/cache/c", 40)], 2, 2, ["/srv/cache/a", "/srv/cache/a/leaf"], 60),
])
def test_explanations(spark, extra, limit, depth, want, left):
    rows = grown(spark, [("/srv", 1, 2, p, d) for p, d in [("/srv/cache", 160), ("/srv/cache/a", 100), ("/srv/cache/a/leaf", 100), *extra]])
    shown, rest = frontier.explain_breakdown(rows, b"/srv/cache", limit, depth)
    assert [bytes(r["path"]).decode() for r in shown.orderBy("position").collect()] == want and rest.first()[0] == left


def test_pairs_and_warnings(spark):
    s = snapshots(spark, [
        (1, "/srv", "complete", "2026-06-12T18:00:00Z"), (2, "/srv", "complete", "2026-06-13T12:00:00Z"), (3, "/srv", "failed", "2026-06-13T18:00:00Z"), (4, "/srv", "partial", "2026-06-13T19:00:00Z"),
        (5, "/var", "complete", "2026-06-12T20:00:00Z"), (6, "/var", "complete", "2026-06-13T21:00:00Z"), (7, "/opt", "complete", "2026-06-13T21:00:00"), (8, "/new", "complete", "2026-06-13T01:00:00+02:00"), (9, "/new", "complete", "2026-06-13T02:00:00Z"), (10, "/run", "failed", None),
    ])
    pairs, warnings = selection.resolve_pairs(s, values.parse_since("24h"))
    assert {(r[0], r[1], r[2]) for r in pairs.collect()} == {("/srv", 1, 4), ("/var", 5, 6), ("/new", 8, 9)}
    assert {(r["code"], r["root_path"], r["snapshot_id"]) for r in warnings.collect()} == {
        ("failed_snapshot_excluded", "/srv", 3), ("partial_snapshot", "/srv", 4), ("invalid_snapshot_timestamp", "/opt", 7), ("insufficient_same_root_snapshots", "/opt", None), ("baseline_before_since_unavailable", "/new", 8),
        ("running_snapshot_excluded", "/run", 10), ("insufficient_same_root_snapshots", "/run", None),
    }
    assert [r["id"] for r in selection.latest_snapshots(s).collect()] == [9, 7, 4, 6]
    for code, choose in (("invalid_snapshot_id", "x"), ("snapshot_not_found", "99")):
        with pytest.raises(ReportError) as e:
            selection.select_snapshots(s, choose)
        assert e.value.code == code


def mounts(spark, rows, sid=1):
    return spark.createDataFrame([(i, sid, i, 0, mm, bytearray(b"/"), bytearray(p.encode()), kind, src) for i, (p, mm, kind, src) in enumerate(rows)], "seq long, snapshot_id long, mount_id long, parent_id long, major_minor string, root binary, mount_point binary, filesystem_type string, mount_source string")


def test_domain_totals_through_gaps(spark):
    s = state(spark, [(1, "/a", 1000, 900), (1, "/a/b/c", 300, 250)], root="/a")
    m = mounts(spark, [("/a", "8:1", "ext4", "/dev/domainA"), ("/a/b/c", "8:17", "xfs", "/dev/domainC")])
    snaps = snapshots(spark, [(1, "/a", "complete", "2026-06-12T18:00:00Z")])
    got = domains.domain_totals(s, snaps, m).collect()
    assert [(r["domain"], r["disk_bytes"], r["apparent_bytes"]) for r in got] == [("8:1|/|ext4|/dev/domainA", 700, 650), ("8:17|/|xfs|/dev/domainC", 300, 250)]
    usage = spark.createDataFrame([("8:1|/|ext4|/dev/domainA", "/", 10 << 30, 4 << 30, None), ("8:17|/|xfs|/dev/domainC", "/a/b/c", None, None, "gone")], "domain string, mount_point string, total_bytes long, free_bytes long, capture_error string")
    rows = reconcile.ranked_sections(reconcile.df_index(domains.domain_totals(s, snaps, m), usage), 9).collect()
    assert rows[0]["unattributed_bytes"] == (6 << 30) - 700 and rows[0]["hints"] == ["unattributed_usage", "filesystem_scope_extends_beyond_indexed_roots"]
    assert rows[1]["hints"] == ["filesystem_stat_unavailable"]


def test_groups(spark):
    s = state(spark, [(1, "/srv", 9), (1, "/srv/a/x", 5), (1, "/srv/ab", 4), (1, "/other", 1)])
    m = mounts(spark, [("/srv/a", "8:2", "xfs", "x"), ("/srv/a", "9:9", "late", "y")])
    by = lambda g: {bytes(r["path"]).decode(): (r["group_key"], r["group_warning"]) for r in grouping.with_group(s, g, m).collect()}
    assert by("top-level-subtree") == {"/srv": (".", None), "/srv/a/x": ("a", None), "/srv/ab": ("ab", None), "/other": (None, "path_outside_root")}
    assert by("mount") == {"/srv": (None, "unknown_mount"), "/srv/a/x": ("/srv/a", None), "/srv/ab": (None, "unknown_mount"), "/other": (None, "path_outside_root")}
    assert by("storage-domain")["/srv/a/x"][0] == "8:2|/|xfs|x"
    with pytest.raises(ReportError):
        grouping.with_group(s, "owner", m)


SHAPES = [
    ([1000, 1010, 1020, 1030, 1040], "steady_growth"), ([0, 1000, 1010, 1005], "one_time_jump"), ([0, 1000, 1000, 1500, 1500], "bursty_growth"), ([100, 1000, 200], "grow_then_clean"), ([1000] * 4, "stable_large"), ([0, 1000], "unknown_insufficient_samples")
]


def test_shapes(spark):
    day = datetime(2026, 8, 1, tzinfo=UTC)
    rows = [("/", bytearray(f"/{k}".encode()), i, day + timedelta(days=i), v, 2 * v) for k, (series, _) in enumerate(SHAPES) for i, v in enumerate(series)]
    df = spark.createDataFrame(rows, "root_path string, path binary, snapshot_id long, finished_at timestamp, disk_bytes long, apparent_bytes long")
    got = {bytes(r["path"]): r for r in trends.trend_metrics(df, spark.createDataFrame([("/", 6)], "root_path string, expected long")).collect()}
    for k, (_, shape) in enumerate(SHAPES):
        assert got[f"/{k}".encode()]["shape"] == shape
    first = got[b"/0"]
    assert (first["net"], first["gross_growth"], first["gross_loss"], first["daily_slope"], first["volatility"], first["missing_count"]) == (40, 40, 0, 10.0, 0.0, 1)
    assert got[b"/5"]["daily_slope"] is None and got[b"/4"]["last_growth_at"] is None and got[b"/3"]["peak_bytes"] == 1000


def test_intervals_round_trip_and_promote(spark):
    rng = random.Random(3)
    snaps = snapshots(spark, [(i, "/srv", "partial" if i % 5 == 0 else "complete", f"2026-06-{i:02d}T00:00:00Z") for i in range(1, 12)])
    rows = [(i, f"/srv/{p}", rng.randint(1, 2)) for i in range(1, 12) for p in "abcd" if rng.random() < 0.7]
    s = state(spark, rows)
    iv = intervals.compress(s, snaps)
    back = intervals.snapshot_state(iv, s, snaps)
    key = lambda df: sorted((r["snapshot_id"], bytes(r["path"]), r["disk_bytes"]) for r in df.collect())
    assert key(back) == key(s)
    grown_ = spark.createDataFrame([], iv.schema)
    for i in (1, 2, 3, 4):
        grown_ = intervals.promote(grown_, s.filter(F.col("snapshot_id") == i), "/srv", i)
    want = intervals.compress(s, snaps.filter("id <= 4"))
    shown = lambda df: sorted((bytes(r["path"]), r["valid_from_snapshot_id"], r["valid_to_snapshot_id"] or 0, r["disk_bytes"]) for r in df.collect())
    assert shown(grown_) == shown(want) == shown(intervals.promote(grown_, s.filter("snapshot_id = 4"), "/srv", 4))


def test_retention_and_new_bounds(spark):
    now = datetime(2026, 6, 17, 12, tzinfo=UTC)
    day = lambda n: (now - timedelta(days=n)).strftime("%Y-%m-%dT%H:%M:%SZ")
    cases = [
        ("alpha", "complete", day(1), 1), ("alpha", "partial", day(7), 0), ("alpha", "failed", day(12), 0), ("alpha", "complete", "2026-05-20T09:00:00Z", 0), ("alpha", "complete", "2026-05-20T18:00:00Z", 1), ("alpha", "failed", "2026-05-20T23:00:00Z", 0),
        ("alpha", "partial", "2026-05-15T00:00:00Z", 0), ("alpha", "complete", "2026-04-01T00:00:00Z", 1), ("alpha", "complete", "2026-01-05T00:00:00Z", 0), ("alpha", "complete", "2026-01-28T00:00:00Z", 1), ("alpha", "failed", "2026-01-30T00:00:00Z", 0),
        ("alpha", "partial", "2025-12-10T00:00:00Z", 0), ("beta", "complete", "2026-05-20T01:00:00Z", 1), ("beta", "complete", "2026-01-20T00:00:00Z", 1), ("beta", "failed", day(2), 0),
    ]
    s = snapshots(spark, [(i, "/" + root, status, at) for i, (root, status, at, _) in enumerate(cases)])
    kept = retention.retained(s, now)
    ids = {r["id"] for r in kept.collect()}
    assert ids == {i for i, c in enumerate(cases) if c[3]}
    assert {r["id"] for r in retention.retained(s.join(kept, "id", "left_semi"), now).collect()} == ids
    iv = spark.createDataFrame([("/r", bytearray(b"/r/a"), 1, 2, 1), ("/r", bytearray(b"/r/a"), 2, 3, 2), ("/r", bytearray(b"/r/a"), 3, None, 3)], "root_path string, path binary, valid_from_snapshot_id long, valid_to_snapshot_id long, disk_bytes long")
    got = retention.rebound(iv, spark.createDataFrame([("/r", 1), ("/r", 3)], "root_path string, id long"))
    assert sorted((r[2], r[3] or 0, r[4]) for r in got.collect()) == [(1, 3, 1), (3, 0, 3)]
    with pytest.raises(ReportError):
        RetentionPolicy(0, 1, 1)


def test_rollup_links_and_folds(spark, tmp_path):
    from pathledger.sources.inventory import inventory

    (tmp_path / "a/x").mkdir(parents=True)
    (tmp_path / "a-b").mkdir()
    (tmp_path / "node_modules/deep").mkdir(parents=True)
    (tmp_path / "a/x/one").write_bytes(b"1" * 5000)
    (tmp_path / "a-b/two").hardlink_to(tmp_path / "a/x/one")
    (tmp_path / "node_modules/deep/three").write_bytes(b"3" * 100)
    e = inventory(spark, str(tmp_path))
    rows = {bytes(r["path"]).decode().removeprefix(str(tmp_path)): r for r in rollup.subtree_sums(e).collect()}
    disk = {p: r["disk_bytes"] for p, r in rows.items()}
    block = (tmp_path / "a/x/one").stat().st_blocks * 512
    own = lambda p: (tmp_path / p).lstat().st_blocks * 512
    assert disk["/a/x"] == own("a/x") + block and disk["/a-b"] == own("a-b")  # the first of a walk has the bytes
    assert rows[""]["file_count"] == 3 and rows[""]["dir_count"] == 5 and rows[""]["apparent_bytes"] > 10100
    folded = {bytes(r["path"]).decode().removeprefix(str(tmp_path)): r for r in rollup.collapse(rollup.subtree_sums(e), ["node_modules"], 99).collect()}
    assert folded["/node_modules"]["collapse_reason"] == "known_noise" and "/node_modules/deep" not in folded
    kept = rollup.collapse(rollup.subtree_sums(e), ["node_modules"], 99, [f"{tmp_path}/node_modules/deep"])
    assert kept.filter("collapsed").count() == 0


def test_path_functions(spark):
    ps = ["/", "/a", "/a/b/", "/srv/a", "/srv/ab", "plain", ""]
    df = spark.createDataFrame([(p, bytearray(p.encode())) for p in ps], "t string, b binary")
    parents = {r[0]: r[1] for r in df.select("t", paths.parent_t(F.col("t"))).collect()}
    assert parents == {"/": None, "/a": "/", "/a/b/": "/a", "/srv/a": "/srv", "/srv/ab": "/srv", "plain": None, "": None}
    assert [r[0] for r in df.filter(paths.under_t(F.col("t"), F.lit("/srv/a"))).collect()] == ["/srv/a"]
    raw = spark.createDataFrame([(bytearray(b"/srv/bad-\xff\x80-dir/x"),)], "b binary")
    assert [bytes(r[1]) for r in paths.with_ancestors(raw, "b", "up").collect()] == [b"/", b"/srv", b"/srv/bad-\xff\x80-dir"]


def test_values(spark):
    sizes = {"20GB": 20 * 10**9, "12GB (60%)": 12 * 10**9, "7.451GB": 7451000000, "8.192kB": 8192, "1,024B": 1024, "2KiB": 2048, "x": None, "5XB": None}
    got = {r[0]: r[1] for r in spark.createDataFrame([(s,) for s in sizes], "s string").select("s", values.parse_size(F.col("s"))).collect()}
    assert got == sizes
    one = spark.range(1)
    shown = one.select(values.humanize_bytes(F.lit(512)), values.humanize_bytes(F.lit(-1536)), values.humanize_count(F.lit(1500)), values.humanize_duration(F.lit(59.96)), values.humanize_duration(F.lit(3725.0)), values.eta_seconds(F.lit(0.0), F.lit(9.0), F.lit(3.0))).first()
    assert tuple(shown) == ("512 B", "-1.5 KiB", "1.5k", "60.0s", "1h2m5s", None)
    ties = one.select(values.humanize_bytes(F.lit(1280)), values.humanize_bytes(F.lit(1408)), values.humanize_count(F.lit(248850)), values.humanize_duration(F.lit(125.0)), values.humanize_bytes(F.lit(1023 * 1024))).first()
    assert tuple(ties) == ("1.2 KiB", "1.4 KiB", "248.8k", "2m5s", "1023.0 KiB")
    assert values.parse_since("7d") == 604800 and parse_limit() == 20 and parse_depth("0") == 0
    for f, bad in ((values.parse_since, "0h"), (values.parse_since, "5w"), (parse_limit, "0"), (parse_limit, 1001), (parse_depth, 21)):
        with pytest.raises(ReportError):
            f(bad)
