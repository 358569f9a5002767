import json
import threading
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from pathledger.model import ReportError
from pathledger.plans import render, reports
from pathledger.sources import config, inventory, parsers
from pathledger.sources.store import Store
from pathledger.streaming import snapshots as live

from .test_engine import state


def test_mountinfo(spark):
    lines = ["29 24 0:42 / /tmp/with\\040space\\134x rw,nosuid,nodev - tmpfs tmpfs rw,size=1024k,inode64", "broken line", ""]
    a, b = parsers.parse_mountinfo(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert bytes(a["mount_point"]) == b"/tmp/with space\\x" and a["mount_id"] == 29 and a["filesystem_type"] == "tmpfs" and a["options"] == ["rw", "nosuid", "nodev"] and not a["malformed"]
    assert b["malformed"] and b["mount_id"] is None


def test_json_usage(spark):
    rows = ['{"Type": "Images", "TotalCount": "3", "Active": "1", "Size": "20GB", "Reclaimable": "12GB (60%)"}', "not json", '[{"Type": "Volumes", "TotalCount": 2, "Active": 0, "Size": "500MB", "Reclaimable": "400MB (80%)"}]']
    got = parsers.usage_categories(spark.createDataFrame([(x,) for x in rows], "value string")).collect()
    assert {(r["category"], r["total_count"], r["size_bytes"], r["reclaimable_bytes"]) for r in got} == {("Images", 3, 20 * 10**9, 12 * 10**9), ("Volumes", 2, 500 * 10**6, 400 * 10**6)}
    g = 1 << 30
    cache = [f'{{"ID": "a", "Size": {3 * g}, "Reclaimable": true}}', f'{{"ID": "b", "Size": "{2 * g}", "Reclaimable": false}}', f'{{"ID": "c", "Size": {g}, "Reclaimable": true}}']
    t = parsers.cache_totals(parsers.cache_entries(spark.createDataFrame([(x,) for x in cache], "value string"))).first()
    assert tuple(t) == (3, 6 * g, 4 * g)


def test_open_files(spark):
    text = "p1059\0g1059\0cuv\0u1000\0\nftxt\0tREG\0s56286648\0n/home/example/.local/bin/uv (deleted)\0\np5301\0cfish\0\nf4\0tREG\0s20971551\0n/tmp/etterminal.log (deleted)\0\n"
    df = parsers.open_files(spark.createDataFrame([(1, text)], "output int, value string"))
    assert {tuple(r)[1:] for r in df.collect()} == {(1059, "uv", "txt", "REG", 56286648, "/home/example/.local/bin/uv"), (5301, "fish", "4", "REG", 20971551, "/tmp/etterminal.log")}
    shown, totals = parsers.open_file_totals(df, 1)
    assert shown.first()["pid"] == 1059 and tuple(totals.first()) == (2, 77258199, True)


def test_open_files_of_one_large_output(spark, tmp_path):
    """One file read in many parts gives what the same text gives as one row."""
    text = "".join(f"p{p}\0cc{p % 7}\0\n" + "".join(f"f{k}\0tREG\0s{p * k}\0n/d/{p}/{k} (deleted)\0\n" for k in range(p % 40)) for p in range(1, 400))
    (tmp_path / "out").write_text(text)
    one = parsers.open_files(spark.createDataFrame([("x", text)], "output string, value string"))
    want = sorted(tuple(r)[1:] for r in one.collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", 16384)
    try:
        fields = parsers.field_rows(spark, str(tmp_path / "out"))
        assert fields.rdd.getNumPartitions() > 3
        got = parsers.open_fields(fields).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(tuple(r)[1:] for r in got) == want and len(want) == sum(p % 40 for p in range(1, 400))
    brute = sorted((p, f"c{p % 7}", str(k), "REG", p * k, f"/d/{p}/{k}") for p in range(1, 400) for k in range(p % 40))
    assert want == brute


def test_deadline_stops_its_own_jobs_alone(spark):
    slow = "select sum(sqrt(id) * sin(id)) from range(0, {}, 1, 2)"
    got = {}

    def run(name, n, seconds):
        try:
            if seconds:
                with reports.deadline(spark, seconds):
                    spark.sql(slow.format(n)).collect()
            else:
                spark.sql(slow.format(n)).collect()
            got[name] = "done"
        except ReportError as e:
            got[name] = e.code

    jobs = [threading.Thread(target=run, args=a) for a in (("late", 10**12, 1.0), ("free", 10**7, None), ("early", 10**5, 60.0))]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join(60)
    assert got == {"late": "query_timeout", "free": "done", "early": "done"}
    with reports.deadline(spark, 60):
        pass
    assert spark.range(3).count() == 3 and not spark.sparkContext.getJobTags()


def test_config():
    c = config.parse_config('exclude_paths = ["/x//y/"]\n[[roots]]\npath = "/srv/"\n[collapse]\nnames = ["a"]\nnever = ["/srv/k"]\n')
    assert c.roots == ["/srv"] and c.exclude_paths == ["/x/y"] and c.collapse.names == ["a"]
    for bad in ("", "roots = [1]", 'roots = ["/a", "/a"]', 'roots = ["a"]', "x = "):
        with pytest.raises(ReportError):
            config.parse_config(bad)


def test_capacity(spark):
    got = inventory.capacity(spark, [b"/", b"/no/such/place"]).collect()
    assert got[0]["total_bytes"] > 0 and got[1]["capture_error"] and got[1]["total_bytes"] is None


def rows(spark, sizes):
    return state(spark, [(0, p, d) for p, d in sizes.items()]).drop("snapshot_id", "root_path")


def test_store_reports_and_prune(spark, tmp_path):
    with pytest.raises(ReportError):
        Store(spark, str(tmp_path / "none"))
    store = Store(spark, str(tmp_path / "s"), create=True)
    store.record("/srv", rows(spark, {"/srv": 100, "/srv/a": 60, "/srv/b": 40}), "2026-06-01T00:00:00Z", "2026-06-01T00:01:00Z", "complete")
    store.record("/srv", rows(spark, {"/srv": 150, "/srv/a": 110, "/srv/b": 40}), "2026-06-02T00:00:00Z", "2026-06-02T01:00:00Z", "complete")
    store.record("/srv", rows(spark, {"/srv": 170, "/srv/a": 130, "/srv/b": 40}), "2026-06-03T00:00:00Z", "2026-06-03T01:00:00Z", "partial")
    iv = sorted((bytes(r["path"]), r["valid_from_snapshot_id"], r["valid_to_snapshot_id"] or 0) for r in store.table("intervals").collect())
    assert iv == [(b"/srv", 1, 2), (b"/srv", 2, 0), (b"/srv/a", 1, 2), (b"/srv/a", 2, 0), (b"/srv/b", 1, 0)]
    r = reports.Reports(store)
    top = r.top()
    assert [x["path"] for x in top["rows"]] == [b"/srv".hex(), b"/srv/a".hex(), b"/srv/b".hex()] and top["snapshots"][0]["id"] == 3
    d = r.diff("24h")
    assert [x["path"] for x in d["frontier"]] == [b"/srv/a".hex()] and d["frontier"][0]["suppressed_ancestor_count"] == 1
    assert {w["code"] for w in d["warnings"]} == {"partial_snapshot"}
    assert "frontier path=/srv/a" in render.diff_text(d) and json.loads(reports.to_json(d))
    assert r.report("24h")["frontier_totals"][0]["disk_delta"] == 20
    assert r.explain_path(b"/srv", "24h")["residual"] == 0
    assert r.snapshots()["snapshots"][0]["path_count"] == 3 and r.deleted("24h")["deleted"] == []
    got = r.investigate("14d")
    assert got["contributors"][0]["shape"] == "steady_growth" and got["next_paths"] == ["/srv/a", "/srv/b"]
    assert [b["code"] for b in got["blind_spots"]] == ["partial_snapshot_evidence"] and {c["confidence"] for c in got["contributors"]} == {"high"}
    with pytest.raises(ReportError) as e:
        reports.Reports(store, 0.01).snapshots()
    assert e.value.code == "query_timeout"
    for code, ask in (("path_outside_roots", lambda: r.explain_path(b"/etc", "24h")), ("invalid_since", lambda: r.diff("x")), ("invalid_group_by", lambda: r.diff("1h", group_by="x"))):
        with pytest.raises(ReportError) as e:
            ask()
        assert e.value.code == code and reports.error_payload(e.value)["error"]["code"] == code
    before = {(x["snapshot_id"], bytes(x["path"]), x["disk_bytes"]) for x in store.state().collect()}
    assert r.prune(datetime(2026, 6, 30, tzinfo=UTC)) == {"retained": 2, "removed": 1}
    assert {(x["snapshot_id"], bytes(x["path"]), x["disk_bytes"]) for x in store.state().collect()} == {x for x in before if x[0] != 3}
    assert r.prune(datetime(2026, 6, 30, tzinfo=UTC))["removed"] == 0 and r.vacuum()["versions_removed"] > 0
    assert store.state().count() == 6
    assert "id" in render.table(r.snapshots()["snapshots"], ["id", "status"])


def test_stream_of_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    events = [(datetime(2026, 1, 1, h, 5), bytearray(p.encode()), n, n) for h, p, n in ((1, "/srv/a/x", 5), (1, "/srv/b", 3), (2, "/srv/a/x", 7), (9, "/srv/a", 1))]
    spark.createDataFrame(events, "ts timestamp, path binary, disk_bytes long, apparent_bytes long").coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema("ts timestamp, path binary, disk_bytes long, apparent_bytes long").parquet(src)
    whole = live.to_memory(live.window_sums(read()), "sums")
    got = {(r["window_start"].hour, bytes(r["path"])): r["disk_bytes"] for r in whole.collect()}
    assert got[1, b"/srv"] == 8 and got[2, b"/srv/a"] == 7 and got[9, b"/"] == 1
    store = Store(spark, str(tmp_path / "s"), create=True)
    live.promote_stream(live.window_sums(read()).filter(F.col("window_end") == F.lit("2026-01-01 02:00:00").cast("timestamp")), store, "/", str(tmp_path / "cp")).awaitTermination()
    assert store.table("snapshots").count() == 1 and store.state().filter(F.col("path") == F.lit(b"/srv")).first()["disk_bytes"] == 8
    three = Store(spark, str(tmp_path / "three"), create=True)
    hours = spark.createDataFrame([(datetime(2026, 1, 1, h, 5), bytearray(b"/srv/a"), h, h) for h in (1, 2, 3, 9)], "ts timestamp, path binary, disk_bytes long, apparent_bytes long")
    hours.coalesce(1).write.parquet(str(tmp_path / "hours"))
    sums = lambda: live.window_sums(spark.readStream.schema(hours.schema).parquet(str(tmp_path / "hours")))
    live.promote_stream(sums(), three, "/", str(tmp_path / "cp2")).awaitTermination()
    snaps = sorted(three.table("snapshots").collect(), key=lambda r: r["id"])
    assert [r["finished_at"][11:13] for r in snaps] == ["02", "03", "04"] and all(r["error"] is None and r["notes"] for r in snaps)
    per = sorted((r["snapshot_id"], bytes(r["path"]), r["disk_bytes"]) for r in three.state().collect())
    assert per == [(k, p, k) for k in (1, 2, 3) for p in (b"/", b"/srv", b"/srv/a")]
    again = three.record("/", rows(spark, {"/": 5}), "x", "x", "complete", notes=snaps[0]["notes"], once=True)
    assert again == 1 and three.table("snapshots").count() == 3


def test_two_writers_of_a_store(spark, tmp_path):
    import threading

    a, b = Store(spark, str(tmp_path / "s"), create=True), Store(spark, str(tmp_path / "s"))
    write = lambda s, root: s.record(root, rows(spark, {root: 1}), "2026-06-01T00:00:00Z", "2026-06-01T00:01:00Z", "complete")
    both = [threading.Thread(target=write, args=x) for x in ((a, "/p"), (b, "/q"))]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert sorted(r["root_path"] for r in a.table("snapshots").collect()) == ["/p", "/q"] and a.state().count() == 2
    with a.lock(), pytest.raises(ReportError), b.lock(wait_seconds=0.2):
        pass


def test_llm_is_optional():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "pathledger"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text())


def test_open_files_of_a_row_equal_its_fields_and_need_no_shuffle(spark):
    texts = ["", "\0", "n/early\0f1\0n/none (deleted)\0", "p1\0ca\0cb\0fcwd\0n/x\0n/y\0s5\0sx\0tREG\0\n\np2\0n/head\0f7\0cz\0\nn/z (deleted) (deleted)\0", "px\0cq\0f\0n\0p\0f\0s9\0", None]
    df = spark.createDataFrame(list(enumerate(texts)), "output int, value string")
    got = parsers.open_files(df)
    fields = df.select("output", F.posexplode(F.split("value", "\0")).alias("pos", "field"))
    want = sorted(map(tuple, parsers.open_fields(fields).collect()), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) == 6
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
