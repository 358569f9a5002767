import random

from pyspark.sql import functions as F

from pathledger.operators import descend, dictionary, intervals, links, retention
from pathledger.operators.held import numbered

DIRS = "root_path string, path binary, device long, inode long, mount_id long, filesystem_type string, major_minor string, mount_root binary, mount_point binary"


def b(t):
    return bytearray(t.encode())


def dirs(spark, *rows):
    """(path, device, inode, mount id, kind, major:minor, mount point)"""
    return spark.createDataFrame([("/srv", b(p), d, i, m, k, mm, b("/") if m is not None else None, b(at) if m is not None else None) for p, d, i, m, k, mm, at in rows], DIRS)


def verdicts(df, **how):
    return {bytes(r["path"]).decode(): (r["verdict"], r["reason"]) for r in descend.descend_verdicts(df, **how).collect()}


def test_walk_stops_at_mounts_devices_and_cycles(spark):
    base = (1, "ext4", "8:1", "/srv")
    rows = dirs(
        spark, ("/srv", 1, 10, *base), ("/srv/a", 1, 11, *base), ("/srv/a/again", 1, 10, *base), ("/srv/a/again/below", 1, 99, *base), ("/srv/tmp", 1, 12, 5, "tmpfs", "0:5", "/srv/tmp"),
        ("/srv/tmp/x", 1, 13, 5, "tmpfs", "0:5", "/srv/tmp"), ("/srv/m", 2, 14, 2, "xfs", "8:2", "/srv/m"), ("/srv/m/back", 1, 15, *base), ("/srv/m/own", 2, 16, 2, "xfs", "8:2", "/srv/m"), ("/srv/m/own/twin", 2, 17, 9, "xfs", "8:1", "/srv"), ("/srv/u", 1, 18, None, None, None, None),
    )
    got = verdicts(rows)
    assert got["/srv"] == ("root", None) and got["/srv/a"] == ("included", "ext4 included") and got["/srv/u"] == ("included", "no mount classification available")
    assert got["/srv/a/again"] == ("directory_cycle", "bind mount cycle detected for device/inode 1:10") and got["/srv/a/again/below"] == ("unreached", None)
    assert got["/srv/tmp"][0] == "skipped_filesystem" and got["/srv/tmp/x"][0] == "unreached"
    assert got["/srv/m/back"] == ("mount_cycle", "bind mount cycle detected for mount_id 1") and got["/srv/m/own/twin"][0] == "mount_cycle"
    one = verdicts(rows, one_filesystem=True)
    assert one["/srv/m"] == ("separate_filesystem", "separate filesystem skipped by one-filesystem policy (root st_dev 1, child st_dev 2)") and one["/srv/m/own"][0] == "unreached"
    assert verdicts(rows, included=["tmpfs"])["/srv/tmp/x"][0] == "included_filesystem"
    assert verdicts(rows.limit(0)) == {}


def walk(entries, cap):
    """The same walk, entry by entry."""
    below = {}
    for e in entries:
        if e[0] != "/r":
            below.setdefault(e[0].rpartition("/")[0], []).append(e)
    seen, over, visited = set(), set(), set()

    def go(d):
        for path, kind, nlink, inode in sorted(below.get(d, []), key=lambda e: e[0].rpartition("/")[2].encode()):
            visited.add(path)
            if kind == "directory":
                go(path)
            elif nlink > 1 and inode not in seen:
                if len(seen) >= cap:
                    over.add(path)
                    return
                seen.add(inode)

    go("/r")
    return visited, over


def test_link_limit_equals_a_walk(spark):
    rng = random.Random(2)
    for cap in (0, 3, 12, 1000):
        names = {"/r": ("/r", "directory", 1, 0)}
        for _ in range(150):
            up = rng.choice([p for p, e in names.items() if e[1] == "directory" and p.count("/") < 5])
            p = f"{up}/{rng.choice('abcdefgh.-')}{rng.randrange(40)}"
            names.setdefault(p, (p, "directory" if rng.random() < 0.25 else "file", rng.choice([1, 2, 3]), rng.randrange(40)))
        entries = list(names.values())
        df = spark.createDataFrame([("/r", b(p), k, n, 1, i) for p, k, n, i in entries], "root_path string, path binary, kind string, nlink long, device long, inode long")
        got = links.link_limit(df, cap).cache()
        visited, over = walk(entries, cap)
        assert {bytes(r["path"]).decode() for r in got.collect() if r["over"]} == over
        assert {bytes(r["path"]).decode() for r in got.collect() if r["skipped"]} == set(names) - visited - {"/r"}
        assert links.abandoned(got).count() == len(over)


def test_dictionary_ids_are_stable_and_gapless(spark, tmp_path):
    d = dictionary.PathDictionary(spark, str(tmp_path / "d"))
    batch = lambda *ps: spark.createDataFrame([(b(p) if p is not None else None,) for p in ps], "path binary")
    assert d.add(batch("/b", "/a", None, "/b")) == 2 and d.add(batch("/a", "/c", "/0")) == 2 and d.add(batch("/c", "/b")) == 0 and d.add(batch()) == 0
    rows = {bytes(r["path"]).decode(): r["id"] for r in d.rows().collect()}
    assert rows == {"/a": 1, "/b": 2, "/0": 3, "/c": 4}
    coded = dictionary.encode(batch("/c", "/zz", "/a"), d.rows())
    assert sorted((r["path_id"] for r in coded.collect()), key=str) == [1, 4, None]
    back = dictionary.decode(coded.orderBy(F.desc("path_id")).limit(1), d.rows()).collect()
    assert [bytes(r["path"]) for r in back] == [b"/c"]


def test_places_over_ranges(spark):
    rows = [(x % 3, x * 7919 % 1000) for x in range(1000)] + [(None, 1), (None, 2)]
    got = numbered(spark.createDataFrame(rows, "g long, v long"), "n", ["v"], ["g"]).collect()
    for g in (0, 1, 2, None):
        own = sorted((r["n"], r["v"]) for r in got if r["g"] == g)
        assert [n for n, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own] == sorted(v for _, v in own)


def test_states_and_bounds_equal_a_comparison_of_all(spark):
    rng = random.Random(8)
    rows = []
    for root in ("/r", "/s"):
        for p in range(30):
            cuts = sorted(rng.sample(range(1, 60), rng.randint(2, 6)))
            rows += [(root, b(f"{root}/{p}"), a, z if rng.random() < 0.8 or z != cuts[-1] else None, rng.randrange(99)) for a, z in zip(cuts, cuts[1:], strict=False)]
    iv = spark.createDataFrame(rows, "root_path string, path binary, valid_from_snapshot_id long, valid_to_snapshot_id long, disk_bytes long")
    ids = {"/r": rng.sample(range(1, 60), 25), "/s": [7]}
    snaps = spark.createDataFrame([(i, r, "complete") for r, own in ids.items() for i in own], "id long, root_path string, status string")
    none = spark.createDataFrame([], "snapshot_id long, root_path string, path binary, disk_bytes long")
    got = sorted((r["snapshot_id"], bytes(r["path"]), r["disk_bytes"]) for r in intervals.snapshot_state(iv, none, snaps).collect())
    assert got == sorted((i, bytes(p), v) for root, p, a, z, v in rows for i in ids[root] if a <= i and (z is None or i < z))
    only = spark.createDataFrame([("/r", b("/r/3")), ("/r", b("/r/3")), ("/s", b("/s/4"))], "root_path string, path binary")
    some = sorted((r["snapshot_id"], bytes(r["path"])) for r in intervals.snapshot_state(iv, none, snaps, only).collect())
    assert some == sorted((i, p) for i, p, _ in got if p in (b"/r/3", b"/s/4"))
    plan = intervals.snapshot_state(iv, none, snaps)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    kept = snaps.select("root_path", "id")
    want = []
    for root, p, a, z, v in rows:
        inside = [i for i in ids[root] if i >= a and (z is None or i < z)]
        if inside:
            want.append((bytes(p), min(inside), min((i for i in ids[root] if i >= z), default=None) if z is not None else None, v))
    assert sorted(((bytes(r[1]), r[2], r[3], r[4]) for r in retention.rebound(iv, kept).collect()), key=str) == sorted(want, key=str)
