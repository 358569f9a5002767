import random

from pyspark.sql import functions as F

from pathledger.operators import antichain, pressure
from pathledger.operators.held import carried

G = 1 << 30
FOUND = "domain string, mount_point string, stat_available boolean, capture_error string, used_bytes long, disk_bytes long, unattributed_bytes long, unattributed_ratio double, over_indexed_bytes long, used_ratio double, scope_extends boolean, statuses array<string>, accounting_alias boolean"


def section(domain, used=0, disk=0, ratio=0.5, wide=False, statuses=("complete",), alias=False, known=True):
    under, over = max(used - disk, 0), max(disk - used, 0)
    if not known:
        return (domain, "/m", False, "gone", None, disk, None, None, None, None, wide, list(statuses), alias)
    return (domain, "/m", True, None, used, disk, under, under / used if used else None, over, ratio, wide, list(statuses), alias)


def test_ladder_of_each_kind(spark):
    rows = [section("a", 10 * G, 2 * G), section("b", 10 * G, 2 * G, wide=True, statuses=("complete", "partial")), section("c", 2 * G, 3 * G), section("d", G, G, 0.9), section("e", known=False), section("f", 10 * G, 10 * G - 5, 0.9)]
    found = spark.createDataFrame(rows, FOUND)
    got = {r["domain"]: r for r in pressure.with_ladder(pressure.with_context(found)).collect()}
    codes = {d: [h["code"] for h in r["hints"]] for d, r in got.items()}
    assert codes == {
        "a": ["unattributed_usage", "deleted_open_file_suspected"], "b": ["unattributed_usage", "filesystem_scope_extends_beyond_indexed_roots", "partial_snapshot_evidence"], "c": ["over_indexed_skew"],
        "d": ["capacity_pressure"], "e": ["filesystem_stat_unavailable"], "f": ["capacity_pressure"],
    }
    assert got["a"]["next_checks"] == [pressure.INDEX, pressure.OPEN] and got["e"]["next_checks"] == [pressure.DF, pressure.INDEX] and got["d"]["next_checks"] == []
    assert got["a"]["facts"][1] == "evidence: filesystem usage ratio 0.500" and "(gone)" in got["e"]["facts"][0] and not got["a"]["truncated"]


def test_summary_keeps_its_limits(spark):
    """Six sections, of which one is another name of its storage: four are shown, facts and checks are cut, of equal checks the first stays."""
    rows = [section("a", 10 * G, 2 * G, wide=True, statuses=("partial",)), section("b", 20 * G, 2 * G), section("c", 2 * G, 3 * G), section("d", G, G, 0.9), section("e", known=False), section("z", 90 * G, 0, alias=True)]
    found = spark.createDataFrame(rows, FOUND)
    growth = spark.createDataFrame([("a", 5), ("a", 2), ("b", -3), (None, 9)], "group_key string, disk_delta long")
    opened = spark.createDataFrame([(7,)], "total_bytes long")
    kinds = spark.createDataFrame([("Images", 0, 1), ("Volumes", 12, 2), ("Cache", 40, 3)], "category string, reclaimable_bytes long, position int")
    sections, summary = pressure.pressure_summary(found, growth, opened, kinds)
    got = sections.orderBy("rank").collect()
    assert [r["domain"] for r in got] == ["b", "a", "d", "c"] and [r["growth"] for r in got] == [-3, 7, 0, 0]
    assert len(got[1]["facts"]) == 5 and got[1]["truncated"] and got[0]["facts"][-1] == "evidence: docker Volumes reclaimable 12 bytes" and not got[0]["truncated"]
    assert "deleted_open_file_suspected" in [h["code"] for h in got[1]["hints"]]  # files held open are known apart from coverage
    s = summary.first()
    assert s["truncated_sections"] and s["next_checks"] == [pressure.INDEX, pressure.OPEN, pressure.DOCKER]
    assert s["hint_codes"][:2] == ["unattributed_usage", "deleted_open_file_suspected"]
    none, empty = pressure.pressure_summary(found.limit(0), growth.limit(0), opened.limit(0), kinds.limit(0))
    assert none.count() == 0 and empty.first()["next_checks"] == [] and not empty.first()["truncated_sections"]


def test_next_paths_by_brute_force(spark):
    r = random.Random(4)
    rows = []
    for scope in range(12):
        tree = {"/" + "/".join(r.choice("ab") for _ in range(r.randint(1, 4))) for _ in range(r.choice([1, 2, 12]))} | ({"/"} if scope % 2 else set())
        order = sorted(tree)
        r.shuffle(order)
        rows += [(scope, bytearray(p.encode()), 0 if p == "/" else p.count("/"), k) for k, p in enumerate(order, 1)]
    under = lambda a, b: a != b and (b == "/" or a.startswith(b + "/"))
    want = set()
    for scope in range(12):
        mine = [(k, p.decode(), d) for s, p, d, k in rows if s == scope]
        inside = [x for x in mine if under(x[1], mine[0][1])]
        chosen = [max(inside, key=lambda x: (x[2], len(x[1]), x[1]))] if inside else [mine[0]]
        for x in mine:
            if len(chosen) < 3 and x not in chosen and not any(under(x[1], c[1]) or under(c[1], x[1]) for c in chosen):
                chosen.append(x)
        want |= {(scope, c[1], k) for k, c in enumerate(chosen, 1)}
    df = spark.createDataFrame(rows, "scope int, path binary, depth int, rank long")
    assert {(x["scope"], bytes(x["path"]).decode(), x["position"]) for x in antichain.next_paths(df, ["scope"]).collect()} == want
    one = df.filter("scope = 3").drop("scope")
    assert {(bytes(x["path"]).decode(), x["position"]) for x in antichain.next_paths(one).collect()} == {w[1:] for w in want if w[0] == 3}
    assert antichain.next_paths(one.limit(0)).count() == 0


def test_carried_over_ranges(spark):
    """A value is handed on over ranges that have none, within its group alone; null groups count as one."""
    r = random.Random(1)
    rows = [(g, i, i if r.random() < 0.02 else None) for g in ("x", None, "y") for i in range(600 if g != "y" else 3)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    got = {(x["g"], x["i"]): x["last"] for x in carried(df, {"last": F.col("v")}, "i", ["g"]).collect()}
    for g in ("x", None, "y"):
        last = None
        for _, i, v in (x for x in rows if x[0] == g):
            last = v if v is not None else last
            assert got[g, i] == last
    assert len(got) == len(rows)
