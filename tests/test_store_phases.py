import time
from datetime import UTC, datetime

import pytest

from pathledger.model import STATE, RetentionPolicy
from pathledger.sources import store as store_module
from pathledger.sources.store import Store


def b(t):
    return bytearray(t.encode())


def rows(spark, sizes):
    names = STATE.replace("snapshot_id long, root_path string, ", "")
    values = [(b(p), b(p.rpartition("/")[0]) if p.count("/") > 1 else None, p.count("/") - 1, v, v, 1, 0, None, False, None, None, None, None) for p, v in sizes.items()]
    return spark.createDataFrame(values, names)


def states(store):
    return sorted((r["snapshot_id"], bytes(r["path"]).decode(), r["disk_bytes"]) for r in store.state().collect())


def test_a_writer_that_dies_leaves_no_state_and_goes_on(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), create=True)
    store.record("/srv", rows(spark, {"/srv": 10, "/srv/a": 10}), "2026-06-01T00:00:00Z", "2026-06-01T01:00:00Z", "complete")
    before = states(store)
    id_ = store.begin("/srv", "2026-06-02T00:00:00Z", "scan 2")
    assert id_ == 2 and store.add_batch(id_, 0, rows(spark, {"/srv": 30, "/srv/a": 10}))
    rows(spark, {"/srv/x": 1}).write.parquet(str(tmp_path / "s/pending-2/batch-1"))
    (tmp_path / "s/pending-2/batch-1/_SUCCESS").unlink()  # the second batch died half-way
    assert states(store) == before and store.table("snapshots").filter("status = 'running'").count() == 1
    again = Store(spark, str(tmp_path / "s"))
    assert again.begin("/srv", "2026-06-02T00:00:00Z", "scan 2") == id_
    assert not again.add_batch(id_, 0, rows(spark, {"/srv": 999})) and again.add_batch(id_, 1, rows(spark, {"/srv/b": 20}))
    again.vacuum()
    assert again.finalize(id_, "2026-06-02T01:00:00Z", "complete") and not again.finalize(id_, "2026-06-02T01:00:00Z", "complete")
    plain = Store(spark, str(tmp_path / "plain"), create=True)
    plain.record("/srv", rows(spark, {"/srv": 10, "/srv/a": 10}), "2026-06-01T00:00:00Z", "2026-06-01T01:00:00Z", "complete")
    plain.record("/srv", rows(spark, {"/srv": 30, "/srv/a": 10, "/srv/b": 20}), "2026-06-02T00:00:00Z", "2026-06-02T01:00:00Z", "complete", notes="scan 2")
    assert states(store) == states(plain)
    assert sorted(map(tuple, store.table("snapshots").collect())) == sorted(map(tuple, plain.table("snapshots").collect()))
    assert not (tmp_path / "s/pending-2").exists()
    part = store.begin("/srv", "2026-06-03T00:00:00Z", "scan 3")
    store.add_batch(part, 0, rows(spark, {"/srv": 5}))
    assert store.finalize(part, "2026-06-03T01:00:00Z", "partial") and (3, "/srv", 5) in states(store)


def test_removal_leaves_other_folders_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), create=True)
    for day in range(1, 7):
        for root in ("/srv", "/var"):
            if root == "/srv" or day >= 5:
                store.record(root, rows(spark, {root: 10 * day, f"{root}/a": 7, f"{root}/d{day}": day}), f"2026-06-{day:02}T00:00:00Z", f"2026-06-{day:02}T01:00:00Z", "complete")
    store.record("/srv", rows(spark, {"/srv": 1}), "2026-06-06T12:00:00Z", "2026-06-06T13:00:00Z", "partial")
    before, was = states(store), store._current()
    known = spark.createDataFrame([(b(p),) for p in ["/srv", "/srv/a", *[f"/srv/d{d}" for d in range(1, 7)]]], "path binary")
    assert store.orphans(known).count() == 0
    found = store.prune(datetime(2026, 6, 7, tzinfo=UTC), RetentionPolicy(2, 3, 48))
    now = store._current()
    kept = {r["id"] for r in store.table("snapshots").collect()}
    assert found["removed"] == 9 - len(kept) > 0 and states(store) == [x for x in before if x[0] in kept]
    assert set(was["diagnostics"]) == set(now["diagnostics"]) and set(was["intervals"]) & set(now["intervals"])
    assert store.folders_rewritten == len(set(was["intervals"]) - set(now["intervals"])) + len(set(was["open"].values()) - set(now["open"].values()))
    assert set(now["ids"]) == {f for n in ("intervals", "diagnostics") for f in store._folders(now, n)}
    gone = {bytes(r["path"]).decode() for r in store.orphans(known).collect()}
    assert gone == {f"/srv/d{d}" for d in range(1, 7)} - {p for _, p, _ in states(store)} and gone
    assert store.prune(datetime(2026, 6, 7, tzinfo=UTC), RetentionPolicy(2, 3, 48))["removed"] == 0 == store.folders_rewritten


def test_a_lock_is_taken_and_left_by_its_owner_alone(spark, tmp_path, monkeypatch):
    store, other = Store(spark, str(tmp_path / "s"), create=True), Store(spark, str(tmp_path / "s"))
    monkeypatch.setattr(store_module, "STALE_SECONDS", 0.2)
    with store.lock():
        time.sleep(0.5)
        with other.lock(1):  # the first is taken for dead
            monkeypatch.setattr(store_module, "STALE_SECONDS", 600)
            mine = other._read("lock")
            assert mine == other._owner
    # neither writer's end removed a lock that wasn't its own
    assert not (tmp_path / "s/lock").exists()
    monkeypatch.setattr(store_module, "STALE_SECONDS", 0.2)
    with store.lock():
        time.sleep(0.5)
        assert other._take_lock("newer")
    assert store._read("lock") == "newer"
    with pytest.raises(store_module.ReportError), monkeypatch.context() as m:
        m.setattr(store_module, "STALE_SECONDS", 600)
        with store.lock(0.2):
            pass
