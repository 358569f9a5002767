"""Snapshots, intervals and samples as Parquet tables with versions, on any file system that Spark reaches.

A version is a small file that names the folders of each table; a commit writes new folders beside the
old ones, then renames the next version into place, so readers see a commit whole. A snapshot adds
folders of its own and rewrites only its root's open intervals. One writer at a time holds the lock file.
The version also has the least and greatest snapshot id that each folder mentions, so a removal reads and
rewrites only folders that may mention a removed snapshot.

A snapshot can be written in two phases: begin() shows it as running, add_batch() writes parts of it aside, each once,
and finalize() promotes them all in one commit. A writer that dies leaves no state; one that starts over goes on with the batches there are.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathledger.model import FILESYSTEMS, INTERVALS, MOUNTS, SNAPSHOTS, STATE, ReportError
from pathledger.operators import intervals as iv
from pathledger.operators import retention

TABLES = {"snapshots": SNAPSHOTS, "intervals": INTERVALS, "diagnostics": STATE, "mounts": MOUNTS, "filesystems": FILESYSTEMS}
STALE_SECONDS = 6 * 3600  # a lock older than this is that of a writer that died


class Store:
    """Tables in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, create: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        self._held = threading.RLock()
        self._depth, self._owner = 0, ""
        self.folders_rewritten = 0  #: by the last removal
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._fs.exists(self._at("")) or not self._versions():
            if not create:
                raise ReportError("database_error", f"no store at {path}")
            self._fs.mkdirs(self._at(""))
            self._point({})

    def _at(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str = "") -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))]

    def _versions(self) -> list[int]:
        return sorted(int(n[8:-5]) for n in self._names() if n.startswith("version-") and n.endswith(".json"))

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        out = self._fs.create(self._at(name), False)
        try:
            out.write(text.encode())
        finally:
            out.close()

    def _current(self) -> dict:
        return json.loads(self._read(f"version-{self._versions()[-1]}.json"))

    def _point(self, current: dict) -> None:
        new, to = f"next.{uuid.uuid4().hex}", f"version-{(self._versions() or [0])[-1] + 1}.json"
        self._write(new, json.dumps(current))
        if self._fs.exists(self._at(to)) or not self._fs.rename(self._at(new), self._at(to)):
            raise ReportError("operation_locked", "another writer committed first")

    def _take_lock(self, owner: str) -> bool:
        j = self.spark._jvm
        try:
            if self._fs.exists(self._at("lock")):
                age = time.time() - self._fs.getFileStatus(self._at("lock")).getModificationTime() / 1000
                if age < STALE_SECONDS:
                    return False
                # only one of several that find it stale can move it away; what it moved may be a newer one, which goes back
                aside = f"lock.{owner}"
                if not self._fs.rename(self._at("lock"), self._at(aside)):
                    return False
                if time.time() - self._fs.getFileStatus(self._at(aside)).getModificationTime() / 1000 < STALE_SECONDS:
                    self._fs.rename(self._at(aside), self._at("lock"))
                    return False
                self._fs.delete(self._at(aside), False)
            self._write("lock", owner)
            return self._read("lock") == owner
        except Exception as e:
            cause = getattr(e, "java_exception", None)
            if cause is not None and j.java.io.IOException().getClass().isInstance(cause):  # another writer was first, or has just left
                return False
            raise

    @contextmanager
    def lock(self, wait_seconds: float = 10_800) -> Iterator[None]:
        """Only one writer; others wait, then fail. A writer may take it again inside."""
        if not self._held.acquire(timeout=wait_seconds):
            raise ReportError("operation_locked", "another writer holds the store")
        try:
            if self._depth == 0:
                owner, end = uuid.uuid4().hex, time.monotonic() + wait_seconds
                while not self._take_lock(owner):
                    if time.monotonic() >= end:
                        raise ReportError("operation_locked", "another writer holds the store")
                    time.sleep(0.05)
                self._owner = owner
            self._depth += 1
            try:
                yield
            finally:
                self._depth -= 1
                if self._depth == 0 and self._fs.exists(self._at("lock")) and self._read("lock") == self._owner:
                    self._fs.delete(self._at("lock"), False)
        finally:
            self._held.release()

    @staticmethod
    def _folders(current: dict, name: str) -> list[str]:
        return current.get(name, []) + (list(current.get("open", {}).values()) if name == "intervals" else [])

    def _load(self, schema: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        return self._load(TABLES[name], self._folders(self._current(), name))

    def _save(self, name: str, df: DataFrame) -> str:
        at = f"{name}-{uuid.uuid4().hex}"
        df.select(*self.spark.createDataFrame([], TABLES[name]).columns).write.parquet(f"{self.path}/{at}")
        return at

    def _save_intervals(self, df: DataFrame) -> tuple[list[str], dict[str, str], dict[str, list[int]]]:
        """(folders of ended intervals, folder of each root's open ones, ids that each mentions), from one job and a count."""
        at = f"intervals-{uuid.uuid4().hex}"
        keyed = df.select(*self.spark.createDataFrame([], INTERVALS).columns, F.col("valid_to_snapshot_id").isNull().alias("_open"), F.md5(F.encode("root_path", "UTF-8")).alias("_root"))
        keyed.write.partitionBy("_open", "_root").parquet(f"{self.path}/{at}")
        found = {side: [n for n in self._names(f"{at}/_open={side}") if n.startswith("_root=")] if f"_open={side}" in self._names(at) else [] for side in ("false", "true")}
        ids: dict[str, list[int]] = {}
        if found["false"] or found["true"]:
            back = self.spark.read.schema(INTERVALS + ", _open boolean, _root string").parquet(f"{self.path}/{at}")
            lo, hi = F.min("valid_from_snapshot_id").alias("lo"), F.max(F.coalesce("valid_to_snapshot_id", "valid_from_snapshot_id")).alias("hi")
            ids = {f"{at}/_open={str(r['_open']).lower()}/_root={r['_root']}": [r["lo"], r["hi"]] for r in back.groupBy("_open", "_root").agg(lo, hi).collect()}
        return [f"{at}/_open=false/{n}" for n in found["false"]], {n[6:]: f"{at}/_open=true/{n}" for n in found["true"]}, ids

    def _ids(self, name: str, folder: str) -> list[int]:
        r = self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{folder}").agg(F.min("snapshot_id"), F.max("snapshot_id")).first()
        return [r[0], r[1]] if r[0] is not None else [0, -1]

    def commit(self, **tables: DataFrame) -> None:
        """Write tables anew; all of them show at once."""
        with self.lock():
            current = self._current()
            ids = current.setdefault("ids", {})
            for name, df in tables.items():
                if name == "intervals":
                    current["intervals"], current["open"], new = self._save_intervals(df)
                    ids |= new
                else:
                    current[name] = [self._save(name, df)]
                    if name != "snapshots":
                        ids[current[name][0]] = self._ids(name, current[name][0])
            self._point(self._tidy(current))

    def _tidy(self, current: dict) -> dict:
        """Without the ids of folders that it doesn't name."""
        live = {f for name in TABLES for f in self._folders(current, name)}
        return current | {"ids": {f: i for f, i in current.get("ids", {}).items() if f in live}}

    def state(self, snapshots: DataFrame | None = None) -> DataFrame:
        return iv.snapshot_state(self.table("intervals"), self.table("diagnostics"), self.table("snapshots") if snapshots is None else snapshots)

    def record(
        self, root_path: str, rows: DataFrame, started_at: str, finished_at: str | None, status: str, mounts: DataFrame | None = None, filesystems: DataFrame | None = None, error: str | None = None, notes: str | None = None, once: bool = False
    ) -> int:
        """One snapshot and all that belongs to it in one commit; complete ones go into intervals. With
        once, a snapshot of these notes that is there already is left as it is."""
        with self.lock():
            known = self.table("snapshots")
            was = known.filter(F.col("notes") == notes).select("id").first() if once else None
            if was:
                return was[0]
            id_ = (known.agg(F.max("id")).first()[0] or 0) + 1
            one = self.spark.createDataFrame([(id_, started_at, finished_at, root_path, "failed" if status == "running" else status, notes, error)], SNAPSHOTS)
            self._promote(one, id_, root_path, rows, status, mounts, filesystems, known)
            return id_

    def _promote(self, one: DataFrame, id_: int, root_path: str, rows: DataFrame, status: str, mounts: DataFrame | None, filesystems: DataFrame | None, others: DataFrame) -> None:
        """One commit of a snapshot's row, its states and samples."""
        current = self._current()
        ids = current.setdefault("ids", {})
        mine = lambda df: df.withColumn("snapshot_id", F.lit(id_).cast("long"))
        if status == "complete":
            key = self.spark.range(1).select(F.md5(F.encode(F.lit(root_path), "UTF-8"))).first()[0]
            was_open = self._load(INTERVALS, [current["open"][key]] if key in current.get("open", {}) else [])
            ended, still, new = self._save_intervals(iv.promote(was_open, rows, root_path, id_))
            ids |= new
            current["intervals"] = current.get("intervals", []) + ended
            current["open"] = {k: v for k, v in current.get("open", {}).items() if k != key} | still
            more = []
        else:
            more = [("diagnostics", rows.withColumn("root_path", F.lit(root_path)))]
        for name, df in [*more, ("mounts", mounts), ("filesystems", filesystems)]:
            if df is not None:
                whole = self.spark.createDataFrame([], TABLES[name]).unionByName(mine(df), allowMissingColumns=True)
                folder = self._save(name, whole)
                ids[folder] = [id_, id_]
                current[name] = [*current.get(name, []), folder]
        current["snapshots"] = [self._save("snapshots", others.unionByName(one).coalesce(1))]
        self._point(self._tidy(current))

    def begin(self, root_path: str, started_at: str, notes: str) -> int:
        """The id of a running snapshot, shown with no state; the one of these notes if it is running already."""
        with self.lock():
            known = self.table("snapshots")
            was = known.filter((F.col("notes") == notes) & (F.col("root_path") == root_path) & (F.col("status") == "running")).select("id").first()
            if was:
                return was[0]
            id_ = (known.agg(F.max("id")).first()[0] or 0) + 1
            one = self.spark.createDataFrame([(id_, started_at, None, root_path, "running", notes, None)], SNAPSHOTS)
            self._point(self._current() | {"snapshots": [self._save("snapshots", known.unionByName(one).coalesce(1))]})
            return id_

    def add_batch(self, id_: int, number: int, rows: DataFrame) -> bool:
        """Write a numbered batch of a running snapshot aside; False if that batch is there, whole, already."""
        at = f"pending-{id_}/batch-{number}"
        if self._fs.exists(self._at(f"{at}/_SUCCESS")):
            return False
        columns = [c for c in self.spark.createDataFrame([], STATE).columns if c not in ("snapshot_id", "root_path")]
        rows.select(*[c for c in columns if c in rows.columns]).write.mode("overwrite").parquet(f"{self.path}/{at}")
        return True

    def finalize(self, id_: int, finished_at: str, status: str, mounts: DataFrame | None = None, filesystems: DataFrame | None = None, error: str | None = None) -> bool:
        """Promote all batches of a running snapshot in one commit; False, and nothing happens, if it isn't running any more."""
        with self.lock():
            known = self.table("snapshots")
            row = known.filter((F.col("id") == id_) & (F.col("status") == "running")).first()
            if row is None:
                return False
            folder = f"pending-{id_}"
            whole = [n for n in (self._names(folder) if self._fs.exists(self._at(folder)) else []) if self._fs.exists(self._at(f"{folder}/{n}/_SUCCESS"))]
            kept = STATE.replace("snapshot_id long, root_path string, ", "")
            rows = self.spark.read.schema(kept).parquet(*[f"{self.path}/{folder}/{n}" for n in sorted(whole)]) if whole else self.spark.createDataFrame([], kept)
            one = self.spark.createDataFrame([(id_, row["started_at"], finished_at, row["root_path"], status, row["notes"], error)], SNAPSHOTS)
            self._promote(one, id_, row["root_path"], rows, status, mounts, filesystems, known.filter(F.col("id") != id_))
            self._fs.delete(self._at(folder), True)
            return True

    def prune(self, now, policy=None) -> dict[str, int]:  # noqa: ANN001
        """Keep what the policy retains; states of retained snapshots don't change. Only folders that may mention a removed snapshot are read and written anew."""
        with self.lock():
            snapshots = self.table("snapshots")
            kept = snapshots.join(retention.retained(snapshots, now, policy), "id", "left_semi")
            gone = [r["id"] for r in snapshots.join(kept.select("id"), "id", "left_anti").select("id").orderBy("id").collect()]
            after, rewritten = snapshots.count() - len(gone), 0
            if gone:
                current = self._current()
                ids = current.setdefault("ids", {})
                done = kept.filter("status = 'complete'").select("root_path", "id")
                hit = lambda f: f not in ids or bisect_left(gone, ids[f][0]) < bisect_right(gone, ids[f][1])
                for name in ("diagnostics", "mounts", "filesystems"):
                    old = [f for f in current.get(name, []) if hit(f)]
                    if old:
                        new = self._save(name, retention.without(self._load(TABLES[name], old), kept, "snapshot_id"))
                        ids[new] = self._ids(name, new)
                        current[name] = [f for f in current[name] if f not in old] + [new]
                        rewritten += len(old)
                ended, open_ = current.get("intervals", []), current.get("open", {})
                # an ended interval can become open, so a root's open folder goes with its ended ones
                roots = {f.rpartition("_root=")[2] for f in [*ended, *open_.values()] if hit(f)}
                old = [f for f in ended if hit(f)] + [f for k, f in open_.items() if k in roots]
                if old:
                    new_ended, new_open, new_ids = self._save_intervals(retention.rebound(self._load(INTERVALS, old), done))
                    ids |= new_ids
                    current["intervals"] = [f for f in ended if f not in old] + new_ended
                    current["open"] = {k: f for k, f in open_.items() if k not in roots} | new_open
                    rewritten += len(old)
                current["snapshots"] = [self._save("snapshots", kept.coalesce(1))]
                self._point(self._tidy(current))
            self.folders_rewritten = rewritten
        return {"retained": after, "removed": len(gone)}

    def orphans(self, known: DataFrame) -> DataFrame:
        """The paths of a dictionary (column path) that no interval or diagnostic row refers to, as its own path, its parent or its largest child."""
        held = [self.table(name) for name in ("intervals", "diagnostics")]
        return retention.orphan_paths(known, *[(df, c) for df in held for c in ("path", "parent_path", "top_child_path")])

    def vacuum(self) -> dict[str, int]:
        """Delete folders that the version in force doesn't name, and versions before it."""
        with self.lock():
            current, versions = self._current(), self._versions()
            running = {r["id"] for r in self.table("snapshots").filter("status = 'running'").select("id").collect()}
            live, gone = {f.split("/")[0] for name in TABLES for f in self._folders(current, name)}, 0
            for n in self._names():
                # batches of snapshots that aren't running are what a writer left after its commit
                if (n.split("-")[0] in TABLES and n not in live) or (n.startswith("pending-") and int(n[8:]) not in running):
                    self._fs.delete(self._at(n), True)
                    gone += 1
            for v in versions[:-1]:
                self._fs.delete(self._at(f"version-{v}.json"), False)
        return {"versions_removed": gone, "versions_kept": len(live)}
