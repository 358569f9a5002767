"""Snapshots from a stream: windows of file events, promoted into intervals batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathledger.functions import paths
from pathledger.sources.store import Store


def window_sums(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """events: ts, path (bytes), disk_bytes, apparent_bytes. Subtree sums of each window; later events than ``late`` are left out."""
    up = paths.with_ancestors(events.withWatermark("ts", late), "path", "above", proper=False)
    got = up.groupBy(F.window("ts", window), F.col("above").alias("path")).agg(F.sum("disk_bytes").alias("disk_bytes"), F.sum("apparent_bytes").alias("apparent_bytes"), F.count(F.lit(1)).alias("file_count"))
    return got.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "path", "disk_bytes", "apparent_bytes", "file_count")


def promote_stream(rows: DataFrame, store: Store, root_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each window of state rows becomes a complete snapshot of the root, in the order of the windows.

    rows: of window_sums. A window that was promoted before a restart is known by the snapshot's notes
    and left as it is.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        null = {c: F.lit(None).cast(t) for c, t in (("error", "string"), ("collapse_reason", "string"), ("collapsed_dirs", "long"), ("top_child_path", "binary"), ("top_child_disk_bytes", "long"))}
        t = paths.to_text(F.col("path"))
        full = batch.withColumns({"at": F.date_format("window_end", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "parent_path": paths.parent(F.col("path")), "depth": paths.depth_t(t).cast("int"), "dir_count": F.lit(0).cast("long"), "collapsed": F.lit(False), **null}).persist()
        try:
            for (at,) in full.select("at").distinct().orderBy("at").collect():  # one row a window
                one = full.filter(F.col("at") == at).drop("window_start", "window_end", "at")
                store.record(root_path, one, at, at, "complete", notes=f"{checkpoint}:{batch_id}:{at}", once=True)
        finally:
            full.unpersist()

    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(take).start()


def to_memory(rows: DataFrame, name: str, then: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Run a bounded stream to its end and give its result."""
    q = rows.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    out = rows.sparkSession.table(name)
    if then:
        then(out)
    return out
