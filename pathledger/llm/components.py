"""Connected components of links that are spread over the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that are drawn together at once; about so many go to a task.
CHUNK = 1 << 19


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links a-b."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that join what the links a-b join: each node, and the smallest one that it reaches over these links."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    return nodes, nodes[local_roots(code[: len(a)], code[len(a) :], len(nodes))]


def _stars(edges: DataFrame, parts: int) -> DataFrame:
    """u, v: the edges of so many partitions drawn together into stars, CHUNK edges at once; the smallest node of each star comes with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []

        def take() -> pa.RecordBatch:
            u, v = _contracted(np.concatenate(a), np.concatenate(b))
            a.clear()
            b.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for r in batches:
            a.append(r.column("u").to_numpy())
            b.append(r.column("v").to_numpy())
            if sum(map(len, a)) >= CHUNK:
                yield take()
        if a:
            yield take()

    return edges.coalesce(parts).mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """links a, b (long, not null) to node, root: the smallest node that each node reaches.

    Links are drawn together in their partitions, of which there are as many as there are CHUNKs of links; a single one is the result. Else
    there are rounds of large and small stars: each links a node's larger neighbours, then itself and its
    smaller ones, to the smallest; the number of rounds is logarithmic. Each round and the result are held in the
    shared folder. Nodes without links are not in the result.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    seen = None
    while True:
        n = edges.count()
        stars = _stars(edges, max(1, -(-n // CHUNK)))
        if n <= CHUNK:
            return cut(stars).toDF("node", "root")
        edges = cut(stars.filter("u <> v"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = cut(small)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cut(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots))
