"""Approximate nearest neighbours by robust-pruned graphs, one in each shard.

Distinct vectors are dealt by hash to shards of about SHARD_SIZE. In a shard the unit vectors
make a directed graph: every node is searched for from the medoid, greedily, over the graph so far;
of what the search expands (and the node's present edges) an edge is kept to the nearest, and
further candidates go if a kept one is nearer to them, by the factor ALPHA, than the node is. Reverse
edges are added and pruned likewise. Nodes are put in by growing batches, all of a batch at once.
A query searches each shard's graph with a beam; the beam's nodes are scored exactly, by the
cosine of the original vectors in double precision, and the best of all shards are kept. Blocks of queries stream past a shard where it
lies, PIECE_BLOCKS of them past one copy of it, so no join pairs shards with queries. All shards are searched: going only to those with near centroids
loses too much on vectors without clusters.

Copies of a vector are one node that carries its K + 1 smallest ids, all that an answer can
need. Vectors that are null, zero, or hold null or non-finite components take no part; those of
another length are only compared with their like. Rows with a null vec_id take no part either, as no answer could name them. A vec_id
that repeats with other vectors is one candidate for each of them and asks once for each; none of its rows answers the others.
Other columns aren't read. Fewer candidates than K: all are returned; no vectors: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut

K = 5
EVERY = 50
SHARD_SIZE = 4096
DEGREE = 32
ALPHA = 1.2
BUILD_BEAM = 48
SEARCH_BEAM = 96
#: Queries that are searched together, and blocks of them for one copy of a shard.
BLOCK, PIECE_BLOCKS = 256, 256
#: More shards than this aren't broadcast by their numbers.
BROADCAST_SHARDS = 100_000


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b (float64)."""
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def beam_search(unit: np.ndarray, edges: np.ndarray, start: int, asked: np.ndarray, beam: int) -> np.ndarray:
    """Node ids (rows of beam, -1 for none) that greedy searches for the rows of asked end with.

    All searches take a step at a time: each expands its best node that isn't expanded yet.
    """
    q, n = len(asked), len(unit)
    ids = np.full((q, beam), -1, np.int64)
    near = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n), bool)
    rows = np.arange(q)
    ids[:, 0], near[:, 0], done[:, 0] = start, asked @ unit[start], False
    seen[:, start] = True
    while True:
        live = rows[~done.all(1)]
        if not len(live):
            return ids
        best = np.where(done[live], -np.inf, near[live]).argmax(1)
        node = ids[live, best]
        done[live, best] = True
        out = edges[node]
        new = (out >= 0) & ~seen[live[:, None], out]
        seen[np.repeat(live, new.sum(1)), out[new]] = True
        d = np.where(new, np.einsum("qd,qkd->qk", asked[live], unit[np.maximum(out, 0)]), -np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[live], np.where(new, out, -1)], 1)
        all_near = np.concatenate([near[live], d], 1)
        all_done = np.concatenate([done[live], ~new], 1)
        top = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(all_ids, top, 1)
        near[live] = np.take_along_axis(all_near, top, 1)
        done[live] = np.take_along_axis(all_done, top, 1)


def robust_prune(unit: np.ndarray, nodes: np.ndarray, found: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges of nodes out of the candidates in the rows of found (-1 for none)."""
    found = np.sort(found, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found[found == nodes[:, None]] = -1
    d = 2 - 2 * np.einsum("qd,qkd->qk", unit[nodes], unit[np.maximum(found, 0)])
    d = np.where(found < 0, np.inf, np.maximum(d, 0))
    order = np.argsort(d, axis=1, kind="stable")
    found, d = np.take_along_axis(found, order, 1), np.take_along_axis(d, order, 1)
    vectors = unit[np.maximum(found, 0)]
    open_ = np.isfinite(d)
    out = np.full((len(nodes), degree), -1, np.int64)
    count = np.zeros(len(nodes), np.int64)
    rows = np.arange(len(nodes))
    while True:
        live = rows[open_.any(1) & (count < degree)]
        if not len(live):
            return out
        pick = open_[live].argmax(1)
        out[live, count[live]] = found[live, pick]
        count[live] += 1
        open_[live, pick] = False
        between = 2 - 2 * np.einsum("qd,qkd->qk", vectors[live, pick], vectors[live])
        open_[live] &= alpha * alpha * between > d[live]


def build_graph(unit: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM, seed: int = 3) -> tuple[np.ndarray, int]:
    """Edges (rows of degree, -1 for none) and the start node of the graph over unit vectors (float32)."""
    n = len(unit)
    start = int((unit @ unit.mean(0)).argmax())
    edges = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at, size = 1, 1
    while at < n:
        batch = order[at : at + size]
        found = beam_search(unit, edges, start, unit[batch], beam)
        # those of the same batch see each other too
        peers = np.broadcast_to(batch[:: max(1, len(batch) // 16)], (len(batch), len(batch[:: max(1, len(batch) // 16)])))
        edges[batch] = robust_prune(unit, batch, np.concatenate([found, edges[batch], peers], 1), degree, alpha)
        a, b = np.repeat(batch, degree), edges[batch].ravel()
        a, b = a[b >= 0], b[b >= 0]
        by = np.argsort(b, kind="stable")
        a, b = a[by], b[by]
        targets, first, counts = np.unique(b, return_index=True, return_counts=True)
        wide = int(counts.max())
        back = np.full((len(targets), wide), -1, np.int64)
        back[np.repeat(np.arange(len(targets)), counts), np.arange(len(b)) - np.repeat(first, counts)] = a
        old = edges[targets]
        free = (old < 0).sum(1) >= counts
        if free.any():
            for r in np.nonzero(free)[0]:
                t = targets[r]
                have = edges[t]
                new = back[r][: counts[r]]
                new = new[~np.isin(new, have)]
                empty = np.nonzero(have < 0)[0][: len(new)]
                edges[t, empty] = new
        full = ~free
        if full.any():
            edges[targets[full]] = robust_prune(unit, targets[full], np.concatenate([old[full], back[full]], 1), degree, alpha)
        at += size
        size = min(BLOCK, max(1, at // 4))
    return edges, start


def _usable(v: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(x, lambda e: e != 0)
    return v.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)
    return np.ascontiguousarray(m / np.sqrt((m * m).sum(1, keepdims=True)), np.float32)


def build_index(vectors: DataFrame, k: int = K, shard_size: int = SHARD_SIZE) -> DataFrame:
    """A row for each shard: shard, dim, n, start, and as binary the vectors, edges and ids.

    vectors: vec_id and v.
    """
    own = vectors.withColumn("h", F.xxhash64("v"))
    w = Window.partitionBy("h", "v").orderBy("vec_id")
    few = own.dropDuplicates(["vec_id", "h"]).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    nodes = cut(few.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, -(-nodes.count() // shard_size))
    nodes = nodes.withColumn("dim", F.size("v")).withColumn("shard", F.pmod("h", F.lit(shards)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h"], kind="stable", key=None)
        m = _matrix(group["v"])
        edges, start = build_graph(_unit(m))
        ids = np.full((len(m), k + 1), -1, np.int64)
        for i, x in enumerate(group["ids"]):
            ids[i, : len(x)] = x
        return pd.DataFrame([{"shard": int(group["shard"].iloc[0]), "dim": m.shape[1], "n": len(m), "start": start, "vectors": m.tobytes(), "edges": edges.astype(np.int32).tobytes(), "ids": ids.tobytes()}])

    return nodes.groupBy("dim", "shard").applyInPandas(run, "shard long, dim int, n int, start int, vectors binary, edges binary, ids binary")


def search_index(index: DataFrame, queries: DataFrame, k: int = K, beam: int = SEARCH_BEAM, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all shards, without itself.

    queries (vec_id, v) go to every shard in blocks, behind the shard's own row; a block's answer from a shard is at most k rows
    a query. Blocks are by hash, so none needs an order.
    """
    bounded_batches(index.sparkSession)
    queries = queries.dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v"))
    blocks = max(1, -(-queries.count() // block))
    pieces = -(-blocks // PIECE_BLOCKS)
    number = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    packed = queries.groupBy("dim", number.alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
    shards = index.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    shards = F.broadcast(shards) if index.count() <= BROADCAST_SHARDS else shards
    asked = packed.join(shards, "dim").select(
        "dim", F.explode("shards").alias("shard"), (F.col("block") % pieces).alias("piece"), "block", F.col("q.vec_id").alias("qi"), F.flatten("q.v").alias("qv")
    )
    own = index.select("dim", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))).alias("piece"), F.lit(-1).cast("long").alias("block"), "n", "start", "vectors", "edges", "ids")
    keys = ["dim", "shard", "piece"]
    streams = own.unionByName(asked, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = edges = ids = start = unit = None
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if r["block"] < 0:
                    m = np.frombuffer(r["vectors"]).reshape(r["n"], r["dim"])
                    edges = np.frombuffer(r["edges"], np.int32).reshape(r["n"], -1).astype(np.int64)
                    ids, start, unit = np.frombuffer(r["ids"], np.int64).reshape(r["n"], -1), r["start"], _unit(m)
                    continue
                qi, qv = np.asarray(r["qi"], np.int64), np.asarray(r["qv"], np.float64).reshape(-1, r["dim"])
                out: list[tuple[int, int, float, int]] = []
                found = beam_search(unit, edges, start, _unit(qv), max(beam, k + 1))
                for j in range(len(qi)):
                    node = found[j][found[j] >= 0]
                    score = cosine(m[node], qv[j][None, :])
                    vec = ids[node]
                    ok = (vec >= 0) & (vec != qi[j])
                    s, v = np.broadcast_to(score[:, None], vec.shape)[ok], vec[ok]
                    best = np.lexsort((v, -s))[:k]
                    asks = xxhash.xxh64_intdigest(qv[j].tobytes()) >> 1
                    out += zip([int(qi[j])] * len(best), v[best].tolist(), s[best].tolist(), [asks] * len(best), strict=True)
                cols = [list(c) for c in zip(*out, strict=True)] or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64())], ["query_id", "vec_id", "score", "asks"])

    got = streams.mapInArrow(run, "query_id long, vec_id long, score double, asks long")
    w = Window.partitionBy("query_id", "asks").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The k nearest of every vector whose vec_id is divisible by ``every``, among all the others."""
    vectors = cut(_usable(embeddings))
    index = cut(build_index(vectors, k))
    return search_index(index, vectors.filter(F.col("vec_id") % every == 0), k)
