"""SimHash near-duplicates through vantage-point trees.

A fingerprint has a bit for each of 64 places, set if over half of the text's shingle hashes have it.
Distinct fingerprints are dealt to shards by their Hamming distances to the first few vantage points of a
fixed list; these are the upper levels of the tree, and levels are added until no shard is too
large. By the triangle bound a fingerprint within r of another lies within r of it in each of these
distances, and differs from it in parity as they do, so each fingerprint is also sent to the shards
that its ball overlaps. In a shard a vantage-point tree over its members answers all that
came with exact distances. A shard reports the links as stars around its smallest members, so a
dense family gives no more rows than it has members; components are found over these.

Texts without words have the fingerprint zero, which links like any other. Null texts count as
empty. Rows may repeat; a null doc_id takes part but names no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut
from .components import components, local_roots

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints in a shard, as measured, before a level is added.
SHARD_SIZE = 8192
MIN_LEVELS, MAX_LEVELS = 2, 5
LEAF = 64
#: Links held in a shard before they are drawn together into stars.
HELD_LINKS = 1 << 20


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of a text: 3-word shingles, lower-cased A-Z, XXH64 with seed 42."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(w, w[1:], w[2:], strict=False)) if len(w) >= SHINGLE else iter([b" ".join(w)])
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(1, len(w) - SHINGLE + 1))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed long) for every row of docs."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def vantage_points(n: int) -> list[int]:
    """The first n of a fixed list, as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(b"vantage %d" % i, 7)).astype(np.int64)) for i in range(n)]


def _pairs(points: np.ndarray, ids: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of all pairs within radius of each other, by a vantage-point tree over points."""
    work = [(points, ids, asked, asked_ids)]
    while work:
        p, i, q, j = work.pop()
        if not len(p) or not len(q):
            continue
        d = np.bitwise_count(p ^ p[0]) if len(p) > LEAF else None
        middle = int(np.median(d)) if d is not None else 0
        near = d <= middle if d is not None else None
        if near is None or near.all():
            for at in range(0, len(q), max(1, (1 << 22) // len(p))):
                part = q[at : at + max(1, (1 << 22) // len(p))]
                x, y = np.nonzero(np.bitwise_count(part[:, None] ^ p[None, :]) <= radius)
                yield j[at + x], i[y]
            continue
        e = np.bitwise_count(q ^ p[0]).astype(np.int16)
        inner, outer = e <= middle + radius, e > middle - radius
        work.append((p[near], i[near], q[inner], j[inner]))
        work.append((p[~near], i[~near], q[outer], j[outer]))


def shard_links(fp: np.ndarray, member: np.ndarray, own: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the linked fingerprints of one shard: members and those that came to ask.

    own: the member is asked about in its own shard, where each pair shows twice and counts once.
    """
    nodes, code = np.unique(fp, return_inverse=True)
    u = nodes.view(np.uint64)
    points = np.unique(code[member])
    asking = np.unique(code[~member | own])
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    held, root = 0, np.arange(len(nodes))
    for x, y in _pairs(u[points], points, u[asking], asking, radius):
        keep = x != y
        a.append(x[keep])
        b.append(y[keep])
        held += int(keep.sum())
        if held > HELD_LINKS:
            linked = np.nonzero(root != np.arange(len(nodes)))[0]
            root = local_roots(np.concatenate([*a, linked]), np.concatenate([*b, root[linked]]), len(nodes))
            a, b, held = [], [], 0
    linked = np.nonzero(root != np.arange(len(nodes)))[0]
    root = local_roots(np.concatenate([*a, linked]).astype(np.int64), np.concatenate([*b, root[linked]]).astype(np.int64), len(nodes))
    out = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[out], nodes[root[out]]


def links(distinct: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """a, b: links that join all fingerprints (column fp, distinct) within radius of each other."""
    levels = MIN_LEVELS
    while True:
        keys = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(v).cast("long"))).cast("long") for v in vantage_points(levels)]
        shard = F.lit(0).cast("long")
        for k in keys:
            shard = shard * 256 + k
        most = distinct.groupBy(shard.alias("s")).count().agg(F.max("count")).first()[0] or 0
        if most <= shard_size or levels == MAX_LEVELS:
            break
        levels += 1
    # distances of a pair d apart differ by d, d - 2, ... in each level; of each pair the lower key asks
    steps = {s for d in range(radius + 1) for s in product(range(-d, d + 1, 2), repeat=levels) if s > (0,) * levels}
    steps = sorted(sum(x * 256 ** (levels - 1 - i) for i, x in enumerate(s)) for s in steps)
    there = distinct.select("fp", shard.alias("own"))
    held = there.groupBy(F.col("own").alias("shard")).count().select("shard")
    members = there.select("fp", F.col("own").alias("shard"), F.lit(True).alias("member"))
    asking = there.select("fp", F.explode(F.array(*[F.col("own") + F.lit(s).cast("long") for s in steps])).alias("shard"), F.lit(False).alias("member"))
    asking = asking.join(F.broadcast(held) if levels <= 2 else held, "shard", "left_semi").select("fp", "shard", "member")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        m = group["member"].to_numpy()
        a, b = shard_links(group["fp"].to_numpy(), m, m, radius)
        return pd.DataFrame({"a": a, "b": b})

    return members.unionByName(asking).groupBy("shard").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp, component_id and grp (the smallest fingerprint of the component)."""
    rows = cut(fingerprints(docs))
    reps = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components(links(cut(reps.select("fp")), radius))
    of = found.join(reps, found["node"] == reps["fp"]).groupBy("root").agg(F.min("rep").alias("low"))
    named = found.join(of, "root").select(F.col("node").alias("fp"), "low", "root")
    named = reps.join(named, "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id"), F.coalesce("root", "fp").alias("grp"))
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "grp")


def text_links(texts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: each text (h, text; hashes distinct) with the smallest hash that it reaches over fingerprints within radius."""
    found = near_duplicates(texts.select(F.col("h").alias("doc_id"), "text"), radius)
    return found.filter("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest
    doc_id (then text hash) stays, once if it repeats. Columns as in docs."""
    got = cut(near_duplicates(docs, radius))
    stays = got.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("k"))
    stays = stays.select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    again = got.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count()
    row = F.struct(*[docs[c] for c in docs.columns])
    wrapped = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    kept = wrapped.join(stays, wrapped["id"].eqNullSafe(stays["_id"]) & (wrapped["hash"] == stays["_hash"]), "left_semi")
    return (kept.dropDuplicates(["id", "hash"]) if again else kept).select("row.*")
