"""Shards of near-equal bytes by histogram sort.

Rows have the order of (hash of the text, doc_id, place of the row), so equal texts lie together and are
parted only where a limit has to fall among them. The limits between shards are found by
rounds: each round counts, in one pass and exactly, the bytes below a fixed number of candidate keys;
then every limit keeps the two candidates around its target and probes between them.
It ends when each limit is within tolerance, or no key lies between. Then rows move once, in ranges of their
order: a row's slot is its place in its range after the counts of the ranges before.

Rows with the same text and doc_id differ by their place alone, so any of them can be parted. Null texts have no bytes (size 1) and
hash as an empty group of their own; null doc_ids come first. Long texts don't move, only their hashes and sizes; columns other than
doc_id and text aren't read, so their names can't clash. No rows: no shards.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS = 8
#: Candidate keys for each limit in a round.
PROBES = 7
#: A limit may be off by this share of a shard's bytes.
TOLERANCE = 0.001
#: Rows that are put in order together, on average; no result depends on it.
PART_ROWS = 100_000
_HALF, _SPAN = 1 << 63, 1 << 64
KEY = ["k1", "k2", "k3"]


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the three parts of the key for every row of docs; hold it before use,
    as the place of a row (k3) is fixed then."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("text")).alias("k1"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-_HALF)).alias("k2"),
        F.monotonically_increasing_id().alias("k3"),
    )


def _parts(key: int) -> list[int]:
    return [key // _SPAN ** (len(KEY) - 1 - i) % _SPAN - _HALF for i in range(len(KEY))]


def _whole(parts: tuple[int, ...]) -> int:
    out = 0
    for p in parts:
        out = out * _SPAN + p + _HALF
    return out


def _below(key: int) -> Column:
    """Whether a row's key is less than this one."""
    out = F.lit(False)
    for name, p in reversed(list(zip(KEY, _parts(key), strict=True))):
        out = (F.col(name) < p) | ((F.col(name) == p) & out)
    return out


def _interval(keys: list[int]) -> Column:
    """How many of the rising keys are at or below a row's key, by halving."""
    def side(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(_below(keys[mid]), side(low, mid)).otherwise(side(mid + 1, high))

    return side(0, len(keys))


def find_limits(rows: DataFrame, shards: int = SHARDS, probes: int = PROBES, tolerance: float = TOLERANCE) -> tuple[list[int], int]:
    """shards - 1 rising keys, each the first of its shard, and the number of rounds taken.

    rows: KEY and size. Only sums for each interval between candidates come to the driver.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [0] * (shards - 1), 0
    targets = [total * i / shards for i in range(1, shards)]
    near = tolerance * total / shards
    top = _SPAN ** len(KEY)
    low, high = [0] * len(targets), [top] * len(targets)  # bytes below low <= target < bytes below high
    below: dict[int, int] = {0: 0, top: total}
    rounds = 0
    while True:
        open_ = [i for i, t in enumerate(targets) if high[i] - low[i] > 1 and min(t - below[low[i]], below[high[i]] - t) > near]
        if not open_:
            break
        rounds += 1
        keys = sorted({low[i] + (high[i] - low[i]) * k // (probes + 1) for i in open_ for k in range(probes + 2)} - {0, top})
        got = rows.groupBy(_interval(keys).alias("i")).agg(F.sum("size").alias("b"), F.min(F.struct(*KEY)).alias("lo"), F.max(F.struct(*KEY)).alias("hi")).collect()
        sums = [0] * (len(keys) + 1)
        ends: list[int] = []
        for r in got:
            sums[r["i"]] = r["b"]
            ends += [_whole(r["lo"]), _whole(r["hi"])]
        run = 0
        for key, b in zip(keys, sums, strict=False):
            run += b
            below[key] = run
        # the keys that exist at the edges of intervals close gaps in which there is no row
        for i in open_:
            t = targets[i]
            for key in keys:
                if below[key] <= t and key > low[i]:
                    low[i] = key
                if below[key] > t and key < high[i]:
                    high[i] = key
        ends.sort()
        for i in open_:
            first, after = bisect_left(ends, low[i]), bisect_left(ends, high[i])
            if first < len(ends) and low[i] < ends[first] < high[i]:
                below[ends[first]] = below[low[i]]
                low[i] = ends[first]
            if after and low[i] < ends[after - 1] + 1 < high[i]:
                below[ends[after - 1] + 1] = below[high[i]]
                high[i] = ends[after - 1] + 1
    return [low[i] if t - below[low[i]] <= below[high[i]] - t else high[i] for i, t in enumerate(targets)], rounds


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, probes: int = PROBES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard, in the order of keys) for every row of docs."""
    rows = cut(rows_of(docs))
    limits, _ = find_limits(rows, shards, probes, tolerance)
    ranges = max(shards, rows.count() // PART_ROWS + 1)
    rows = rows.withColumn("shard", _interval(limits).cast("int"))
    # the one exchange: the place in the sorted range is the low part of the number that each row gets there
    placed = cut(rows.repartitionByRange(ranges, *KEY).sortWithinPartitions(*KEY).withColumn("at", F.monotonically_increasing_id()))
    place = placed.withColumn("range", F.shiftright("at", 33)).withColumn("own", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = place.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("low"))
    # a row for each range and shard: as many as there are ranges and shards together, at most
    run = F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    starts = counts.select("shard", "range", (run - F.col("n") - F.col("low")).alias("start"))
    got = place.join(F.broadcast(starts) if ranges + shards <= 100_000 else starts, ["shard", "range"])
    return got.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("own")).cast("long").alias("slot"))
