"""Optimal length buckets and token-budget batches.

The lengths of all sequences make one histogram with at most MAX_LEN bins. Dynamic programming over
it finds the bucket limits with the least padding. Inside each bucket the sequences, in the
order of a seeded hash, fill batches of as many rows as the token budget allows. A
sequence's place comes from its place in a small slice of that order and the counts of the
slices before, so no bucket is ever sorted in one task.

A text of more than max_len tokens becomes several sequences, the last of them shorter.
Null, empty and blank texts give none. Repeated rows give their sequences again.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

MAX_LEN = 2048
BUCKETS = 8
TOKEN_BUDGET = 16_384
SEED = 29
SLICE_ROWS = 50_000


def optimal_limits(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper limits of at most ``buckets`` buckets with the least total padding.

    lengths: distinct and rising. Of equal choices the bucket that starts lowest is taken, from the last
    bucket down. No lengths: no limits.
    """
    m = len(lengths)
    if not m:
        return []
    b = np.asarray(lengths, np.int64)
    rows = np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64))))
    tokens = np.concatenate(([0], np.cumsum(b * np.asarray(counts, np.int64))))
    big = np.iinfo(np.int64).max // 4
    best = np.full(m + 1, big)
    best[0] = 0
    back: list[np.ndarray] = []
    for _ in range(min(buckets, m)):
        now, come = np.full(m + 1, big), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            cost = best[:j] + b[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            come[j] = int(np.argmin(cost))
            now[j] = min(big, cost[come[j]])
        back.append(come)
        best = now
    limits, j = [], m
    for come in reversed(back):
        limits.append(int(b[j - 1]))
        j = int(come[j])
    return limits[::-1]


def sequences(docs: DataFrame, tokens: Column | None = None, max_len: int = MAX_LEN) -> DataFrame:
    """doc_id, chunk (from 0) and seq_len for each sequence of each row."""
    n = n_words(F.col("text")) if tokens is None else tokens
    rows = docs.select("doc_id", n.alias("n")).filter("n > 0")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / max_len))))
    return rows.select("doc_id", "chunk", F.least(F.lit(max_len).cast("long"), F.col("n") - F.col("chunk") * max_len).alias("seq_len"))


def pack(seqs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, seed: int = SEED) -> DataFrame:
    """seqs with bucket_len (its padded length), batch (from 0 in each bucket), slot (from 0 in
    each batch) and padding. Every sequence gets one place."""
    histogram = sorted((r["seq_len"], r["count"]) for r in seqs.groupBy("seq_len").count().collect())
    limits = optimal_limits([x for x, _ in histogram], [c for _, c in histogram], buckets)
    if not limits:
        zero = F.lit(0).cast("long")
        return seqs.select("*", zero.alias("bucket_len"), zero.alias("batch"), zero.alias("slot"), zero.alias("padding"))
    total = sum(c for _, c in histogram)
    digits = max(0, math.ceil(math.log(max(1.0, total / len(limits) / SLICE_ROWS), 16)))
    limit = F.coalesce(*[F.when(F.col("seq_len") <= x, F.lit(x).cast("long")) for x in limits])
    at = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("chunk").cast("string")))
    rows = seqs.withColumn("bucket_len", limit).withColumn("at", at).withColumn("slice", F.substring("at", 1, digits))
    w = Window.partitionBy("bucket_len", "slice").orderBy("at", "doc_id", "chunk", "seq_len")
    before = F.sum("count").over(Window.partitionBy("bucket_len").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")
    starts = rows.groupBy("bucket_len", "slice").count().select("bucket_len", "slice", before.alias("before"))
    got = rows.withColumn("k", F.row_number().over(w)).join(starts, ["bucket_len", "slice"])
    rank = F.col("before") + F.col("k") - 1
    fit = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_len")))
    return got.select(*seqs.columns, "bucket_len", F.floor(rank / fit).alias("batch"), (rank % fit).cast("long").alias("slot"), (F.col("bucket_len") - F.col("seq_len")).alias("padding"))


def pack_documents(docs: DataFrame, max_len: int = MAX_LEN, **args) -> DataFrame:
    return pack(cut(sequences(docs, max_len=max_len)), **args)
