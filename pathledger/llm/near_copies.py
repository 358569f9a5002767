"""Near copies by the Jaccard similarity of 5-word shingles: exact checks of candidates by MinHash bands.

Of each distinct text BANDS keys are taken, each of ROWS minima of its shingle hashes. A pair with
similarity s shares a key with a chance of 1 - (1 - s ** ROWS) ** BANDS, so at SIMILAR it's missed
about three times in a million. Pairs that share a key are candidates, and are linked after a check of their sets of shingles:

1. each text with the smallest of those it shares keys with; texts that are linked are joined into components;
2. of each key, the smallest text of each component in it with the key's smallest text, one pair for two components, ROUNDS times (no result depends on it);
3. the texts that share a key and still lie in different components. These are compared by sketches first: SKETCH further minima,
   a byte of each, of which a similar pair has at least AGREE equal but for one pair in a million. Texts with such a partner are compared by the hashes of all
   their shingles, in the same key. Large keys are compared in blocks of rows, and a block gives the links that join what is similar in it, fewer than it has texts.

So a large family of near copies costs a few checks for each of its texts, no group is gathered whole or cut, and no pair becomes a row before it is
known to be similar. Texts that share no key aren't read again.

Texts of fewer words are one shingle; those without words all are the same. Null texts count as empty.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, discard, written
from .components import components

SHINGLE, SIMILAR, SEED = 5, 0.8, 42
BANDS, ROWS = 32, 5
#: Minima in a sketch, and how many of them agree for a similar pair, with a chance of 1 - 1e-6 at SIMILAR (binomial).
SKETCH = 320
#: Rounds of step 2; each joins most of what is alike, and the last step finds the rest.
ROUNDS = 2
#: Texts of a key that are compared with each other in one row, and hashes of shingles.
BLOCK, BLOCK_SHINGLES = 2_048, 1 << 21
#: Text hashes are broadcast up to this number (8 bytes each).
BROADCAST_TEXTS = 200_000


def _agree(n: int, p: float, miss: float) -> int:
    """The largest k for which fewer than k of n come up with a chance of at most miss, each having the chance p."""
    total, k = 0.0, 0
    while total + (x := math.comb(n, k) * p**k * (1 - p) ** (n - k)) <= miss:
        total, k = total + x, k + 1
    return k


AGREE = _agree(SKETCH, SIMILAR, 1e-6)
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"minimum %d" % i, 11) | 1 for i in range(BANDS * ROWS)], np.uint64)
_SKETCHERS = np.array([xxhash.xxh64_intdigest(b"sketch %d" % i, 13) | 1 for i in range(SKETCH)], np.uint64)


def shingles(text: str | None) -> set[bytes]:
    """5-word shingles, lower-cased A-Z."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return set(map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)), strict=False))) if len(w) >= SHINGLE else {b" ".join(w)}


def _minima(text: str | None, by: np.ndarray) -> np.ndarray:
    s = shingles(text)
    h = np.fromiter(map(xxhash.xxh64_intdigest, s, repeat(SEED)), np.uint64, len(s))
    least = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 512):
        np.minimum(least, (by[:, None] * h[None, at : at + 512]).min(axis=1), out=least)
    return least


def bands(text: str | None) -> list[int]:
    """The keys of a text, as signed longs."""
    keys = [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(_minima(text, _MULTIPLIERS).reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketch(text: str | None) -> bytes:
    """A byte of each of SKETCH minima: the highest bits of a hash of the minimum."""
    least = _minima(text, _SKETCHERS)
    return ((least ^ least >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes()


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return both >= SIMILAR * (len(a) + len(b) - both)


def keyed(texts: DataFrame) -> DataFrame:
    """h and key: the keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = [bands(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(k, pa.list_(pa.int64()))], ["h", "keys"])

    return texts.mapInArrow(run, "h long, keys array<long>").select("h", F.explode("keys").alias("key"))


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for r in batches:
            ok = []
            for i, x, y in zip(r.column("b").to_pylist(), r.column("x").to_pylist(), r.column("y").to_pylist(), strict=True):
                if last != i:
                    last, held = i, shingles(y)
                ok.append(similar(shingles(x), held))
            yield pa.RecordBatch.from_arrays([r.column("a"), r.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    first = pairs.join(texts.select(F.col("h").alias("a"), F.col("text").alias("x")), "a")
    return first.join(texts.select(F.col("h").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _few(df: DataFrame) -> DataFrame:
    """df marked for a broadcast where its number of rows, counted, allows it."""
    return F.broadcast(df) if df.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else df


def _rooted(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """key, h, of: the component of each text in the keys in which there are several."""
    named = shared.join(_few(roots).withColumnRenamed("node", "h"), "h", "left").select("key", "h", F.coalesce("root", "h").alias("of"))
    mixed = named.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high")).filter("low < high").select("key")
    return cut(named.join(_few(cut(mixed)), "key"))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, root after more links: components of the roots alone."""
    plain = roots.select("node", "root")
    ends = links.join(_few(plain.toDF("a", "ra")), "a", "left").join(_few(plain.toDF("b", "rb")), "b", "left")
    upper = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    moved = plain.join(_few(upper.toDF("root", "top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return cut(moved.unionByName(upper.join(plain.select("node"), "node", "left_anti")))


def _blocks(rows: DataFrame, share: Column) -> DataFrame:
    """key, i, j, h, of, side: the rows (key, h, of) of each key in pairs of blocks; share: a row's part of a block. side: the row's block is
    the first of the pair (0), the second (1) or both (0)."""
    # a row goes to every pair of blocks that has its own
    many = rows.groupBy("key").agg(F.ceil(F.sum(share)).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = rows.join(_few(cut(many)), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("h"), "blocks").cast("int"))
    other = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "h", "of", F.when(F.col("own") > F.col("with"), 1).otherwise(0).alias("side"))


def _grouped(spread: DataFrame, marks: DataFrame) -> DataFrame:
    """key, same (one block with itself) and group: what a pair of blocks holds, with the marks (h, mark) of its texts."""
    groups = spread.join(marks, "h").groupBy("key", "i", "j").agg(F.collect_list(F.struct("h", "of", "side", "mark")).alias("group"))
    return groups.select("key", (F.col("i") == F.col("j")).alias("same"), "group")


def _others(i: int, same: bool, of: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Members of a group that are compared with its i-th: in other components, each pair once."""
    return np.flatnonzero((of != of[i]) & ((np.arange(len(of)) < i) if same else (side > side[i])))


def _agreeing(rooted: DataFrame, sketches: DataFrame) -> DataFrame:
    """key, h, of: the texts whose sketch agrees with that of another one, of the same key and a different component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            for key, same, group in zip(r.column("key").to_pylist(), r.column("same").to_pylist(), r.column("group"), strict=True):
                g = group.values
                h, of, side = (g.field(x).to_numpy(zero_copy_only=False) for x in ("h", "of", "side"))
                marks = np.frombuffer(b"".join(g.field("mark").to_pylist()), np.uint8).reshape(len(h), SKETCH)
                agrees = np.zeros(len(h), bool)
                for i in range(len(h)):
                    others = _others(i, same, of, side)
                    others = others[(marks[others] == marks[i]).sum(axis=1) >= AGREE]
                    agrees[others] = True
                    agrees[i] |= len(others) > 0
                if agrees.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(agrees.sum()), key)), pa.array(h[agrees]), pa.array(of[agrees])], ["key", "h", "of"])

    spread = _blocks(rooted, F.lit(1 / BLOCK))
    return _grouped(spread, sketches).mapInArrow(run, "key long, h long, of long").distinct()


def block_links(of: np.ndarray, side: np.ndarray, sets: list[np.ndarray], same: bool) -> list[tuple[int, int]]:
    """Pairs of a group that join all that is similar in it and isn't in one component yet; sets: distinct hashes of shingles."""
    size = np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    seen, code = np.unique(np.concatenate(sets), return_inverse=True)
    here, of, out = np.zeros(len(seen), bool), of.copy(), []
    for i in range(len(of)):
        others = _others(i, same, of, side)
        # sets of much different sizes can't be similar
        others = others[np.minimum(size[others], size[i]) >= SIMILAR * np.maximum(size[others], size[i])]
        if not len(others):
            continue
        here[code[start[i] : start[i] + size[i]]] = True
        ends = np.cumsum(size[others])
        places = np.repeat(start[others] - ends + size[others], size[others]) + np.arange(ends[-1])
        both = np.add.reduceat(here[code[places]].astype(np.int64), ends - size[others])
        here[code[start[i] : start[i] + size[i]]] = False
        for k in others[both >= SIMILAR * (size[others] + size[i] - both)].tolist():
            if of[k] != of[i]:
                of[of == of[k]] = of[i]
                out.append((i, k))
    return out


def _similar(near: DataFrame, sets: DataFrame) -> DataFrame:
    """Links a, b that join the similar texts of each key. near: key, h, of; sets: h, n and mark, of :func:`hashed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            for same, group in zip(r.column("same").to_pylist(), r.column("group"), strict=True):
                g = group.values
                h, of, side = (g.field(x).to_numpy(zero_copy_only=False) for x in ("h", "of", "side"))
                found = block_links(of, side, [np.frombuffer(x, np.uint64) for x in g.field("mark").to_pylist()], same)
                if found:
                    x, y = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(h[x]), pa.array(h[y])], ["a", "b"])

    sized = near.join(_few(sets.select("h", "n")), "h")
    spread = _blocks(sized, F.col("n") / BLOCK_SHINGLES)
    return _grouped(spread, sets.select("h", "mark")).select("same", "group").mapInArrow(run, "a long, b long").distinct()


def hashed(texts: DataFrame) -> DataFrame:
    """h, n and mark: the number of different shingles of each text, and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(t), repeat(SEED)), np.uint64)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([len(x) for x in found], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], ["h", "n", "mark"])

    return texts.mapInArrow(run, "h long, n int, mark binary")


def sketched(texts: DataFrame) -> DataFrame:
    """h and mark: the sketch of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([sketch(t) for t in b.column("text").to_pylist()], pa.binary())], ["h", "mark"])

    return texts.mapInArrow(run, "h long, mark binary")


def near_copies(texts: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """node, root: the smallest text hash that each one with near copies reaches. texts: h (distinct) and text. links: pairs a, b of
    texts that another method found; they join components like those of similar texts."""
    spark = texts.sparkSession
    bounded_batches(spark)
    held: list[str] = []
    keys = written(keyed(texts), held)
    low = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low < high").select("key", "low")
    shared = written(keys.join(_few(cut(low)), "key"), held)
    discard(spark, [held.pop(0)])
    texts = written(texts.join(_few(cut(shared.select("h").distinct())), "h", "left_semi"), held)
    tried = cut(shared.filter("h <> low").groupBy(F.col("h").alias("a")).agg(F.min("low").alias("b")))
    first = checked(tried, texts)
    roots = components(first if links is None else first.unionByName(links))
    rooted = _rooted(shared.select("key", "h"), roots)
    for _ in range(ROUNDS):
        first = rooted.groupBy("key", "of").agg(F.min("h").alias("a"))
        hub = first.groupBy("key").agg(F.min(F.struct("a", "of")).alias("hub"))
        pairs = first.join(hub, "key").select("of", F.col("hub.of").alias("hub"), "a", F.col("hub.a").alias("b")).filter("of <> hub").distinct()
        pairs = pairs.join(tried, ["a", "b"], "left_anti").groupBy("of", "hub").agg(F.min(F.struct("a", "b")).alias("p"))
        pairs = cut(pairs.select("p.a", "p.b"))
        more = cut(checked(pairs, texts))
        tried = tried.unionByName(pairs)
        if not more.limit(1).count():
            break
        roots = _joined(roots, more)
        rooted = _rooted(shared.select("key", "h"), roots)
    sketches = cut(sketched(texts.join(_few(cut(rooted.select("h").distinct())), "h", "left_semi")))
    near = cut(_agreeing(rooted, sketches))
    sets = cut(hashed(texts.join(_few(cut(near.select("h").distinct())), "h", "left_semi")))
    roots = _joined(roots, cut(_similar(near, sets)))
    discard(spark, held)
    return roots


def keep_one(docs: DataFrame, linked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the smallest doc_id (then
    text hash) stays, once if it repeats. Columns as in docs. linked: gives links a, b of another method for texts (h, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held: list[str] = []
    texts = written(docs.select(F.xxhash64(text).alias("h"), text.alias("text")).dropDuplicates(["h"]), held)
    found = near_copies(texts, linked(texts) if linked else None)
    discard(docs.sparkSession, held)
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h")).groupBy("id", "h").count())
    first = rows.groupBy("h").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "h")).alias("k"))
    named = first.join(found.select(F.col("node").alias("h"), "root"), "h", "left").select("k", F.coalesce("root", "h").alias("grp"))
    stays = named.groupBy("grp").agg(F.min("k").alias("k")).select(F.col("k.id").alias("_id"), F.col("k.h").alias("_h"))
    again = rows.filter("count > 1").limit(1).count()
    row = F.struct(*[docs[c] for c in docs.columns])
    wrapped = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h"))
    kept = wrapped.join(stays, wrapped["id"].eqNullSafe(stays["_id"]) & (wrapped["h"] == stays["_h"]), "left_semi")
    return (kept.dropDuplicates(["id", "h"]) if again else kept).select("row.*")
