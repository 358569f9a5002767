"""Scores of texts by a causal self-attention model in numpy over subword ids.

Texts are words, lower-cased, and an end. Each word has the byte-pair ids of the word after a space.
The chance of the next id is that of its class times that of the id in its class. The most
frequent ids are classes of their own; the others share classes by what comes before them.

What the model knows comes from the whole training part: counts of words (they also give the base
score) give the counts of ids after the beginnings of words. Chances by the beginning of the word, for
the NODES most frequent ones, are smoothed with those by the last id alone, and so on. On top, self-attention with relative places over the last ids and a
layer of rectifiers change them: both the weights of keys and the chances of classes are softmaxes, the one over products and places, the other
over the logarithms of the counted chances and what the layers add. These are trained with Adam on every id of every training document, by trainers
all over the cluster that read the documents in place; the documents are parted among the rounds by ROUND_PARTS, after each of which
the weights are averaged. Blocks of BLOCK ids are trained and scored with the block before as context, so windows overlap
and each id is a target once.

Sizes of the model (documented parameters; they bound what is broadcast, not what is counted or scored): classes, SYMBOLS, NODES, KNOWN_IDS, HOT_WORDS.
Ids that KNOWN_IDS leaves out share the smoothed rest of their class, so all chances sum to one. The
HOT_WORDS most frequent words and their counts are broadcast; other words find their counts by
a join on a 64-bit hash. All training ids are counted and train the attention.

Null texts count as empty: an end alone. Rows may repeat, doc_ids be null. Very long texts are split into blocks like all others. No rows: no result.
"""

from __future__ import annotations

import base64
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
import xxhash
from numpy.lib.stride_tricks import as_strided
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PARTS, HELD_PART = 7, 2
HOT_WORDS = 1 << 17
#: Ids with classes of their own, and classes of the others.
HEADS, TAILS = 104, 24
#: Ids with vectors of their own; the others have those of their classes.
SYMBOLS = 2048
#: Beginnings of words with chances of their own, and ids in shared classes that have some after them.
NODES, KNOWN_IDS = 1 << 13, 200_000
DIM, HIDDEN, BLOCK = 16, 32, 32
#: Windows (blocks of targets with the block before) that a trainer holds and mixes at once.
TRAINER_WINDOWS = 8192
#: Each document trains in one round: short rounds come first, as weights are averaged well while trainers haven't gone far apart.
ROUND_PARTS = (1, 4, 27)
STEP_WINDOWS, RATE = 64, 0.03
#: Steps of a trainer in a round, at least: few windows are passed over again.
LEAST_STEPS = 150
#: Averages of trainers that come to the driver, at most.
MEANS = 32
SMOOTH = 2.0
#: Largest power whose exponentials are summed without a shift; beyond it the largest is taken away first.
LARGEST = 60.0
CLASSES, LAST = HEADS + TAILS, SYMBOLS + HEADS + TAILS
LOG10 = math.log(10.0)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def read_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


class Bpe:
    """Byte-pair ids of words, each after a space, in pieces of at most 24 characters."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bpe = tiktoken.Encoding("words", pat_str=r" [^ ]{1,23}|[^ ]{1,24}", mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.opens = np.zeros(self.end + 1, bool)
        self.opens[[i for x, i in ranks.items() if x[:1] == b" "]] = True

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of all the words, one after another; those that ``opens`` marks begin a word."""
        return np.array(self.bpe.encode_ordinary("".join(" " + w.decode("utf-8", "replace") for w in words)), np.int64)


#: What a word's ids bring: the id, the row of chances after it, and the log chance of the id in its class.
TOKEN = np.dtype([("id", "<u2"), ("row", "<u2"), ("within", "<f4")])


class WordTokens:
    """TOKEN records of words; those of hot words are remembered."""

    def __init__(self, bpe: Bpe, stats: Stats, hot: list[bytes] = ()):
        self.bpe, self.stats = bpe, stats
        self.end = np.array([(bpe.end, stats.symbols[bpe.end], stats.within[bpe.end])], TOKEN)
        self.one = np.full(len(stats.symbols), -1, np.int64)
        two = {}
        for start, row in stats.nodes.items():
            if len(start) == 2:
                self.one[int.from_bytes(start, "little")] = row
            else:
                two[int.from_bytes(start[:2], "little") << 16 | int.from_bytes(start[2:], "little")] = row
        self.two, self.two_rows = np.array(sorted(two), np.int64), np.array([two[k] for k in sorted(two)], np.int64)
        order = np.argsort(stats.pairs[0])
        self.known, self.counts = stats.pairs[0][order], stats.pairs[1][order]
        # what is held of each shared class after a row: chances of its ids sum to one whatever isn't held
        self.held = np.zeros_like(stats.raw)
        if len(self.known):
            np.add.at(self.held, (self.known >> 16, stats.classes[self.known & 0xFFFF]), self.counts)
        self.place = dict(zip(hot, range(len(hot)), strict=True))
        parts = [self.encode(hot[at : at + 4096]) for at in range(0, len(hot), 4096)] or [(np.zeros(0, TOKEN), np.zeros(0, np.int64))]
        base = np.cumsum([0, *(len(t) for t, _ in parts)])
        self.flat = np.concatenate([t for t, _ in parts])
        self.at = np.concatenate([starts + b for (_, starts), b in zip(parts, base, strict=False)])
        self.size = np.diff(np.append(self.at, len(self.flat)))

    def _count(self, row: np.ndarray, ids: np.ndarray) -> np.ndarray:
        k = row << 16 | ids
        at = np.minimum(np.searchsorted(self.known, k), len(self.known) - 1)
        return np.where(self.known[at] == k, self.counts[at], 0) if len(self.known) else np.zeros(len(k))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all the words, and where each word begins."""
        st, ids = self.stats, self.bpe.ids(words)
        n = len(ids)
        opens = self.bpe.opens[ids]
        starts = np.nonzero(opens)[0]
        row = st.symbols[ids].astype(np.int64)
        row = np.where(opens & (self.one[ids] >= 0), self.one[ids], row)
        second = np.nonzero(opens[:-1] & ~opens[1:])[0] + 1
        if len(second) and len(self.two):
            k = ids[second - 1] << 16 | ids[second]
            at = np.minimum(np.searchsorted(self.two, k), len(self.two) - 1)
            hit = self.two[at] == k
            row[second[hit]] = self.two_rows[at[hit]]
        out = np.zeros(n, TOKEN)
        out["id"], out["row"] = ids, row
        tail = np.nonzero(st.classes[ids] >= HEADS)[0]
        if len(tail):
            i = ids[tail]
            before = np.where(opens[tail], st.symbols[self.bpe.end], row[np.maximum(tail - 1, 0)])
            c, p = st.classes[i], np.exp(st.within[i])
            deep = before >= LAST
            low = np.where(deep, st.last[np.maximum(before - LAST, 0)] if len(st.last) else 0, before)
            p = (self._count(low, i) + SMOOTH * p) / (self.held[low, c] + SMOOTH)
            p = np.where(deep, (self._count(before, i) + SMOOTH * p) / (self.held[before, c] + SMOOTH), p)
            out["within"][tail] = np.log(p)
        return out, starts

    def places(self, words: list[bytes]) -> np.ndarray:
        """The number of each hot word, -1 for others."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def tokens(self, words: list[bytes], places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all the words, one after another, and how many each word has."""
        if not words:
            return np.zeros(0, TOKEN), np.zeros(0, np.int64)
        places = self.places(words) if places is None else places
        new = np.nonzero(places < 0)[0]
        start, size, flat = self.at[places] if len(self.at) else np.zeros(len(words), np.int64), self.size[places] if len(self.at) else np.zeros(len(words), np.int64), self.flat
        if len(new):
            more, starts = self.encode([words[i] for i in new.tolist()])
            start[new], size[new] = len(flat) + starts, np.diff(np.append(starts, len(more)))
            flat = np.concatenate([flat, more])
        ends = np.cumsum(size)
        return flat.view(np.uint64)[np.repeat(start - ends + size, size) + np.arange(ends[-1])].view(TOKEN), size


_HELD: dict[str, tuple[str, object]] = {}


class Shared:
    """A broadcast value, with a name for what a worker makes of it and keeps for its next tasks."""

    def __init__(self, spark: SparkSession, value: object):
        self.tag, self.of = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):  # noqa: ANN201
        return self.of.value

    def made(self, name: str, make):  # noqa: ANN001, ANN201
        if name not in _HELD or _HELD[name][0] != self.tag:
            _HELD[name] = (self.tag, make(self.of.value))
        return _HELD[name][1]


def part_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and held_out."""
    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % PARTS == HELD_PART
    return docs.select("doc_id", "text", held.alias("held_out"))


def word_counts(training: DataFrame) -> DataFrame:
    """word (binary) and c, over all texts."""
    bounded_batches(training.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def take() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for b in batches:
            for t in b.column("text"):
                seen.update(words_of(t.as_py()))
                if len(seen) > 600_000:
                    yield take()
                    seen = Counter()
        yield take()

    return training.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Stats:
    """Classes and symbols of ids, and smoothed chances after each row: symbols first, then nodes.

    raw: counts of classes after each row. pairs: row << 16 | id and count, of ids that share classes.
    last: the symbol of each node, whose row it is smoothed with.
    """

    def __init__(self, counts: np.ndarray, classes: np.ndarray, symbols: np.ndarray, raw: np.ndarray, last: np.ndarray, nodes: dict[bytes, int], known: tuple[np.ndarray, np.ndarray]):
        self.classes, self.symbols, self.nodes, self.pairs = classes.astype(np.int16), symbols.astype(np.int16), nodes, known
        self.raw, self.last = raw, last
        smooth = counts + 0.5
        mass = np.bincount(classes, smooth, CLASSES)
        self.within = np.log(smooth) - np.log(mass[classes])  # log chance of the id in its class
        base = np.bincount(classes, counts, CLASSES) + 0.5
        rows = raw[:LAST] + (SMOOTH * base / base.sum()).astype(np.float32)
        rows /= rows.sum(1, keepdims=True)
        more = raw[LAST:] + 2 * SMOOTH * rows[last]
        more /= more.sum(1, keepdims=True)
        self.follow = np.concatenate([rows, more]).astype(np.float32)


def arrays(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a small result."""
    t = df.toArrow()
    return {c: t.column(c).to_numpy() for c in t.column_names}


def most_frequent(df: DataFrame, count: str, most: int) -> int:
    """A least count such that at most ``most`` rows have it or more; only a histogram of counts comes here."""
    step = F.floor(F.log2(F.col(count).cast("double")) * 16).cast("long")
    held, least = 0, None
    for r in df.filter(F.col(count) > 0).groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("rows"), F.min(count).alias("low")).orderBy(F.desc("s")).collect():
        held += r["rows"]
        if held > most:
            break
        least = r["low"]
    return 1 << 62 if least is None else least


def id_counts(counts: DataFrame, ranks: Shared) -> DataFrame:
    """start, next (an id, or -1 for the word's end) and n over all words. start: the ids from the beginning of
    a word, as bytes, if there are at most 2; else ff and the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = ranks.made("bpe", Bpe), Counter()

        def take() -> pa.RecordBatch:
            starts, nexts = list(zip(*seen, strict=True)) or ((), ())
            return pa.RecordBatch.from_arrays([pa.array(starts, pa.binary()), pa.array(nexts, pa.int64()), pa.array(list(seen.values()), pa.int64())], ["start", "next", "n"])

        for b in batches:
            words = b.column("word").to_pylist()
            ids = bpe.ids(words)
            at = np.nonzero(bpe.opens[ids])[0].tolist()
            flat, raw = ids.tolist(), ids.astype("<u2").tobytes()
            for a, z, c in zip(at, [*at[1:], len(flat)], b.column("c").to_pylist(), strict=True):
                seen[b"", flat[a]] += c
                for k in range(a + 1, z):
                    seen[raw[2 * a : 2 * k] if k - a <= 2 else b"\xff" + raw[2 * k - 2 : 2 * k], flat[k]] += c
                seen[raw[2 * a : 2 * z] if z - a <= 2 else b"\xff" + raw[2 * z - 2 : 2 * z], -1] += c
            if len(seen) > 500_000:
                yield take()
                seen = Counter()
        yield take()

    return counts.mapInArrow(run, "start binary, next long, n long").groupBy("start", "next").agg(F.sum("n").alias("n"))


def learn_stats(counts: DataFrame, texts: int, ranks: Shared, vocabulary: int) -> Stats:
    """Statistics from the counts of all words. What comes here is bounded: tables by ids, by ids
    and heads, by rows and classes, and the KNOWN_IDS most frequent pairs of row and id."""
    spark = counts.sparkSession
    found = written(id_counts(counts, ranks))
    end = vocabulary - 1
    freq = np.zeros(vocabulary, np.int64)
    one = arrays(found.filter("next >= 0").groupBy("next").agg(F.sum("n").alias("n")))
    freq[one["next"]] = one["n"]
    freq[end] = texts
    order = np.lexsort((np.arange(vocabulary), -freq))
    head = np.sort(order[:HEADS])
    classes = np.full(vocabulary, -1)
    classes[head] = np.arange(HEADS)
    pairs = written(found.groupBy(F.when(F.length("start") > 0, F.expr("conv(hex(substring(start, length(start), 1)), 16, 10) * 256 + conv(hex(substring(start, length(start) - 1, 1)), 16, 10)").cast("long")).otherwise(F.lit(end)).alias("prev"), "next").agg(F.sum("n").alias("n")))
    # the others: by what comes before them, some rounds of means on the shares of the heads and the start
    named = F.broadcast(spark.createDataFrame(pa.table({"prev": head, "k": np.arange(HEADS)})))
    before = arrays(pairs.filter("next >= 0").join(named, "prev", "left").groupBy("next", F.when(F.col("prev") == end, HEADS).otherwise(F.coalesce("k", F.lit(HEADS + 1))).alias("k")).agg(F.sum("n").alias("n")))
    profile = np.zeros((vocabulary, HEADS + 2), np.float32)
    profile[before["next"], before["k"]] = before["n"]
    # ids that begin words (or end texts) and others share no class: the first kind's chances don't depend on the word before
    opens = np.zeros(vocabulary, bool)
    opens[[i for x, i in ranks.value.items() if x[:1] == b" "]] = opens[end] = True
    for kind, low, many in ((True, HEADS, TAILS // 2), (False, HEADS + TAILS // 2, TAILS - TAILS // 2)):
        rest = np.array([i for i in order[HEADS:] if opens[i] == kind], np.int64)
        x = np.sqrt(profile[rest] / np.maximum(profile[rest].sum(1, keepdims=True), 1))
        weight = freq[rest].astype(np.float64)
        centre = x[:many].copy()
        near = np.zeros(len(rest), np.int64)
        for _ in range(12):
            near = (x @ centre.T * 2 - (centre * centre).sum(1)).argmax(1)
            for k in range(len(centre)):
                w = weight * (near == k)
                if w.sum():
                    centre[k] = (x * w[:, None]).sum(0) / w.sum()
        classes[rest] = low + near
    symbols = SYMBOLS + classes
    symbols[order[:SYMBOLS]] = np.arange(SYMBOLS)
    # nodes: the most frequent beginnings
    begun = written(found.filter(F.length("start").isin(2, 4)).groupBy("start").agg(F.sum("n").alias("n")))
    starts = sorted(begun.filter(F.col("n") >= most_frequent(begun, "n", NODES)).select("start").toArrow().column("start").to_pylist())
    nodes = {x: LAST + k for k, x in enumerate(starts)}
    last = np.array([symbols[int.from_bytes(x[-2:], "little")] for x in starts], np.int64)
    of = F.broadcast(spark.createDataFrame(pa.table({"next": np.arange(vocabulary), "class": classes})))
    by_last = F.broadcast(spark.createDataFrame(pa.table({"prev": np.arange(vocabulary), "row": symbols})))
    rows = pairs.join(by_last, "prev").select("row", "next", "n")
    if starts:
        by_start = F.broadcast(spark.createDataFrame(pa.table({"start": pa.array(starts, pa.binary()), "row": np.arange(LAST, LAST + len(starts))})))
        rows = rows.unionByName(found.join(by_start, "start").select("row", "next", "n"))
    rows = cut(rows.groupBy("row", "next").agg(F.sum("n").alias("n")).join(of, "next", "left"))
    raw, ends = np.zeros((LAST + len(starts), CLASSES), np.float32), np.zeros(LAST + len(starts), np.float32)
    got = arrays(rows.groupBy("row", F.coalesce("class", F.lit(-1).cast("long")).alias("c")).agg(F.sum("n").alias("n")))
    inner = got["c"] >= 0
    np.add.at(raw, (got["row"][inner], got["c"][inner]), got["n"][inner])
    np.add.at(ends, got["row"][~inner], got["n"][~inner])
    shared = rows.filter(F.col("class") >= HEADS)
    tails = arrays(shared.filter(F.col("n") >= most_frequent(shared, "n", KNOWN_IDS)).select((F.col("row") * 65536 + F.col("next")).alias("k"), "n"))
    known = (tails["k"], tails["n"])
    # after a word comes the next word's first id, or the end of the text
    first = raw[symbols[end]].astype(np.float64)
    words = max(1.0, first.sum())
    after = first / words * (1 - texts / (words + texts))
    after[classes[end]] += texts / (words + texts)
    raw += ends[:, None] * after.astype(np.float32)
    return Stats(freq, classes, symbols, raw, last, nodes, known)


NAMES = ("E", "Q", "K", "V", "bias", "M", "W", "b", "U", "c")


def first_weights(seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    n, classes = LAST, CLASSES
    g = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
    return {"E": g(n, DIM), "Q": g(DIM, DIM), "K": g(DIM, DIM), "V": g(DIM, DIM), "bias": np.zeros(2 * BLOCK, np.float32), "M": g(DIM, HIDDEN), "W": g(DIM, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "U": g(HIDDEN, classes) * np.float32(0.03), "c": np.zeros(classes, np.float32)}


_NEVER = np.float32(-1e9)
_BACK = (BLOCK + np.arange(BLOCK))[:, None] - np.arange(2 * BLOCK)[None, :]  # how far back each key lies


def _near(bias: np.ndarray) -> np.ndarray:
    """What each key's place weighs for each id; 0 for those to come."""
    return np.where(_BACK >= 0, np.exp(bias[np.maximum(_BACK, 0)]), 0).astype(bias.dtype)


def laid_out(tokens: np.ndarray, sizes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts in blocks of their own, after a block before all: the first block of each text and the number of all, what is seen and what comes next at each
    place, which places are real, and which blocks are a text's first. tokens: those of all texts, sizes: how many each has."""
    blocks = sizes // BLOCK + 1
    starts = np.concatenate(([0], np.cumsum(blocks))) + 1
    n = int(starts[-1]) * BLOCK
    seen, goal = np.full(n, end[0], TOKEN), np.full(n, end[0], TOKEN)
    before = np.cumsum(sizes) - sizes
    at = np.repeat(starts[:-1] * BLOCK - before, sizes) + np.arange(len(tokens))
    goal[at] = tokens
    inner = (at + 1) % BLOCK != 0
    inner |= at + 1 < np.repeat(starts[1:] * BLOCK, sizes)
    seen[at[inner] + 1] = tokens[inner]
    real = np.zeros(n, bool)
    real[at] = real[starts[:-1] * BLOCK + sizes] = True
    first = np.zeros(starts[-1], bool)
    first[starts[:-1]] = True
    return starts, seen, goal, real, first


def windows(stats: Stats, tokens: np.ndarray, sizes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbols, rows and target, as :func:`gradients` takes them, of all blocks of the texts: each id and each end is a target once."""
    _, seen, goal, real, first = laid_out(tokens, sizes, end)
    ids = stats.symbols[seen["id"]].reshape(-1, BLOCK)
    target = np.where(real, stats.classes[goal["id"]], -1).reshape(-1, BLOCK)
    return np.concatenate([np.where(first[1:, None], -1, ids[:-1]), ids[1:]], 1), seen["row"].reshape(-1, BLOCK)[1:], target[1:]


def _bound(x: np.ndarray, y: np.ndarray) -> float:
    """What no product of a row of x with a row of y can pass."""
    return math.sqrt(np.einsum("ij,ij->i", x, x).max()) * math.sqrt(np.einsum("ij,ij->i", y, y).max())


def _largest(x: np.ndarray) -> float:
    """The largest of the sizes of numbers."""
    return max(float(x.max()), -float(x.min()))


def gradients(w: dict[str, np.ndarray], stats: Stats, symbols: np.ndarray, rows: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss and gradients on windows: symbols (n, 2 blocks; -1 for none), and for the second block rows and
    classes to come (-1 for none).

    Products with the vectors of symbols are made once a symbol. Both softmaxes stay undivided: columns of ones bring their sums out of products that are needed anyway, and sums and means
    go into the narrow side of each product. They are shifted only if products could pass LARGEST."""
    n, kind = len(symbols), w["E"].dtype
    many_rows = n * BLOCK
    there = symbols >= 0
    gaps = np.nonzero(~there.all(1))[0]
    s = np.maximum(symbols, 0).ravel()
    own = s.reshape(n, -1)[:, BLOCK:].ravel()
    scale = kind.type(1 / math.sqrt(DIM))
    of_keys, of_ids = np.concatenate([w["K"], w["V"]], 1), np.concatenate([w["Q"] * scale, w["W"]], 1)
    # keys, values and a column of ones
    keys = np.ones((len(w["E"]), 2 * DIM + 1), kind)
    np.matmul(w["E"], of_keys, out=keys[:, : 2 * DIM])
    ids = w["E"] @ of_ids
    kv = keys.take(s, axis=0).reshape(n, 2 * BLOCK, -1)
    k, v = kv[:, :, :DIM], kv[:, :, DIM:]
    qw = ids.take(own, axis=0)
    q = qw.reshape(n, BLOCK, -1)[:, :, :DIM]
    a = q @ k.transpose(0, 2, 1)
    if _largest(a) + _largest(w["bias"]) <= LARGEST:
        np.exp(a, out=a)
        a *= _near(w["bias"])
        if len(gaps):
            a[gaps] *= there[gaps, None, :]
    else:
        a += np.where(_BACK >= 0, w["bias"][np.maximum(_BACK, 0)], _NEVER)
        if len(gaps):
            a[gaps] = np.where(there[gaps, None, :], a[gaps], _NEVER)
        a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
    o = (a @ v).reshape(-1, DIM + 1)
    whole = o[:, DIM:]
    o = o[:, :DIM] / whole
    pre = o @ w["M"]
    pre += qw[:, DIM:]
    pre += w["b"]
    h = np.ones((many_rows, HIDDEN + 1), kind)
    np.maximum(pre, 0, out=h[:, :HIDDEN])
    u = np.concatenate([w["U"], w["c"][None]])
    back = np.ones((CLASSES, HIDDEN + 1), kind)
    back[:, :HIDDEN] = w["U"].T
    y = h @ u
    if _largest(y) > LARGEST:
        y -= y.max(1, keepdims=True)
    d = np.exp(y, out=y)
    d *= stats.follow.take(rows.ravel(), axis=0)
    dh = d @ back
    z = dh[:, HIDDEN].copy()
    goal = target.ravel()
    ok = goal >= 0
    many = max(1, int(ok.sum()))
    goal = np.maximum(goal, 0)
    at = np.arange(0, many_rows * CLASSES, CLASSES) + goal
    wide = d.ravel()
    loss = float(-(np.log(wide[at] / z + kind.type(1e-30)) * ok).sum() / many)
    part = (ok / many).astype(kind)
    share = (part / z)[:, None]
    wide[at] -= z
    h *= share
    gu = d.T @ h
    g = {"U": gu[:, :HIDDEN].T, "c": gu[:, HIDDEN]}
    dqw = np.empty((many_rows, DIM + HIDDEN), kind)
    dpre = dqw[:, DIM:]
    np.multiply(dh[:, :HIDDEN], share, out=dpre)
    dpre -= back.take(goal, axis=0)[:, :HIDDEN] * part[:, None]
    dpre *= pre > 0
    g |= {"M": o.T @ dpre, "b": np.ones(many_rows, kind) @ dpre}
    do = np.empty((many_rows, DIM + 1), kind)
    np.matmul(dpre, w["M"].T, out=do[:, :DIM])
    do[:, :DIM] /= whole
    np.negative(np.einsum("ij,ij->i", do[:, :DIM], o), out=do[:, DIM])
    do = do.reshape(n, BLOCK, -1)
    dkv = np.empty((n, 2 * BLOCK, 2 * DIM), kind)
    np.matmul(a.transpose(0, 2, 1), do[:, :, :DIM], out=dkv[:, :, DIM:])
    a *= do @ v.transpose(0, 2, 1)
    by_place = (np.ones(n, kind) @ a.reshape(n, -1)).reshape(_BACK.shape)
    np.matmul(a.transpose(0, 2, 1), q, out=dkv[:, :, :DIM])
    np.matmul(a, k, out=dqw.reshape(n, BLOCK, -1)[:, :, :DIM])
    dkv = dkv.reshape(-1, 2 * DIM)
    x = w["E"].take(s, axis=0)
    g_keys, g_ids = (dkv.T @ x).T, (dqw.T @ x.reshape(n, -1, DIM)[:, BLOCK:].reshape(-1, DIM)).T
    g |= {"Q": g_ids[:, :DIM] * scale, "W": g_ids[:, DIM:], "K": g_keys[:, :DIM], "V": g_keys[:, DIM:]}
    g["bias"] = np.bincount(np.maximum(_BACK, 0).ravel(), np.where(_BACK >= 0, by_place, 0).ravel(), 2 * BLOCK).astype(kind)
    # a row for each dimension: its sums by symbol need no order
    dx = of_keys @ dkv.T
    dx.reshape(DIM, n, -1)[:, :, BLOCK:] += (of_ids @ dqw.T).reshape(DIM, n, BLOCK)
    g["E"] = np.array([np.bincount(s, part, len(w["E"])) for part in dx]).T.astype(kind, order="C")
    return loss, g


class Adam:
    """Weights and their moments, each as one vector; a step for each part of the windows that come."""

    def __init__(self, w: dict[str, np.ndarray], stats: Stats):
        self.stats, self.i = stats, 0
        self.take(w)
        self.m1, self.m2, self.room = np.zeros_like(self.flat), np.zeros_like(self.flat), np.zeros_like(self.flat)

    def take(self, w: dict[str, np.ndarray]) -> None:
        """Goes on from these weights."""
        self.flat = np.concatenate([w[k].ravel() for k in NAMES])
        ends = np.cumsum([w[k].size for k in NAMES])
        self.w = {k: x.reshape(w[k].shape) for k, x in zip(NAMES, np.split(self.flat, ends[:-1]), strict=True)}

    def step(self, symbols: np.ndarray, rows: np.ndarray, target: np.ndarray, rate: float) -> None:
        _, parts = gradients(self.w, self.stats, symbols, rows, target)
        g = np.concatenate([parts[k].ravel() for k in NAMES], out=self.room)
        self.i += 1
        now = rate * min(1.0, self.i / 10)
        self.m1 *= np.float32(0.9)
        self.m2 *= np.float32(0.98)
        g *= np.float32(0.1)
        self.m1 += g
        g *= g
        g *= np.float32(2)  # 0.02 of the squares before they were scaled
        self.m2 += g
        np.multiply(self.m2, np.float32(1 / (1 - 0.98**self.i)), out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-6)
        np.divide(self.m1, g, out=g)
        g *= np.float32(now / (1 - 0.9**self.i))
        self.flat -= g


class Learner:
    """Trains on windows as they come, TRAINER_WINDOWS of them mixed at once; few windows are passed over again by :func:`train`."""

    def __init__(self, w: dict[str, np.ndarray], stats: Stats, rate: float, seed: int):
        self.start, self.adam, self.stats, self.rate = w, Adam(w, stats), stats, rate
        self.mixed, self.held, self.size, self.n = np.random.default_rng(seed), [], 0, 0

    def add(self, symbols: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
        for at in range(0, len(symbols), TRAINER_WINDOWS):
            part = slice(at, at + TRAINER_WINDOWS)
            self.held.append((symbols[part], rows[part], target[part]))
            self.size += len(symbols[part])
            if self.size >= max(TRAINER_WINDOWS, LEAST_STEPS * STEP_WINDOWS):
                self._learn()

    def _learn(self) -> None:
        s, f, g = self._take()
        for at in range(0, len(s), STEP_WINDOWS):
            part = slice(at, at + STEP_WINDOWS)
            self.adam.step(s[part].astype(np.int64), f[part], g[part].astype(np.int64), self.rate / math.sqrt(1 + self.adam.i / LEAST_STEPS))

    def _take(self) -> list[np.ndarray]:
        order = self.mixed.permutation(self.size)
        self.n += self.size
        out = [np.concatenate(x)[order] for x in zip(*self.held, strict=True)]
        self.held, self.size = [], 0
        return out

    def done(self) -> dict[str, np.ndarray]:
        """The weights, after all windows that were added."""
        if self.size and not self.n:
            s, f, g = self._take()
            return train(self.start, self.stats, s.astype(np.int64), f, g.astype(np.int64), self.rate)
        if self.size:
            self._learn()
        return self.adam.w


def train(w: dict[str, np.ndarray], stats: Stats, symbols: np.ndarray, rows: np.ndarray, target: np.ndarray, rate: float = RATE) -> dict[str, np.ndarray]:
    """Adam over the windows, at least once and for LEAST_STEPS. Every 8th window is for checking first: of the
    weights at the start and after each pass (or each LEAST_STEPS) those are kept that do best on these. Then these train too, once, at the last rate."""
    own = np.arange(len(symbols)) % 8 != 0
    check = ~own if own.any() and not own.all() else np.ones(len(symbols), bool)
    own = own if own.any() else check

    def loss(w: dict[str, np.ndarray]) -> float:
        at = np.nonzero(check)[0]
        parts = [(len(k), gradients(w, stats, symbols[k], rows[k], target[k])[0]) for k in np.array_split(at, -(-len(at) // 64))]
        return sum(n * x for n, x in parts) / len(at)

    best, least = w, loss(w)
    adam = Adam(w, stats)
    order = np.nonzero(own)[0]
    once = -(-len(order) // STEP_WINDOWS)
    steps = once * max(1, -(-LEAST_STEPS // once))
    for i in range(steps):
        at = order[i % once * STEP_WINDOWS : (i % once + 1) * STEP_WINDOWS]
        adam.step(symbols[at], rows[at], target[at], rate * (1 - 0.8 * i / steps))
        if i == steps - 1 or (i + 1) % min(once, LEAST_STEPS) == 0:
            x = loss(adam.w)
            if x < least:
                best, least = {k: v.copy() for k, v in adam.w.items()}, x
    adam.take(best)
    rest = np.nonzero(check & ~own)[0]
    for at in np.array_split(rest, -(-len(rest) // STEP_WINDOWS) or 1) if len(rest) else ():
        adam.step(symbols[at], rows[at], target[at], 0.2 * rate)
    return adam.w


class Model:
    """Weights as tables by symbol, ready to score."""

    def __init__(self, w: dict[str, np.ndarray], stats: Stats):
        e, one = w["E"], np.ones((len(w["E"]), 1), np.float32)
        self.stats = stats
        self.q = e @ w["Q"] * np.float32(1 / math.sqrt(DIM))
        # the column of ones sums the weights of keys
        self.kv = np.concatenate([e @ w["K"], one, e @ w["V"]], 1)
        # a last hidden value that is always 1 brings the classes' own weights
        self.w = np.concatenate([e @ w["W"] + w["b"], one], 1)
        self.m = np.concatenate([w["M"], np.zeros((DIM, 1), np.float32)], 1)
        self.u = np.concatenate([w["U"], w["c"][None]])
        self.near = _near(w["bias"])
        # no product can pass the largest norms: below LARGEST, with its place, its exponential needs no shift
        self.wild = _bound(self.q, self.kv[:, :DIM]) + float(np.abs(w["bias"]).max()) > LARGEST
        self.places = np.where(_BACK >= 0, w["bias"][np.maximum(_BACK, 0)], _NEVER).astype(np.float32)
        self.follow = stats.follow
        stats.follow = stats.follow[:0]  # only the rows above are used from here
        self.classes, self.symbols = stats.classes.astype(np.int64), stats.symbols.astype(np.int64)

    def score(self, tokens: np.ndarray, sizes: np.ndarray, end: np.ndarray, step: int = 32) -> np.ndarray:
        """Log10 chance of each text with its end; tokens: those of all texts, sizes: how many each has."""
        if not len(sizes):
            return np.zeros(0)
        starts, seen, goal, real, first = laid_out(tokens, sizes, end)
        ids_s, rows = self.symbols[seen["id"]], seen["row"].astype(np.int64)
        cls = self.classes[goal["id"]]
        # of each place: the goal's weight and count, and the sum over all classes
        power, count, total = (np.zeros(len(seen), np.float32) for _ in range(3))
        flat = np.arange(step * BLOCK) * CLASSES
        gaps = [np.nonzero(first[lo : lo + step])[0] for lo in range(1, starts[-1], step)]
        # fresh arrays for each step cost more than what is done in some of them
        places = step * BLOCK
        kv_, q_, w_, y_, p_, a_, o_, h_ = (np.empty(x, np.float32) for x in ((places + BLOCK, 2 * DIM + 1), (places, DIM), (places, HIDDEN + 1), (places, CLASSES), (places, CLASSES), (step, BLOCK, 2 * BLOCK), (step, BLOCK, DIM + 1), (places, HIDDEN + 1)))
        for lo, gap in zip(range(1, starts[-1], step), gaps, strict=True):
            hi = min(lo + step, starts[-1])
            n, m = hi - lo, (hi - lo) * BLOCK
            s, here = ids_s[(lo - 1) * BLOCK : hi * BLOCK], slice(lo * BLOCK, hi * BLOCK)
            kv = self.kv.take(s, axis=0, out=kv_[: m + BLOCK], mode="clip")
            # each block with the one before it: views of the same rows
            both = as_strided(kv, (n, 2 * BLOCK, 2 * DIM + 1), (BLOCK * kv.strides[0], *kv.strides), writeable=False)
            own = s[BLOCK:]
            q = self.q.take(own, axis=0, out=q_[:m], mode="clip").reshape(n, BLOCK, DIM)
            a = np.matmul(q, both[:, :, :DIM].transpose(0, 2, 1), out=a_[:n])
            if self.wild:
                a += self.places
                a[gap, :, :BLOCK] = _NEVER
                a -= a.max(2, keepdims=True)
                np.exp(a, out=a)
            else:
                np.exp(a, out=a)
                a *= self.near
                a[gap, :, :BLOCK] = 0
            o = np.matmul(a, both[:, :, DIM:], out=o_[:n]).reshape(m, DIM + 1)
            o[:, 1:] /= o[:, :1]
            h = np.matmul(o[:, 1:], self.m, out=h_[:m])
            h += self.w.take(own, axis=0, out=w_[:m], mode="clip")
            np.maximum(h, 0, out=h)
            y = np.matmul(h, self.u, out=y_[:m])
            p = self.follow.take(rows[here], axis=0, out=p_[:m], mode="clip")
            at = flat[:m] + cls[here]
            if _largest(y) > LARGEST:
                y -= y.max(1, keepdims=True)
            power[here], count[here] = y.ravel().take(at), p.ravel().take(at)
            np.exp(y, out=y)
            total[here] = np.einsum("ij,ij->i", y, p)
        out = np.zeros(len(seen))
        out[BLOCK:] = np.log(count[BLOCK:]) + power[BLOCK:] - np.log(total[BLOCK:])
        out += goal["within"]
        out[~real] = 0
        return np.add.reduceat(out, starts[:-1] * BLOCK) / LOG10


def fit(spark: SparkSession, training: DataFrame, ranks: Shared, stats: Stats, table: Shared) -> dict[str, np.ndarray]:
    """Weights that every id of the training texts has trained. The trainers are the partitions of the texts. table: the hot words."""
    told = Shared(spark, stats)
    part = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.length(F.coalesce("text", F.lit("")))), F.lit(sum(ROUND_PARTS)))
    w = first_weights()
    shapes = [(k, w[k].shape) for k in NAMES]

    def pack(w: dict[str, np.ndarray]) -> bytes:
        return np.concatenate([w[k].ravel() for k in NAMES]).astype(np.float32).tobytes()

    def unpack(b: bytes) -> dict[str, np.ndarray]:
        flat, at, out = np.frombuffer(b, np.float32), 0, {}
        for k, s in shapes:
            out[k] = flat[at : at + math.prod(s)].reshape(s)
            at += math.prod(s)
        return out

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        total, n = None, 0
        for b, k in zip(group["w"], group["n"], strict=True):
            x = np.frombuffer(b, np.float32).astype(np.float64) * k
            total, n = x if total is None else total + x, n + k
        return pd.DataFrame({"w": [(total / n).astype(np.float32).tobytes()], "n": [n]})

    def trainer(now: Shared, r: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            st = told.value
            enc = told.made("words", lambda v: WordTokens(ranks.made("bpe", Bpe), v, table.value.column("word").to_pylist()))
            learner = Learner(unpack(now.value), st, RATE / (1 + r), r)
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    split = [words_of(t) for t in b.column("text").slice(at, 256).to_pylist()]
                    tokens, sizes = enc.tokens(list(chain.from_iterable(split)))
                    ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *map(len, split)])]
                    learner.add(*windows(st, tokens, np.diff(ends), enc.end))
            w = learner.done()
            if learner.n:
                yield pa.RecordBatch.from_arrays([pa.array([pack(w)], pa.binary()), pa.array([learner.n], pa.int64()), pa.array([TaskContext.get().partitionId() % MEANS])], ["w", "n", "slot"])

        return run

    low = 0
    for r, many in enumerate(ROUND_PARTS):
        texts = training.filter((part >= low) & (part < low + many)).select("text")
        low += many
        means = texts.mapInArrow(trainer(Shared(spark, pack(w)), r), "w binary, n long, slot long").groupBy("slot").applyInPandas(lambda g: mean(g), "w binary, n long")
        found = means.orderBy("n").toArrow().to_pandas()
        if len(found):
            w = unpack(mean(found)["w"].iloc[0])
    return w


def score_texts(docs: DataFrame, tokenizer: str = TOKENIZER, window_words: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs. window_words: has no effect any more, as every
    id trains the model."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ranks_here = read_ranks(tokenizer)
    ranks = Shared(spark, ranks_here)
    rows = part_of(docs)
    training = rows.filter("not held_out")
    counts = written(word_counts(training))
    texts = training.count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + texts, v + (texts > 0)
    stats = learn_stats(counts, texts, ranks, max(ranks_here.values()) + 2)
    least = most_frequent(counts, "c", HOT_WORDS)
    table = Shared(spark, counts.filter(F.col("c") >= least).toArrow())
    model = Shared(spark, Model(fit(spark, training, ranks, stats, table), stats))

    def hash_(word: bytes) -> int:
        return xxhash.xxh64_intdigest(word, 42)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        enc = model.made("words", lambda v: WordTokens(ranks.made("bpe", Bpe), v.stats, table.value.column("word").to_pylist()))
        logs = table.made("logs", lambda t: np.log10(np.append(t.column("c").to_numpy(), 0) + 1.0))
        key = TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                split = [words_of(t) for t in part.column("text").to_pylist()]
                n = np.array(list(map(len, split)), np.int64)
                words = list(chain.from_iterable(split))
                places = enc.places(words)
                tokens, sizes = enc.tokens(words, places)
                ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(n)))]
                score = m.score(tokens, np.diff(ends), enc.end)
                whose = np.repeat(np.arange(len(split)), n)
                base = np.bincount(whose, logs[places], len(split))
                missing = np.nonzero(places < 0)[0]
                doc = whose[missing]
                gaps = np.bincount(doc, minlength=len(split))
                h = np.fromiter((hash_(words[i]) for i in missing.tolist()), np.uint64, len(missing)).view(np.int64)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.nonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool))[0]
                times = np.diff(np.append(new, len(h))).astype(np.int32)
                ends = np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=len(split))))).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(h[new]), pa.array(times)], ["h", "n"]))
                keys = np.arange(key, key + len(split))
                key += len(split)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), part.column("doc_id"), part.column("held_out"), pa.array(n + 1), pa.array(n - gaps), pa.array(base), pa.array(score), rare], ["key", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"]
                )

    scored = written(rows.mapInArrow(run, f"key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, known long, base double, score double, rare array<struct<h:long,n:int>>"))
    others = counts.filter(F.col("c") < least).select(F.xxhash64("word").alias("h"), "c")
    asked = scored.select("key", F.explode("rare").alias("r")).select("key", F.col("r.h").alias("h"), F.col("r.n").alias("k"))
    found = asked.join(others, "h").groupBy("key").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("k").alias("more_known"))
    whole = F.col("base") + F.coalesce("more", F.lit(0.0)) + math.log10(texts + 1) - F.col("n_tokens") * math.log10(n + v + 1)
    return scored.join(found, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0)) + int(texts > 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), whole.alias("base_score"), "score"
    )
