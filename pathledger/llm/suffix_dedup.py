"""Repeated passages by a logarithmic family of sparse suffix arrays.

A passage is a string of LENGTH bytes that also starts earlier: in a document with a smaller
doc_id, or further up in the same one. All bytes that passages cover go.

Suffixes are kept only at anchors: of each LENGTH-byte window the leftmost of its NAME-byte strings with the
least name (a 64-bit hash). Equal windows have their anchors at equal places, so suffixes that start
alike at the anchor are the only ones to compare. An anchor stands for the windows that chose it; the bytes
these cover are its context. Order and equality of suffixes go by names (of the first NAME bytes,
then of the context), as in prefix doubling, so a suffix array is an array sorted by names.

1. Where the texts lie, each batch of documents gives its anchors; of equal contexts the earliest
   goes on and the others are passages already.
2. By shards of names, each batch of anchors becomes a suffix array. It is looked up in
   the levels before it: of two equal contexts the later one is a passage. The array is then a new level, and levels of
   like size merge, so each anchor takes part in logarithmically many merges. At the end anchors
   with equal names in different contexts are marked.
3. Only the first of each marked context can hide a passage that parts of others share. Each is cut
   into the windows that hold more bytes before their anchor and those that hold more after it. Equal windows
   have the bytes on that side in common, so only pieces that agree there (most don't) are looked at: their windows
   are named (128 bits) one by one, and each window but the earliest of its name is a passage.

A name that one batch holds in several contexts is marked there, and its anchors are dealt by
context, with one row to tell the shard of the name: no name brings more than a row from each
batch to its shard. Texts move twice: to cut pieces and to cut passages out.

Null texts count as empty; a null doc_id comes before all others. Rows with the same doc_id count as one
document, so of two the string with the earlier start stays and equal rows keep their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, discard, written

LENGTH = 100
NAME = 32
#: Anchors that make a new level.
BATCH = 1 << 16
_FIRST = -(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.arange(1, 257, dtype=np.uint64) * _ODD

#: Bytes of text that are looked at together.
CHUNK = 1 << 15
#: Pieces with one middle from which their windows are dealt one by one.
HOT_NAME = 4096
#: Of a window's bytes besides its anchor's, half are on one side at least.
SIDE = (LENGTH - NAME) // 2


def names(data: np.ndarray, size: int = NAME) -> np.ndarray:
    """A 64-bit name for each string of size (a power of 2) bytes in data, by doubling."""
    h = _BYTES.take(data)
    step, factor = 1, 0xD6E8FEB86659FD93
    while step < size:
        right = h[step:] >> np.uint64(29)
        right ^= h[step:]
        right ^= h[:-step] * np.uint64(factor)
        h = right
        factor = (factor * factor | 5) % (1 << 64)
        step *= 2
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def _chunk_anchors(data: np.ndarray, ends: np.ndarray, length: int, size: int) -> tuple[np.ndarray, ...]:
    """(start, end, name) of the anchors of texts that lie one after another in data."""
    per = length - size + 1
    h = names(data, size)
    # least of each run of per names
    low, done = h, 1
    while done < per:
        step = min(done, per - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    # the leftmost of the least changes where it is left behind, or a lesser one comes
    new = np.ones(len(low), bool)
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[1:] |= h[: len(low) - 1] == low[:-1]
    inside = np.zeros(len(low), bool)
    begin = 0
    for end in ends.tolist():
        inside[begin : max(begin, end - length + 1)] = True
        if begin < len(new):
            new[begin] = True
        begin = end
    at = np.nonzero(inside)[0]
    if not len(at):
        return at, at, h[:0]
    first = at[new[at]]
    gap = np.concatenate((new[at[1:]] | (at[1:] != at[:-1] + 1), [True]))
    last = at[gap]
    return first, last + length, low[first]


def anchors(texts: list[bytes], length: int = LENGTH, size: int = NAME) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, name, context name) of each anchor: its context is bytes start to end of the text.

    The contexts of a text's anchors hold all its windows, each in one context. Shorter texts have none.
    """
    out: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(texts):
        picked, held = [], 0
        while at < len(texts) and (not picked or held < CHUNK):
            if len(texts[at]) >= length:
                picked.append(at)
                held += len(texts[at])
            at += 1
        if not picked:
            continue
        data = b"".join(texts[i] for i in picked)
        ends = np.cumsum([len(texts[i]) for i in picked])
        start, end, h = _chunk_anchors(np.frombuffer(data, np.uint8), ends, length, size)
        c = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
        who = np.searchsorted(ends, start, side="right")
        base = np.concatenate(([0], ends))[who]
        out.append((np.asarray(picked)[who], start - base, end - base, h, c))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


class Suffixes:
    """Suffixes as columns: name, context name, doc_id, text hash, start, length, marked."""

    FIELDS = ("h", "c", "doc", "th", "start", "size", "marked")

    def __init__(self, *columns: np.ndarray):
        self.h, self.c, self.doc, self.th, self.start, self.size, self.marked = columns

    def __len__(self) -> int:
        return len(self.h)

    def __getitem__(self, which: np.ndarray) -> Suffixes:
        return Suffixes(*(getattr(self, f)[which] for f in self.FIELDS))

    def __add__(self, other: Suffixes) -> Suffixes:
        return _joined([self, other])

    def array(self) -> Suffixes:
        """In the order of names; of equals, the earliest in the documents first."""
        return self[self.order(self.h)]

    def halves(self) -> np.ndarray:
        """The upper halves of both names."""
        return self.h >> np.uint64(32) << np.uint64(32) | self.c >> np.uint64(32)

    def order(self, first: np.ndarray, kind: str = "quicksort") -> np.ndarray:
        """Places by a number of each that goes before names. kind: stable is faster where sorted parts follow each other."""
        at = np.argsort(first, kind=kind)
        tied = _with_equals(first[at])
        several = at[tied]
        at[tied] = several[np.lexsort((self.start[several], self.doc[several], self.c[several], self.h[several], first[several]))]
        return at


def _with_equals(x: np.ndarray) -> np.ndarray:
    """Which of a sorted array have equals."""
    out = np.zeros(len(x), bool)
    same = x[1:] == x[:-1]
    out[1:] = same
    out[:-1] |= same
    return out


def _joined(parts: list[Suffixes]) -> Suffixes:
    return Suffixes(*(np.concatenate([getattr(x, f) for x in parts]) for f in Suffixes.FIELDS))


def same_contexts(a: Suffixes) -> np.ndarray:
    """Later ones of equal contexts in a sorted array; the first is marked if one of them is."""
    if not len(a):
        return np.zeros(0, bool)
    new = np.concatenate(([True], (a.h[1:] != a.h[:-1]) | (a.c[1:] != a.c[:-1])))
    first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    a.marked[first[a.marked]] = True
    return (a.doc != a.doc[first]) | (a.start != a.start[first])


def scan(a: Suffixes) -> np.ndarray:
    """Later ones of equal contexts in a sorted array; the others are marked where names have several contexts."""
    later = same_contexts(a)
    if not len(a):
        return later
    new_h = np.concatenate(([True], a.h[1:] != a.h[:-1]))
    new_c = new_h | np.concatenate(([True], a.c[1:] != a.c[:-1]))
    name = np.cumsum(new_h) - 1
    several = np.bincount(name, new_c) > 1
    marks = np.bincount(name, a.marked) > 0
    a.marked |= several[name] | marks[name]
    return later


class Family:
    """Levels of suffix arrays, each at least twice as large as the next, in the order of halves of both names, so a context is found without others of its name.

    What a batch takes from a level stays there, as dead, until the level is merged."""

    def __init__(self) -> None:
        self.levels: list[Suffixes] = []
        self.halves: list[np.ndarray] = []
        self.dead: list[np.ndarray] = []

    def add(self, batch: Suffixes) -> list[Suffixes]:
        """Take in a batch; returns the suffixes whose contexts are now known to come earlier too."""
        gone: list[Suffixes] = []
        batch = batch[batch.order(batch.halves())]
        later = same_contexts(batch)
        gone.append(batch[later])
        batch = batch[~later]
        halves = batch.halves()
        for level, known, dead in zip(self.levels, self.halves, self.dead, strict=True):
            left, right = np.searchsorted(known, halves, "left"), np.searchsorted(known, halves, "right")
            here = np.nonzero(right > left)[0]
            if not len(here):
                continue
            # the places in the level, each once
            once = here[np.concatenate(([True], halves[here[1:]] != halves[here[:-1]]))]
            many = right[once] - left[once]
            there = np.repeat(left[once] - np.cumsum(many) + many, many) + np.arange(many.sum())
            there = there[~dead[there]]
            both = level[there] + batch[here]
            order = both.order(np.concatenate((known[there], halves[here])))
            both = both[order]
            later = same_contexts(both)
            gone.append(both[later])
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            of_level, of_batch = back[: len(there)], back[len(there) :]
            level.marked[there] = both.marked[of_level]
            batch.marked[here] = both.marked[of_batch]
            dead[there[later[of_level]]] = True
            stays = np.ones(len(batch), bool)
            stays[here[later[of_batch]]] = False
            batch, halves = batch[stays], halves[stays]
        self._push(batch, halves)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            alive = [~x for x in self.dead[-2:]]
            both = _joined([x[k] for x, k in zip(self.levels[-2:], alive, strict=True)])
            halves = np.concatenate([x[k] for x, k in zip(self.halves[-2:], alive, strict=True)])
            del self.levels[-2:], self.halves[-2:], self.dead[-2:]
            order = both.order(halves, "stable")
            self._push(both[order], halves[order])
        return gone

    def _push(self, level: Suffixes, halves: np.ndarray) -> None:
        self.levels.append(level)
        self.halves.append(halves)
        self.dead.append(np.zeros(len(level), bool))

    def marked(self) -> list[Suffixes]:
        """The first of each context whose name has several, or that was marked."""
        alive = [x[~dead] for x, dead in zip(self.levels, self.dead, strict=True)]
        h = np.concatenate([x.h for x in alive]) if alive else np.zeros(0, np.uint64)
        at = np.argsort(h)
        several = np.zeros(len(h), bool)
        several[at[_with_equals(h[at])]] = True
        ends = np.cumsum([len(x) for x in alive])
        return [x[(x.marked | s) & (x.size > 0)] for x, s in zip(alive, np.split(several, ends[:-1]), strict=True)] if alive else []


_ROWS = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("span", pa.int64())])
_ROWS_DDL = "kind int, h long, c long, doc long, th long, span long"
#: Kinds of rows: a passage, an anchor, an anchor that is marked already.
PASSAGE, ANCHOR, MARKED = 0, 1, 2


def _rows(kind: int | np.ndarray, x: Suffixes, plain: bool = False) -> pa.RecordBatch:
    n = len(x)
    zero = np.zeros(n, np.int64)
    kinds = np.full(n, kind, np.int32) if np.isscalar(kind) else kind
    span = x.start.astype(np.int64) << 16 | x.size
    return pa.RecordBatch.from_arrays([pa.array(kinds), *map(pa.array, (zero if plain else x.h.view(np.int64), zero if plain else x.c.view(np.int64), x.doc, x.th, span))], schema=_ROWS)


def _key(docs: DataFrame) -> DataFrame:
    """docs with doc and th, which tell a text: th only where doc_ids repeat."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))
    repeats = docs.groupBy(doc.alias("d")).count().filter("count > 1").limit(1).count()
    return docs.select("doc_id", doc.alias("doc"), (F.xxhash64("text") if repeats else F.lit(0).cast("long")).alias("th"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        who, start, end, h, c = anchors(b.column("bytes").to_pylist())
        if not len(who):
            continue
        doc, th = (b.column(x).to_numpy(zero_copy_only=False)[who] for x in ("doc", "th"))
        a = Suffixes(h, c, doc, th, start, end - start, np.zeros(len(h), bool)).array()
        later = scan(a)
        yield _rows(PASSAGE, a[later], plain=True)
        a = a[~later]
        yield _rows(np.where(a.marked, MARKED, ANCHOR).astype(np.int32), a)
        if a.marked.any():  # one row for each name that is marked here
            m = np.unique(a.h[a.marked])
            zero = np.zeros(len(m), np.int64)
            yield _rows(ANCHOR, Suffixes(m, zero.view(np.uint64), np.full(len(m), np.iinfo(np.int64).max), zero, zero, zero, zero.astype(bool)))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family, held, n = Family(), [], 0

    def take() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        col = {x: t.column(x).to_numpy() for x in t.column_names}
        for x in family.add(Suffixes(col["h"].view(np.uint64), col["c"].view(np.uint64), col["doc"], col["th"], col["span"] >> 16, col["span"] & 0xFFFF, col["kind"] == MARKED)):
            yield _rows(PASSAGE, x[x.size > 0], plain=True)

    for b in batches:
        passages = b.filter(pa.compute.equal(b.column("kind"), PASSAGE))
        if passages.num_rows:
            yield passages
        rest = b.filter(pa.compute.not_equal(b.column("kind"), PASSAGE))
        held.append(rest)
        n += rest.num_rows
        if n >= BATCH:
            yield from take()
            held, n = [], 0
    if held:
        yield from take()
    for x in family.marked():
        yield _rows(MARKED, x)


_WINDOWS = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("w", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])
_WINDOWS_DDL = "kind int, h long, w long, doc long, th long, start long, bytes binary"


def _windows(h: np.ndarray, doc: np.ndarray, th: np.ndarray, start: np.ndarray, contexts: list[bytes]) -> Suffixes:
    """Every window of some contexts, as suffixes of one window each; the hash of the window is the name, as fewer are equal."""
    per = np.array([len(x) - LENGTH + 1 for x in contexts], np.int64)
    w = np.fromiter((xxhash.xxh3_64_intdigest(x[i : i + LENGTH]) for x, n in zip(contexts, per.tolist(), strict=True) for i in range(n)), np.uint64, int(per.sum()))
    at = np.repeat(start, per) + np.arange(len(w)) - np.repeat(np.cumsum(per) - per, per)
    return Suffixes(w, np.repeat(h, per).view(np.uint64), np.repeat(doc, per), np.repeat(th, per), at, np.full(len(w), LENGTH), np.zeros(len(w), bool))


def _passage_windows(x: Suffixes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in (x.doc, x.th, x.start << 16 | x.size)], ["doc", "th", "span"])


def _middles(strips: np.ndarray) -> np.ndarray:
    """Where in its context each anchor is; strips: the contexts' first LENGTH bytes, as rows."""
    h = np.concatenate((names(strips.ravel()), np.zeros(NAME - 1, np.uint64)))
    return h.reshape(strips.shape)[:, : LENGTH - NAME + 1].argmin(1)


_PIECES = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])
_PIECES_DDL = "h long, doc long, th long, start long, bytes binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked contexts in at most two pieces, one with the windows that hold SIDE bytes before their anchor, one with the others.

    Equal windows hold equal bytes on the same side, so only pieces with equal middles (h: a hash of the anchor with that side) can share any."""
    for b in batches:
        marks, data = b.column("marks"), b.column("bytes")
        if pa.types.is_large_binary(data.type):
            data = data.cast(pa.binary())
        ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
        who = np.repeat(np.arange(len(b)), np.diff(marks.offsets.to_numpy()))
        text = data.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if len(who) else b""
        ends = ends - ends[0]
        raw = np.frombuffer(text, np.uint8)
        span = marks.flatten().to_numpy(zero_copy_only=False)
        doc, th = (b.column(x).to_numpy(zero_copy_only=False)[who] for x in ("doc", "th"))
        for at in range(0, len(who), 4096):
            part = slice(at, at + 4096)
            start, size = span[part] >> 16, span[part] & 0xFFFF
            base = ends[who[part]] + start
            anchor = _middles(raw[base[:, None] + np.arange(LENGTH)])
            for chosen, low, high, left, right in (
                (anchor >= SIDE, np.zeros_like(anchor), np.minimum(size, anchor + LENGTH - SIDE), anchor - SIDE, anchor + NAME),
                (size - LENGTH > anchor - SIDE, np.maximum(anchor - SIDE + 1, 0), size, anchor, anchor + LENGTH - SIDE + 1),
            ):
                i = np.nonzero(chosen)[0]
                h = np.fromiter((xxhash.xxh3_64_intdigest(text[x:y]) for x, y in zip((base + left)[i].tolist(), (base + right)[i].tolist(), strict=True)), np.uint64, len(i)).view(np.int64)
                found = [text[x:y] for x, y in zip((base + low)[i].tolist(), (base + high)[i].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, doc[part][i], th[part][i], (start + low)[i])] + [pa.array(found, pa.binary())], schema=_PIECES)


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, but where they are hot all their windows."""
    for b in batches:
        hot = b.column("hot").to_numpy(zero_copy_only=False)
        cold = b.filter(pa.array(~hot))
        n = cold.num_rows
        col = [cold.column(x) for x in ("h", "doc", "th", "start", "bytes")]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, ANCHOR, np.int32)), col[0], pa.array(np.zeros(n, np.int64)), *col[1:]], schema=_WINDOWS)
        if hot.any():
            b = b.filter(pa.array(hot))
            a = _windows(*(b.column(x).to_numpy() for x in ("h", "doc", "th", "start")), b.column("bytes").to_pylist()).array()
            later = scan(a)
            for kind, x in ((PASSAGE, a[later]), (MARKED, a[~later])):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), *map(pa.array, (x.c.view(np.int64), x.h.view(np.int64), x.doc, x.th, x.start)), pa.array([b""] * len(x), pa.binary())], schema=_WINDOWS)


def _shared_windows(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Later ones of equal windows of pieces; a piece with a middle of its own has none. Pieces with equal middles are looked at together, some 4 * BATCH windows at once."""
    t = pa.Table.from_batches(pieces).combine_chunks()
    h = t.column("h").to_numpy()
    at = np.argsort(h)
    at = at[_with_equals(h[at])]
    if not len(at):
        return
    h = h[at]
    size = pa.compute.binary_length(t.column("bytes")).to_numpy()
    before = np.cumsum(size[at] - LENGTH + 1) // (4 * BATCH)
    first = np.nonzero(np.concatenate(([True], h[1:] != h[:-1])))[0]
    cuts = first[np.concatenate(([True], before[first[1:]] != before[first[:-1]]))]
    for low, high in zip(cuts, [*cuts[1:], len(at)], strict=True):
        part = t.take(at[low:high])
        a = _windows(*(part.column(x).to_numpy() for x in ("h", "doc", "th", "start")), part.column("bytes").to_pylist()).array()
        yield _passage_windows(a[scan(a)])


def _first_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces: list[pa.RecordBatch] = []
    held: list[Suffixes] = []
    new = old = 0
    for b in batches:
        kind = b.column("kind").to_numpy()
        whole = kind == ANCHOR
        if whole.any():
            pieces.append(b.filter(pa.array(whole)))
        if whole.all():
            continue
        col = {x: b.column(x).to_numpy() for x in ("h", "w", "doc", "th", "start")}
        known = kind == PASSAGE
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (col["doc"][known], col["th"][known], col["start"][known] << 16 | LENGTH)], ["doc", "th", "span"])
        held.append(Suffixes(col["w"].view(np.uint64), col["h"].view(np.uint64), col["doc"], col["th"], col["start"], np.full(len(kind), LENGTH), np.zeros(len(kind), bool))[kind == MARKED])
        new += len(held[-1])
        if new > max(old, 4 * BATCH):  # later ones of equal windows needn't wait; those that stay are gone through again when as many have come
            a = _joined(held).array()
            later = scan(a)
            yield _passage_windows(a[later])
            held, new = [a[~later]], 0
            old = len(held[0])
    if held:
        a = _joined(held).array()
        yield _passage_windows(a[scan(a)])
    if pieces:
        yield from _shared_windows(pieces)


def passages(docs: DataFrame, held: list[str] | None = None) -> DataFrame:
    """doc, th and spans (start << 16 | length, at most LENGTH + 68 long, in any order) of each text
    with passages; docs as of _key. held: gets the paths of tables that the result reads, for discard."""
    bounded_batches(docs.sparkSession)
    seen = docs.select("doc", "th", "bytes").mapInArrow(_find_anchors, _ROWS_DDL)
    route = F.when(F.col("kind") == PASSAGE, F.xxhash64("doc", "span")).when(F.col("kind") == MARKED, F.xxhash64("c")).otherwise(F.col("h"))
    found = written(seen.repartition(route).mapInArrow(_index, _ROWS_DDL), held)
    marked = found.filter(F.col("kind") == MARKED)
    marks = marked.groupBy("doc", "th").agg(F.collect_list("span").alias("marks"))
    # the pieces are few beside the texts; where they are hot is known once all have been counted
    pieces = written(docs.join(marks, ["doc", "th"]).select("doc", "th", "bytes", "marks").mapInArrow(_pieces, _PIECES_DDL), held)
    # at most a row for HOT_NAME pieces
    hot = pieces.groupBy("h").count().filter(F.col("count") >= HOT_NAME).select("h", F.lit(True).alias("hot"))
    named = pieces.join(F.broadcast(hot), "h", "left").select("h", "doc", "th", "start", "bytes", F.coalesce("hot", F.lit(False)).alias("hot")).mapInArrow(_hot_windows, _WINDOWS_DDL)
    route = F.when(F.col("kind") == ANCHOR, F.col("h")).otherwise(F.xxhash64("h", "w", F.when(F.col("kind") == PASSAGE, F.col("start"))))
    more = named.repartition(route).mapInArrow(_first_windows, "doc long, th long, span long")
    spans = found.filter(F.col("kind") == PASSAGE).select("doc", "th", "span").unionByName(more)
    return spans.groupBy("doc", "th").agg(F.collect_list("span").alias("spans"))


def kept_pieces(n: int, spans: list[int] | None) -> tuple[list[tuple[int, int]], int, int]:
    """(start, end) of what is left of n bytes, the bytes removed and the maximal runs removed."""
    pieces, at, gone, runs = [], 0, 0, 0
    end = -1
    for s in sorted(spans or []):
        start, stop = s >> 16, (s >> 16) + (s & 0xFFFF)
        if start > end:
            runs += 1
            pieces.append((at, start))
            gone += stop - start
            end = stop
        elif stop > end:
            gone += stop - end
            end = stop
        at = end
    pieces.append((at, n))
    return [p for p in pieces if p[1] > p[0]], gone, runs


def remove_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that are left) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, bytes]] = []
            for data, spans in zip(b.column("bytes").to_pylist(), b.column("spans").to_pylist(), strict=True):
                pieces, gone, runs = kept_pieces(len(data), spans)
                out.append((len(data), gone, runs, data if not runs else b"".join(data[x:y] for x, y in pieces)))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    keyed, held = _key(docs), []
    spans = cut(passages(keyed, held))
    discard(docs.sparkSession, held)
    got = keyed.join(spans, ["doc", "th"], "left").select("doc_id", "bytes", "spans")
    return got.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
