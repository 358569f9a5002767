"""Periodic runs of words by divide and conquer.

A run is a stretch of words with smallest period q, at least MIN_WORDS words and MIN_PERIODS periods long, that no
neighbouring word extends. A text's words become numbers (equal words, equal number). The text is halved again and
again, down to pieces shorter than MIN_WORDS. At each midpoint two Z-functions tell, for every period, how far the
words around the midpoint go on repeating to the left and to the right: one for periods that lie right of the
midpoint, one for those left of it. A run is found whole by the smallest piece that holds it, as it crosses that piece's
midpoint; a repetition that goes on beyond its piece belongs to a larger one and is left to it. Of equal stretches
the smallest period stays. So a text of n words takes n log n steps, whatever repeats in it.

A run that crosses a midpoint has a half of 12 words or one and a half periods on one side at least, so GRAM words at the midpoint come
again on that side, a period away. Midpoints where no equal GRAM words follow or precede (compared by hashes, for a whole batch
of texts at once) need no Z-function; this drops nothing.

Null texts have no words; empty and blank ones neither. Very long texts are handled whole, one at a time. Repeated rows
and null doc_ids stay as rows of their own; other columns aren't read, so their names can't clash. No rows: no result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MIN_WORDS, MIN_PERIODS = 24, 3
#: Words that any run repeats at a midpoint, a period away: 12 - p or half of p at least, so 4 for 24 words and 3 periods.
GRAM = 4
#: Words of the texts that are held together, and places that are screened together, about; longer texts and pieces come alone.
BATCH_WORDS, BATCH_PLACES = 1 << 18, 1 << 20
_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest stretch there that s starts with."""
    n = len(s)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _crossing(ids: list[int], lo: int, mid: int, hi: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the repetitions long enough in ids[lo:hi] around mid, of which none goes on beyond it."""
    u, v = ids[lo:mid], ids[mid:hi]
    back = u[::-1]
    # places with v: words from mid on; places with back: words before mid, backwards. -1 is no word's number.
    ahead = z_function([*v, -1, *u, *v])
    behind = z_function([*back, -1, *v[::-1], *back])
    nu, nv = len(u), len(v)
    n = len(ids)
    for p in range(1, nv):
        after, before = ahead[p], behind[nu + 1 + nv - p]
        length = before + p + after
        if length >= MIN_WORDS and length >= MIN_PERIODS * p:
            yield from _whole(ids, mid - before, mid + p + after, p, lo, hi, n)
    for p in range(1, nu):
        after, before = ahead[nv + 1 + nu - p], behind[p]
        length = before + p + after
        if length >= MIN_WORDS and length >= MIN_PERIODS * p:
            yield from _whole(ids, mid - p - before, mid + after, p, lo, hi, n)


def _whole(ids: list[int], start: int, end: int, p: int, lo: int, hi: int, n: int) -> Iterator[tuple[int, int, int]]:
    if (start == lo and lo and ids[lo - 1] == ids[lo - 1 + p]) or (end == hi and hi < n and ids[hi] == ids[hi - p]):
        return
    yield start, end, p


def pieces(n: int) -> Iterator[tuple[int, int, int]]:
    """(low, middle, high) of a text of n words, halved down to MIN_WORDS."""
    level = [(0, n)]
    while level:
        below = []
        for lo, hi in level:
            if hi - lo >= MIN_WORDS:
                mid = (lo + hi) // 2
                yield lo, mid, hi
                below += [(lo, mid), (mid, hi)]
        level = below


def _grams(ids: np.ndarray) -> np.ndarray:
    """A hash of the GRAM words from each place on."""
    gram = np.zeros(max(0, len(ids) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        gram += (ids[i : len(ids) - GRAM + 1 + i].astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX[i])
    return gram


def _screen(gram: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Whether each piece (low, middle, high) may have a run around its middle.

    All pieces together, as one flat array of their places: the GRAM words from the middle on come again in the right part, or
    those before the middle came before in the left one.
    """
    out = np.zeros(len(cuts), bool)
    for low, high, at in ((cuts[:, 1] + 1, cuts[:, 2] - GRAM + 1, cuts[:, 1]), (cuts[:, 0], cuts[:, 1] - GRAM, cuts[:, 1] - GRAM)):
        size = np.maximum(high - low, 0)
        ends = np.cumsum(size)
        which = np.repeat(np.arange(len(cuts)), size)
        place = np.arange(ends[-1]) - np.repeat(ends - size - low, size)
        out[which[gram[place] == gram[at[which]]]] = True
    return out


def find_runs(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text of word numbers, by start, then period."""
    sizes = [len(t) for t in texts]
    found: list[set[tuple[int, int, int]]] = [set() for _ in texts]
    own = [(k, *c) for k, n in enumerate(sizes) for c in pieces(n)]
    if own:
        at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        cuts = np.array(own, np.int64)
        flat = np.concatenate([np.asarray(t, np.int64) for t in texts])
        parts = np.cumsum(cuts[:, 3] - cuts[:, 1]) // BATCH_PLACES
        chunks = np.split(cuts[:, 1:] + at[cuts[:, 0]][:, None], np.flatnonzero(np.diff(parts)) + 1)
        gram = _grams(flat)
        for i in np.flatnonzero(np.concatenate([_screen(gram, c) for c in chunks])):
            k, lo, mid, hi = own[i]
            found[k].update(_crossing(texts[k], lo, mid, hi))
    out = []
    for f in found:
        least: dict[tuple[int, int], int] = {}
        for start, end, p in f:
            least[start, end] = min(p, least.get((start, end), p))
        out.append(sorted(((start, end - start, p) for (start, end), p in least.items()), key=lambda r: (r[0], r[2])))
    return out


def collapsed(n: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches (from, to) of n words that stay when each run keeps its first period alone."""
    out, at = [], 0
    for a, z in sorted((start + p, start + length) for start, length, p in found):
        if a > at:
            out.append((at, a))
        at = max(at, z)
    return [*out, (at, n)] if at < n else out


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def interned(words: list[bytes]) -> list[int]:
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the tail that repeats, where the document's number asks for one; a null number asks for none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    head = words[a : a + p]
    return words[:a] + (head * ((n - a) // p + 1))[: n - a]


SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _rows(ids: list, words: list[list[bytes]], texts: bool) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(8)]
    kept = []
    for doc, w, found in zip(ids, words, find_runs([interned(w) for w in words]), strict=True):
        best = strongest(found)
        row = (doc, len(w), len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None)
        for c, x in zip(cols, row, strict=False):
            c.append(x)
        text = b" ".join([x for a, z in collapsed(len(w), found) for x in w[a:z]])
        if texts:
            cols[7].append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
            kept.append(text)
        else:
            cols[7].append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest())
            kept.append(hashlib.sha256(text).hexdigest())
    made = [pa.array(c, pa.int64()) for c in cols[:7]]
    last = [pa.array(cols[7], _RUNS), pa.array(kept, pa.binary()).cast(pa.string())] if texts else [pa.array(cols[7], pa.string()), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays([*made, *last], [str(i) for i in range(9)])


def word_runs(docs: DataFrame, plant: bool = False, digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_runs, the strongest run, all runs and the text with each run collapsed to its first period, for every row.

    plant: texts get the repeated tails of :func:`planted` first. digests: the last two columns are runs_sha256 and collapsed_sha256,
    hexadecimal digests of the runs (``start,length,period`` and a line feed each) and of the collapsed text.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words, n = [], [], 0
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                w = (t.as_buffer().to_pybytes() if t.is_valid else b"").split()
                ids.append(i)
                words.append(planted(w, i) if plant else w)
                n += len(w)
                if n >= BATCH_WORDS:
                    yield _rows(ids, words, not digests).rename_columns(names)
                    ids, words, n = [], [], 0
            if ids:
                yield _rows(ids, words, not digests).rename_columns(names)

    schema = SCHEMA if not digests else SCHEMA.partition(", runs")[0] + ", runs_sha256 string, collapsed_sha256 string"
    names = [c.split(" ")[0] for c in schema.replace("struct<start:long,length:long,period:long>", "").split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
