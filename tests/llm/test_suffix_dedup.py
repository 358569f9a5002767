import random

import numpy as np
import pyarrow as pa
import pytest

from pathledger.llm import suffix_dedup as sd

from .helpers import documents, empty, prose


def brute(rows):
    """(doc_id, text) to removed bytes, with strings ordered by (doc_id, start)."""
    first = {}
    low = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 99):
            first[b[p : p + 100]] = min(first.get(b[p : p + 100], (2**63, 0)), (low(i), p))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        mark = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (low(i), p):
                mark[p : p + 100] = True
        out[i, t] = (len(b), int(mark.sum()), int((np.diff(np.concatenate(([0], mark.astype(int)))) == 1).sum()), np.frombuffer(b, np.uint8)[~mark].tobytes())
    return out


def passages(rng):
    shared = [prose(rng, rng.randint(12, 60)) for _ in range(6)]
    rows = [(1000 + i, " ".join(rng.choice(shared) if rng.random() < 0.4 else prose(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 9))), "en", "s", 1) for i in range(80)]
    return rows + [(2000, "ab" * 400, "en", "s", 1), (2001, "ab" * 60, "en", "s", 1), (2002, "é" * 90, "en", "s", 1), (2003, "x" * 99, "en", "s", 1), (2004, "x" * 100, "en", "s", 1), (2005, "x" * 101, "en", "s", 1)]


@pytest.mark.parametrize(("batch", "hot"), [(1 << 16, 4096), (16, 2)])
def test_against_brute_force(spark, batch, hot, monkeypatch):
    monkeypatch.setattr(sd, "BATCH", batch)
    monkeypatch.setattr(sd, "HOT_NAME", hot)
    docs = documents(spark, passages(random.Random(4))).repartition(7)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows)
    got = sd.remove_passages(docs).collect()
    assert len(got) == len(rows)
    left = {}
    for r in got:
        left.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])))
    for i in left:
        assert sorted(left[i]) == sorted(want[k] for k in rows if k[0] == i)


def test_family_levels_and_order():
    rng = np.random.default_rng(0)
    family, gone, seen = sd.Family(), 0, {}
    for _ in range(40):
        n = 50
        h = rng.integers(0, 60, n).astype(np.uint64)
        c = rng.integers(0, 3, n).astype(np.uint64)
        doc, start = rng.integers(0, 1000, n), rng.integers(0, 10**6, n)
        for k in zip(h.tolist(), c.tolist(), doc.tolist(), start.tolist(), strict=True):
            seen.setdefault(k[:2], []).append(k[2:])
        gone += sum(map(len, family.add(sd.Suffixes(h, c, doc, np.zeros(n, np.int64), start, np.full(n, 100), np.zeros(n, bool)))))
        sizes = list(map(len, family.levels))
        assert all(a >= 2 * b or b == 0 for a, b in zip(sizes, sizes[1:], strict=False))
    assert gone == sum(len(v) - 1 for v in seen.values())
    marked = {(int(a), int(b)): (int(d), int(s)) for x in family.marked() for a, b, d, s in zip(x.h, x.c, x.doc, x.start, strict=True)}
    several = {h for h, _ in seen if sum(g == h for g, _ in seen) > 1}
    assert marked == {k: min(v) for k, v in seen.items() if k[0] in several}


def test_empty(spark):
    assert sd.remove_passages(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["ab" * 300, "x" * 400, "abc " * 90, None])
def test_anchors_are_the_leftmost_least_names(text):
    rng = random.Random(1)
    texts = [(text or "".join(rng.choice("ab") for _ in range(900))).encode(), b"x" * 99, b"y" * 100]
    who, start, end, h, _ = sd.anchors(texts)
    got = [(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(who, start, end, h, strict=True)]
    want = []
    for i, t in enumerate(texts):
        names = sd.names(np.frombuffer(t, np.uint8)).tolist()
        last = None
        for p in range(len(t) - 99):
            least = min(range(p, p + 69), key=lambda q: (names[q], q))
            if least == last:
                want[-1] = (i, want[-1][1], p + 100, names[least])
            else:
                want.append((i, p, p + 100, names[least]))
            last = least
    assert got == want


def test_pieces_hold_each_window_once_and_equal_windows_agree():
    rng = random.Random(2)
    shared = prose(rng, 60)
    texts = [(prose(rng, 20) + shared[rng.randint(0, 40) :] + prose(rng, 20)).encode() for _ in range(40)]
    who, start, end, _, _ = sd.anchors(texts)
    spans = [[int(a) << 16 | int(b - a) for w, a, b in zip(who, start, end, strict=True) if w == i] for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts, pa.binary()), pa.array(spans, pa.list_(pa.int64()))], ["doc", "th", "bytes", "marks"])
    seen, middle = [], {}
    for r in pa.Table.from_batches(sd._pieces(iter([batch.slice(0, 3), batch.slice(3)]))).to_pylist():
        assert texts[r["doc"]][r["start"] :].startswith(r["bytes"])
        for i in range(len(r["bytes"]) - 99):
            seen.append((r["doc"], r["start"] + i))
            middle.setdefault(r["bytes"][i : i + 100], set()).add(r["h"])
    assert sorted(seen) == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 99)]
    assert len(middle) < len(seen)
    assert all(len(x) == 1 for x in middle.values())


def rows_moved(monkeypatch):
    """How many suffixes have been picked so far."""
    moved = []
    plain = sd.Suffixes.__getitem__
    monkeypatch.setattr(sd.Suffixes, "__getitem__", lambda self, which: moved.append(len(x := plain(self, which))) or x)
    return moved


def test_a_batch_leaves_the_rest_of_its_levels_alone(monkeypatch):
    """Each batch copied all levels that it met, and went through all contexts of its names."""
    rng = np.random.default_rng(0)
    moved = rows_moved(monkeypatch)
    total = {}
    for many in (32, 128):
        family, n = sd.Family(), 64
        c = rng.integers(0, 1 << 63, many * n).astype(np.uint64)
        moved.clear()
        for i in range(many):
            part = np.append(np.arange(i * n, i * n + n), rng.integers(0, i * n + 1))  # one of them has come before
            h = np.where(part % 2 == 0, 7, part).astype(np.uint64)
            family.add(sd.Suffixes(h, c[part], part.astype(np.int64), np.zeros(n + 1, np.int64), np.full(n + 1, i), np.full(n + 1, 100), np.zeros(n + 1, bool)))
        total[many] = sum(moved)
    assert total[128] < 6 * total[32]


def test_windows_that_stay_are_sorted_again_seldom(monkeypatch):
    """All that had stayed was sorted again with each batch."""
    monkeypatch.setattr(sd, "BATCH", 16)
    moved = rows_moved(monkeypatch)
    total = {}
    for many in (16, 64):
        n = 100
        w = np.random.default_rng(0).permutation(many * n)
        batches = [pa.RecordBatch.from_arrays([pa.array(np.full(n, sd.MARKED, np.int32)), *(pa.array(x) for x in (np.zeros(n, np.int64), w[i : i + n], w[i : i + n], np.zeros(n, np.int64), np.zeros(n, np.int64))), pa.array([b""] * n, pa.binary())], schema=sd._WINDOWS) for i in range(0, many * n, n)]
        moved.clear()
        assert sum(b.num_rows for b in sd._first_windows(iter(batches))) == 0
        total[many] = sum(moved)
    assert total[64] < 6 * total[16]
