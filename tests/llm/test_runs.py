import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from pathledger.llm import runs

from .helpers import documents, empty


def brute(words):
    """Every stretch that repeats for each period, word by word."""
    n, least = len(words), {}
    for p in range(1, n // 3 + 1):
        start = None
        for i in range(n - p + 1):
            same = i + p < n and words[i] == words[i + p]
            if same and start is None:
                start = i
            if not same and start is not None:
                if i + p - start >= max(24, 3 * p):
                    least.setdefault((start, i + p), p)
                start = None
    return sorted(((a, z - a, p) for (a, z), p in least.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 4), st.lists(st.tuples(st.integers(1, 12), st.integers(0, 60), st.booleans()), max_size=5), st.randoms(use_true_random=False))
def test_runs_are_those_found_word_by_word(kinds, parts, rng):
    ids = []
    for period, length, repeats in parts:
        head = [rng.randrange(kinds) for _ in range(period)]
        ids += [head[i % period] if repeats else rng.randrange(kinds) for i in range(length)]
    other = [rng.randrange(2) for _ in range(40)]
    assert runs.find_runs([ids, [], other, ids]) == [brute(ids), [], brute(other), brute(ids)]


def test_many_places_are_screened_in_parts(monkeypatch):
    rng = random.Random(3)
    texts = [[rng.randrange(2) for _ in range(rng.randint(0, 300))] for _ in range(20)]
    texts.append([i % 7 for i in range(200)] + [rng.randrange(9) for _ in range(100)] + [i % 5 for i in range(100)])
    want = [brute(t) for t in texts]
    assert (0, 200, 7) in want[-1] and runs.find_runs(texts) == want
    monkeypatch.setattr(runs, "BATCH_PLACES", 50)
    assert runs.find_runs(texts) == want


def test_runs_with_overlaps_ties_and_borders():
    a, b = [1, 2] * 15, [1, 3, 2] * 12
    assert runs.find_runs([a + b]) == [[(0, 31, 2), (29, 37, 3)]] == [brute(a + b)]
    assert runs.strongest([(0, 24, 2), (40, 36, 3), (90, 30, 3)]) == (0, 24, 2)
    assert runs.strongest([]) is None
    assert runs.collapsed(50, [(0, 24, 2), (20, 30, 3)]) == [(0, 2)]
    assert runs.find_runs([[5] * 23, [5] * 24]) == [[], [(0, 24, 1)]]
    assert runs.find_runs([[5] * 5000])[0] == [(0, 5000, 1)]


def doc_words(text, doc_id):
    w = [x for x in text.replace("\t", " ").replace("\n", " ").split(" ") if x]
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    a = (h // 10) % len(w)
    p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def test_query_rows_by_brute_force(spark):
    loop = " ".join(["lu mi ka"] * 40)
    extra = [(i, f"start {loop} end {i} " + "re " * 30, "en", "s", 1) for i in range(200, 260)]
    docs = documents(spark, extra)
    got = sorted((tuple(r) for r in runs.word_runs(docs, plant=True, digests=True).collect()), key=str)
    want = []
    for r in docs.collect():
        w = doc_words(r["text"] or "", r["doc_id"])
        found = brute(w)
        dropped = {i for s, n, p in found for i in range(s + p, s + n)}
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{p}\n" for s, n, p in found), " ".join(x for i, x in enumerate(w) if i not in dropped))]
        want.append((r["doc_id"], len(w), len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest))
    assert got == sorted(want, key=str)
    assert sum(r[2] for r in want) > 100 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[2] for r in want)


def test_texts_and_runs_of_the_operator(spark):
    docs = spark.createDataFrame([(1, "x " + "a b " * 12 + "c"), (2, None), (3, "plain words")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.word_runs(docs).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(1, 24, 2)] and got[1]["collapsed"] == "x a b c" and got[1]["exponent_milli"] == 12000
    assert got[2]["collapsed"] == "" and got[2]["runs"] == [] and got[3]["collapsed"] == "plain words" and got[3]["start"] is None
    assert runs.word_runs(empty(spark)).collect() == []
