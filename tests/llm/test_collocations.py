import re
from collections import Counter

import pyarrow as pa
import pytest

from pathledger.llm import collocations

from .helpers import documents, empty


def brute(rows, least=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting all phrases in one place."""
    f, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, _, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


TEXTS = [
    ("en", "New York City is big, new york city IS big! New  York\tstate; old york city\n" * 4), ("en", "of the of the of the. of the end of the end of the " * 3), (None, "a b a b a b a b a b a b a b a b"),
    ("", "x y. x y, x y: x y? x y\x0bx y\x0cx y\rx y\nx y; x y"), ("de", "ÄB öl ÄB öl. " * 11 + "äb öl" * 12), ("de", " .,;\t\n"), ("fr", None), ("fr", ""), ("en", "is big new york " * 12), ("en", "z" * 5000 + " q " * 30),
]


@pytest.mark.parametrize("chunk", [1 << 19, 40])
def test_phrases_by_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk)
    if chunk == 40:
        monkeypatch.setattr(collocations, "BUCKET_BYTES", 500)
    docs = documents(spark, [(1000 + i, t, lang, "s", 1) for i, (lang, t) in enumerate(TEXTS)])
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    got = sorted(tuple(r) for r in collocations.phrases(docs).collect())
    assert got == brute(rows) and len(got) > 20
    assert sorted(tuple(r) for r in collocations.phrases(docs, 3, 5).collect()) == brute(rows, 3, 5)


def test_scores_beyond_64_bits(spark):
    n = 10**12
    rows = [("en", 1, "a", 3 * n), ("en", 1, "b", 2 * n + 1), ("en", 2, "a b", n + 7), ("en", 0, "", 5 * n)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, words byte, phrase string, n long")).collect()
    assert [(r["l"], r["r"], r["score"]) for r in got] == [(3 * n, 2 * n + 1, 1000000 * (n + 7) ** 2 // (3 * n * (2 * n + 1)))]


def test_chunks_count_by_weight():
    import numpy as np

    got = {(k, p): n for k, ps, ns, _ in collocations.chunk_counts(pa.array(["a b a b", "b", "a b c"]), np.array([2, 5, 1])) for p, n in zip(ps.to_pylist(), ns.tolist(), strict=True)}
    assert got == {(0, ""): 16, (1, "a"): 5, (1, "b"): 10, (1, "c"): 1, (2, "a b"): 5, (2, "b a"): 2, (2, "b c"): 1, (3, "a b a"): 2, (3, "b a b"): 2, (3, "a b c"): 1}


def test_no_rows(spark):
    assert collocations.phrases(empty(spark)).collect() == []
