import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from pathledger.llm import lm

from .helpers import documents, empty, prose


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in lm.first_weights().items()}
    w["U"] += rng.standard_normal(w["U"].shape) * 0.2
    stats = lm.Stats.__new__(lm.Stats)
    stats.follow = rng.dirichlet(np.ones(lm.CLASSES), 50)
    s, r, t = rng.integers(-1, 40, (3, 2 * lm.BLOCK)), rng.integers(0, 50, (3, lm.BLOCK)), rng.integers(-1, 60, (3, lm.BLOCK))
    s[:, lm.BLOCK :] = np.maximum(s[:, lm.BLOCK :], 0)
    _, g = lm.gradients(w, stats, s, r, t)
    for name in lm.NAMES:
        at = tuple(rng.integers(0, min(n, 20)) for n in w[name].shape)
        if name == "bias":
            at = (3,)
        old, e = w[name][at], 1e-5
        w[name][at] = old + e
        up, _ = lm.gradients(w, stats, s, r, t)
        w[name][at] = old - e
        down, _ = lm.gradients(w, stats, s, r, t)
        w[name][at] = old
        assert abs((up - down) / (2 * e) - g[name][at]) < 2e-4, name


@pytest.mark.parametrize("large", [1, 12])
def test_gradients_are_the_same_with_and_without_shifts(monkeypatch, large):
    rng = np.random.default_rng(2)
    w = {k: v.astype(np.float64) for k, v in lm.first_weights().items()}
    w["E"] *= large
    w["U"] += rng.standard_normal(w["U"].shape) * 0.2
    w["bias"] += rng.standard_normal(w["bias"].shape)
    stats = lm.Stats.__new__(lm.Stats)
    stats.follow = rng.dirichlet(np.ones(lm.CLASSES), 50)
    s, r, t = rng.integers(0, lm.LAST, (5, 2 * lm.BLOCK)), rng.integers(0, 50, (5, lm.BLOCK)), rng.integers(-1, lm.CLASSES, (5, lm.BLOCK))
    s[::2, : lm.BLOCK] = -1
    found = []
    for largest in (0.0, 500.0):
        monkeypatch.setattr(lm, "LARGEST", largest)
        found.append(lm.gradients(w, stats, s, r, t))
    assert abs(found[0][0] - found[1][0]) < 1e-9
    for name in lm.NAMES:
        assert np.allclose(found[0][1][name], found[1][1][name], rtol=1e-7, atol=1e-12), name


def test_a_large_place_beside_a_large_product_is_shifted():
    """exp(59.9) and exp(29.9) each fit single precision, but their product doesn't."""
    stats = lm.Stats.__new__(lm.Stats)
    stats.follow, stats.classes, stats.symbols = np.full((4, lm.CLASSES), 1 / lm.CLASSES, np.float32), np.zeros(9, np.int16), np.zeros(9, np.int16)
    w = lm.first_weights()
    q, k = w["E"] @ w["Q"] / math.sqrt(lm.DIM), w["E"] @ w["K"]
    w["K"] *= np.float32(59.9 / (np.linalg.norm(q, axis=1).max() * np.linalg.norm(k, axis=1).max()))
    w["bias"] += np.float32(29.9)
    assert lm.Model(w, stats).wild


def test_a_step_updates_all_weights_at_once(monkeypatch):
    """As Adam has it, without arrays besides the gradients: they took longer than the update."""
    rng = np.random.default_rng(4)
    w = lm.first_weights()
    plain = {k: (v.astype(np.float64), 0.0, 0.0) for k, v in w.items()}
    adam = lm.Adam(w, None)
    for i in range(1, 13):
        g = {k: rng.standard_normal(v.shape).astype(np.float32) for k, v in w.items()}
        monkeypatch.setattr(lm, "gradients", lambda *_, g=g: (0.0, g))
        tracemalloc.start()
        adam.step(None, None, None, 0.03)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        for k, (x, a, b) in plain.items():
            a, b = 0.9 * a + 0.1 * g[k], 0.98 * b + 0.02 * g[k].astype(np.float64) ** 2
            plain[k] = (x - 0.03 * min(1, i / 10) * a / (1 - 0.9**i) / (np.sqrt(b / (1 - 0.98**i)) + 1e-6), a, b)
    assert most < 100_000
    assert all(np.allclose(adam.w[k], plain[k][0], atol=1e-4) for k in w)
    again = lm.first_weights()
    assert all(np.array_equal(w[k], again[k]) for k in w)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    kinds = (("ka", "to", "mi", "re", "lu", "na"), ("sch", "ung", "keit", "ver", "be", "ge"))  # the words before tell the kind
    docs = documents(spark, [(1000 + i, prose(rng, rng.randint(30, 200), kinds[i % 2]), "en", "s", 1) for i in range(400)])
    return docs.collect(), lm.score_texts(docs, window_words=40).collect()


def test_base_scores_and_counts(scored):
    docs, got = scored
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for r in docs if not held(r["doc_id"]) for w in words(r["text"]))
    n, v = sum(c.values()), len(c)
    want = Counter((r["doc_id"], held(r["doc_id"]), len(words(r["text"])), sum(c[w] > 0 for w in words(r["text"])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(r["text"])), 6)) for r in docs)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want


def test_model_beats_the_base_on_held_out_texts(scored):
    _, got = scored
    rows = [r for r in got if r["held_out"] and r["n_tokens"] > 1]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert all(r["score"] < 0 for r in got)


@pytest.mark.parametrize("known", [lm.KNOWN_IDS, 40])
def test_chances_sum_to_one(spark, monkeypatch, known):
    """Also where most pairs of row and id are not held."""
    monkeypatch.setattr(lm, "KNOWN_IDS", known)
    docs = documents(spark)
    ranks_here = lm.read_ranks()
    ranks = lm.Shared(spark, ranks_here)
    counts = lm.written(lm.word_counts(docs))
    stats = lm.learn_stats(counts, docs.count(), ranks, max(ranks_here.values()) + 2)
    assert np.allclose(stats.follow.sum(1), 1, atol=1e-4)
    # of a class of several ids, the chances after any beginning sum to one
    enc = lm.WordTokens(lm.Bpe(ranks_here), stats)
    enc.bpe.opens[enc.bpe.end] = True
    inner = stats.classes[(stats.classes >= lm.HEADS) & ~enc.bpe.opens]
    first = stats.classes[(stats.classes >= lm.HEADS) & enc.bpe.opens]
    assert not set(inner.tolist()) & set(first.tolist())
    for kind, row in ((inner[0], 0), (inner[0], next(iter(stats.nodes.values()))), (first[0], int(stats.symbols[enc.bpe.end]))):
        tail = np.nonzero(stats.classes == kind)[0]
        before = np.full(len(tail), row)
        p = np.exp(stats.within[tail])
        for r in ((before,) if row < lm.LAST else (np.full(len(tail), stats.last[row - lm.LAST]), before)):
            p = (enc._count(r, tail) + lm.SMOOTH * p) / (enc.held[r, kind] + lm.SMOOTH)
        assert abs(p.sum() - 1) < 1e-3


def _plain_score(w, stats, enc, text):
    """A second scorer: loops over ids, one at a time, from the formulas alone."""
    ids = [enc.encode([x])[0] for x in lm.words_of(text)]
    goal = [t for word in ids for t in word] + [enc.end[0]]
    seen = [enc.end[0], *goal[:-1]]
    sym = [int(stats.symbols[t["id"]]) for t in seen]
    total = 0.0
    for i, t in enumerate(goal):
        q = w["E"][sym[i]] @ w["Q"] / math.sqrt(lm.DIM)
        weigh, mixed = 0.0, np.zeros(lm.DIM)
        for j in range(max(0, (i // lm.BLOCK - 1) * lm.BLOCK), i + 1):
            x = float(q @ (w["E"][sym[j]] @ w["K"]))
            a = math.exp(x + w["bias"][i - j])
            weigh += a
            mixed += a * (w["E"][sym[j]] @ w["V"])
        h = np.maximum(w["E"][sym[i]] @ w["W"] + (mixed / weigh) @ w["M"] + w["b"], 0)
        y = h @ w["U"] + w["c"]
        p = stats.follow[seen[i]["row"]] * np.exp(y)
        total += math.log10(p[stats.classes[t["id"]]] / p.sum()) + t["within"] / math.log(10)
    return total


@pytest.mark.parametrize("large", [1, 8])
def test_scores_equal_a_plain_scorer(spark, large):
    """Each token once, by the formulas; a text scored alone, or among others, has the same score; also where exponentials must be shifted."""
    docs = documents(spark)
    ranks_here = lm.read_ranks()
    stats = lm.learn_stats(lm.written(lm.word_counts(docs)), docs.count(), lm.Shared(spark, ranks_here), max(ranks_here.values()) + 2)
    rng = np.random.default_rng(1)
    w = lm.first_weights()
    w["U"] += rng.standard_normal(w["U"].shape).astype(np.float32) * 0.1
    w["bias"] += rng.standard_normal(w["bias"].shape).astype(np.float32) * 0.3
    w["E"] *= np.float32(large)
    enc = lm.WordTokens(lm.Bpe(ranks_here), stats, [b"mila", b"two"])
    texts = sorted({r["text"] or "" for r in docs.collect()}, key=len)
    texts = [t for t in texts if len(t) < 4000]
    want = [_plain_score(w, stats, enc, t) for t in texts]
    split = [lm.words_of(t) for t in texts]
    got = [enc.tokens(x) for x in split]
    held = stats.follow
    m = lm.Model(w, stats)
    assert m.wild == (large > 1)
    together = m.score(np.concatenate([t for t, _ in got]), np.array([len(t) for t, _ in got]), enc.end)
    alone = [m.score(t, np.array([len(t)]), enc.end, step=3)[0] for t, _ in got]
    assert len(held) and any(len(t) > 3 * lm.BLOCK for t, _ in got)
    assert np.allclose(together, want, atol=2e-3, rtol=1e-4) and np.allclose(alone, want, atol=2e-3, rtol=1e-4)


class Counting(lm.Learner):
    """Learns nothing but how many targets came."""

    def add(self, symbols, rows, target):
        self.n += len(symbols)
        self.adam.w["c"][0] += (target >= 0).sum()

    def done(self):
        return self.adam.w


def test_every_id_of_every_training_text_trains_once(spark, monkeypatch):
    """Windows at seeded places held about one id in twenty."""
    docs = documents(spark, [(2000 + i, prose(random.Random(i), 5 + 13 * i % 400), "en", "s", 1) for i in range(60)]).coalesce(1)
    ranks_here = lm.read_ranks()
    ranks, counts = lm.Shared(spark, ranks_here), lm.written(lm.word_counts(docs))
    stats = lm.learn_stats(counts, docs.count(), ranks, max(ranks_here.values()) + 2)
    monkeypatch.setattr(lm, "Learner", Counting)
    w = lm.fit(spark, docs, ranks, stats, lm.Shared(spark, counts.limit(50).toArrow()))
    bpe = lm.Bpe(ranks_here)
    assert w["c"][0] == sum(len(bpe.ids(lm.words_of(r["text"]))) + 1 for r in docs.collect()) > 5000


def test_windows_are_the_blocks_of_the_texts(spark):
    docs = documents(spark)
    ranks_here = lm.read_ranks()
    stats = lm.learn_stats(lm.written(lm.word_counts(docs)), docs.count(), lm.Shared(spark, ranks_here), max(ranks_here.values()) + 2)
    enc = lm.WordTokens(lm.Bpe(ranks_here), stats)
    texts = ["", prose(random.Random(1), 90), "mila", prose(random.Random(2), 200)]
    tokens = [enc.tokens(lm.words_of(t))[0] for t in texts]
    symbols, rows, target = lm.windows(stats, np.concatenate(tokens), np.array(list(map(len, tokens))), enc.end)
    at = 0
    for own in tokens:
        seen, goal = np.concatenate([enc.end, own]), np.concatenate([own, enc.end])
        for lo in range(0, len(goal), lm.BLOCK):
            n = len(goal[lo : lo + lm.BLOCK])
            assert target[at].tolist() == [*stats.classes[goal["id"][lo : lo + n]].tolist(), *[-1] * (lm.BLOCK - n)]
            assert rows[at, :n].tolist() == seen["row"][lo : lo + n].tolist()
            past = stats.symbols[seen["id"][lo - lm.BLOCK : lo]].tolist() if lo else [-1] * lm.BLOCK
            assert symbols[at, : lm.BLOCK + n].tolist() == past + stats.symbols[seen["id"][lo : lo + n]].tolist()
            at += 1
    assert at == len(target)


def test_empty(spark):
    assert lm.score_texts(empty(spark)).count() == 0


def test_scoring_takes_logarithms_once_and_steps_change_nothing(monkeypatch):
    """Logarithms of a few places with each step were time without use. Scores of texts of any length don't depend on the step."""
    rng = np.random.default_rng(3)
    stats = lm.Stats.__new__(lm.Stats)
    stats.follow = rng.dirichlet(np.ones(lm.CLASSES), 50).astype(np.float32)
    stats.classes, stats.symbols = rng.integers(0, lm.CLASSES, 900).astype(np.int16), rng.integers(0, lm.LAST, 900).astype(np.int16)
    m = lm.Model(lm.first_weights(), stats)
    sizes = np.array([0, 5, 31, 32, 33, 64, 1, 3000, 40])
    tokens = np.zeros(sizes.sum(), lm.TOKEN)
    tokens["id"], tokens["row"] = rng.integers(0, 899, len(tokens)), rng.integers(0, 50, len(tokens))
    end = np.array([(899, 7, -0.5)], lm.TOKEN)
    want = m.score(tokens, sizes, end, step=1)
    for step in (2, 7, 16, 1000):
        assert np.allclose(m.score(tokens, sizes, end, step=step), want, rtol=1e-5)
    made, log = [], np.log
    monkeypatch.setattr(np, "log", lambda *a, **k: made.append(1) or log(*a, **k))
    assert np.allclose(m.score(tokens, sizes, end), want, rtol=1e-5)
    assert len(made) == 2
