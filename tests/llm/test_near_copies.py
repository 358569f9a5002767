import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from pathledger.llm import near_copies, simhash

from .helpers import SCHEMA, documents, empty, prose


def brute(texts):
    sets = [near_copies.shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def edited(rng, text, n):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), n):
        w[i] = "edited%d" % rng.randrange(10**6)
    return " ".join(w)


def test_edited_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    texts = []
    for n in (50, 100, 300, 1000):
        for _ in range(8):
            base = prose(rng, n)
            texts += [base, *(edited(rng, base, k) for k in (1, 1, max(1, n // 60), max(1, n // 45), n // 12))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z", "w") for i, t in enumerate(texts)], SCHEMA)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert kept == sorted(set(brute(texts)))


def test_chains_and_pairs_without_the_smallest_text_are_joined(spark):
    # each text shares words with the next, only the neighbours are similar
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[5 * i : 5 * i + 100]) for i in range(50)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z", "w") for i, t in enumerate(texts)], SCHEMA)
    assert [r["doc_id"] for r in near_copies.keep_one(docs).collect()] == [0] and set(brute(texts)) == {0}


def test_rows_columns_and_empty_tables(spark):
    docs = documents(spark)
    kept = near_copies.keep_one(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns
    assert ids.count(106) == 1 and not {101, 102, 103, 104, 107} & set(ids) and {0, 100, 105} <= set(ids)
    assert near_copies.keep_one(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [2048, 3])
def test_families_that_share_keys_but_are_not_similar(spark, monkeypatch, block):
    """Members of a star lie just beyond the limit from its middle; a few pairs among them are similar."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(9)
    base = prose(rng, 300)
    far = [edited(rng, base, 11) for _ in range(30)]
    texts = [base, *far, *(edited(rng, f, 2) for f in far[::5])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z", "w") for i, t in enumerate(texts)], SCHEMA)
    kept = sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect())
    assert kept == sorted(set(brute(texts))) and 20 < len(kept) < len(texts)


def test_sketches_tell_how_alike_sets_are():
    rng = random.Random(4)
    base = prose(rng, 400)
    marks = [near_copies.sketch(t) for t in (base, edited(rng, base, 4), prose(rng, 400))]
    same = [sum(a == b for a, b in zip(marks[0], m, strict=True)) for m in marks]
    assert same[0] == near_copies.SKETCH and same[1] >= near_copies.AGREE > same[2] and 200 < near_copies.AGREE < 256


def test_stage_links_by_fingerprints_too(spark):
    """A passage that comes once beside one that repeats: apart by their sets of shingles, one by op4's fingerprints."""
    rng = random.Random(12)
    words = prose(rng, 40).split(" ")
    base = " ".join(words)
    texts = [" ".join([base] * 60), " ".join([base] * 60 + prose(rng, 20).split(" ")), prose(rng, 200)]
    marks = [simhash.fingerprint(t) for t in texts]
    assert (marks[0] ^ marks[1]).bit_count() <= simhash.RADIUS < (marks[0] ^ marks[2]).bit_count() and brute(texts) == [0, 1, 2]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z", "w") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [0, 2]


@pytest.mark.parametrize("same", [True, False])
def test_a_block_gives_fewer_links_than_it_has_texts(same):
    rng = random.Random(6)
    base = prose(rng, 150)
    texts = [edited(rng, base, 1 if i % 3 else 9) for i in range(90)]
    sets = [np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in near_copies.shingles(t)), np.uint64)) for t in texts]
    side = np.arange(90) % 2 * (not same)
    found = near_copies.block_links(np.arange(90), side, sets, same)
    pairs = [(a, b) for a in range(90) for b in range(a) if (same or side[a] != side[b]) and near_copies.similar(near_copies.shingles(texts[a]), near_copies.shingles(texts[b]))]

    def roots(links):
        root = list(range(90))
        for _ in range(90):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert roots(found) == roots(pairs) and len(found) == 90 - len(set(roots(pairs))) < len(pairs)
    assert not near_copies.block_links(np.zeros(90, int), side, sets, same)
