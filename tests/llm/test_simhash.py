import random

import numpy as np
import pytest

from pathledger.llm import components as linked
from pathledger.llm import simhash
from pathledger.llm.components import components

from .helpers import documents, empty


def reach(fps, radius=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_components_of_documents_are_those_of_all_pairs(spark):
    docs = documents(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    fps = [r["fp"] for r in got]
    root = reach(fps)
    for i, r in enumerate(got):
        ids = [s["doc_id"] for j, s in enumerate(got) if root[j] == root[i] and s["doc_id"] is not None]
        assert r["component_id"] == min(ids, default=None)
    assert {r["fp"] for r in got if r["doc_id"] in (100, 101, 102)} == {0}


@pytest.mark.parametrize("levels", [1, 3])
def test_links_join_everything_within_the_radius(spark, levels, monkeypatch):
    monkeypatch.setattr(simhash, "MIN_LEVELS", levels)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40)
    near = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (12, 2))]
    fps = sorted({*map(int, base), *near})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(df)).collect()}
    root = reach(fps)
    for i, f in enumerate(fps):
        family = [x for j, x in enumerate(fps) if root[j] == root[i]]
        assert got.get(f, f) == min(family)


def test_dense_families_report_stars(monkeypatch):
    monkeypatch.setattr(simhash, "HELD_LINKS", 50)
    fp = np.array([1 << i for i in range(40)], np.int64)
    a, b = simhash.shard_links(fp, np.ones(40, bool), np.ones(40, bool))
    assert len(a) == 39 and set(b.tolist()) == {1}


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(106) == 1 and 107 not in ids and 103 not in ids and 0 in ids
    got = simhash.near_duplicates(docs)
    assert len(ids) == got.select("grp").distinct().count()
    assert simhash.keep_one(empty(spark)).count() == 0


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[501] == 500


def test_few_links_are_joined_without_rounds(spark):
    """Each round of stars shuffles; with many partitions their small files took more disk than the links."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(501, 500), (7, 7), (900, 900)], "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup("few links", "")
    try:
        got = {r["node"]: r["root"] for r in components(edges).collect()}
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("few links") for s in tracker.getJobInfo(j).stageIds}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {**dict.fromkeys(range(301), 0), 500: 500, 501: 500} and len(stages) <= 8


def test_more_links_than_a_chunk_are_joined(spark, monkeypatch):
    monkeypatch.setattr(linked, "CHUNK", 16)
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(90)]
    root = list(range(1100))
    for _ in range(1100):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["root"] for r in got} == {i: root[i] for p in pairs if p[0] != p[1] for i in p}
