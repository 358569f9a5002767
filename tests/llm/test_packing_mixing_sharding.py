import itertools
import random
import zlib

import pytest

from pathledger.llm import mixing, packing, sharding

from .helpers import documents, empty


def test_limits_are_optimal():
    rng = random.Random(5)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 4)
        pad = lambda limits: sum(c * (min(x for x in limits if x >= n) - n) for n, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
        best = min(pad([*some, lengths[-1]]) for some in itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1))
        got = packing.optimal_limits(lengths, counts, k)
        assert pad(got) == best and len(got) == min(k, len(lengths))
    assert packing.optimal_limits([], []) == []


@pytest.mark.parametrize("slice_rows", [50_000, 3])
def test_every_sequence_has_one_place(spark, slice_rows, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", slice_rows)
    docs = documents(spark)
    got = packing.pack_documents(docs, max_len=500, buckets=3, token_budget=1000).collect()
    words = sum(len((r["text"] or "").split()) for r in docs.collect())
    assert sum(r["seq_len"] for r in got) == words
    places = {(r["bucket_len"], r["batch"], r["slot"]) for r in got}
    assert len(places) == len(got)
    for r in got:
        fit = max(1, 1000 // r["bucket_len"])
        assert r["slot"] < fit and r["padding"] == r["bucket_len"] - r["seq_len"] >= 0
        assert r["slot"] == 0 or (r["bucket_len"], r["batch"], r["slot"] - 1) in places
        assert r["batch"] == 0 or (r["bucket_len"], r["batch"] - 1, fit - 1) in places
    assert packing.pack_documents(empty(spark)).count() == 0


def fill(budget, children):
    """Shares by raising one level until the budget is gone, in small steps."""
    out, left, live = {c: 0.0 for c in children}, float(budget), dict(children)
    while left > 1e-9 and live:
        total = sum(w for w, _ in live.values())
        step = min(left / total, *((m - out[c]) / w for c, (w, m) in live.items()))
        for c, (w, _) in live.items():
            out[c] += w * step
        left -= step * total
        live = {c: (w, m) for c, (w, m) in live.items() if out[c] < m - 1e-9}
    return out


def test_shares_go_to_siblings_before_ancestors(spark):
    rows = spark.createDataFrame([(i, d, lang, s, n) for i, (d, lang, s, n) in enumerate([("web", "en", "a", 10), ("web", "en", "b", 500), ("web", "de", "c", 40), ("code", "en", "d", 900), ("books", "fr", "e", 5)])], "doc_id long, domain string, lang string, source string, n_tokens long")
    got = {r["source"]: r["share"] for r in mixing.plan_mixture(rows, budget_percent=50, max_epochs=1).collect()}
    w = mixing.WEIGHTS
    top = fill(727, {"web": (w["domain"]["web"], 550), "code": (w["domain"]["code"], 900), "books": (w["domain"]["books"], 5)})
    lang = fill(top["web"], {"en": (50, 510), "de": (20, 40)})
    source = fill(lang["en"], {"a": (1, 10), "b": (1, 500)})
    want = {"a": source["a"], "b": source["b"], "c": lang["de"], "d": top["code"], "e": top["books"]}
    for s, x in want.items():
        assert abs(got[s] - x) <= 3


@pytest.mark.parametrize("slice_rows", [4000, 1])
def test_prefixes_meet_the_budgets(spark, slice_rows, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    rows = mixing.leaf_rows(documents(spark))
    plan = mixing.plan_mixture(rows, budget_percent=70).collect()
    took = {}
    for r in mixing.mixture(rows, mixing.plan_mixture(rows, budget_percent=70)).collect():
        k = r["domain"], r["lang"], r["source"]
        took[k] = took.get(k, 0) + r["take_tokens"]
        assert 0 < r["take_tokens"] <= r["n_tokens"]
    for r in plan:
        spent = took.get((r["domain"], r["lang"], r["source"]), 0)
        assert spent >= r["share"] and spent - r["share"] <= 4  # repeats of one row are taken together


def test_kept_documents_and_empty_tables(spark):
    docs = documents(spark)
    kept = mixing.keep_mixture(docs, budget_percent=60)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert mixing.keep_mixture(empty(spark)).count() == 0
    rows = mixing.leaf_rows(empty(spark))
    assert mixing.mixture(rows, mixing.plan_mixture(rows)).count() == 0


def test_shards_are_near_equal_and_gapless(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 300), "en", "s", 1) for i in range(3000)] + [(10_000 + i, "same text " * 9, "en", "s", 1) for i in range(1500)]
    docs = documents(spark, rows)
    got = sharding.shard(docs).collect()
    assert len(got) == docs.count()
    sizes = [0] * 8
    for r in got:
        sizes[r["shard"]] += r["size"]
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    longest = max(r["size"] for r in got)
    assert max(sizes) - min(sizes) <= 2 * longest
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] >= 10_000:
            assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]]) + 1
    assert sharding.shard(empty(spark)).count() == 0


def test_few_rows_still_shard(spark):
    docs = documents(spark).filter("doc_id in (106, 107)")
    assert sharding.shard(docs).count() == 3


def _brute_shards(spark, docs, shards):
    """Rows in the order of keys; the limits nearest to equal bytes that a sort of everything finds."""
    keys = sorted((r["k1"], r["k2"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in sharding.rows_of(docs).collect())
    sums, out, starts = [0], [], {}
    for k in keys:
        sums.append(sums[-1] + k[4])
    limits = [min(range(len(sums)), key=lambda i: (abs(sums[i] - sums[-1] * t / shards), i)) for t in range(1, shards)]
    for i, k in enumerate(keys):
        shard = sum(i >= x for x in limits)
        starts.setdefault(shard, i)
        out.append((k[3] if k[2] else None, k[4], k[5], shard, i - starts[shard]))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_rows", [100_000, 37, 5])
def test_shards_equal_a_sort_of_everything(spark, part_rows, monkeypatch):
    """Whatever the number of ranges: order, sizes and slots."""
    monkeypatch.setattr(sharding, "PART_ROWS", part_rows)
    rng = random.Random(4)
    rows = [(2000 + i, "y" * rng.randint(0, 90), "en", "s", 1) for i in range(150)] + [(5000 + i, "copies of one text", "en", "s", 1) for i in range(90)]
    docs = documents(spark, rows).filter("doc_id is null or doc_id <> 105")
    got = sorted((tuple(r) for r in sharding.shard(docs, tolerance=0.0).collect()), key=str)
    assert got == _brute_shards(spark, docs, 8)


def test_equal_rows_without_ids_are_parted(spark):
    docs = spark.createDataFrame([(None, "the same")] * 1000, "doc_id long, text string")
    got = sharding.shard(docs).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [125] * 8
