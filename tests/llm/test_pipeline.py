import random

import corpus_pipeline

from .helpers import documents, empty, prose

LABELS = "doc_id long, quality int, toxic int"


def folder(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_keeps_clean_documents_and_drops_copies(spark, tmp_path):
    rng = random.Random(3)
    base = [prose(rng, 80) for _ in range(4)]
    extra = [(200 + i, t, "en", "src0", len(t)) for i, t in enumerate(base)] + [(210, base[0], "en", "src1", 1), (211, base[1] + " ending", "en", "src1", 1)]
    extra += [(220, prose(rng, 60) + " mail to ann.smith@corp.test now", "en", "src0", 1)]
    docs = documents(spark, extra)
    sf = folder(spark, tmp_path / "a", docs)
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns, name
        seen.append({r["doc_id"]: r["text"] for r in now.collect()})
    assert {200, 201, 202, 203, 210, 211, 220} <= set(seen[0]) and not {100, 101, 102, 106, 107} & set(seen[0])
    assert {200, 201, 202, 203, 220} <= set(seen[1]) and not {210, 211} & set(seen[1])
    assert seen[2].keys() == seen[1].keys() and "ann.smith@corp.test" not in seen[2][220] and all(seen[2][i] == base[i - 200] for i in range(200, 204))
    assert set(seen[3]) <= set(seen[2])
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    assert packed == set(seen[3])


def test_run_over_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "b", empty(spark))).count() == 0
