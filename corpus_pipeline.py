"""Corpus preparation: quality rules, near-duplicates, surrogates, mixture, length buckets.

Each stage reads what the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathledger.llm import mixing, near_copies, packing, pii, quality, simhash
from pathledger.llm.common import discard, table, written
from pathledger.llm.queries import SYNTHETIC_KEY

#: Per cent of the tokens that reach the mixture.
MIXTURE_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays. Texts are linked by op4 (fingerprints of 3-word shingles that differ in 2 bits at
    most, through vantage-point trees), and beyond that by an exact check of their 5-word shingles (similarity 0.8 or more)."""
    return near_copies.keep_one(docs, simhash.text_links)


def surrogate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in the texts give way to surrogates; n_chars follows the text."""
    got = pii.pseudonymise(docs, pii.session_key(spark, SYNTHETIC_KEY))
    return got.select(*[(F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(c)).alias(c) for c in docs.columns])


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the budgets of their sources take, once at most."""
    return mixing.keep_mixture(docs, budget_percent=MIXTURE_PERCENT)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each sequence with its place in a batch."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("surrogates", surrogate_stage),
    ("mixture", mixture_stage),
    ("length buckets", packing_stage),
]
#: Keys of near copies need XXH64, which DuckDB doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is held in the shared folder, so none runs twice."""
    docs = table(spark, sf_dir, "documents")
    held: list[str] = []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, held)
            discard(spark, [held.pop(0) for _ in held[:-1]])
    return docs
