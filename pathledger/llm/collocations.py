"""Phrases that occur more often than their parts let expect.

Texts are lower-cased (A-Z) and split into pieces at punctuation and line ends. Identical pieces of a language are drawn together
first, with their multiplicity. The pieces' phrases of 1 to MAX_WORDS words are counted in chunks, as numbers: a phrase is the number of
the phrase without its last word and the number of that word. The distinct phrases of a chunk go, as compressed blocks, to the hash buckets of
their words, and DuckDB adds up each bucket, streaming the blocks and spilling beyond its memory. The number of buckets follows the bytes of the
texts, so a bucket stays small; a frequent phrase comes once from a chunk, so none is hot.

Candidates have 2 to MAX_WORDS words. Each cut into a first part and a rest sends a request for either to where that phrase's count lies (a
shuffled join that splits skewed parts). Both occur as often as the candidate at least, so counts below the least frequency aren't kept.
The score of a cut is floor(1000000 a^2 / (l r)) in exact decimals: of 38 digits, so counts may reach 10^15.

Null texts are empty; those, blank ones and texts of punctuation alone have no words. A null language is ``und``, an empty one stays. Very long pieces
are read in one chunk. Repeated rows and any doc_id count alike, other columns aren't read, so their names can't clash. Ties go by count, then by the
phrase's bytes. No rows: no phrases.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written

MAX_WORDS, MIN_COUNT, TOP = 3, 10, 2000
#: A candidate goes if a longer one around it has this share of its occurrences at least.
COVER_PERCENT = 50
#: What parts pieces, and what parts words.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
#: Words that are counted as one chunk, about.
CHUNK_WORDS = 1 << 19
#: Bytes of text for a bucket, and what DuckDB may hold of a bucket in memory.
BUCKET_BYTES, BUCKET_MEMORY = 8 << 20, "200MB"
#: Parts of a language that are ranked apart first.
RANK_PARTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = pa.schema([("lang", pa.string()), ("words", pa.int8()), ("phrase", pa.string()), ("n", pa.int64())])


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (words joined by single spaces) and n: how often it occurs in the language's texts."""
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER + PIECE_ENDS + "\t", _LOWER + "\n" * len(PIECE_ENDS) + " ")
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(text, "\n+")).alias("p"))
    tidy = F.trim(F.when(F.col("p").contains("  "), F.regexp_replace("p", " +", " ")).otherwise(F.col("p")))
    return rows.select("lang", tidy.alias("piece")).filter("piece <> ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("n"))


def chunk_counts(piece: pa.Array, weight: np.ndarray) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(words, phrases, their weighted counts, their hashes) for 0 to MAX_WORDS words; the phrase of no words counts all words."""
    lists = pc.split_pattern(piece, " ")
    coded = lists.values.dictionary_encode()
    word, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))
    ends = lists.offsets.to_numpy()[1:].astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    end, times = np.repeat(ends, sizes), np.repeat(weight, sizes)
    yield 0, pa.array([""]), np.array([int(times.sum())]), np.zeros(1, np.uint64)
    start, number, phrase, hash_ = np.arange(len(word)), word, vocabulary, hashed
    yield 1, phrase, _sums(number, times, len(phrase)), hash_
    for k in range(2, MAX_WORDS + 1):
        fits = start + k <= end[start]
        start, before = start[fits], number[fits]
        if not len(start):
            return
        both, number = np.unique(before << 32 | word[start + k - 1], return_inverse=True)
        head, last = both >> 32, both & 0xFFFFFFFF
        phrase = pc.binary_join_element_wise(phrase.take(pa.array(head)), vocabulary.take(pa.array(last)), " ")
        hash_ = (hash_[head] ^ hash_[head] >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + hashed[last]
        yield k, phrase, _sums(number, times[start], len(both)), hash_


def _sums(number: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, number, weight)
    return out


def _blocks(lang: str, piece: pa.Array, weight: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket and block: the compressed counts of one chunk that belong there."""
    parts = list(chunk_counts(piece, weight))
    bucket = np.concatenate([(h ^ h >> np.uint64(32)) % np.uint64(buckets) for *_, h in parts]).astype(np.int64)
    words = np.concatenate([np.full(len(p), k, np.int8) for k, p, _, _ in parts])
    counts = pa.table([pa.repeat(lang, len(words)), pa.array(words), pa.chunked_array([p for _, p, _, _ in parts]).combine_chunks(), pa.array(np.concatenate([n for _, _, n, _ in parts]))], schema=_BLOCK)
    order = np.argsort(bucket, kind="stable")
    counts, bucket = counts.take(pa.array(order)), bucket[order]
    limits = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    for a, z in zip(limits[:-1], limits[1:], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _BLOCK, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(counts.slice(a, z - a))
        yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "block"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            held.append(part)
            size += pc.sum(pc.add(pc.count_substring(part.column("piece"), " "), 1)).as_py() or 0
            if size >= CHUNK_WORDS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, words, phrase, n: phrases of 1 to MAX_WORDS words with their exact occurrences, min_count at least; words 0: all words of the language."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            lang = chunk.column("lang").combine_chunks().dictionary_encode()
            for i, name in enumerate(lang.dictionary.to_pylist()):
                own = chunk.filter(pc.equal(lang.indices, i))
                yield from _blocks(name, own.column("piece").combine_chunks(), own.column("n").to_numpy(), buckets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block in b.column("block"):
                    yield from pa.ipc.open_stream(block.as_buffer())

        # what DuckDB spills is scratch of this task alone: a task that is run again starts over
        with tempfile.TemporaryDirectory() as scratch, duckdb.connect(config={"memory_limit": BUCKET_MEMORY, "temp_directory": scratch, "threads": 1, "preserve_insertion_order": False}) as con:
            con.register("blocks", pa.RecordBatchReader.from_batches(_BLOCK, read()))
            got = con.execute("SELECT lang, words, phrase, CAST(sum(n) AS BIGINT) AS n FROM blocks GROUP BY ALL HAVING sum(n) >= $1 OR words = 0", [min_count])
            yield from got.to_arrow_reader(1 << 16)

    blocks = pieces(docs).mapInArrow(count, "bucket int, block binary")
    return written(blocks.repartitionById(buckets, "bucket").select("block").mapInArrow(add, "lang string, words byte, phrase string, n long"))


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score for the candidates in a table of counts: of their cuts the one with the lowest score, then the shortest first part."""
    word = F.split("phrase", " ")
    n = F.col("words").cast("int")
    cuts = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(word, 1, k), " ").alias("head"), F.array_join(F.slice(word, k + 1, n - k), " ").alias("rest")))
    asked = found.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "words", "a", "c.*")
    known = found.filter(f"words between 1 and {MAX_WORDS - 1}")
    got = asked.join(known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]).select("lang", "phrase", "words", "a", "k", "rest", "l")
    got = got.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    a, l, r = (f"CAST({x} AS DECIMAL(15,0))" for x in "alr")
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * ({a} * {a})) div ({l} * {r})")
    got = got.select("lang", "phrase", "words", "a", F.struct(score.alias("score"), "k", "l", "r").alias("c"))
    return got.groupBy("lang", "phrase", "words", "a").agg(F.min("c").alias("c")).select("lang", "phrase", "words", "a", "c.l", "c.r", "c.score")


def uncovered(candidates: DataFrame) -> DataFrame:
    """The candidates that no longer one around them covers by COVER_PERCENT."""
    word, n = F.split("phrase", " "), F.col("words").cast("int")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(word, i, k), " "))))
    around = candidates.filter("words >= 3").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("around")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    return candidates.join(around, ["lang", "phrase"], "left").filter(f"around is null or 100 * around < {COVER_PERCENT} * a").drop("around")


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's first top phrases by score, then count, then bytes."""
    found = counts(docs, min_count)
    ranked = written(uncovered(scored(found)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = ranked.withColumn("part", part).withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("at") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    total = found.filter("words = 0").select("lang", F.col("n").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
