"""What the operators of this subpackage share: tables, words and checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that part words: space and the controls 09 to 0D.
BLANKS = " \t\n\x0b\x0c\r"
_BLANK_RUN = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _BLANK_RUN))


def n_words(text: Column) -> Column:
    """Number of words without keeping them; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share; where none is set (tests), one beside the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, into the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no column in taken has, whatever its case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"{name}_{uuid.uuid4().hex[:6]}"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Limit the bytes of an Arrow batch, so a batch of very long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def written(df: DataFrame, held: list[str] | None = None) -> DataFrame:
    """Compute df once, as a table in the shared folder: smaller there than a checkpoint. held: gets the table's path, for :func:`discard`."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if held is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, held: list[str]) -> None:
    """Delete written tables that nothing reads any more; any file system of Hadoop."""
    for path in held:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    held.clear()
