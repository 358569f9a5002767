"""A persistent dictionary of paths: stable ids without gaps, new ones by an anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathledger.operators.held import held, numbered

SCHEMA = "id long, path binary"


def new_entries(dictionary: DataFrame, paths: DataFrame) -> DataFrame:
    """id and path of the paths that the dictionary (id, path) doesn't have: they go on after its greatest id, in byte order. Null paths have no id."""
    new = paths.select("path").filter("path is not null").distinct().join(dictionary.select("path"), "path", "left_anti")
    last = dictionary.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("last"))
    got = numbered(new, "place", ["path"]).join(F.broadcast(last), F.lit(True))
    return got.select((F.col("last") + F.col("place")).alias("id"), "path")


def extend(dictionary: DataFrame, paths: DataFrame) -> DataFrame:
    """The dictionary with all paths; those it has keep their ids."""
    return dictionary.select("id", "path").unionByName(new_entries(dictionary, paths))


def encode(rows: DataFrame, dictionary: DataFrame, path: str = "path", name: str = "path_id") -> DataFrame:
    """rows with the id of a path column in place of it; null for paths that aren't known."""
    known = dictionary.select(F.col("path").alias(path), F.col("id").alias(name))
    return rows.join(known, path, "left").drop(path)


def decode(shown: DataFrame, dictionary: DataFrame, name: str = "path_id", path: str = "path") -> DataFrame:
    """rows with the path of an id column in place of it. Limit and order the rows first: only shown ones need their paths."""
    known = dictionary.select(F.col("id").alias(name), F.col("path").alias(path))
    return shown.join(known, name, "left").drop(name)


class PathDictionary:
    """A dictionary in a folder, one part for each batch. Batches are added by one writer at a time (the lock of the store); a batch that is added
    again, or was written but not reported, adds nothing."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def rows(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.folder)

    def add(self, paths: DataFrame) -> int:
        """Add a batch of paths; the number of new ones."""
        new = held(new_entries(self.rows(), paths))
        n = new.count()
        if n:
            new.write.mode("append").parquet(self.folder)
        return n
