"""Semi-structured sources as DataFrames: mount tables, NDJSON usage, NUL-framed open files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathledger.functions.values import parse_size, to_int
from pathledger.operators.held import carried


def unescape(text: Column) -> Column:
    """Bytes of a text in which a backslash and three octal digits stand for a byte; others stay as they are."""
    raw = F.encode(text, "UTF-8")
    pieces = F.regexp_extract_all(F.decode(raw, "ISO-8859-1"), F.lit(r"\\[0-3][0-7]{2}|[^\\]+|\\"), F.lit(0))
    read = F.transform(pieces, lambda p: F.when(p.rlike(r"^\\[0-3][0-7]{2}$"), F.char(F.conv(F.substr(p, F.lit(2)), 8, 10).cast("int"))).otherwise(p))
    return F.when(text.contains("\\"), F.encode(F.array_join(read, ""), "ISO-8859-1")).otherwise(raw)


def parse_mountinfo(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rows of a mount table out of its lines; malformed ones have ``malformed`` set and the rest null."""
    sides = F.split(F.col(value), " - ", 2)
    left, right = F.split(F.get(sides, F.lit(0)), " +"), F.split(F.get(sides, F.lit(1)), " +")
    fine = (F.size(sides) == 2) & (F.size(left) >= 6) & (F.size(right) >= 3)
    got = lines.filter(F.trim(F.col(value)) != "").withColumns({"_l": F.when(fine, left), "_r": F.when(fine, right)})
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    keep = [c for c in lines.columns if c != value]
    return got.select(
        *keep, at("_l", 0).try_cast("bigint").alias("mount_id"), at("_l", 1).try_cast("bigint").alias("parent_id"), at("_l", 2).alias("major_minor"), unescape(at("_l", 3)).alias("root"),
        unescape(at("_l", 4)).alias("mount_point"), F.split(at("_l", 5), ",").alias("options"), at("_r", 0).alias("filesystem_type"), unescape(at("_r", 1)).cast("string").alias("mount_source"),
        F.split(at("_r", 2), ",").alias("super_options"), F.col("_l").isNull().alias("malformed"),
    )


def json_records(lines: DataFrame, fields: str, value: str = "value") -> DataFrame:
    """Records out of NDJSON lines or lines that hold one array of records; ``malformed`` lines give a null record."""
    text = F.trim(F.col(value))
    one, many = F.from_json(text, fields), F.from_json(text, f"array<struct<{fields}>>")
    valid = F.try_parse_json(text).isNotNull()
    keep = [c for c in lines.columns if c != value]
    rows = lines.filter(text != "").withColumn("_v", F.when(~valid, F.array(F.lit(None).cast(f"struct<{fields}>"))).when(text.startswith("["), many).otherwise(F.array(one)))
    return rows.select(*keep, F.explode("_v").alias("record")).withColumn("malformed", F.col("record").isNull())


def usage_categories(lines: DataFrame) -> DataFrame:
    """Type, counts and sizes of container storage, one row for each category line."""
    got = json_records(lines, "Type string, TotalCount string, Active string, Size string, Reclaimable string")
    r = lambda f: F.col(f"record.{f}")
    keep = [c for c in got.columns if c not in ("record", "malformed")]
    return got.filter(~F.col("malformed") & r("Type").isNotNull()).select(
        *keep, r("Type").alias("category"), to_int(r("TotalCount")).alias("total_count"), to_int(r("Active")).alias("active_count"), parse_size(r("Size")).alias("size_bytes"), parse_size(r("Reclaimable")).alias("reclaimable_bytes")
    )


def cache_entries(lines: DataFrame) -> DataFrame:
    """Build-cache entries; sizes are whole numbers or size texts."""
    got = json_records(lines, "ID string, Size string, Reclaimable string, LastUsedAt string")
    r = lambda f: F.col(f"record.{f}")
    keep = [c for c in got.columns if c not in ("record", "malformed")]
    return got.filter(~F.col("malformed") & r("ID").isNotNull()).select(
        *keep, r("ID").alias("cache_id"), F.coalesce(to_int(r("Size")), parse_size(r("Size"))).alias("size_bytes"), (F.lower(r("Reclaimable")) == "true").alias("reclaimable"), r("LastUsedAt").alias("last_used_at")
    )


def cache_totals(entries: DataFrame) -> DataFrame:
    size = F.coalesce("size_bytes", F.lit(0).cast("long"))
    return entries.agg(F.count(F.lit(1)).alias("entry_count"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum(F.when(F.col("reclaimable"), size)), F.lit(0)).alias("reclaimable_bytes"))


def open_files(outputs: DataFrame, value: str = "value") -> DataFrame:
    """Deleted files that processes hold open, out of NUL-delimited tagged fields.

    outputs: one text a row, with an id that tells outputs apart (column ``output``). For texts too large for a row see :func:`field_rows`.
    """
    # an output is cut at its processes, and these at their files; nothing leaves the row's task
    whole = F.concat(F.lit("\0"), F.col(value))
    procs = outputs.select("output", F.posexplode(F.split(whole, r"\x00\n*p")).alias("_at", "_part"))
    rest = lambda part: F.filter(F.transform(F.split(part, r"\x00"), lambda x: F.ltrim(x, F.lit("\n"))), lambda x, i: (i > 0) & (x != ""))
    largest = lambda fields, tag: F.array_max(F.transform(F.filter(fields, lambda x: x.startswith(tag)), lambda x: F.substr(x, F.lit(2))))
    pid = F.when(F.col("_at") > 0, F.substring_index("_part", "\0", 1)).try_cast("bigint")
    files = procs.select("output", pid.alias("pid"), largest(rest(F.col("_part")), "c").alias("command"), F.posexplode(F.split("_part", r"\x00\n*f")).alias("_at", "_file"))
    # what comes before a process's first file is a record without a descriptor
    files = files.withColumns({"fd": F.when(F.col("_at") > 0, F.substring_index("_file", "\0", 1)), "_fields": rest(F.col("_file"))})
    got = files.select("output", "pid", "command", "fd", largest(F.col("_fields"), "t").alias("kind"), largest(F.col("_fields"), "s").try_cast("bigint").alias("size_bytes"), largest(F.col("_fields"), "n").alias("name"))
    return got.filter("name is not null").select(*got.columns[:-1], F.regexp_replace("name", r" \(deleted\)$", "").alias("path"))


def field_rows(spark: SparkSession, path: str) -> DataFrame:
    """Fields of files of any size, for :func:`open_fields`; each file is an output, read in parts by many tasks."""
    rows = spark.read.option("lineSep", "\0").text(path)
    # rows of a part follow one another in one task
    return rows.select(F.col("_metadata.file_path").alias("output"), F.struct(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row")).alias("pos"), F.col("value").alias("field"))


def open_fields(fields: DataFrame) -> DataFrame:
    """The same out of fields (output, pos, field), in the order of pos.

    A process's pid and command hold for the file records after it. They are carried forward over ranges of positions, so one output can be
    spread over many tasks.
    """
    rows = fields.withColumn("field", F.ltrim("field", F.lit("\n"))).filter("field <> ''")
    rows = rows.select("output", "pos", F.substr("field", F.lit(1), F.lit(1)).alias("tag"), F.substr("field", F.lit(2)).alias("text"))
    tag = F.col("tag")
    rows = carried(rows, {"proc": F.when(tag == "p", F.struct("pos", F.col("text").alias("pid"))), "file": F.when(tag == "f", F.col("pos"))}, "pos", ["output"])
    rows = rows.filter(tag.isin("c", "f", "t", "s", "n"))
    pick = lambda x: F.max(F.when(tag == x, F.col("text")))
    commands = rows.filter(tag == "c").groupBy(F.col("output").alias("_o"), F.col("proc.pos").alias("_p")).agg(F.max("text").alias("command"))
    files = rows.filter(tag != "c").groupBy("output", "proc", "file").agg(pick("f").alias("fd"), pick("t").alias("kind"), pick("s").try_cast("bigint").alias("size_bytes"), pick("n").alias("name"))
    got = files.filter("name is not null").join(commands, F.col("output").eqNullSafe(F.col("_o")) & F.col("proc.pos").eqNullSafe(F.col("_p")), "left")
    return got.select("output", F.col("proc.pid").try_cast("bigint").alias("pid"), "command", "fd", "kind", "size_bytes", F.regexp_replace("name", r" \(deleted\)$", "").alias("path"))


def open_file_totals(files: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(shown, totals): the largest first, unknown sizes last."""
    size = F.coalesce("size_bytes", F.lit(0).cast("long"))
    shown = files.orderBy(F.coalesce("size_bytes", F.lit(-1).cast("long")).desc(), "pid", "fd").limit(limit)
    return shown, files.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"), (F.count(F.lit(1)) > limit).alias("truncated"))
