"""Functions of path columns.

Paths are bytes; to split them they are read as ISO-8859-1, one character a byte, and
written back unchanged. Functions whose names end in _t take and give that text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_text(path: Column) -> Column:
    return F.decode(path, "ISO-8859-1")


def to_bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def parent_t(t: Column) -> Column:
    """The path above; null for '/', '' and names without a slash."""
    bare = F.rtrim(t, F.lit("/"))
    head = F.regexp_extract(bare, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(bare.contains("/"), F.when(head == "", "/").otherwise(head))


def parent(path: Column) -> Column:
    return to_bytes(parent_t(to_text(path)))


def under_t(t: Column, prefix: Column) -> Column:
    """Whether a path is the prefix or lies below it, by whole segments."""
    return F.when(prefix == "/", t.startswith("/")).otherwise((t == prefix) | t.startswith(F.concat(prefix, F.lit("/"))))


def strictly_under_t(t: Column, prefix: Column) -> Column:
    return (t != prefix) & under_t(t, prefix)


def ancestors_t(t: Column, proper: bool = True) -> Column:
    """The paths above, from the top; with the path itself last unless proper."""
    parts = F.split(t, "/")
    count = F.size(parts) - (1 if proper else 0)
    up = F.transform(F.sequence(F.lit(1), count), lambda i: F.when((i == 1) & (F.get(parts, F.lit(0)) == ""), "/").otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    root = F.array().cast("array<string>") if proper else F.array(F.lit("/"))
    return F.when(t == "/", root).when(count < 1, F.array().cast("array<string>")).otherwise(up)


def directories_t(files: DataFrame, t: str) -> DataFrame:
    """The directories above files, each once, in column t; those that hold files directly are told apart before any path is split up."""
    own = files.select(parent_t(F.col(t)).alias(t)).distinct()
    return own.select(F.explode(ancestors_t(F.col(t), proper=False)).alias(t)).distinct()


def with_ancestors(df: DataFrame, path: str, name: str, proper: bool = True) -> DataFrame:
    """A row for each path above that in column path (bytes), in column name."""
    return df.withColumn(name, F.explode(ancestors_t(to_text(F.col(path)), proper))).withColumn(name, to_bytes(F.col(name)))


def relative_t(t: Column, root: Column) -> Column:
    """The path below a root it lies under; '' for the root."""
    return F.when(root == "/", F.substr(t, F.lit(2))).when(t == root, "").otherwise(F.substr(t, F.length(root) + 2))


def top_segment_t(t: Column, root: Column) -> Column:
    """First segment below the root; '.' for the root itself."""
    first = F.split_part(relative_t(t, root), F.lit("/"), F.lit(1))
    return F.when(first == "", ".").otherwise(first)


def depth_t(t: Column) -> Column:
    return F.when(t == "/", 0).otherwise(F.size(F.split(t, "/")) - 1)


def domain_key(major_minor: Column, root: Column, kind: Column, source: Column) -> Column:
    return F.concat_ws("|", major_minor, F.decode(root, "UTF-8"), kind, source)


def hex_path(path: Column) -> Column:
    return F.lower(F.hex(path))


def traversal_key(path: Column) -> Column:
    """Sorts as a depth-first walk with siblings in byte order."""
    return to_bytes(F.replace(to_text(path), F.lit("/"), F.lit("\0")))


def traversed(key: Column) -> Column:
    """The path of a traversal key; paths hold no zero bytes."""
    return to_bytes(F.replace(to_text(key), F.lit("\0"), F.lit("/")))


def protected_t(t: Column, never: list[str]) -> Column:
    """Whether a path is, lies below, or lies above one that must not be folded."""
    out = F.lit(False)
    for n in never:
        out = out | under_t(t, F.lit(n)) | under_t(F.lit(n), t)
    return out


def excluded_t(t: Column, excludes: list[str]) -> Column:
    out = F.lit(False)
    for e in excludes:
        out = out | under_t(t, F.lit(e))
    return out
