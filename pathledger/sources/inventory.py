"""What the driver's host knows: files under a root, capacity of filesystems, deleted open files.

A walk gives one row for each entry; sizes are summed in Spark (operators.rollup).
"""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from pathledger.functions.values import SKIPPED_FILESYSTEMS

ENTRIES = "root_path string, path binary, kind string, size long, blocks long, nlink long, device long, inode long, error string"
USAGE = "mount_point binary, total_bytes long, used_bytes long, free_bytes long, available_bytes long, capture_error string"
_KINDS = [(stat.S_ISDIR, "directory"), (stat.S_ISREG, "file"), (stat.S_ISLNK, "link")]


def walk(root: str, excludes: list[str] = (), one_filesystem: bool = False) -> Iterator[tuple]:
    """Entries depth first, siblings by bytes; links aren't followed, and no directory is entered twice."""
    base = os.fsencode(root)
    out = [os.fsencode(x) for x in excludes]
    top = os.lstat(base)
    stack, seen = [base], set()
    while stack:
        path = stack.pop()
        if any(path == e or path.startswith(e.rstrip(b"/") + b"/") for e in out):
            continue
        error, names = None, []
        try:
            s = os.lstat(path)
        except OSError as e:
            yield root, path, "unknown", 0, 0, 1, 0, 0, type(e).__name__
            continue
        kind = next((k for test, k in _KINDS if test(s.st_mode)), "other")
        if kind == "directory" and (s.st_dev, s.st_ino) not in seen and not (one_filesystem and s.st_dev != top.st_dev):
            seen.add((s.st_dev, s.st_ino))
            try:
                names = sorted(os.listdir(path), reverse=True)
            except OSError as e:
                error = type(e).__name__
        yield root, path, kind, s.st_size, s.st_blocks, s.st_nlink, s.st_dev, s.st_ino, error
        stack += [path.rstrip(b"/") + b"/" + n for n in names]


def inventory(spark: SparkSession, root: str, excludes: list[str] = (), one_filesystem: bool = False) -> DataFrame:
    return spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in e) for e in walk(root, excludes, one_filesystem)], ENTRIES)


def capacity(spark: SparkSession, mount_points: list[bytes], stat_of: Callable = os.statvfs) -> DataFrame:
    """Usage of each mount point, or why there is none."""
    rows = []
    for point in mount_points:
        try:
            s = stat_of(point)
            rows.append((bytearray(point), s.f_blocks * s.f_frsize, (s.f_blocks - s.f_bfree) * s.f_frsize, s.f_bfree * s.f_frsize, s.f_bavail * s.f_frsize, None))
        except OSError as e:
            rows.append((bytearray(point), None, None, None, None, str(e)))
    return spark.createDataFrame(rows, USAGE)


def deleted_open_files(spark: SparkSession, proc: str = "/proc") -> DataFrame:
    """pid, command, fd and path of open files whose names are gone; sizes aren't known here."""
    rows = []
    for pid in filter(str.isdigit, os.listdir(proc)):
        try:
            with open(f"{proc}/{pid}/comm") as f:
                command = f.read().strip()
            links = [(fd, os.readlink(f"{proc}/{pid}/fd/{fd}")) for fd in os.listdir(f"{proc}/{pid}/fd")]
        except OSError:
            continue
        rows += [(int(pid), command, fd, to.removesuffix(" (deleted)")) for fd, to in links if to.endswith(" (deleted)")]
    return spark.createDataFrame(rows, "pid long, command string, fd string, path string")


def skipped_kinds(extra: list[str] = ()) -> list[str]:
    return sorted({*SKIPPED_FILESYSTEMS, *extra})
