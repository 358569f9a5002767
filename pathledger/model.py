"""Schemas, constants and errors of the snapshot model.

Paths are bytes. A state row describes a directory in a snapshot: sizes and counts of its whole subtree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SNAPSHOTS = "id long, started_at string, finished_at string, root_path string, status string, notes string, error string"
STATE_COLUMNS = [
    "parent_path", "depth", "apparent_bytes", "disk_bytes", "file_count", "dir_count", "error",
    "collapsed", "collapse_reason", "collapsed_dirs", "top_child_path", "top_child_disk_bytes",
]
_STATE = (
    "parent_path binary, depth int, apparent_bytes long, disk_bytes long, file_count long, dir_count long, error string, "
    "collapsed boolean, collapse_reason string, collapsed_dirs long, top_child_path binary, top_child_disk_bytes long"
)
STATE = f"snapshot_id long, root_path string, path binary, {_STATE}"
INTERVALS = f"root_path string, path binary, valid_from_snapshot_id long, valid_to_snapshot_id long, {_STATE}"
MOUNTS = "seq long, snapshot_id long, mount_id long, parent_id long, major_minor string, root binary, mount_point binary, filesystem_type string, mount_source string"
FILESYSTEMS = (
    "seq long, snapshot_id long, mount_id long, major_minor string, root binary, mount_point binary, filesystem_type string, mount_source string, "
    "total_bytes long, used_bytes long, free_bytes long, available_bytes long, capture_error string, created_at string"
)
USABLE = ["complete", "partial"]
GROUPINGS = ["root", "top-level-subtree", "mount", "storage-domain"]

#: A descendant with this share of an ancestor's growth explains it.
DOMINANCE = 0.95
DEFAULT_LIMIT, MAX_LIMIT = 20, 1000
MAX_DEPTH = 20
MATERIAL_BYTES, MATERIAL_RATIO = 1 << 30, 0.05
RETAIN_ALL_DAYS, RETAIN_DAILY_DAYS, RETAIN_INCOMPLETE_HOURS = 3, 90, 24


class ReportError(Exception):
    """A request that can't be answered, with a code for programs."""

    def __init__(self, code: str, message: str, **details: object):
        super().__init__(message)
        self.code, self.message, self.details = code, message, details


@dataclass(frozen=True)
class RetentionPolicy:
    all_days: int = RETAIN_ALL_DAYS
    daily_days: int = RETAIN_DAILY_DAYS
    incomplete_hours: int = RETAIN_INCOMPLETE_HOURS

    def __post_init__(self) -> None:
        if min(self.all_days, self.daily_days, self.incomplete_hours) <= 0 or self.daily_days < self.all_days:
            raise ReportError("invalid_retention_policy", "retention windows must be positive, and the daily one not the shorter")


def parse_limit(value: object = None) -> int:
    """A row limit from 1 to 1000; none given: 20."""
    if value is None:
        return DEFAULT_LIMIT
    try:
        n = int(str(value))
    except ValueError:
        raise ReportError("invalid_limit", f"limit must be a positive integer: {value!r}") from None
    if n < 1:
        raise ReportError("invalid_limit", f"limit must be a positive integer: {value!r}")
    if n > MAX_LIMIT:
        raise ReportError("limit_too_large", f"limit must be at most {MAX_LIMIT}")
    return n


def parse_depth(value: object = None) -> int:
    """How many levels an explanation shows, 0 to 20; none given: 1."""
    try:
        n = 1 if value is None else int(str(value))
    except ValueError:
        n = -1
    if not 0 <= n <= MAX_DEPTH:
        raise ReportError("invalid_depth", f"depth must be 0 to {MAX_DEPTH}: {value!r}")
    return n


def parse_grouping(value: str) -> str:
    if value not in GROUPINGS:
        raise ReportError("invalid_group_by", f"group by one of {', '.join(GROUPINGS)}")
    return value


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
