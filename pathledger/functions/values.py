"""Functions of sizes, times, states and kinds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathledger.model import ReportError

_BINARY = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
# Factors of the units that size texts carry.
SIZE_FACTORS = {"B": 1} | {f"{u}B": 1000 ** (i + 1) for i, u in enumerate("KMGTP")} | {f"{u}IB": 1024 ** (i + 1) for i, u in enumerate("KMGTP")}
# Filesystem kinds that a walk skips unless told otherwise.
SKIPPED_FILESYSTEMS = ["proc", "sysfs", "devtmpfs", "devpts", "tmpfs", "cgroup2", "pstore", "securityfs", "debugfs", "tracefs", "configfs", "fusectl", "nsfs"]


def decimals(x: Column, n: int) -> Column:
    """A double with n decimals, rounded by its exact value, real ties to even."""
    return F.replace(F.format_number(x, n), F.lit(","), F.lit(""))


def one_decimal(x: Column) -> Column:
    return decimals(x, 1)


def humanize_bytes(n: Column) -> Column:
    size = F.abs(n).cast("double")
    sign = F.when(n < 0, "-").otherwise("")
    out = F.concat(sign, F.abs(n).cast("string"), F.lit(" B"))
    for i, unit in enumerate(_BINARY[1:], 1):
        out = F.when(size >= float(1024**i), F.concat(sign, one_decimal(size / float(1024**i)), F.lit(f" {unit}"))).otherwise(out)
    return out


def humanize_count(n: Column) -> Column:
    size = F.abs(n).cast("double")
    out = n.cast("string")
    for i, unit in enumerate("kMBT", 1):
        out = F.when(size >= float(1000**i), F.concat(one_decimal(n / float(1000**i)), F.lit(unit))).otherwise(out)
    return out


def humanize_duration(seconds: Column) -> Column:
    whole = F.bround(seconds).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    long = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(""), m.cast("string"), F.lit("m"), s.cast("string"), F.lit("s"))
    return F.when(seconds < 60, F.concat(one_decimal(seconds.cast("double")), F.lit("s"))).otherwise(long)


def parse_size(text: Column) -> Column:
    """Bytes of texts such as 7.451GB or 12GB (60%); null if they can't be read."""
    bare = F.trim(F.regexp_replace(text, r"\([^)]*%\)", ""))
    number = F.regexp_replace(F.regexp_extract(bare, r"^([0-9][0-9.,]*)\s*([A-Za-z]+)$", 1), ",", "").try_cast("double")
    unit = F.upper(F.regexp_extract(bare, r"^([0-9][0-9.,]*)\s*([A-Za-z]+)$", 2))
    factor = F.lit(None).cast("double")
    for name, k in SIZE_FACTORS.items():
        factor = F.when(unit == name, float(k)).otherwise(factor)
    return (number * factor).try_cast("bigint")


def to_int(text: Column) -> Column:
    return F.trim(text.cast("string")).try_cast("bigint")


def parse_since(text: str) -> int:
    """Seconds of a span such as 24h or 7d."""
    m = re.fullmatch(r"([1-9][0-9]*)([smhd])", text)
    if not m:
        raise ReportError("invalid_since", f"expected a number and one of s, m, h, d: {text!r}")
    return int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]


def utc(text: Column) -> Column:
    """The instant of an ISO text with an offset; null without one."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")))


def micros(time: Column) -> Column:
    return F.unix_micros(time)


def seconds_between(start: Column, end: Column) -> Column:
    return F.round((micros(utc(end)) - micros(utc(start))) / 1e6, 1)


def status(stored: Column, finished_at: Column) -> Column:
    """A stored failure without an end is still running."""
    return F.when((stored == "failed") & finished_at.isNull(), "running").otherwise(stored)


def age_seconds(generated: Column, finished: Column) -> Column:
    return F.greatest(((micros(generated) - micros(finished)) / 1e6).cast("bigint"), F.lit(0).cast("bigint"))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)


def confidence(samples: Column, missing: Column) -> Column:
    return F.when((samples >= 3) & (missing == 0), "high").when(samples >= 2, "medium").otherwise("low")


def error_kind(name: Column) -> Column:
    return F.when(name == "PermissionError", "permission_denied").when(name == "FileNotFoundError", "missing_path").when(name == "NotADirectoryError", "not_a_directory").otherwise("os_error")


def mount_verdict(kind: Column, included: list[str], skipped: list[str], skip_overlay: bool = True, skip_namespace: bool = True) -> Column:
    """Whether a scan crosses into a mount of a filesystem kind, and why (or why not)."""
    skip = sorted({*SKIPPED_FILESYSTEMS, *skipped})
    return (
        F.when(kind.isin(included or [""]), "included_filesystem").when(F.lit(skip_overlay) & (kind == "overlay"), "skipped_overlay").when(F.lit(skip_namespace) & (kind == "nsfs"), "skipped_nsfs")
        .when(kind.isin(skip), "skipped_filesystem").otherwise("included")
    )


def mount_reason(kind: Column, verdict: Column) -> Column:
    # The reasons that reports give.
    return (
        F.when(verdict == "included_filesystem", F.concat(kind, F.lit(" explicitly included by configuration"))).when(verdict == "skipped_overlay", "overlay mount skipped by default").when(verdict == "skipped_nsfs", "nsfs mount skipped by default")
        .when(verdict == "skipped_filesystem", F.concat(kind, F.lit(" skipped by default mount policy"))).when(kind.isNull(), "no mount classification available").otherwise(F.concat(kind, F.lit(" included")))
    )


def mount_in_scope(mount_point: Column, mount_id: Column, root: str, root_mount_id: int | None) -> Column:
    """Whether a mount matters to a root: it holds the root, or is at or below it."""
    bare = F.rtrim(mount_point, F.lit("/"))
    top = root.rstrip("/")
    if not top:
        return F.lit(True)
    return F.coalesce(mount_id == F.lit(root_mount_id), F.lit(False)) | (bare == top) | bare.startswith(f"{top}/")


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the rate so far; null while there is none."""
    return F.try_divide(total - done, F.try_divide(done, elapsed))


def reason_text(ancestors: Column, descendants: Column) -> Column:
    a, d = ancestors > 0, descendants > 0
    # The reasons that reports give.
    return (
        F.when(a & d, "dominates near-duplicate ancestors while hiding lower-signal descendants").when(a, "dominates near-duplicate ancestors").when(d, "suppresses lower-signal descendants").otherwise("highest-signal growth target")
    )
