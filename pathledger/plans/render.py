"""Reports as text: one line of key=value pairs a row, or an aligned table."""

from __future__ import annotations


def escape(value: object) -> str:
    return str(value).encode("unicode_escape").decode("ascii")


def path_text(hexed: str | None) -> str:
    """A path for people; bytes that aren't UTF-8 show escaped."""
    return "-" if hexed is None else escape(bytes.fromhex(hexed).decode("utf-8", "surrogateescape"))


def line(kind: str, row: dict, fields: list[str]) -> str:
    shown = [f"{f}={path_text(row[f]) if f.endswith('path') and row.get(f) and f != 'root_path' else escape(row.get(f, '-'))}" for f in fields]
    return " ".join([kind, *shown])


def table(rows: list[dict], fields: list[str]) -> str:
    cells = [fields, *[[escape("-" if r.get(f) is None else r[f]) for f in fields] for r in rows]]
    wide = [max(len(c[i]) for c in cells) for i in range(len(fields))]
    out = ["  ".join(x.ljust(w) for x, w in zip(c, wide, strict=True)).rstrip() for c in cells]
    return "\n".join([out[0], "  ".join("-" * w for w in wide), *out[1:]]) + "\n"


def diff_text(payload: dict) -> str:
    lines = [line("pair", p, ["root_path", "baseline_snapshot_id", "current_snapshot_id"]) for p in payload["pairs"]]
    lines += [line("frontier", r, ["path", "classification", "disk_delta", "apparent_delta", "reason"]) for r in payload["frontier"]]
    lines += [line("warning", w, list(w)) for w in payload["warnings"]]
    return "\n".join(lines) + "\n"
