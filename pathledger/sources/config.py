"""Configuration in TOML: roots, excludes, mounts to cross, directories to fold."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pathledger.model import ReportError


@dataclass(frozen=True)
class CollapsePolicy:
    names: list[str] = field(default_factory=lambda: ["node_modules", ".git", "__pycache__", ".cache"])
    direct_directories: int = 10_000
    never: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Config:
    roots: list[str]
    exclude_paths: list[str] = field(default_factory=list)
    one_filesystem: bool = False
    include_filesystems: list[str] = field(default_factory=list)
    skip_filesystems: list[str] = field(default_factory=list)
    collapse: CollapsePolicy = field(default_factory=CollapsePolicy)


def absolute(path: object) -> str:
    if not isinstance(path, str) or not path.startswith("/"):
        raise ReportError("path_not_absolute", f"not an absolute path: {path!r}")
    return "/" + "/".join(x for x in path.split("/") if x)


def _strings(section: dict, key: str) -> list[str]:
    got = section.get(key, [])
    if not isinstance(got, list) or not all(isinstance(x, str) for x in got):
        raise ReportError("invalid_config", f"{key} has to be a list of strings")
    return got


def parse_config(text: str) -> Config:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ReportError("invalid_toml", str(e)) from None
    roots = [absolute(r.get("path") if isinstance(r, dict) else r) for r in data.get("roots", [])]
    if not roots:
        raise ReportError("missing_roots", "no roots")
    if len(set(roots)) < len(roots):
        raise ReportError("duplicate_roots", "a root is given twice")
    mounts, fold = data.get("mount_policy", {}), data.get("collapse", {})
    count = fold.get("direct_directories", CollapsePolicy().direct_directories)
    if not isinstance(count, int) or isinstance(count, bool) or count < 1:
        raise ReportError("invalid_config", "direct_directories has to be a positive number")
    names = _strings(fold, "names") if "names" in fold else CollapsePolicy().names
    return Config(
        roots, [absolute(x) for x in _strings(data, "exclude_paths")], bool(mounts.get("one_filesystem", False)), _strings(mounts, "include_filesystems"), _strings(mounts, "skip_filesystems"),
        CollapsePolicy(names, count, [absolute(x) for x in _strings(fold, "never")]),
    )


def load_config(path: str) -> Config:
    try:
        return parse_config(Path(path).read_text())
    except OSError as e:
        raise ReportError("config_not_found", str(e)) from None
