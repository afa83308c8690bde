"""Configuration files: where they lie, what is in them, and values by dotted names."""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def resolved(path: str | Path, root: Path = ROOT) -> Path:
    """A path as it is, from the working folder if it exists there, else from the repository's."""
    path = Path(path).expanduser()
    return path if path.is_absolute() or path.exists() else root / path


def load(path: str | Path) -> dict:
    """A file's values; YAML where its reader is installed, JSON (which is YAML too) in any case."""
    text = resolved(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        value = json.loads(text or "{}")
    else:
        value = yaml.safe_load(text)
    if value is not None and not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    return value or {}


def value_at(values: dict, name: str, default=None):
    """The value of a dotted name."""
    for part in name.split("."):
        if not isinstance(values, dict) or part not in values:
            return default
        values = values[part]
    return values


def plain(value) -> dict:
    """A configuration object as nested mappings."""
    return asdict(value) if is_dataclass(value) else dict(value or {})
