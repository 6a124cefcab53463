"""Settings of a run: a YAML (or JSON) mapping, with the names and defaults of the command line."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any

# Words for yes.
TRUE = {"1", "true", "yes", "y"}


def as_bool(value: Any, default: bool = False) -> bool:
    if value is None:
        return default
    return value if isinstance(value, bool) else str(value).strip().lower() in TRUE


def as_int(value: Any, default: int | None = None) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def as_year(value: Any) -> str:
    """current or previous; anything else is current."""
    name = str(value or "").strip().lower()
    return {"previous": "previous", "претходна": "previous", "prethodna": "previous"}.get(name, "current")


@dataclass(frozen=True)
class Config:
    year_preference: str = "current"
    overwrite_nonempty: bool = False
    clear_on_overwrite: bool = False
    as_of_year: int = 2024
    page_limit: int = 30
    options: dict = field(default_factory=dict)


def load(path: str, **overrides: Any) -> Config:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        read = yaml.safe_load(text)
    except ImportError:
        read = json.loads(text)
    if not isinstance(read, dict):
        raise ValueError(f"{path} holds no mapping")
    return settings(read | {k: v for k, v in overrides.items() if v is not None})


def settings(given: dict) -> Config:
    known = {f.name for f in fields(Config)}
    return Config(
        as_year(given.get("year_preference")), as_bool(given.get("overwrite_nonempty")), as_bool(given.get("clear_on_overwrite")), as_int(given.get("as_of_year"), Config.as_of_year),
        as_int(given.get("page_limit"), Config.page_limit), {k: v for k, v in given.items() if k not in known},
    )
