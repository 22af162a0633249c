"""Project configuration from YAML."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path


class ConfigError(ValueError):
    """A configuration that cannot be used."""


@dataclass
class Config:
    project: str
    design: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=lambda: ["."])
    store: str = ".graphloom/store"


def load(text: str, root: str = ".") -> Config:
    import yaml

    try:
        data = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise ConfigError(str(e)) from e
    if not isinstance(data, dict) or (extra := set(data) - set(Config.__dataclass_fields__)):
        raise ConfigError("unknown settings: " + ", ".join(sorted(map(str, extra if isinstance(data, dict) else [data]))))
    if not re.fullmatch(r"[a-z][a-z0-9_-]{0,127}", str(data.get("project", ""))):
        raise ConfigError(f"invalid project id {data.get('project')!r}")
    c = Config(**{k: [v] if k in ("design", "sources") and isinstance(v, str) else v for k, v in data.items()})
    for f in c.design:
        if Path(f).suffix not in (".yaml", ".yml", ".json"):
            raise ConfigError(f"{f}: designs are YAML or JSON")
    base = Path(root).resolve()
    for s in c.sources:
        if not (base / s).resolve().is_relative_to(base):
            raise ConfigError(f"{s} lies outside of the project")
    return c
