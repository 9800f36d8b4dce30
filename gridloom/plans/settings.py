"""Settings from JSON or YAML files, over defaults. Nothing is cached: a file is read when it is asked for."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import fields, is_dataclass
from pathlib import Path
from typing import Any

from gridloom.plans.capacity import AnalogueConfig


def load(path: str | None, defaults: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """The file's mapping over ``defaults``; the defaults alone if there is no such file. YAML needs its library."""
    out = dict(defaults or {})
    if path is None or not Path(path).is_file():
        return out
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML settings need the yaml library") from e
        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    return merged(out, found or {})


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``over`` wins; mappings within are merged too."""
    both = lambda k: isinstance(base.get(k), Mapping) and isinstance(over[k], Mapping)
    return {**base, **{k: merged(base[k], v) if both(k) else v for k, v in over.items()}}


def as_config(settings: Mapping[str, Any], kind: type = AnalogueConfig) -> Any:
    """A settings dataclass from a mapping; lists become tuples, unknown names are an error."""
    if not is_dataclass(kind):
        raise TypeError("a dataclass is needed")
    if unknown := set(settings) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})
