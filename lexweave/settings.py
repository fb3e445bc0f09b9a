"""Settings of the correction engine: typed, with ranges checked, from a mapping or a JSON file."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


def _between(low: float, high: float, default: float) -> Any:
    return field(default=default, metadata={"range": (low, high)})


class _Checked:
    def __post_init__(self) -> None:
        for f in fields(self):  # type: ignore[arg-type]
            low, high = f.metadata.get("range", (None, None))
            if low is not None and not low <= getattr(self, f.name) <= high:
                raise ValueError(f"{f.name} must be between {low} and {high}, not {getattr(self, f.name)}")


@dataclass(frozen=True)
class EntityMemory(_Checked):
    decay_rate: float = _between(0, 1, 0.8)
    min_weight: float = _between(0, 1, 0.2)
    boost_factor: float = _between(0, 1, 0.15)


@dataclass(frozen=True)
class Normalization(_Checked):
    punctuation: bool = True
    spacing: bool = True
    simplified: bool = False
    lowercase_latin: bool = False


@dataclass(frozen=True)
class Matcher(_Checked):
    fuzzy_threshold: float = _between(0, 100, 82.0)
    pinyin_threshold: float = _between(0, 100, 76.0)
    max_candidates: int = _between(1, 1000, 8)


@dataclass(frozen=True)
class Expansion(_Checked):
    candidates_per_cue: int = _between(1, 1000, 4)
    entity_consistency: bool = True
    long_entity_variant: bool = True
    local_term: bool = True
    hint_min_alignment: float = _between(0, 1, 0.72)
    hints_per_cue: int = _between(1, 1000, 2)


@dataclass(frozen=True)
class Reuse(_Checked):
    enabled: bool = True
    min_confidence: float = _between(0, 1, 0.85)
    min_chars: int = _between(1, 1000, 3)
    categories: tuple[str, ...] = ("character",)


@dataclass(frozen=True)
class Deciding(_Checked):
    provider: str | None = None
    threshold: float = _between(0, 1, 0.72)
    per_batch: int = _between(1, 10_000, 10)
    retry_single: bool = True


@dataclass(frozen=True)
class Categories(_Checked):
    hot: tuple[str, ...] = ()
    cold: tuple[str, ...] = ()
    decay_rate: float = _between(0, 1, 0.7)
    min_weight: float = _between(0, 1, 0.3)


@dataclass(frozen=True)
class Settings(_Checked):
    """All settings. Unknown names and values of another type are errors; what is left out has its default."""

    chunk_size: int = _between(1, 1_000_000, 100)
    chunk_overlap: int = _between(0, 1_000_000, 15)
    detector_weights: Mapping[str, float] = field(default_factory=lambda: {"pinyin": 0.35, "terminology": 0.35, "entity_consistency": 0.2, "language_model": 0.1})
    entity_memory: EntityMemory = field(default_factory=EntityMemory)
    normalization: Normalization = field(default_factory=Normalization)
    matcher: Matcher = field(default_factory=Matcher)
    expansion: Expansion = field(default_factory=Expansion)
    reuse: Reuse = field(default_factory=Reuse)
    deciding: Deciding = field(default_factory=Deciding)
    categories: Categories = field(default_factory=Categories)


def _made(kind: type, given: Mapping[str, Any], at: str) -> Any:
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"unknown setting {at}{unknown[0]}")
    out = {}
    for name, value in given.items():
        default = getattr(kind(), name)
        if is_dataclass(default):
            out[name] = _made(type(default), value, f"{at}{name}.")
        elif isinstance(default, tuple):
            out[name] = tuple(value)
        elif isinstance(default, bool) != isinstance(value, bool) or (isinstance(default, int | float) and not isinstance(value, int | float)):
            raise ValueError(f"{at}{name} must be like {default!r}, not {value!r}")
        else:
            out[name] = value
    return kind(**out)


def from_mapping(given: Mapping[str, Any]) -> Settings:
    return _made(Settings, given, "")


def load(path: str | None = None) -> Settings:
    """The settings in a JSON file; the defaults without one."""
    if path is None:
        return Settings()
    with open(path, encoding="utf-8") as f:
        return from_mapping(json.load(f))
