"""Settings of the stages: named values with strict checks, nested mappings and ``section.key=value`` overrides."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


class ConfigError(ValueError):
    """A setting that is missing, unknown, of another type, or not among the choices."""


@dataclass(frozen=True)
class Segmentation:
    window: int = 3
    depth_std_factor: float = 0.5
    min_depth: float = 0.05
    min_segment_sentences: int = 4
    max_section_tokens: int = 900
    max_sections: int = 2000
    max_heading_words: int = 12


@dataclass(frozen=True)
class Contradiction:
    pair_min_similarity: float = 0.20
    candidate_top_k: int = 30
    max_pairs: int = 40_000
    max_resolutions: int = 200
    threshold: float = 0.50
    direction_aggregation: str = "mean"
    resolution_margin: float = 0.15
    action: str = "flag"
    min_claim_words: int = 4


@dataclass(frozen=True)
class Merging:
    mode: str = "extractive"
    dedup_similarity: float = 0.85
    max_group_sections: int = 5
    max_input_tokens: int = 1024


@dataclass(frozen=True)
class Provenance:
    top_k: int = 3
    min_candidate_similarity: float = 0.30
    supported_entailment: float = 0.70
    weak_entailment: float = 0.35


@dataclass(frozen=True)
class Config:
    segmentation: Segmentation = field(default_factory=Segmentation)
    contradiction: Contradiction = field(default_factory=Contradiction)
    merging: Merging = field(default_factory=Merging)
    provenance: Provenance = field(default_factory=Provenance)


# The choices of named settings.
CHOICES = {"direction_aggregation": ("max", "min", "mean"), "action": ("flag", "remove"), "mode": ("extractive", "abstractive")}


def _checked(name: str, value: Any, kind: type) -> Any:
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise ConfigError(f"{name} must be {kind.__name__}, not {value!r}")
    if name in CHOICES and value not in CHOICES[name]:
        raise ConfigError(f"{name} must be one of {', '.join(CHOICES[name])}")
    return value


def apply(config: Any, values: dict[str, Any]) -> Any:
    """A config with nested ``values`` put in; every key must exist and keep its type."""
    known = {f.name: getattr(config, f.name) for f in fields(config)}
    if unknown := set(values) - set(known):
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(config, **{k: apply(known[k], v) if is_dataclass(known[k]) else _checked(k, v, type(known[k])) for k, v in values.items()})


def override(config: Config, text: str) -> Config:
    """``section.key=value`` with the value as JSON, or else as text."""
    path, sep, raw = text.partition("=")
    section, dot, key = path.partition(".")
    if not sep or not dot:
        raise ConfigError(f"{text!r} is not section.key=value")
    try:
        value = json.loads(raw)
    except json.JSONDecodeError:
        value = raw
    return apply(config, {section: {key: value}})
