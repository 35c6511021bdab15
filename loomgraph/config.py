"""Settings of the pipeline: defaults, then a mapping (a parsed file), then the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Extraction:
    chunk_size: int = 8000
    chunk_overlap: int = 500
    max_claims_per_source: int = 50
    min_quote_length: int = 10


@dataclass(frozen=True)
class Relationships:
    within_threshold: float = 0.6
    cross_threshold: float = 0.4
    merge_threshold: float = 0.92
    pairs_per_claim: int = 5
    batch_size: int = 15


@dataclass(frozen=True)
class Crux:
    decay: float = 0.7
    max_depth: int = 20
    top_n: int = 10


@dataclass(frozen=True)
class Discourse:
    min_cluster_sizes: tuple[int, ...] = (5, 10, 15, 20)
    fewest_positions: int = 2
    most_positions: int = 8


@dataclass(frozen=True)
class Settings:
    extraction: Extraction = field(default_factory=Extraction)
    relationships: Relationships = field(default_factory=Relationships)
    crux: Crux = field(default_factory=Crux)
    discourse: Discourse = field(default_factory=Discourse)
    change_gate: float = 0.05
    budget_tokens: int = 2_000_000


def _cast(kind, value):
    return tuple(value) if isinstance(kind, tuple) else type(kind)(value)


def load_settings(given: Mapping | None = None, env: Mapping[str, str] | None = None, prefix: str = "LOOMGRAPH_") -> Settings:
    """Apply every section of ``given``, then variables such as ``LOOMGRAPH_CRUX_DECAY``.

    Unknown sections or keys raise, so a misspelt setting is not silently ignored.
    """
    settings, env = Settings(), os.environ if env is None else env
    known = {f.name: getattr(settings, f.name) for f in fields(settings)}
    for name, value in (given or {}).items():
        if name not in known:
            raise KeyError(f"unknown section: {name}")
        if isinstance(value, Mapping):
            section = getattr(settings, name)
            odd = set(value) - {f.name for f in fields(section)}
            if odd:
                raise KeyError(f"unknown settings in {name}: {sorted(odd)}")
            value = replace(section, **{k: _cast(getattr(section, k), v) for k, v in value.items()})
        settings = replace(settings, **{name: value})
    for name, default in known.items():
        if hasattr(default, "__dataclass_fields__"):
            section = getattr(settings, name)
            over = {f.name: env[key] for f in fields(section) if (key := f"{prefix}{name}_{f.name}".upper()) in env}
            cast = {k: tuple(int(x) for x in v.split(",")) if isinstance(getattr(section, k), tuple) else _cast(getattr(section, k), v) for k, v in over.items()}
            settings = replace(settings, **{name: replace(section, **cast)})
        elif (key := f"{prefix}{name}".upper()) in env:
            settings = replace(settings, **{name: _cast(default, env[key])})
    return settings
