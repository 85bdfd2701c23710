"""Settings of an engine, each with its type; values from mappings and the environment are brought to it."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """What the operators are run with; the defaults are theirs."""

    top_k: int = 8
    gap_s: float = 2.5
    max_moment_s: float = 90.0
    min_moment_s: float = 8.0
    subject_rule: bool = True
    subject_similarity: float = 0.45
    salience_floor: float = 0.0
    contradiction_threshold: float = 0.55
    max_claims: int = 50_000
    bucket_cap: int = 200
    topic_threshold: float = 0.5
    topic_min_size: int = 2
    topic_representatives: int = 512
    consensus_cosine: float = 0.0
    halflife_days: float = 365.0
    decay: bool = False
    relevance_floor: float = 0.55
    relevance_min_moments: int = 50
    clip_gap_s: float = 2.5
    common_words: tuple = ()

    @classmethod
    def of(cls, values: Mapping[str, object] | None = None, prefix: str = "TIDEMARK_", environment: Mapping[str, str] | None = None) -> "Settings":
        """Settings from ``values`` over the environment's (prefix and upper-case name) over the defaults; unknown names are refused."""
        known = {f.name: f for f in fields(cls)}
        given = dict(values or {})
        if unknown := set(given) - set(known):
            raise ValueError(f"no such settings: {sorted(unknown)}")
        environment = os.environ if environment is None else environment
        for name in known:
            if name not in given and prefix + name.upper() in environment:
                given[name] = environment[prefix + name.upper()]
        return cls(**{name: coerced(value, type(known[name].default), known[name].default) for name, value in given.items()})


def coerced(value: object, kind: type, default: object) -> object:
    """``value`` as ``kind``; a value that can't be one gives the default."""
    try:
        if kind is bool:
            text = str(value).strip().lower()
            return True if text in {"1", "true", "yes", "on"} else False if text in {"0", "false", "no", "off", ""} else default
        if kind is tuple:
            return tuple(value.split(",")) if isinstance(value, str) else tuple(value)
        if kind is int:
            return int(float(value))
        number = kind(value)
        return number if not isinstance(number, float) or abs(number) < float("inf") else default
    except (TypeError, ValueError, OverflowError):
        return default
