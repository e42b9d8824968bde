"""Settings of the review pipeline: defaults, profiles, overrides and their hash."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from typing import Any


@dataclass
class DataSettings:
    min_chars: int = 20
    max_reviews: int | None = None
    language: str | None = None
    near_dedupe: bool = False
    near_threshold: float = 0.9


@dataclass
class SplitSettings:
    train: float = 0.8
    val: float = 0.1
    test: float = 0.1
    by_product: bool = True


@dataclass
class ExtractionSettings:
    min_chars: int = 2
    max_words: int = 4
    allow_standalone_generics: bool = False


@dataclass
class ClusterSettings:
    by_category: bool = True
    min_cluster_size: int = 3
    min_samples: int = 1
    eps: float = 0.35


@dataclass
class Settings:
    seed: int = 42
    profile: str = "dev"
    dedupe: bool = False
    data: DataSettings = field(default_factory=DataSettings)
    split: SplitSettings = field(default_factory=SplitSettings)
    extraction: ExtractionSettings = field(default_factory=ExtractionSettings)
    clustering: ClusterSettings = field(default_factory=ClusterSettings)


PROFILES: dict[str, dict[str, Any]] = {"smoke": {"data.max_reviews": 500}, "dev": {}, "full": {"dedupe": True, "data.near_dedupe": True}}


def _coerce(v: Any) -> Any:
    if not isinstance(v, str):
        return v
    if v.lower() in ("true", "false"):
        return v.lower() == "true"
    for kind in (int, float):
        try:
            return kind(v)
        except ValueError:
            pass
    return None if v.lower() in ("none", "null", "") else v


def read_settings(text: str) -> dict[str, Any]:
    """'section.key' to value from a YAML document of scalars and sections by indentation; comments and lists are passed over."""
    out: dict[str, Any] = {}
    path: list[tuple[int, str]] = []
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        at = len(body) - len(body.lstrip())
        key, colon, value = body.strip().partition(":")
        if not colon or key.startswith(("#", "-")):
            continue
        path = [p for p in path if p[0] < at] + [(at, key.strip())]
        if value.strip():
            out[".".join(k for _, k in path)] = value.strip().strip("'\"")
    return out


def load_settings(profile: str = "dev", overrides: dict[str, Any] | list[str] | None = None, text: str | None = None) -> Settings:
    """Defaults, then a YAML document's values, then the profile's, then overrides ('section.key=value' strings or a dict)."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}")
    if isinstance(overrides, list):
        overrides = dict(x.split("=", 1) for x in overrides)
    s = Settings(profile=profile)
    for key, v in {**(read_settings(text) if text else {}), **PROFILES[profile], **(overrides or {})}.items():
        *path, name = key.split(".")
        at: Any = s
        for p in path:
            at = getattr(at, p, None)
        if not dataclasses.is_dataclass(at) or name not in {f.name for f in dataclasses.fields(at)}:
            raise ValueError(f"unknown setting {key}")
        setattr(at, name, _coerce(v))
    return s


def settings_hash(s: Settings) -> str:
    return hashlib.sha256(json.dumps(dataclasses.asdict(s), sort_keys=True).encode()).hexdigest()
