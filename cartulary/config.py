"""Settings: defaults, then a file, then the environment, then arguments; an empty variable is unset."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace

PROVIDERS = ("ollama", "openai", "anthropic", "openrouter")
PREFIX = "CARTULARY_"


@dataclass(frozen=True)
class Settings:
    provider: str = "ollama"
    model: str = "gemma4:latest"
    temperature: float = 0.0
    max_tokens: int | None = 1000
    timeout: int = 60
    max_retries: int = 3
    retry_min_wait: float = 2.0
    retry_max_wait: float = 10.0
    taxonomy: str = "household"
    taxonomy_mode: str = "fallback"
    naming_style: str = "nara"
    sample_strategy: str = "adaptive"
    max_pages: int = 10
    log_level: str = "quiet"
    on_error: str = "fail"
    concurrency: int = 1
    metrics: bool = False
    capture_debug: bool = False
    debug_structure: bool = False
    debug_dir: str | None = None
    prompt: str | None = None

    def __post_init__(self):
        checks = (
            (self.provider in PROVIDERS, f"provider must be one of {', '.join(PROVIDERS)}"),
            (0 <= self.temperature <= 2, "temperature must be from 0 to 2"),
            (self.max_tokens is None or self.max_tokens >= 1, "max_tokens must be at least 1"),
            (self.timeout >= 1, "timeout must be at least 1"),
            (1 <= self.max_retries <= 10, "max_retries must be from 1 to 10"),
            (self.retry_min_wait >= 0.1 and self.retry_max_wait >= 1, "waits must be at least 0.1 and 1"),
            (self.retry_min_wait <= self.retry_max_wait, "retry_min_wait must not exceed retry_max_wait"),
            (self.taxonomy_mode in ("strict", "fallback"), "taxonomy_mode must be strict or fallback"),
            (self.on_error in ("fail", "continue", "skip"), "on_error must be fail, continue or skip"),
        )
        for ok, message in checks:
            if not ok:
                raise ValueError(message)


_KINDS = {f.name: f.type for f in fields(Settings)}


def _typed(name: str, value):
    if not isinstance(value, str) or "str" in _KINDS[name]:
        return value
    if "bool" in _KINDS[name]:
        return value.lower() in ("1", "true", "yes", "on")
    return float(value) if "float" in _KINDS[name] else int(value)


def load(path: str | None = None, environment: dict | None = None, **given) -> Settings:
    """Settings of a YAML or JSON file (``ai`` settings may be nested), the environment, and arguments that are not None."""
    held: dict = {}
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            import yaml

            raw = yaml.safe_load(text) or {}
        except ImportError:
            raw = json.loads(text)
        held |= {**{k: v for k, v in raw.items() if k != "ai"}, **raw.get("ai", {})}
    env = os.environ if environment is None else environment
    held |= {n: v for n in _KINDS if (v := env.get(PREFIX + n.upper()))}
    held |= {k: v for k, v in given.items() if v is not None}
    unknown = sorted(set(held) - set(_KINDS))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return replace(Settings(), **{k: _typed(k, v) for k, v in held.items()})
