"""Settings of a run: arguments, then the environment, then defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Every field may be set in the environment under DOCMETRICS_ and its name in capitals."""

    data_dir: str = "data"
    store_dir: str = "data/store"
    provider: str = "mock"
    model: str = "mock-model-v1"
    attempts: int = 3
    timeout_seconds: float = 60.0
    parser: str = "text"
    log_level: str = "WARN"

    @classmethod
    def read(cls, environment: Mapping[str, str] = os.environ, **given: object) -> Settings:
        """Numbers are read as such; the provider is put in lower case, the log level in capitals; unknown arguments are an error."""
        values = {}
        for f in fields(cls):
            raw = given.pop(f.name, environment.get(f"DOCMETRICS_{f.name.upper()}"))
            if raw is not None:
                values[f.name] = {"int": int, "float": float}.get(f.type, str)(raw)
        if given:
            raise TypeError(f"unknown settings: {', '.join(given)}")
        if "provider" in values:
            values["provider"] = values["provider"].lower()
        if "log_level" in values:
            values["log_level"] = values["log_level"].upper()
        return cls(**values)
