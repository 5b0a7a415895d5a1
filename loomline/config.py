"""Settings as frozen dataclasses; a key that nothing reads is an error."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import subprocess
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from datetime import datetime, timezone
from importlib import metadata
from typing import Any


@dataclass(frozen=True)
class Dedup:
    window_hours: int = 24


@dataclass(frozen=True)
class Burst:
    least: int = 10
    gap_seconds: float = 60.0


@dataclass(frozen=True)
class Coverage:
    min_source_share: float = 0.05
    recent_months: int = 12
    window_days: int = 7
    min_ratio: float = 0.5
    reference_days: int = 365


@dataclass(frozen=True)
class Features:
    return_lags: int = 6
    vol_windows: tuple[int, ...] = (6, 24)
    rolling: int = 6
    trend: int = 3
    lag: int = 1
    intensity_hours: int = 168


@dataclass(frozen=True)
class Validation:
    test_months: int = 24
    fold_months: int = 3
    tuning_months: int = 6
    embargo_hours: int = 24


@dataclass(frozen=True)
class Evaluation:
    costs_bp: tuple[float, ...] = (0.0, 5.0, 10.0, 20.0)
    bootstrap_reps: int = 2000
    mean_block: float = 24.0
    level: float = 0.95


@dataclass(frozen=True)
class Config:
    seed: int = 42
    data_path: str = "data"
    dedup: Dedup = field(default_factory=Dedup)
    burst: Burst = field(default_factory=Burst)
    coverage: Coverage = field(default_factory=Coverage)
    features: Features = field(default_factory=Features)
    validation: Validation = field(default_factory=Validation)
    evaluation: Evaluation = field(default_factory=Evaluation)

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def build(kind: type, values: dict[str, Any], where: str = "") -> Any:
    """A dataclass from nested dicts; unknown keys raise."""
    known = {f.name: f for f in fields(kind)}
    if extra := sorted(set(values) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(where + x for x in extra)}")
    made = kind()
    out = {}
    for name, value in values.items():
        now = getattr(made, name)
        if is_dataclass(now):
            out[name] = build(type(now), value, f"{where}{name}.")
        else:
            out[name] = tuple(value) if isinstance(now, tuple) else type(now)(value)
    return kind(**out)


def load(path: str | None = None, environ: dict[str, str] | None = None) -> Config:
    """Settings of a YAML file; LOOMLINE_DATA overrides data_path."""
    values: dict[str, Any] = {}
    if path:
        import yaml

        with open(path) as file:
            values = yaml.safe_load(file) or {}
    if folder := (os.environ if environ is None else environ).get("LOOMLINE_DATA"):
        values["data_path"] = folder
    return build(Config, values)


def manifest(config: Config, inputs: dict[str, str] | None = None) -> dict[str, Any]:
    """What a run depended on: time, versions, commit, settings and input digests."""
    git = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True).stdout.strip()
    return {
        "time": datetime.now(timezone.utc).isoformat(),
        "python": platform.python_version(),
        "commit": git("rev-parse", "HEAD"),
        "dirty": bool(git("status", "--porcelain")),
        "config": config.digest(),
        "packages": {p: metadata.version(p) for p in ("pyspark", "pyarrow", "pandas", "numpy")},
        "inputs": inputs or {},
    }
