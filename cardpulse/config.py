"""Paths and settings from YAML, with defaults. Relative paths are resolved in one place, against the file's folder."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path


def load_yaml(path: str | Path) -> dict:
    """The mapping in a YAML file; an empty file is an empty mapping."""
    import yaml

    path = Path(path)
    if not path.is_file():
        raise FileNotFoundError(f"no configuration at {path}")
    with path.open() as f:
        return yaml.safe_load(f) or {}


@dataclass(frozen=True)
class Layers:
    """Where the layers lie, and which raw files are read."""

    raw: str = "data/raw"
    bronze: str = "data/bronze"
    silver: str = "data/silver"
    gold: str = "data/gold"
    file_pattern: str = "*.jsonl"

    @classmethod
    def load(cls, path: str | Path) -> Layers:
        """``data: {raw, bronze, silver, gold}`` and ``ingest: {file_pattern}`` of a YAML file."""
        found = load_yaml(path)
        base = Path(path).resolve().parent
        own = {k: resolve(v, base) for k, v in (found.get("data") or {}).items() if k in ("raw", "bronze", "silver", "gold")}
        pattern = (found.get("ingest") or {}).get("file_pattern")
        return cls(**own, **({"file_pattern": pattern} if pattern else {}))


@dataclass(frozen=True)
class BenchmarkSource:
    """A labelled CSV source, its layers, label values and session settings."""

    input_path: str = "data/benchmark/data.csv"
    normalized_raw_path: str = "data/raw_benchmark"
    bronze_path: str = "data/benchmark/bronze"
    silver_path: str = "data/benchmark/silver"
    gold_path: str = "data/benchmark/gold"
    fraud_label_value: str = "fraud"
    non_fraud_label_value: str = "none"
    spark_runtime: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path, section: str = "benchmark") -> BenchmarkSource:
        """The fields under ``section`` of a YAML file."""
        found, base = load_yaml(path).get(section) or {}, Path(path).resolve().parent
        own = {k: resolve(v, base) if k.endswith("_path") else v for k, v in found.items() if k in cls.__dataclass_fields__}
        return cls(**own)


def resolve(path: str, base: Path) -> str:
    """``path`` against ``base`` if it is relative and names no store."""
    return path if "://" in path or Path(path).is_absolute() else str(base / path)
