"""Spark-native analytics for card-transaction features, alert ranking and corpus preparation."""

from __future__ import annotations

import importlib

#: Exported names and their modules, which are imported when a name is first used: Python workers need few of them.
_EXPORTS = {
    **dict.fromkeys(("normalize_benchmark_raw", "run_bronze_ingest", "run_gold_features", "run_layers", "run_silver_transform"), "plans.layers"),
    **dict.fromkeys(("evaluate", "gate_sweep", "model_frame", "split_and_sample", "two_stage"), "operators.modelling"),
    "feature_table": "plans.features",
    "GeneratorConfig": "synth",
    "generate": "synth",
}
__all__ = list(_EXPORTS)


def __getattr__(name: str) -> object:
    if name not in _EXPORTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f".{_EXPORTS[name]}", __name__), name)
