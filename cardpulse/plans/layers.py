"""Layer builds: raw -> bronze (lineage) -> silver (clean) -> gold (features). Each returns the table that it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import BenchmarkSource, Layers
from ..operators.clean import clean
from ..session import pin_utc
from ..sources.adapters import from_benchmark
from ..sources.files import read_benchmark_csv, read_json, with_lineage, write_json, write_parquet
from .features import feature_table


def run_bronze_ingest(spark: SparkSession, raw_path: str | None = None, bronze_path: str | None = None, paths_yaml: str | None = None, file_pattern: str | None = None) -> DataFrame:
    """Raw JSON with lineage columns as Parquet. What is not passed comes from ``paths_yaml``, or else from the defaults."""
    layers = Layers.load(paths_yaml) if paths_yaml else Layers()
    raw = read_json(spark, raw_path or layers.raw, file_pattern or layers.file_pattern)
    return write_parquet(with_lineage(raw), bronze_path or layers.bronze)


def run_silver_transform(spark: SparkSession, bronze_path: str | None = None, silver_path: str | None = None) -> DataFrame:
    """Typed, valid and deduplicated transactions."""
    layers = Layers()
    return write_parquet(clean(spark.read.parquet(bronze_path or layers.bronze)), silver_path or layers.silver)


def run_gold_features(spark: SparkSession, silver_path: str | None = None, gold_path: str | None = None, exact: int | None = None, slice_merchants: bool = False, slice_cards: bool = False) -> DataFrame:
    """The feature table; with slices for merchants or cards that have a large share of all rows (see ``feature_table``)."""
    pin_utc(spark)
    layers = Layers()
    return write_parquet(feature_table(spark.read.parquet(silver_path or layers.silver), exact, slice_merchants=slice_merchants, slice_cards=slice_cards), gold_path or layers.gold)


def normalize_benchmark_raw(spark: SparkSession, input_path: str | None = None, output_path: str | None = None, config: BenchmarkSource | None = None) -> DataFrame:
    """The labelled CSV source as canonical raw JSON; returns what was written, so that counting it does not read the CSV again."""
    pin_utc(spark)
    config = config or BenchmarkSource()
    out = output_path or config.normalized_raw_path
    write_json(from_benchmark(read_benchmark_csv(spark, input_path or config.input_path), config.fraud_label_value, config.non_fraud_label_value), out)
    return read_json(spark, out, "*.json")


def run_layers(spark: SparkSession, layers: Layers) -> dict[str, DataFrame]:
    """All three layers; their row counts are metadata of the written files."""
    return {
        "bronze": run_bronze_ingest(spark, layers.raw, layers.bronze, file_pattern=layers.file_pattern),
        "silver": run_silver_transform(spark, layers.bronze, layers.silver),
        "gold": run_gold_features(spark, layers.silver, layers.gold),
    }
