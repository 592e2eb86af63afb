"""CSV, JSON and Parquet sources and sinks with declared schemas: no inference pass over the input."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import benchmark_schema, raw_schema


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A CSV with a header. Columns are taken by name, so that files may have more or fewer than ``schema`` (all text by default)."""
    if schema is not None:
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return spark.read.option("header", True).csv(path)


def read_benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    """The labelled CSV source as text columns; its header decides which of them there are."""
    found = read_csv(spark, path)
    known = set(benchmark_schema().names) | {"trans_date_trans_time", "trans_date", "trans_time"}
    return found.select(*[c for c in found.columns if c in known])


def read_json(spark: SparkSession, path: str, pattern: str = "*.jsonl", schema: StructType | None = None) -> DataFrame:
    """JSON lines of a folder's files that match ``pattern`` (or of one file), with ``_metadata``; absent fields are NULL."""
    return spark.read.schema(schema or raw_schema()).option("pathGlobFilter", pattern).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_lineage(df: DataFrame) -> DataFrame:
    """``df`` of a file source with ``ingestion_timestamp`` (one instant per query) and ``source_path``."""
    return df.withColumns({"ingestion_timestamp": F.current_timestamp(), "source_path": F.col("_metadata.file_path")})


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Newline-delimited JSON; NULL fields are left out. ``mode`` is overwrite or append."""
    _check(mode)
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", rebalance: Sequence[str] = (), partition_by: Sequence[str] = ()) -> DataFrame:
    """Write Parquet and return the written table (not the plan that made it, which would run again).

    With ``rebalance`` adaptive execution evens file sizes out by these columns, splitting large ones; there is no fixed number of files.
    """
    _check(mode)
    out = df.hint("rebalance", *rebalance) if rebalance else df
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def rows_frame(spark: SparkSession, rows: Iterable[dict], schema: str) -> DataFrame:
    """A small DataFrame from local rows, for results tables."""
    names = [f.split()[0] for f in schema.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def _check(mode: str) -> None:
    if mode not in ("overwrite", "append"):
        raise ValueError(f"a write mode is overwrite or append, not {mode!r}")
