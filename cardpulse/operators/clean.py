"""Cleaning: typed projection, validity, deterministic deduplication and a count of what was rejected."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType

from ..schema import CONTENT, REQUIRED, SILVER


def typed(df: DataFrame) -> DataFrame:
    """The columns of SILVER, in order. A value that does not fit its type becomes NULL, as does a column that is absent."""
    have = set(df.columns)
    return df.select(*[(F.col(c).try_cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in SILVER.items()])


def add_missing(df: DataFrame, columns: Mapping[str, DataType], false_flags: bool = False) -> DataFrame:
    """``df`` with each absent column as a typed NULL; with ``false_flags`` an absent boolean is FALSE."""
    absent = {c: F.lit(False) if false_flags and isinstance(t, BooleanType) else F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def _present(column: str) -> Column:
    is_number = SILVER[column].typeName() == "double"
    return F.col(column).isNotNull() & ~F.isnan(column) if is_number else F.col(column).isNotNull()


#: Reasons for which a typed row is rejected, in the order in which they are tried.
def rejections() -> dict[str, Column]:
    """Reason -> condition that must hold. NaN counts as missing; bounds are inclusive."""
    return {f"missing_{c}": _present(c) for c in REQUIRED} | {
        "negative_amount": F.col("amount") >= 0,
        "latitude_out_of_range": F.col("latitude").between(-90, 90),
        "longitude_out_of_range": F.col("longitude").between(-180, 180),
    }


def valid(df: DataFrame) -> DataFrame:
    """Typed rows that meet every condition."""
    for condition in rejections().values():
        df = df.where(condition)
    return df


def reject_reason() -> Column:
    """The first condition that a typed row fails; NULL for a valid row."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(rejections().items()):
        reason = F.when(~F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(reason)
    return reason


def reject_counts(df: DataFrame) -> DataFrame:
    """(reason, rows) over typed rows; valid ones under ``valid``."""
    return df.groupBy(F.coalesce(reject_reason(), F.lit("valid")).alias("reason")).agg(F.count("*").alias("rows"))


def deduplicate(df: DataFrame) -> DataFrame:
    """One row of each content (CONTENT, NULLs alike): the one with the smallest transaction id, then the smallest other columns, whatever the partitioning.

    An aggregate of the smallest row per content, so that copies meet pre-aggregated and a hot content is no hot group. Contents meet by a 128-bit hash
    (of which columns are NULL, and of their values), so that what is sorted and compared is two numbers.
    """
    rest = ["transaction_id", *[c for c in df.columns if c not in CONTENT and c != "transaction_id"]]
    values = [F.col(c) + F.lit(0.0) if df.schema[c].dataType.typeName() == "double" else F.col(c) for c in CONTENT]  # -0.0 is 0.0
    keys = [F.xxhash64(F.lit(salt), *[F.col(c).isNull() for c in CONTENT], *values).alias(f"_key{salt}") for salt in (0, 1)]
    smallest = F.min(F.struct(*rest, *CONTENT)).alias("_row")
    return df.groupBy(*keys).agg(smallest).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def clean(df: DataFrame) -> DataFrame:
    """Raw or lineage-tagged transactions -> typed, valid, deduplicated ones."""
    return deduplicate(valid(typed(df)))
