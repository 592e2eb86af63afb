"""Adapters from other tables to canonical transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import iso_time, parse_time
from ..schema import SILVER


#: Layouts of the time in the labelled CSV source, by the columns they need, and how that time is written.
TIME_COLUMNS = (("unix_time",), ("trans_date_trans_time",), ("trans_date", "trans_time"))
TIME_TEXT = "yyyy-MM-dd HH:mm:ss"
#: Canonical column -> (column of the labelled CSV source, type).
BENCHMARK_MAPPING = {
    "transaction_id": ("trans_num", "string"),
    "card_id": ("cc_num", "string"),
    "amount": ("amt", "double"),
    "merchant_category": ("category", "string"),
    "latitude": ("merch_lat", "double"),
    "longitude": ("merch_long", "double"),
    "merchant": ("merchant", "string"),
    "is_fraud": ("is_fraud", "int"),
    "customer_latitude": ("lat", "double"),
    "customer_longitude": ("long", "double"),
}


def benchmark_event_time(columns: set[str]) -> tuple[Column, Column]:
    """(ISO event time, epoch seconds) of the labelled CSV source in the first of its layouts whose columns there are."""
    layout = next((c for c in TIME_COLUMNS if columns.issuperset(c)), None)
    if layout is None:
        raise ValueError(f"the source has no time: {', or '.join(' and '.join(c) for c in TIME_COLUMNS)}")
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in layout])
    seconds = text.try_cast("long") if len(layout) == 1 and layout[0].startswith("unix") else F.unix_seconds(parse_time(text, TIME_TEXT))
    return iso_time(seconds), seconds


def from_benchmark(df: DataFrame, fraud_label: str = "fraud", other_label: str = "none") -> DataFrame:
    """The labelled CSV source as canonical transactions. Coordinates are the merchant's; a NULL label counts as ``other_label``; there are no references."""
    event_time, seconds = benchmark_event_time(set(df.columns))
    made = {name: F.col(column).cast(kind) if kind == "string" else F.col(column).try_cast(kind) for name, (column, kind) in BENCHMARK_MAPPING.items()}
    made |= {
        "event_time": event_time,
        "event_time_unix": seconds,
        "anomaly_type": F.when(made["is_fraud"] == 1, F.lit(fraud_label)).otherwise(F.lit(other_label)),
        "ref_transaction_id": F.lit(None).cast("string"),
    }
    return df.select(*[made[c].alias(c) for c in SILVER if c in made])


def from_events(events: DataFrame) -> DataFrame:
    """The driver's ``events`` table as canonical transactions: users are cards, event types are categories, and the key in ``props`` picks a merchant
    and its place. Every tenth key has no merchant; every 101st event refers to its predecessor."""
    k = F.get_json_object("props", "$.k").cast("int")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    user = F.col("user_id")
    return events.select(
        _padded(F.col("event_id")).alias("transaction_id"),
        user.cast("string").alias("card_id"),
        iso_time(seconds).alias("event_time"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("merchant_category"),
        (F.lit(25) + k % 25).cast("double").alias("latitude"),
        (F.lit(-120) + k % 50).cast("double").alias("longitude"),
        F.when((F.col("event_type") == "error") & (F.col("value") >= 100), F.lit("fraud")).otherwise(F.lit("none")).alias("anomaly_type"),
        F.when(F.col("event_id") % 101 == 0, _padded(F.col("event_id") - 1)).alias("ref_transaction_id"),
        F.when(k % 10 != 0, k.cast("string")).alias("merchant"),
        ((F.col("event_type") == "error") & (F.col("value") >= 100)).cast("int").alias("is_fraud"),
        (F.lit(25) + user % 25).cast("double").alias("customer_latitude"),
        (F.lit(-120) + user % 50).cast("double").alias("customer_longitude"),
        seconds.alias("event_time_unix"),
    )


def from_orders(orders: DataFrame) -> DataFrame:
    """The driver's ``orders`` table as transactions of customers' cards, many of them in the same second (midnight)."""
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return orders.select(
        _padded(F.col("o_orderkey")).alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("card_id"),
        iso_time(seconds).alias("event_time"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("merchant_category"),
        seconds.alias("event_time_unix"),
    )


def _padded(number: Column) -> Column:
    return F.lpad(number.cast("string"), 12, "0")
