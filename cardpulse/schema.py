"""Column contracts of the layers: one registry that readers, cleaning and feature planning share."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

#: Columns of a cleaned transaction, in order.
SILVER: dict[str, DataType] = {
    "transaction_id": StringType(),
    "card_id": StringType(),
    "event_time": StringType(),
    "amount": DoubleType(),
    "merchant_category": StringType(),
    "latitude": DoubleType(),
    "longitude": DoubleType(),
    "anomaly_type": StringType(),
    "ref_transaction_id": StringType(),
    "merchant": StringType(),
    "is_fraud": IntegerType(),
    "customer_latitude": DoubleType(),
    "customer_longitude": DoubleType(),
    "event_time_unix": LongType(),
    "ingestion_timestamp": TimestampType(),
    "source_path": StringType(),
}
REQUIRED = ("transaction_id", "card_id", "event_time", "amount", "merchant_category", "latitude", "longitude", "anomaly_type")
OPTIONAL = tuple(c for c in SILVER if c not in REQUIRED)
#: What makes two transactions the same event; not the transaction id.
CONTENT = ("card_id", "event_time", "amount", "merchant_category", "latitude", "longitude", "anomaly_type")
#: Carried columns of a feature row, in order.
GOLD_CARRIED = (
    "transaction_id", "card_id", "event_time", "event_time_ts", "event_time_unix", "amount", "merchant_category", "merchant", "latitude",
    "longitude", "customer_latitude", "customer_longitude", "anomaly_type", "is_fraud", "ref_transaction_id", "ingestion_timestamp", "source_path",
)
#: The features of a feature row, in order.
GOLD_FEATURES = (
    "hour_of_day", "day_of_week", "is_weekend", "is_night_transaction", "time_since_last_tx_minutes", "tx_count_last_5m", "tx_count_last_15m",
    "tx_count_last_1h", "tx_count_last_24h", "amount_sum_last_1h", "amount_sum_last_24h", "amount_zscore", "is_amount_spike",
    "prior_tx_count_card", "prior_amount_mean_card", "prior_amount_std_card", "prior_amount_zscore", "is_amount_spike_prior",
    "prior_tx_count_card_category", "prior_amount_mean_card_category", "prior_amount_std_card_category",
    "prior_amount_mean_card_category_shrunk", "prior_amount_zscore_card_category", "prior_amount_zscore_card_category_damped",
    "prior_amount_zscore_card_category_shrunk", "prior_category_zscore_eligible", "low_history_card_category", "prior_category_log_prior_n",
    "customer_to_merchant_distance_km", "merchant_tx_count_last_24h", "merchant_prior_tx_count", "merchant_prior_fraud_rate",
    "card_merchant_repeat_count_prior", "distance_from_prev_km", "hours_since_prev", "speed_from_prev_kmh",
)
GOLD_COLUMNS = GOLD_CARRIED + GOLD_FEATURES
_BOOLEAN = {"is_weekend", "is_night_transaction", "is_amount_spike", "is_amount_spike_prior", "prior_category_zscore_eligible", "low_history_card_category"}
_COUNTS = {c for c in GOLD_FEATURES if "count" in c}


def gold_type(column: str) -> DataType:
    """The type of a column of a feature row."""
    if column in SILVER:
        return SILVER[column]
    if column == "event_time_ts":
        return TimestampType()
    if column in ("hour_of_day", "day_of_week"):
        return IntegerType()
    return BooleanType() if column in _BOOLEAN else LongType() if column in _COUNTS else DoubleType()


def raw_schema() -> StructType:
    """Schema of raw JSON transactions: as text where cleaning casts, so that one bad value costs its row and not the file."""
    return StructType([StructField(c, StringType()) for c in SILVER if c not in ("ingestion_timestamp", "source_path")])


def benchmark_schema() -> StructType:
    """Schema of the labelled CSV source, all text; the adapter casts."""
    return StructType([StructField(c, StringType()) for c in BENCHMARK_COLUMNS])


#: Columns of the labelled CSV source.
BENCHMARK_COLUMNS = ("trans_num", "cc_num", "unix_time", "amt", "category", "merch_lat", "merch_long", "is_fraud", "merchant", "lat", "long")
