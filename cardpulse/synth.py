"""Synthetic transactions on ``spark.range``: any number of rows in parallel, the same for the same seed.

Every random draw is a hash of (seed, purpose, row), so that a row does not depend on the partitioning or on other rows. Anomalies are
labelled: spending spikes by amount, impossible travel by an extra row far from, and soon after, the card's latest transaction.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import load_yaml
from .functions.scalars import EARTH_KM, iso_time


@dataclass(frozen=True)
class GeneratorConfig:
    """Sizes, ranges and anomaly shares of a generated data set."""

    num_transactions: int = 10_000
    num_cards: int = 500
    start_date: str = "2013-09-01T00:00:00"
    end_date: str = "2013-09-30T23:59:59"
    seed: int = 42
    anomaly_ratio: float = 0.01
    amount_mean: float = 75.0
    amount_std: float = 40.0
    merchant_categories: tuple[tuple[str, float], ...] = field(default=(("retail", 0.40), ("food", 0.25), ("travel", 0.15), ("other", 0.20)))
    geo_center_lat: float = 40.0
    geo_center_lon: float = -74.0
    geo_std: float = 0.5
    normal_min_minutes_between_transactions: int = 30
    min_minutes_between_locations: int = 120
    min_distance_km_impossible_travel: float = 500.0
    spike_amount_multiplier: float = 5.0
    impossible_travel_fraction: float = 0.5
    output_path: str = "data/raw"
    raw_write_mode: str = "overwrite"

    @classmethod
    def load(cls, path: str | Path, **overrides: object) -> GeneratorConfig:
        """From YAML; categories are a list of {name, weight}."""
        found = {k: v for k, v in load_yaml(path).items() if k in {f.name for f in fields(cls)}} | overrides
        if isinstance(found.get("merchant_categories"), list):
            found["merchant_categories"] = tuple((c["name"], float(c["weight"])) for c in found["merchant_categories"])
        return cls(**found)


def uniform(seed: int, purpose: str, *keys: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), *keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def normal(seed: int, purpose: str, *keys: Column) -> Column:
    """A standard normal number, from two uniform ones."""
    u, v = F.greatest(uniform(seed, purpose + "/u", *keys), F.lit(1e-12)), uniform(seed, purpose + "/v", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)


def minimum_gap(df: DataFrame, seconds: int, partition: str, time: str, tie: str) -> DataFrame:
    """``df`` with times moved forward, where needed, so that consecutive rows of a partition are at least ``seconds`` apart.

    In closed form: with rows in order, t'_i = max over j <= i of (t_j - j * gap) + i * gap, a running maximum."""
    order = Window.partitionBy(partition).orderBy(time, tie)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_i", F.row_number().over(order) - 1)
    return df.withColumn(time, F.max(F.col(time) - F.col("_i") * seconds).over(upto) + F.col("_i") * seconds).drop("_i")


def card_of(c: GeneratorConfig, row: Column) -> Column:
    """The card of a transaction by its row."""
    return F.floor(uniform(c.seed, "card", row) * c.num_cards).cast("long")


def generate(spark: SparkSession, config: GeneratorConfig | None = None) -> DataFrame:
    """Canonical transactions with ``anomaly_type`` none, spending_spike or impossible_travel. Travel rows come on top of ``num_transactions`` and refer to
    the transaction that they contradict."""
    c = config or GeneratorConfig()
    if c.num_transactions <= 0 or c.num_cards <= 0:
        raise ValueError("a data set has transactions and cards")
    row, s = F.col("id"), c.seed
    start, length = F.unix_seconds(F.lit(c.start_date).cast("timestamp")), F.unix_seconds(F.lit(c.end_date).cast("timestamp")) - F.unix_seconds(F.lit(c.start_date).cast("timestamp"))
    card = card_of(c, row)
    home_lat = F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.lit(c.geo_center_lat) + F.lit(c.geo_std) * normal(s, "home-lat", F.col("card"))))
    home_lon = F.greatest(F.lit(-180.0), F.least(F.lit(180.0), F.lit(c.geo_center_lon) + F.lit(c.geo_std) * normal(s, "home-lon", F.col("card"))))
    df = spark.range(c.num_transactions).withColumn("card", card)
    spike = uniform(s, "spike", row) < c.anomaly_ratio * (1 - c.impossible_travel_fraction)
    weight, category, total, done = uniform(s, "category", row), None, sum(w for _, w in c.merchant_categories), 0.0
    for name, w in c.merchant_categories[:-1]:
        done += w / total
        category = F.when(weight < done, name) if category is None else category.when(weight < done, name)
    last = F.lit(c.merchant_categories[-1][0])
    amount = F.when(spike, F.lit(c.amount_mean + c.spike_amount_multiplier * c.amount_std)).otherwise(F.greatest(F.lit(0.0), F.lit(c.amount_mean) + F.lit(c.amount_std) * normal(s, "amount", row)))
    df = df.select(
        F.format_string("tx_%012d", row).alias("transaction_id"),
        F.format_string("card_%06d", F.col("card")).alias("card_id"),
        (start + F.floor(uniform(s, "time", row) * (length + 1)).cast("long")).alias("t"),
        F.round(amount, 2).alias("amount"),
        (last if category is None else category.otherwise(last)).alias("merchant_category"),
        F.round(home_lat + F.lit(c.geo_std / 10) * normal(s, "lat", row), 4).alias("latitude"),
        F.round(home_lon + F.lit(c.geo_std / 10) * normal(s, "lon", row), 4).alias("longitude"),
        F.when(spike, "spending_spike").otherwise("none").alias("anomaly_type"),
        F.lit(None).cast("string").alias("ref_transaction_id"),
    )
    df = minimum_gap(df, 60 * c.normal_min_minutes_between_transactions, "card_id", "t", "transaction_id")
    travel = round(c.num_transactions * c.anomaly_ratio * c.impossible_travel_fraction)
    if travel:
        df = df.unionByName(_travel(spark, df, c, travel))
    return df.withColumn("event_time", iso_time(F.col("t"))).select("transaction_id", "card_id", "event_time", "amount", "merchant_category", "latitude", "longitude", "anomaly_type", "ref_transaction_id")


def _travel(spark: SparkSession, df: DataFrame, c: GeneratorConfig, n: int) -> DataFrame:
    """``n`` rows far from, and a tenth of the plausible time after, the latest transaction of the card of a random transaction each: a card without
    transactions is never drawn, so that no row is lost."""
    last = F.max(F.struct("t", "transaction_id", "latitude", "longitude", "merchant_category")).alias("last")
    latest = df.groupBy("card_id").agg(last).select("card_id", "last.*")
    drawn = F.floor(uniform(c.seed, "travel-card", F.col("id")) * c.num_transactions).cast("long")
    rows = spark.range(n).select(F.col("id"), F.format_string("card_%06d", card_of(c, drawn)).alias("card_id"))
    angle = c.min_distance_km_impossible_travel * 1.2 / EARTH_KM  # along the meridian, away from the nearer pole
    lat = F.when(F.col("latitude") > 0, F.col("latitude") - math.degrees(angle)).otherwise(F.col("latitude") + math.degrees(angle))
    return rows.join(latest, "card_id").select(
        F.format_string("tx_travel_%09d", "id").alias("transaction_id"),
        "card_id",
        (F.col("t") + 60 * max(1, c.min_minutes_between_locations // 10)).alias("t"),
        F.round(F.greatest(F.lit(0.0), F.lit(c.amount_mean) + F.lit(c.amount_std) * normal(c.seed, "travel-amount", F.col("id"))), 2).alias("amount"),
        "merchant_category",
        F.round(lat, 4).alias("latitude"),
        "longitude",
        F.lit("impossible_travel").alias("anomaly_type"),
        F.col("transaction_id").alias("ref_transaction_id"),
    )


def write_raw(df: DataFrame, path: str, mode: str = "overwrite", run_id: str | None = None) -> str:
    """Raw JSON lines in event-time order within files; NULL references are left out. To append is to write a folder of its own, named by ``run_id`` (by
    default a new one), beside those that are there; readers see all of them. Returns the folder that was written."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"a write mode is overwrite or append, not {mode!r}")
    target = path if mode == "overwrite" else f"{path.rstrip('/')}/run_id={run_id or uuid.uuid4().hex}"
    df.repartitionByRange("event_time").sortWithinPartitions("event_time", "transaction_id").write.mode("overwrite" if mode == "overwrite" else "error").json(target)
    return target


def run(spark: SparkSession, config: GeneratorConfig) -> DataFrame:
    """Generate and write; returns the generated rows as written."""
    df = generate(spark, config)
    return spark.read.schema(df.schema).json(write_raw(df, config.output_path, config.raw_write_mode))
