"""Session settings that the library relies on, and those that suit large runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Event times are read and written in UTC whatever the cluster's zone; adaptive execution sizes and splits shuffles.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "cardpulse", **settings: str) -> SparkSession:
    """A session with SETTINGS and ``settings`` (dots written as two underscores)."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """Calendar features and ISO times are those of UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
