"""Scalar expressions. All are built-in column functions, so they stay inside generated code.

Spark 4 is in ANSI mode: a bad cast, a bad timestamp or a zero divisor raises. The pipeline wants NULL in these cases, and says so with
``try_*`` functions and guards here, without turning ANSI mode off.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in kilometres.
EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres; NULL if any coordinate is NULL."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known, 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def parse_time(text: Column, layout: str | None = None) -> Column:
    """A timestamp from ISO-8601 text, or by ``layout``; NULL if it cannot be read."""
    return F.try_to_timestamp(text, F.lit(layout)) if layout else F.try_to_timestamp(text)


def iso_time(seconds: Column) -> Column:
    """ISO-8601 text in UTC (the session's time zone is pinned to it) of epoch seconds."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as a double; NULL where the denominator is 0 or NULL."""
    return F.when(denominator != 0, numerator.cast("double") / denominator)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """``ratio``, and 0.0 in place of NULL."""
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` within [low, high]; NULL counts as absent, as in greatest and least."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cents(amount: Column, scale: int) -> Column:
    """``amount`` as a whole number of units of 10**-scale."""
    return F.round(amount * 10**scale).cast("long")
