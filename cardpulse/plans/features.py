"""The feature registry and its planner.

Features are declared as data: frames (what a window looks at), aggregates (what is read off a frame) and derived columns. The
planner adds all aggregates of card-keyed frames in one projection and all of merchant-keyed ones in a second, so that a full feature
table takes one exchange by card and one by merchant, and Spark sorts once per order. Catalyst drops the windows that a query does not
select. History is strictly prior: row frames end before the current row, in the order (time, transaction id).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import cents, haversine_km, parse_time, ratio
from ..operators.clean import add_missing
from ..schema import GOLD_CARRIED, GOLD_COLUMNS, GOLD_FEATURES, SILVER

#: Prior transactions that make a category baseline eligible, and the weights of shrinkage and damping.
GATE, SHRINK, DAMP = 5, 5.0, 5.0
#: Seconds of the range frames.
RANGES = {"5m": 300, "15m": 900, "1h": 3600, "24h": 86400}
#: A z-score from which an amount is a spike.
SPIKE = 3.0

_NOW, _BEGIN = Window.currentRow, Window.unboundedPreceding


@dataclass(frozen=True)
class Frame:
    """A window: partition and order columns, and whether it looks at prior rows, at the last so many seconds, or at everything."""

    partition: tuple[str, ...]
    seconds: int | None = None
    prior: bool = False
    lag: bool = False


CARD, MERCHANT = "card_id", "_merchant"
FRAMES: dict[str, Frame] = {
    "card_before": Frame((CARD,), lag=True),
    "card_prior": Frame((CARD,), prior=True),
    **{f"card_{name}": Frame((CARD,), seconds=s) for name, s in RANGES.items()},
    "card_all": Frame((CARD,)),
    "category_prior": Frame((CARD, "merchant_category"), prior=True),
    "merchant_24h": Frame((MERCHANT,), seconds=RANGES["24h"]),
    "merchant_prior": Frame((MERCHANT,), prior=True),
    "pair_prior": Frame((MERCHANT, CARD), prior=True),
}

_KINDS: dict[str, Callable[[Column], Column]] = {"count": F.count, "sum": F.sum, "mean": F.avg, "deviation": F.stddev_pop}


@dataclass(frozen=True, eq=False)
class Aggregate:
    """A column read off a frame: a count, sum, mean or (population) deviation of a value, or the value of the row before."""

    frame: str
    kind: str
    value: Column

    def made(self) -> Column:
        return _KINDS[self.kind](self.value)

    def over(self, *slices: str, ghosts: bool = False) -> Column:
        """The column, for each row, among the rows of its partition (and slice; ghosts stand behind the rows of their slice)."""
        f = FRAMES[self.frame]
        window = Window.partitionBy(*f.partition, *slices)
        if f.seconds is not None:
            return recent(self.kind, self.value, window.orderBy("_t"), f.seconds)
        ordered = window.orderBy(*["_ghost"] * ghosts, "_t", "transaction_id")
        if f.lag:
            return F.lag(self.value).over(ordered)
        return self.made().over(ordered.rowsBetween(_BEGIN, -1) if f.prior else window)


def recent(kind: str, value: Column, ordered: WindowSpec, seconds: int) -> Column:
    """A count or an exact sum over the rows of the last ``seconds``: the difference of two running totals. Both frames only grow, so that the cost is
    linear in the rows of a key, however many of them lie within the range. Rows without a time see one another."""
    upto, before = ordered.rangeBetween(_BEGIN, _NOW), ordered.rangeBetween(_BEGIN, -seconds - 1)

    def difference(total: Column) -> Column:
        return total.over(upto) - F.coalesce(F.when(F.col("_t").isNotNull(), total.over(before)), F.lit(0))

    if kind == "count":
        return difference(F.count(value))
    return F.when(difference(F.count(value)) > 0, difference(F.sum(value)))


def _moments(frame: str, key: str, exact: int | None) -> dict[str, Aggregate]:
    """Count, sum and sum of squares of the amount over a frame: of doubles, or of whole units in wide decimals."""
    amount = F.col("amount") if exact is None else cents(F.col("amount"), exact).cast("decimal(20,0)")
    return {f"_{key}_n": Aggregate(frame, "count", F.col("amount")), f"_{key}_s": Aggregate(frame, "sum", amount), f"_{key}_q": Aggregate(frame, "sum", amount * amount)}


def aggregates(exact: int | None) -> dict[str, Aggregate]:
    """All window columns by name. ``exact`` is the number of decimals that amounts have, for sums in whole units; None for doubles, of which those of the last
    hours are summed with ten decimals (running totals must be exact), amounts of 10**18 and more apart."""
    amount = F.col("amount").try_cast("decimal(28,10)") if exact is None else cents(F.col("amount"), exact)
    huge = {} if exact is not None else {f"_huge_{n}": Aggregate(f"card_{n}", "count", F.when(amount.isNull(), F.col("amount"))) for n in ("1h", "24h")}
    one = F.lit(1)
    return {
        **{f"_before_{n}": Aggregate("card_before", "lag", F.col(c)) for n, c in _PLACE.items()},
        **_moments("card_prior", "card", exact),
        **_moments("category_prior", "cat", exact),
        **(_moments("card_all", "all", exact) if exact is not None else {"_all_mean": Aggregate("card_all", "mean", F.col("amount")), "_all_std": Aggregate("card_all", "deviation", F.col("amount"))}),
        **{f"tx_count_last_{name}": Aggregate(f"card_{name}", "count", one) for name in RANGES},
        **{f"_sum_{name}": Aggregate(f"card_{name}", "sum", amount) for name in ("1h", "24h")},
        **huge,
        "_merchant_24h": Aggregate("merchant_24h", "count", one),
        "_merchant_n": Aggregate("merchant_prior", "count", F.col("transaction_id")),
        "_merchant_f": Aggregate("merchant_prior", "sum", F.coalesce("is_fraud", F.lit(0))),
        "_pair_n": Aggregate("pair_prior", "count", F.col("transaction_id")),
    }


#: Where and when the row before was.
_PLACE = {"t": "_t", "lat": "latitude", "lon": "longitude"}


def _mean(key: str, exact: int | None) -> Column:
    s, n = F.col(f"_{key}_s").cast("double"), F.col(f"_{key}_n")
    return ratio(s, n) if exact is None else ratio(s, n) / F.lit(float(10**exact))


def _std(key: str, exact: int | None) -> Column:
    """Population deviation from the moments; 0.0, not NULL, without history."""
    n, s, q = (F.col(f"_{key}_{x}") for x in "nsq")
    if exact is None:
        variance = ratio(q, n) - ratio(s, n) * ratio(s, n)
    else:  # integers until the last step: a constant history has a variance of exactly 0
        wide = n.cast("decimal(18,0)")
        variance = ratio((wide * q.cast("decimal(38,0)") - s.cast("decimal(38,0)") * s.cast("decimal(38,0)")).cast("double"), (n * n).cast("double")) / F.lit(float(10 ** (2 * exact)))
    return F.sqrt(F.greatest(variance, F.lit(0.0)))


def prepare(df: DataFrame) -> DataFrame:
    """Cleaned transactions with the columns that frames need: event time, order key, merchant key (a row without merchant is a merchant of its own,
    so that these rows do not meet in one partition) and, for rows that refer to another, that one's place and time."""
    df = add_missing(df, SILVER)
    ts = parse_time(F.col("event_time"))
    lonely = F.concat(F.lit("\x00"), F.coalesce("transaction_id", F.lit("")))
    df = df.withColumn("event_time_ts", ts)
    df = df.withColumns({"_t": F.coalesce("event_time_unix", F.unix_seconds("event_time_ts")), MERCHANT: F.coalesce("merchant", lonely)})
    return df


def with_references(df: DataFrame) -> DataFrame:
    """``prepare``d rows with ``_ref_id``, ``_ref_t``, ``_ref_lat``, ``_ref_lon`` of the transaction they refer to (NULL if it is absent). Of
    transactions that share an id the smallest by (time, place) counts, so that no row is multiplied. Only referenced ids enter the lookup, and
    rows without a reference get a key of their own: no NULL key gathers rows."""
    asked = df.where("ref_transaction_id IS NOT NULL").select(F.col("ref_transaction_id").alias("_ref_id")).distinct()
    parent = F.min(F.struct(F.col("_t").alias("t"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))).alias("_ref")
    lookup = df.join(asked, df["transaction_id"] == asked["_ref_id"], "left_semi").groupBy(F.col("transaction_id").alias("_ref_id")).agg(parent)
    lookup = lookup.select("_ref_id", F.col("_ref.t").alias("_ref_t"), F.col("_ref.lat").alias("_ref_lat"), F.col("_ref.lon").alias("_ref_lon"))
    key = F.coalesce("ref_transaction_id", F.concat(F.lit("\x00"), F.coalesce("transaction_id", F.lit(""))))
    return df.withColumn("_key", key).join(lookup, F.col("_key") == F.col("_ref_id"), "left").drop("_key")


def derived(exact: int | None) -> list[dict[str, Column]]:
    """Feature columns by stage: a stage uses columns of earlier ones."""
    c = F.col
    time = c("event_time_ts")
    has_merchant = c("merchant").isNotNull()
    minutes = (c("_t") - c("_before_t")) / F.lit(60.0)
    hours_before = (c("_t") - c("_before_t")) / F.lit(3600.0)
    hours_ref = (c("_t") - c("_ref_t")) / F.lit(3600.0)
    refers = c("_ref_id").isNotNull()
    here = (c("latitude"), c("longitude"))
    scale = F.lit(1.0) if exact is None else F.lit(float(10**exact))
    all_mean, all_std = (c("_all_mean"), c("_all_std")) if exact is None else (_mean("all", exact), _std("all", exact))
    first = {
        "hour_of_day": F.hour(time),
        "day_of_week": F.dayofweek(time),
        "time_since_last_tx_minutes": minutes,
        **{f"amount_sum_last_{n}": (F.when(c(f"_huge_{n}") > 0, F.lit(float("inf"))).otherwise(c(f"_sum_{n}").cast("double")) if exact is None else c(f"_sum_{n}").cast("double") / scale) for n in ("1h", "24h")},
        "_mean_all": all_mean,
        "_std_all": all_std,
        "prior_tx_count_card": c("_card_n"),
        "prior_amount_mean_card": _mean("card", exact),
        "prior_amount_std_card": _std("card", exact),
        "prior_tx_count_card_category": c("_cat_n"),
        "prior_amount_mean_card_category": _mean("cat", exact),
        "prior_amount_std_card_category": _std("cat", exact),
        "low_history_card_category": c("_cat_n") < GATE,
        "prior_category_log_prior_n": F.log1p(c("_cat_n").cast("double")),
        "customer_to_merchant_distance_km": haversine_km(c("customer_latitude"), c("customer_longitude"), *here),
        "merchant_tx_count_last_24h": F.when(has_merchant, c("_merchant_24h")),
        "merchant_prior_tx_count": F.when(has_merchant, c("_merchant_n")),
        "merchant_prior_fraud_rate": F.when(has_merchant, ratio(c("_merchant_f"), c("_merchant_n"))),
        "card_merchant_repeat_count_prior": F.when(has_merchant, c("_pair_n")),
        "distance_from_prev_km": F.when(refers, haversine_km(c("_ref_lat"), c("_ref_lon"), *here)).otherwise(haversine_km(c("_before_lat"), c("_before_lon"), *here)),
        "hours_since_prev": F.when(refers, hours_ref).otherwise(hours_before),
    }
    n, mean, std = c("prior_tx_count_card_category").cast("double"), c("prior_amount_mean_card_category"), c("prior_amount_std_card_category")
    second = {
        "is_weekend": c("day_of_week").isin(1, 7),
        "is_night_transaction": (c("hour_of_day") < 6) | (c("hour_of_day") >= 22),
        "amount_zscore": F.when(c("_std_all") > 0, (c("amount") - c("_mean_all")) / c("_std_all")).otherwise(F.lit(0.0)),
        "prior_amount_zscore": F.when((c("prior_tx_count_card") > 1) & (c("prior_amount_std_card") > 0), (c("amount") - c("prior_amount_mean_card")) / c("prior_amount_std_card")),
        "prior_amount_mean_card_category_shrunk": F.when(c("prior_tx_count_card_category") > 0, (n * mean + F.lit(SHRINK) * c("prior_amount_mean_card")) / (n + F.lit(SHRINK))).otherwise(c("prior_amount_mean_card")),
        "prior_category_zscore_eligible": (c("prior_tx_count_card_category") >= GATE) & (std > 0),
        "speed_from_prev_kmh": F.when(c("hours_since_prev") > 0, c("distance_from_prev_km") / c("hours_since_prev")),
    }
    gated = c("prior_category_zscore_eligible")
    third = {
        "is_amount_spike": c("amount_zscore") >= SPIKE,
        "is_amount_spike_prior": F.coalesce(c("prior_amount_zscore") >= SPIKE, F.lit(False)),
        "prior_amount_zscore_card_category": F.when(gated, (c("amount") - mean) / std),
        "prior_amount_zscore_card_category_shrunk": F.when(gated, (c("amount") - c("prior_amount_mean_card_category_shrunk")) / std),
    }
    fourth = {"prior_amount_zscore_card_category_damped": F.when(gated, c("prior_amount_zscore_card_category") * F.sqrt(n / (n + F.lit(DAMP))))}
    return [first, second, third, fourth]


def sliced(df: DataFrame, key: str, every: dict[str, Aggregate]) -> DataFrame:
    """``df`` with the columns ``every`` of frames that begin with ``key``, without a task that holds all rows of a key: for cards or merchants with a large
    share of all rows.

    Rows meet by key and day. What a frame saw on earlier days is a running total over one row per partition and day; the last 24 hours
    reach into the day before, whose keys, times and amounts come along as ghosts. Results equal those of the plain frames.
    """
    day, order = F.floor(F.col("_t") / RANGES["24h"]), F.asc_nulls_first("_day")
    by_frame = {n: (a, FRAMES[a.frame]) for n, a in every.items()}
    df = df.withColumn("_day", day)
    ghosts = df.where("_t IS NOT NULL").select(F.col(key), (F.col("_day") + 1).alias("_day"), "_t", "amount", F.lit(True).alias("_ghost"))
    both = df.withColumn("_ghost", F.lit(False)).unionByName(ghosts, allowMissingColumns=True)
    inner = {n: a.over("_day", ghosts=True) for n, (a, f) in by_frame.items() if f.seconds or f.prior or f.lag}
    first = F.row_number().over(Window.partitionBy(key, "_day").orderBy("_ghost", "_t", "transaction_id")) == 1
    out = both.select("*", *[c.alias(n) for n, c in inner.items()], first.alias("_first")).where("NOT _ghost").drop("_ghost")
    partitions = dict.fromkeys(f.partition for _, f in by_frame.values() if f.prior or f.lag)
    for columns in partitions:
        prior = {n: a for n, (a, f) in by_frame.items() if f.prior and f.partition == columns}
        lags = {n: a for n, (a, f) in by_frame.items() if f.lag and f.partition == columns}
        last = [F.max(F.struct("_t", "transaction_id", *[a.value.alias(n) for n, a in lags.items()])).alias("_last")] if lags else []
        totals = df.groupBy(*columns, "_day").agg(*[a.made().alias(n) for n, a in prior.items()], *last)
        before = Window.partitionBy(*columns).orderBy(order).rowsBetween(_BEGIN, -1)
        seen = [F.sum(n).over(before).alias(f"{n}_before") for n in prior] + [F.max("_last").over(before).alias("_last")] * bool(lags)
        totals = totals.select(*[F.col(c).alias(f"{c}_key") for c in (*columns, "_day")], *seen)
        same = [F.col(c).eqNullSafe(F.col(f"{c}_key")) for c in (*columns, "_day")]
        out = out.join(totals, same, "left").drop(*[f"{c}_key" for c in (*columns, "_day")])
        zero = F.lit(0)
        sums = {n: F.when(F.col(n).isNotNull() | F.col(f"{n}_before").isNotNull(), F.coalesce(n, zero) + F.coalesce(f"{n}_before", zero)) for n in prior}
        out = out.withColumns(sums | {n: F.when(F.col("_first"), F.col(f"_last.{n}")).otherwise(F.col(n)) for n in lags}).drop("_last", *[f"{n}_before" for n in prior])
    whole = {n: a for n, (a, f) in by_frame.items() if not (f.seconds or f.prior or f.lag)}
    if whole:
        of_key = df.groupBy(F.col(key).alias("_whole")).agg(*[a.made().alias(n) for n, a in whole.items()])
        out = out.join(of_key, F.col(key).eqNullSafe(F.col("_whole")), "left").drop("_whole")
    return out.drop("_day", "_first")


def feature_table(df: DataFrame, exact: int | None = None, references: bool = True, slice_merchants: bool = False, slice_cards: bool = False) -> DataFrame:
    """Cleaned transactions -> the 17 carried columns and the 36 features, in the order of GOLD_COLUMNS, one row for each row of ``df``.

    ``exact``: amounts have that many decimals, and sums are taken in whole units (independent of the order of addition); None sums doubles.
    ``references``: look up referenced transactions, which then stand in for the previous one in distance, hours and speed.
    ``slice_merchants``, ``slice_cards``: no task holds all rows of a merchant, or card (see ``sliced``).
    """
    df = prepare(df)
    if references:
        df = with_references(df)
    else:
        df = df.withColumns({"_ref_id": F.lit(None).cast("string"), "_ref_t": F.lit(None).cast("long"), "_ref_lat": F.lit(None).cast("double"), "_ref_lon": F.lit(None).cast("double")})
    every = aggregates(exact)
    for key, slicing in ((CARD, slice_cards), (MERCHANT, slice_merchants)):  # one exchange each: all frames of a key begin with it
        own = {name: a for name, a in every.items() if FRAMES[a.frame].partition[0] == key}
        df = sliced(df, key, own) if slicing else df.select("*", *[a.over().alias(name) for name, a in own.items()])
    for stage in derived(exact):
        df = df.withColumns(stage)
    return df.withColumn("event_time_unix", F.col("_t")).select(*GOLD_COLUMNS)


assert len(GOLD_CARRIED) == 17
assert len(GOLD_FEATURES) == 36
