"""Hand-computed timelines and invariants of the feature table."""

import math

import pytest
from pyspark.sql import functions as F

from cardpulse.operators.clean import clean, deduplicate, reject_counts, typed, valid
from cardpulse.plans.features import RANGES, feature_table
from cardpulse.schema import GOLD_COLUMNS, SILVER

BASE = {"card_id": "card_1", "merchant_category": "retail", "latitude": 40.0, "longitude": -74.0, "anomaly_type": "none"}


def frame(spark, rows):
    """Raw rows as text."""
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r.get(n)) for n in names) for r in rows], ", ".join(f"{n} string" for n in names))


def tx(i, seconds, amount, **more):
    day, rest = divmod(seconds, 86400)
    return BASE | {"transaction_id": f"tx_{i:03d}", "event_time": f"2013-09-{1 + day:02d}T{rest // 3600:02d}:{rest // 60 % 60:02d}:{rest % 60:02d}Z", "amount": amount} | more


def rows_of(spark, rows, **options):
    return {r["transaction_id"]: r for r in feature_table(clean(frame(spark, rows)), **options).collect()}


@pytest.mark.parametrize("exact", [None, 2])
def test_two_rows(spark, exact):
    got = rows_of(spark, [tx(1, 3600, 10.0), tx(2, 7200, 25.0, latitude=40.1, longitude=-74.1)], exact=exact)
    one, two = got["tx_001"], got["tx_002"]
    assert two["amount_sum_last_1h"] == 35.0
    assert (two["tx_count_last_1h"], two["tx_count_last_15m"]) == (2, 1)
    assert two["time_since_last_tx_minutes"] == 60.0
    assert (two["prior_amount_mean_card"], two["prior_amount_std_card"], two["prior_amount_zscore"]) == (10.0, 0.0, None)
    assert (two["hour_of_day"], two["day_of_week"], two["is_weekend"], two["is_night_transaction"]) == (2, 1, True, True)
    assert (one["prior_amount_mean_card"], one["prior_amount_std_card"], one["prior_tx_count_card"]) == (None, 0.0, 0)
    assert one["time_since_last_tx_minutes"] is None
    assert one["distance_from_prev_km"] is None
    assert two["merchant_tx_count_last_24h"] is None
    assert two["hours_since_prev"] == 1.0
    assert two["speed_from_prev_kmh"] == pytest.approx(two["distance_from_prev_km"])
    assert two["distance_from_prev_km"] == pytest.approx(14.0, abs=0.6)


def test_column_order(spark):
    df = feature_table(clean(frame(spark, [tx(1, 0, 1.0)])))
    assert tuple(df.columns) == GOLD_COLUMNS
    assert len(df.columns) == 53


def test_range_bounds_are_inclusive_and_peers_count(spark):
    rows = [tx(0, 0, 1.0)] + [tx(k + 1, s, 1.0) for k, s in enumerate(RANGES.values())] + [tx(9, 86400, 2.0)]
    got = rows_of(spark, rows)
    for k, name in enumerate(RANGES):
        assert got[f"tx_{k + 1:03d}"][f"tx_count_last_{name}"] >= 2
    assert got["tx_004"]["tx_count_last_5m"] == 2  # the row of the same second
    assert got["tx_004"]["tx_count_last_24h"] == 6
    assert got["tx_009"]["time_since_last_tx_minutes"] == 0.0


def test_prior_z_gate_shrinkage_and_damping(spark):
    amounts = [10.0, 12.0, 8.0, 11.0, 9.0, 30.0]
    got = rows_of(spark, [tx(k, 3600 * k, a) for k, a in enumerate(amounts)])
    last, before = got["tx_005"], amounts[:5]
    mean, std = sum(before) / 5, math.sqrt(sum(a * a for a in before) / 5 - (sum(before) / 5) ** 2)
    assert last["prior_amount_zscore"] == pytest.approx((30 - mean) / std)
    assert last["prior_category_zscore_eligible"] is True
    assert last["low_history_card_category"] is False
    assert last["prior_amount_zscore_card_category_damped"] == pytest.approx((30 - mean) / std * math.sqrt(0.5))
    assert last["prior_amount_mean_card_category_shrunk"] == pytest.approx((5 * mean + 5 * mean) / 10)
    assert last["prior_category_log_prior_n"] == pytest.approx(math.log(6))
    assert last["is_amount_spike_prior"] is True
    assert got["tx_004"]["prior_amount_zscore_card_category"] is None
    assert got["tx_004"]["is_amount_spike_prior"] is False


def test_references(spark):
    rows = [tx(1, 0, 1.0), tx(2, 3600, 1.0, latitude=41.0), tx(3, 7200, 1.0, latitude=45.0, ref_transaction_id="tx_001"), tx(4, 7300, 1.0, ref_transaction_id="tx_009"), tx(5, 7400, 1.0, ref_transaction_id="tx_006"), tx(6, 9000, 1.0)]
    got = rows_of(spark, rows)
    assert got["tx_003"]["hours_since_prev"] == 2.0
    assert got["tx_003"]["time_since_last_tx_minutes"] == 60.0
    assert got["tx_003"]["distance_from_prev_km"] == pytest.approx(555.97, abs=0.1)
    assert got["tx_004"]["hours_since_prev"] == pytest.approx(100 / 3600)  # the reference is missing: the previous row
    assert got["tx_005"]["hours_since_prev"] < 0
    assert got["tx_005"]["speed_from_prev_kmh"] is None


def test_duplicate_reference_does_not_multiply_rows(spark):
    rows = [tx(1, 0, 1.0), tx(1, 60, 2.0), tx(2, 3600, 1.0, ref_transaction_id="tx_001")]
    assert feature_table(clean(frame(spark, rows))).count() == 3


def test_merchant_features_and_missing_merchant(spark):
    rows = [tx(k, 3600 * k, 1.0, merchant=m, is_fraud=f, card_id=c) for k, (m, f, c) in enumerate([("m", 1, "a"), ("m", 0, "b"), (None, 1, "a"), ("m", 0, "a")])]
    got = rows_of(spark, rows)
    assert [got[f"tx_{k:03d}"]["merchant_prior_tx_count"] for k in range(4)] == [0, 1, None, 2]
    assert [got[f"tx_{k:03d}"]["merchant_prior_fraud_rate"] for k in range(4)] == [None, 1.0, None, 0.5]
    assert [got[f"tx_{k:03d}"]["card_merchant_repeat_count_prior"] for k in range(4)] == [0, 0, None, 1]
    assert got["tx_003"]["merchant_tx_count_last_24h"] == 3


def test_sliced_merchants_equal_plain_ones(spark, sf):
    from cardpulse.plans.queries import transactions

    df = transactions(spark, sf)
    df = df.withColumn("merchant", F.when(F.col("transaction_id") % 3 == 0, F.lit("hot")).otherwise(F.col("merchant")))
    df = df.withColumns({c: F.when(F.col("transaction_id") % 97 != 0, F.col(c)) for c in ("event_time_unix", "event_time")})
    columns = ["transaction_id", "merchant_tx_count_last_24h", "merchant_prior_tx_count", "merchant_prior_fraud_rate", "card_merchant_repeat_count_prior"]
    plain, sliced = (sorted(map(tuple, feature_table(df, slice_merchants=s).select(*columns).collect())) for s in (False, True))
    assert plain == sliced


@pytest.mark.parametrize("exact", [None, 2])
def test_sliced_cards_equal_plain_ones(spark, sf, exact):
    from cardpulse.plans.queries import transactions

    df = transactions(spark, sf)
    df = df.withColumn("card_id", F.when(F.col("transaction_id") % 3 == 0, F.lit("hot")).otherwise(F.col("card_id")))
    df = df.withColumns({c: F.when(F.col("transaction_id") % 97 != 0, F.col(c)) for c in ("event_time_unix", "event_time")})
    plain, cut = ({r["transaction_id"]: r.asDict() for r in feature_table(df, exact, slice_cards=s).collect()} for s in (False, True))
    assert plain.keys() == cut.keys()
    for i, row in plain.items():
        for name, value in row.items():
            assert cut[i][name] == (pytest.approx(value, rel=1e-6, abs=1e-6) if isinstance(value, float) else value), (i, name)


def test_recent_sums_of_doubles_and_huge_amounts(spark):
    got = rows_of(spark, [tx(1, 0, 0.1), tx(2, 60, 0.2), tx(3, 120, "Infinity"), tx(4, 4000, 0.5), tx(5, 90000, 1e20), tx(6, 90060, 1.0)])
    assert [got[f"tx_{k:03d}"]["amount_sum_last_1h"] for k in (1, 2, 3, 4, 5, 6)] == [0.1, pytest.approx(0.3), math.inf, 0.5, math.inf, math.inf]
    assert got["tx_004"]["amount_sum_last_24h"] == math.inf


def test_recent_counts_are_linear_in_the_rows_of_a_key(spark):
    """40,000 rows of one card within a day: frames that only grow take seconds where frames that are summed anew took minutes."""
    import time

    df = spark.range(40000).select(F.format_string("t%06d", "id").alias("transaction_id"), F.lit("c").alias("card_id"), (F.col("id") * 2).alias("event_time_unix"), F.lit(1.0).alias("amount"))
    begun = time.perf_counter()
    got = feature_table(df, 2, references=False).select("tx_count_last_24h", "tx_count_last_5m", "amount_sum_last_24h").agg(F.max("tx_count_last_24h"), F.max("tx_count_last_5m"), F.max("amount_sum_last_24h")).first()
    assert tuple(got) == (40000, 151, 40000.0)
    assert time.perf_counter() - begun < 30


def test_unreadable_time_keeps_the_row(spark):
    got = rows_of(spark, [tx(1, 0, 1.0, event_time="soon"), tx(2, 10, 1.0)])
    assert got["tx_001"]["event_time_ts"] is None
    assert got["tx_001"]["hour_of_day"] is None
    assert got["tx_001"]["event_time_unix"] is None


def test_invariants(spark, sf):
    from cardpulse.plans.queries import gold

    df = gold(spark, sf)
    bad = df.where("tx_count_last_5m > tx_count_last_15m OR tx_count_last_15m > tx_count_last_1h OR tx_count_last_1h > tx_count_last_24h OR tx_count_last_5m < 1 OR amount_sum_last_1h > amount_sum_last_24h + 1e-9")
    assert bad.count() == 0
    assert df.count() == spark.read.parquet(f"{sf}/events.parquet").count()
    counts = df.groupBy("card_id").agg(F.count("*").alias("n"), F.max("prior_tx_count_card").alias("m"), F.countDistinct("prior_tx_count_card").alias("d"))
    assert counts.where("m <> n - 1 OR d <> n").count() == 0


def test_exact_and_double_sums_agree(spark, sf):
    from cardpulse.plans.queries import transactions

    df = transactions(spark, sf)
    a, b = (feature_table(df, exact=e).select("transaction_id", F.col("prior_amount_std_card").alias(n)) for e, n in ((None, "x"), (2, "y")))
    assert a.join(b, "transaction_id").where("abs(x - y) > 1e-5").count() == 0


def test_plan_has_one_exchange_per_key(spark, sf):
    from cardpulse.plans.queries import transactions

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = feature_table(transactions(spark, sf), references=False)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(card_id") == 1
        assert plan.count("Exchange hashpartitioning(_merchant") == 1
        assert plan.count("Exchange") == 2
        narrow = feature_table(transactions(spark, sf), references=False).select("transaction_id", "tx_count_last_5m")._jdf.queryExecution().executedPlan().toString()
        assert narrow.count("Exchange") == 1  # unused windows are dropped
        assert "event_type" not in narrow.split("ReadSchema")[1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_cleaning_rules(spark):
    rows = [tx(0, 0, 0.0), tx(1, 1, None), tx(2, 2, "NaN"), tx(3, 3, "abc"), tx(4, 4, -0.01), tx(5, 5, 1, latitude=90), tx(6, 6, 1, latitude=90.1), tx(7, 7, 1, longitude=-180), tx(8, 8, 1, longitude=180.5), tx(9, 9, "Infinity"), tx(10, 10, 1, card_id=None)]
    raw = typed(frame(spark, rows))
    assert raw.columns == list(SILVER)
    kept = {r[0] for r in valid(raw).select("transaction_id").collect()}
    assert kept == {"tx_000", "tx_005", "tx_007", "tx_009"}
    counts = {r["reason"]: r["rows"] for r in reject_counts(raw).collect()}
    assert counts == {"valid": 4, "missing_amount": 3, "negative_amount": 1, "latitude_out_of_range": 1, "longitude_out_of_range": 1, "missing_card_id": 1}


def test_deduplication_is_deterministic_and_idempotent(spark):
    rows = [tx(3, 0, 1.0, merchant="b"), tx(1, 0, 1.0, merchant="z"), tx(2, 0, 1.0), tx(1, 5, 1.0)]
    once = deduplicate(valid(typed(frame(spark, rows).repartition(3))))
    assert {(r["transaction_id"], r["merchant"]) for r in once.collect()} == {("tx_001", None), ("tx_001", "z")}
    assert once.exceptAll(deduplicate(once)).count() == 0


def test_empty(spark):
    empty = frame(spark, [tx(1, 0, 1.0)]).where("false")
    assert feature_table(clean(empty)).count() == 0
    assert reject_counts(typed(empty)).count() == 0
