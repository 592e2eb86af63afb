"""Registered queries over the driver's tables. Each callable takes (spark, sf_dir); doubles are rounded to six decimals."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import synth
from ..operators import modelling, ranking, reports
from ..operators.clean import add_missing, clean, reject_counts, typed, valid
from ..schema import GOLD_FEATURES, gold_type
from ..session import pin_utc
from ..sources.adapters import from_benchmark, from_events, from_orders
from ..sources.files import read_benchmark_csv, read_json, rows_frame, with_lineage, write_json, write_parquet
from ..streaming.velocity import velocity
from .features import feature_table
from .oracle import FINER

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The K that the model's queries report, and the shortlist that they rerank.
KS = ranking.TOP_K
SHORTLIST = 5000


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, FINER.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_utc(spark)
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def gold(spark: SparkSession, sf_dir: str, references: bool = True) -> DataFrame:
    """The feature table of ``events``; amounts have two decimals."""
    return feature_table(transactions(spark, sf_dir), exact=2, references=references)


def pick(spark: SparkSession, sf_dir: str, *columns: str, references: bool = True) -> DataFrame:
    return rounded(gold(spark, sf_dir, references).select("transaction_id", *columns))


@query
def canonical_tx(spark, sf_dir):
    return transactions(spark, sf_dir)


@query
def velocity_counts(spark, sf_dir):
    return pick(spark, sf_dir, "tx_count_last_5m", "tx_count_last_15m", "tx_count_last_1h", "tx_count_last_24h")


@query
def velocity_sums(spark, sf_dir):
    return pick(spark, sf_dir, "amount_sum_last_1h", "amount_sum_last_24h")


@query
def prior_amount_stats(spark, sf_dir):
    return pick(spark, sf_dir, "prior_tx_count_card", "prior_amount_mean_card", "prior_amount_std_card", "prior_amount_zscore", "is_amount_spike_prior")


@query
def prior_spike_topk(spark, sf_dir):
    df = pick(spark, sf_dir, "card_id", "amount", "prior_amount_zscore", "tx_count_last_1h")
    return df.orderBy(F.desc_nulls_last("prior_amount_zscore"), "transaction_id").limit(100)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text transactions with missing, malformed and out-of-range values at fixed ids."""
    n = F.col("transaction_id").cast("long")
    bad = {
        "amount": F.when(n % 7 == 0, F.lit(None)).when(n % 11 == 0, F.lit("abc")).when(n % 13 == 0, F.lit("-0.01")).when(n % 29 == 0, F.lit("NaN")).otherwise(F.col("amount").cast("string")),
        "latitude": F.when(n % 17 == 0, F.lit("90.1")).when(n % 19 == 0, F.lit("90")).otherwise(F.col("latitude").cast("string")),
        "longitude": F.when(n % 23 == 0, F.lit("-180.5")).when(n % 31 == 0, F.lit("180")).otherwise(F.col("longitude").cast("string")),
        "card_id": F.when(n % 37 == 0, F.lit(None)).otherwise(F.col("card_id")),
    }
    return transactions(spark, sf_dir).withColumns(bad)


_CLEAN = ("transaction_id", "card_id", "event_time", "amount", "merchant_category", "latitude", "longitude", "anomaly_type", "merchant", "is_fraud", "event_time_unix")


@query
def silver_clean(spark, sf_dir):
    return valid(typed(dirty(spark, sf_dir))).select(*_CLEAN)


@query
def silver_dedup(spark, sf_dir):
    df = dirty(spark, sf_dir)
    copies = df.where(F.col("transaction_id").cast("long") % 5 == 0)
    renamed = copies.withColumn("transaction_id", F.concat(F.lit("z"), "transaction_id"))
    return clean(df.unionByName(renamed).unionByName(copies)).select(*_CLEAN)


@query
def silver_reject_counts(spark, sf_dir):
    return reject_counts(typed(dirty(spark, sf_dir)))


@query
def missing_columns(spark, sf_dir):
    df = transactions(spark, sf_dir).select("transaction_id", "amount", "is_fraud")
    wanted = ("is_night_transaction", "prior_amount_zscore", "prior_tx_count_card_category", "hour_of_day", "merchant")
    return modelling.fill_defaults(add_missing(df, {c: gold_type(c) for c in wanted}, false_flags=True), ("prior_amount_zscore", "prior_tx_count_card_category"))


def labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions as the labelled CSV source has them: text."""
    tx = transactions(spark, sf_dir)
    return tx.select(
        F.col("transaction_id").alias("trans_num"), F.col("card_id").alias("cc_num"), F.concat(F.substring("event_time", 1, 10), F.lit(" "), F.substring("event_time", 12, 8)).alias("trans_date_trans_time"),
        F.col("amount").cast("string").alias("amt"), F.col("merchant_category").alias("category"), F.col("latitude").cast("string").alias("merch_lat"), F.col("longitude").cast("string").alias("merch_long"),
        F.when(F.col("transaction_id").cast("long") % 10 != 0, F.col("is_fraud").cast("string")).alias("is_fraud"), "merchant", F.col("customer_latitude").cast("string").alias("lat"), F.col("customer_longitude").cast("string").alias("long"),
    )


@query
def benchmark_normalize(spark, sf_dir):
    return from_benchmark(labelled_text(spark, sf_dir)).drop("ref_transaction_id")


def _folder(name: str) -> str:
    """A new folder for a round trip through files, gone with this process."""
    folder = tempfile.mkdtemp(prefix=f"{name}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"{folder}/out"


def _shared(spark: SparkSession, name: str) -> str:
    """A folder for a round trip through files that all executors see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}" if named else f"file://{_folder(name)}"


_RAW = ("transaction_id", "card_id", "event_time", "amount", "merchant_category", "latitude", "longitude", "anomaly_type", "ref_transaction_id", "merchant", "is_fraud")


@query
def json_round_trip(spark, sf_dir):
    """Raw JSON lines, written, appended to and read by pattern, then typed."""
    path, df = _shared(spark, "json"), dirty(spark, sf_dir).select(*_RAW)
    even = F.col("transaction_id").cast("long") % 2 == 0
    write_json(df.where(even), path)
    write_json(df.where(~even), path, "append")
    return typed(read_json(spark, path, "*.json").select(*_RAW)).select(*_RAW)


@query
def csv_round_trip(spark, sf_dir):
    """The labelled source as a CSV with a header, read back and mapped to canonical transactions."""
    path = _shared(spark, "csv")
    labelled_text(spark, sf_dir).write.option("header", True).csv(path)
    return from_benchmark(read_benchmark_csv(spark, path)).drop("ref_transaction_id")


@query
def parquet_round_trip(spark, sf_dir):
    """The cleaned layer as Parquet, rebalanced by card and partitioned by label, overwritten once."""
    path, df = _shared(spark, "parquet"), valid(typed(dirty(spark, sf_dir))).select(*_CLEAN)
    write_parquet(df.limit(10), path)
    return write_parquet(df, path, "overwrite", rebalance=("card_id",), partition_by=("anomaly_type",)).select(*_CLEAN)


@query
def bronze_lineage(spark, sf_dir):
    df = with_lineage(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return df.select("event_id", F.element_at(F.split("source_path", "/"), -1).alias("source_file"), F.col("ingestion_timestamp").isNotNull().alias("stamped"))


@query
def calendar_flags(spark, sf_dir):
    return pick(spark, sf_dir, "hour_of_day", "day_of_week", "is_weekend", "is_night_transaction")


@query
def inter_tx_gap(spark, sf_dir):
    return pick(spark, sf_dir, "time_since_last_tx_minutes")


@query
def card_zscore(spark, sf_dir):
    return pick(spark, sf_dir, "amount_zscore", "is_amount_spike")


@query
def category_prior(spark, sf_dir):
    return pick(spark, sf_dir, "prior_tx_count_card_category", "prior_amount_mean_card_category", "prior_amount_std_card_category", "prior_category_zscore_eligible", "low_history_card_category", "prior_category_log_prior_n")


@query
def category_shrunk_z(spark, sf_dir):
    return pick(spark, sf_dir, "prior_amount_mean_card_category_shrunk", "prior_amount_zscore_card_category_shrunk")


@query
def category_damped_z(spark, sf_dir):
    return pick(spark, sf_dir, "prior_amount_zscore_card_category", "prior_amount_zscore_card_category_damped")


@query
def customer_distance(spark, sf_dir):
    return pick(spark, sf_dir, "customer_to_merchant_distance_km")


@query
def travel_speed(spark, sf_dir):
    return pick(spark, sf_dir, "distance_from_prev_km", "hours_since_prev", "speed_from_prev_kmh", references=False)


@query
def travel_speed_ref(spark, sf_dir):
    return pick(spark, sf_dir, "ref_transaction_id", "distance_from_prev_km", "hours_since_prev", "speed_from_prev_kmh")


@query
def merchant_velocity(spark, sf_dir):
    return pick(spark, sf_dir, "merchant_tx_count_last_24h", "merchant_prior_tx_count")


@query
def merchant_prior_fraud(spark, sf_dir):
    return pick(spark, sf_dir, "merchant_prior_fraud_rate")


@query
def card_merchant_repeat(spark, sf_dir):
    return pick(spark, sf_dir, "card_merchant_repeat_count_prior")


@query
def gold_features(spark, sf_dir):
    carried = ("card_id", "event_time", "event_time_unix", "amount", "merchant_category", "merchant", "latitude", "longitude", "customer_latitude", "customer_longitude", "anomaly_type", "is_fraud", "ref_transaction_id")
    return pick(spark, sf_dir, *carried, *GOLD_FEATURES)


@query
def order_velocity(spark, sf_dir):
    pin_utc(spark)
    df = feature_table(from_orders(spark.read.parquet(f"{sf_dir}/orders.parquet")), exact=2, references=False)
    return rounded(df.select("transaction_id", "tx_count_last_5m", "tx_count_last_24h", "amount_sum_last_24h", "prior_tx_count_card", "prior_amount_mean_card", "prior_amount_std_card"))


@query
def sliding_velocity(spark, sf_dir):
    df = velocity(transactions(spark, sf_dir))
    return df.select("card_id", F.unix_seconds("window_start").alias("window_start"), F.unix_seconds("window_end").alias("window_end"), "tx_count", F.round("amount_sum", 2).alias("amount_sum"))


# reports


@query
def layer_counts(spark, sf_dir):
    raw = dirty(spark, sf_dir)
    return reports.layer_counts({"bronze": raw, "silver": clean(raw), "gold": gold(spark, sf_dir)})


@query
def layer_coverage(spark, sf_dir):
    nullable = ("merchant", "ref_transaction_id", "time_since_last_tx_minutes", "prior_amount_zscore", "prior_amount_zscore_card_category", "speed_from_prev_kmh", "merchant_prior_fraud_rate")
    return reports.coverage(gold(spark, sf_dir), nullable, ("is_night_transaction", "prior_category_zscore_eligible"))


@query
def label_distribution(spark, sf_dir):
    return reports.distribution(transactions(spark, sf_dir), "anomaly_type")


@query
def feature_percentiles(spark, sf_dir):
    return reports.percentiles(pick(spark, sf_dir, "anomaly_type", "amount", "amount_zscore", "prior_amount_zscore", "speed_from_prev_kmh"), "anomaly_type", ("amount", "amount_zscore", "prior_amount_zscore", "speed_from_prev_kmh"), exact=True)


@query
def feature_percentiles_approx(spark, sf_dir):
    return reports.percentiles(gold(spark, sf_dir), "anomaly_type", ("amount", "amount_zscore", "tx_count_last_24h"))


@query
def prior_n_quantiles(spark, sf_dir):
    return reports.percentiles(gold(spark, sf_dir).withColumn("all", F.lit("all")), "all", ("prior_tx_count_card_category",), (0.1, 0.25, 0.5, 0.75, 0.9), exact=True)


@query
def velocity_extremes(spark, sf_dir):
    return reports.extremes(pick(spark, sf_dir, "anomaly_type", "tx_count_last_1h", "tx_count_last_24h", "speed_from_prev_kmh"), "anomaly_type", ("tx_count_last_1h", "tx_count_last_24h", "speed_from_prev_kmh"))


@query
def rule_alignment(spark, sf_dir):
    return reports.rule_alignment(pick(spark, sf_dir, "anomaly_type", "amount_zscore", "speed_from_prev_kmh"))


@query
def travel_summary(spark, sf_dir):
    return reports.travel_summary(pick(spark, sf_dir, "anomaly_type", "ref_transaction_id", "speed_from_prev_kmh"), "fraud")


@query
def speed_threshold_sweep(spark, sf_dir):
    return reports.threshold_sweep(pick(spark, sf_dir, "anomaly_type", "speed_from_prev_kmh"), "speed_from_prev_kmh", reports.SPEEDS)


@query
def category_volume(spark, sf_dir):
    return reports.category_volume(transactions(spark, sf_dir))


@query
def top_categories(spark, sf_dir):
    return reports.top_categories(transactions(spark, sf_dir), 3)


@query
def sparse_history(spark, sf_dir):
    return rounded(reports.sparse_history(gold(spark, sf_dir)))


@query
def sparse_history_by_label(spark, sf_dir):
    return rounded(reports.sparse_history(gold(spark, sf_dir), "is_fraud"))


@query
def sparse_history_by_category(spark, sf_dir):
    df = gold(spark, sf_dir)
    top = reports.top_categories(df, 15).select("merchant_category")
    return rounded(reports.sparse_history(df.join(F.broadcast(top), "merchant_category", "left_semi"), "merchant_category"))


@query
def history_buckets(spark, sf_dir):
    return reports.history_buckets(gold(spark, sf_dir))


_CORRELATED = ("amount", "amount_zscore", "prior_amount_zscore", "tx_count_last_24h", "amount_sum_last_24h", "prior_tx_count_card", "is_fraud")


@query
def feature_correlation(spark, sf_dir):
    return rounded(reports.correlation(pick(spark, sf_dir, *_CORRELATED), _CORRELATED))


@query
def fraud_rate_bins(spark, sf_dir):
    return rounded(reports.rate_bins(transactions(spark, sf_dir), "amount", 0.0, 200.0, 20))


@query
def quantile_clip(spark, sf_dir):
    return reports.quantile_clip(transactions(spark, sf_dir).select("transaction_id", "amount"), "amount")


@query
def outlier_list(spark, sf_dir):
    df = pick(spark, sf_dir, "is_fraud", "prior_amount_zscore")
    return reports.outliers(df, "prior_amount_zscore", 20, F.col("is_fraud") == 0)


@query
def speed_outlier_list(spark, sf_dir):
    return reports.outliers(pick(spark, sf_dir, "anomaly_type", "speed_from_prev_kmh"), "speed_from_prev_kmh")


# model frames and alert queues


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model frame with two scores that follow from features alone, so that every engine has the same."""
    df = modelling.model_frame(rounded(gold(spark, sf_dir)))
    return df.withColumns({"score": F.round((F.col("prior_amount_zscore_clipped") + 10) / 20.37, 6), "other_score": F.round(F.col("amount_sum_last_1h") / (F.col("amount_sum_last_1h") + 97.31), 6)})


@query
def model_frame(spark, sf_dir):
    return rounded(model(spark, sf_dir).drop("score", "other_score"))


@query
def time_split_summary(spark, sf_dir):
    return reports.split_summary(modelling.time_split(model(spark, sf_dir), exact=True))


@query
def split_sample(spark, sf_dir):
    return modelling.split_and_sample(model(spark, sf_dir), 0.5, 1.0, 0.25).groupBy("split").agg(F.count("*").alias("rows"))


@query
def sample_union(spark, sf_dir):
    """Whole splits by two ways: the union of a sample of each, and one filter; how many rows either has and both share."""
    df, whole = modelling.time_split(model(spark, sf_dir), exact=True), dict.fromkeys(modelling.SPLITS, 1.0)
    one, two = modelling.sampled_union(df, whole), modelling.hash_sample(df, whole).select(F.col("transaction_id").alias("id"))
    return one.join(two, F.col("transaction_id") == F.col("id"), "full").groupBy("split").agg(F.count("*").alias("rows"), F.count("transaction_id").alias("in_union"), F.count("id").alias("in_filter"))


@query
def score_join(spark, sf_dir):
    df = model(spark, sf_dir)
    joined = modelling.with_score(df.select("transaction_id", "event_time_unix", "label", "score"), df.select("transaction_id", F.col("other_score").alias("score")))
    return joined.select("transaction_id", "event_time_unix", "label", "lr_score", "gbt_score")


@query
def stratified_sample(spark, sf_dir):
    return model(spark, sf_dir).sampleBy("label", {1.0: 1.0, 0.0: 0.03}, 42).select("transaction_id", "label")


@query
def feature_sets(spark, sf_dir):
    rows = [{"name": n, "position": k, "feature": c} for n, s in modelling.FEATURE_SETS.items() for k, c in enumerate(s)]
    return rows_frame(spark, rows, "name string, position int, feature string")


@query
def threshold_metrics(spark, sf_dir):
    return rounded(ranking.threshold_table(model(spark, sf_dir)))


@query
def best_threshold(spark, sf_dir):
    return rounded(ranking.best_threshold(ranking.threshold_table(model(spark, sf_dir))))


@query
def topk_metrics(spark, sf_dir):
    return rounded(ranking.top_k_table(model(spark, sf_dir), KS))


@query
def topk_secondary(spark, sf_dir):
    return rounded(ranking.top_k_table(model(spark, sf_dir), KS, "neg_prior_category_log_prior_n"))


@query
def topk_blended(spark, sf_dir):
    return rounded(ranking.top_k_table(model(spark, sf_dir), KS, "prior_amount_zscore", 0.05))


@query
def alert_queue(spark, sf_dir):
    return ranking.queue_head(model(spark, sf_dir).select("transaction_id", "event_time_unix", "label", "score"), 100)


@query
def class_weights(spark, sf_dir):
    return rounded(ranking.class_weights(model(spark, sf_dir)))


@query
def ranking_areas(spark, sf_dir):
    return rounded(ranking.areas(model(spark, sf_dir)))


def reranked(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    df = model(spark, sf_dir).select("transaction_id", "event_time_unix", "label", F.col("score").alias("lr_score"), F.col("other_score").alias("gbt_score"))
    return ranking.rerank(df, max(KS), SHORTLIST, mode, 0.5)


@query
def rerank_pure(spark, sf_dir):
    return reranked(spark, sf_dir, "pure")


@query
def rerank_blended(spark, sf_dir):
    return reranked(spark, sf_dir, "blended")


@query
def rerank_invariance(spark, sf_dir):
    df = reranked(spark, sf_dir, "pure")
    counts = [F.count_if((F.col(p) <= k) & (F.col("label") == 1)).alias(f"{n}_tp_{k}") for k in (SHORTLIST, max(KS)) for p, n in (("baseline_position", "before"), ("position", "after"))]
    return df.agg(*counts)


@query
def final_score_metrics(spark, sf_dir):
    df = model(spark, sf_dir).select("transaction_id", "event_time_unix", "label", F.col("score").alias("lr_score"), F.col("other_score").alias("gbt_score"))
    return rounded(ranking.threshold_table(ranking.final_scores(df, max(KS), SHORTLIST).withColumn("score", F.col("final_score")), (0.3, 0.5, 0.7)))


#: The lengths of the queue's head that are looked into.
ALERTS = (100, 5000)


def alerts(spark: SparkSession, sf_dir: str, k: int = ALERTS[0]) -> DataFrame:
    extra = transactions(spark, sf_dir).select("transaction_id", "merchant_category", "merchant")
    head = ranking.queue_head(model(spark, sf_dir), k)
    return extra.join(F.broadcast(head), "transaction_id")


@query
def alert_label_summary(spark, sf_dir):
    return reports.alert_summary(alerts(spark, sf_dir))


@query
def alert_label_summary_5000(spark, sf_dir):
    return reports.alert_summary(alerts(spark, sf_dir, ALERTS[1]))


@query
def alert_fp_categories(spark, sf_dir):
    return reports.false_positive_categories(alerts(spark, sf_dir))


@query
def alert_fp_categories_5000(spark, sf_dir):
    return reports.false_positive_categories(alerts(spark, sf_dir, ALERTS[1]))


@query
def alert_fp_sample(spark, sf_dir):
    return rounded(reports.sample_false_positives(alerts(spark, sf_dir)).select("transaction_id", "merchant_category", "merchant", "score", "amount", "position"))


@query
def alert_fp_sample_5000(spark, sf_dir):
    return rounded(reports.sample_false_positives(alerts(spark, sf_dir, ALERTS[1])).select("transaction_id", "merchant_category", "merchant", "score", "amount", "position"))


@contextmanager
def _trained(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """The model frame with its splits, cached for as long as models are fitted and scored."""
    base = modelling.model_frame(gold(spark, sf_dir)).cache()
    try:
        yield modelling.time_split(base, exact=True)
    finally:
        base.unpersist()


def _report(spark: SparkSession, report: dict, ks: str) -> DataFrame:
    rows = [{"metric": k, "value": float(v)} for k, v in report.items() if isinstance(v, (int, float))] + [{"metric": f"{ks}precision_{r['k']}", "value": float(r["precision"])} for r in report["top_k_rows"]]
    return rows_frame(spark, rows, "metric string, value double")


@query
def lr_eval(spark, sf_dir):
    with _trained(spark, sf_dir) as df:
        report = modelling.evaluate(df, modelling.FEATURE_SETS["amount_plus_night"], ks=KS)
    return _report(spark, report, "")


@query
def gbt_eval(spark, sf_dir):
    with _trained(spark, sf_dir) as df:
        report = modelling.evaluate(df, modelling.FEATURE_SETS["amount_plus_night"], "gbt", ks=KS)
    return _report(spark, report, "")


@query
def gate_sweep(spark, sf_dir):
    with _trained(spark, sf_dir) as df:
        rows = modelling.gate_sweep(df, (3, 5))
    return rows_frame(spark, rows, "variant string, k int, p_primary double, p_tie double, p_sanity double")


@query
def two_stage_eval(spark, sf_dir):
    with _trained(spark, sf_dir) as df:
        report = modelling.two_stage(df, modelling.FEATURE_SETS["amount_plus_night"], modelling.FEATURE_SETS["amount_plus_night_catz_v3_shrunk"], SHORTLIST, ks=KS, full=True)
    rows = [{"queue": q, **{c: r[c] for c in ("k", "rows", "tp")}} for q in ("baseline", "reranked") for r in report[f"{q}_top_k_rows"]]
    return rows_frame(spark, rows, "queue string, k int, rows long, tp long")


# generator


@query
def min_gap_shift(spark, sf_dir):
    df = transactions(spark, sf_dir).select("transaction_id", "card_id", F.col("event_time_unix").alias("t"))
    return synth.minimum_gap(df, 6 * 3600, "card_id", "t", "transaction_id")


@query
def synthetic_rules(spark, sf_dir):
    pin_utc(spark)
    df = synth.generate(spark, synth.GeneratorConfig())
    return reports.rule_alignment(feature_table(typed(df)))
