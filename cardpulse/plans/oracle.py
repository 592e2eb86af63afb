"""DuckDB SQL for the registered queries: an independent statement of what each one returns."""

from __future__ import annotations

from ..operators.reports import SPARSE
from ..operators.modelling import FEATURE_SETS
from ..operators.ranking import THRESHOLDS, TOP_K
from ..schema import GOLD_FEATURES

_SHORTLIST = 5000
#: Columns in eighths of cents and the like, which six decimals would cut at a tie.
FINER = {"prior_amount_mean_card_category_shrunk": 9}


def _km(a: str, b: str, c: str, d: str) -> str:
    return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL AND {c} IS NOT NULL AND {d} IS NOT NULL THEN 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))) END)"


TX = """tx AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS transaction_id, CAST(user_id AS VARCHAR) AS card_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS event_time, value AS amount, event_type AS merchant_category,
    CAST(25 + k % 25 AS DOUBLE) AS latitude, CAST(-120 + k % 50 AS DOUBLE) AS longitude,
    CASE WHEN event_type = 'error' AND value >= 100 THEN 'fraud' ELSE 'none' END AS anomaly_type,
    CASE WHEN event_id % 101 = 0 THEN lpad(CAST(event_id - 1 AS VARCHAR), 12, '0') END AS ref_transaction_id,
    CASE WHEN k % 10 <> 0 THEN CAST(k AS VARCHAR) END AS merchant,
    CAST(event_type = 'error' AND value >= 100 AS INTEGER) AS is_fraud,
    CAST(25 + user_id % 25 AS DOUBLE) AS customer_latitude, CAST(-120 + user_id % 50 AS DOUBLE) AS customer_longitude,
    CAST(epoch_us(ts) // 1000000 AS BIGINT) AS event_time_unix
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""


def _moments(key: str, window: str) -> str:
    return f"count(amount) OVER {window} AS {key}_n, sum(ct) OVER {window} AS {key}_s, sum(ct * ct) OVER {window} AS {key}_q"


def _mean(key: str) -> str:
    return f"(CASE WHEN {key}_n <> 0 THEN CAST({key}_s AS DOUBLE) / {key}_n / 100.0::DOUBLE END)"


def _std(key: str) -> str:
    return f"sqrt(greatest(CASE WHEN {key}_n <> 0 THEN CAST({key}_n * {key}_q - {key}_s * {key}_s AS DOUBLE) / CAST({key}_n * {key}_n AS DOUBLE) / 10000.0::DOUBLE END, 0.0::DOUBLE))"


def _gold(source: str = "tx") -> str:
    """CTEs from ``source`` (transactions) to ``gold``."""
    prior = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    ranges = {"5m": 300, "15m": 900, "1h": 3600, "24h": 86400}
    windows = {
        "co": "(PARTITION BY card_id ORDER BY event_time_unix NULLS FIRST, transaction_id)",
        "cp": f"(PARTITION BY card_id ORDER BY event_time_unix NULLS FIRST, transaction_id {prior})",
        "kp": f"(PARTITION BY card_id, merchant_category ORDER BY event_time_unix NULLS FIRST, transaction_id {prior})",
        "ca": "(PARTITION BY card_id)",
        "mr": "(PARTITION BY mk ORDER BY event_time_unix NULLS FIRST RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)",
        "mp": f"(PARTITION BY mk ORDER BY event_time_unix NULLS FIRST, transaction_id {prior})",
        "pp": f"(PARTITION BY mk, card_id ORDER BY event_time_unix NULLS FIRST, transaction_id {prior})",
        **{f"r{n}": f"(PARTITION BY card_id ORDER BY event_time_unix NULLS FIRST RANGE BETWEEN {s} PRECEDING AND CURRENT ROW)" for n, s in ranges.items()},
    }
    here = ("latitude", "longitude")
    return f"""
base AS (SELECT *, CAST(event_time AS TIMESTAMP) AS ts, CAST(round(amount * 100) AS BIGINT) AS ct, coalesce(merchant, '~' || transaction_id) AS mk FROM {source}),
refs AS (SELECT transaction_id AS ref_id, min(event_time_unix) AS ref_t, min(latitude) AS ref_lat, min(longitude) AS ref_lon FROM base GROUP BY 1),
framed AS (
  SELECT b.*, r.*, lag(event_time_unix) OVER co AS bt, lag(latitude) OVER co AS blat, lag(longitude) OVER co AS blon,
    {_moments("c", "cp")}, {_moments("k", "kp")}, {_moments("a", "ca")},
    {", ".join(f"count(*) OVER r{n} AS tx_count_last_{n}, sum(ct) OVER r{n} AS sum_{n}" for n in ranges)},
    count(*) OVER mr AS m24, count(transaction_id) OVER mp AS mn, sum(coalesce(is_fraud, 0)) OVER mp AS mf, count(transaction_id) OVER pp AS pn
  FROM base b LEFT JOIN refs r ON b.ref_transaction_id = r.ref_id
  WINDOW {", ".join(f"{n} AS {w}" for n, w in windows.items())}
),
one AS (
  SELECT *, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(dayofweek(ts) + 1 AS INTEGER) AS day_of_week,
    (event_time_unix - bt) / 60.0::DOUBLE AS time_since_last_tx_minutes,
    CAST(sum_1h AS DOUBLE) / 100.0::DOUBLE AS amount_sum_last_1h, CAST(sum_24h AS DOUBLE) / 100.0::DOUBLE AS amount_sum_last_24h,
    {_mean("a")} AS am, {_std("a")} AS sd,
    c_n AS prior_tx_count_card, {_mean("c")} AS prior_amount_mean_card, {_std("c")} AS prior_amount_std_card,
    k_n AS prior_tx_count_card_category, {_mean("k")} AS prior_amount_mean_card_category, {_std("k")} AS prior_amount_std_card_category,
    k_n < 5 AS low_history_card_category, ln(1 + CAST(k_n AS DOUBLE)) AS prior_category_log_prior_n,
    {_km("customer_latitude", "customer_longitude", *here)} AS customer_to_merchant_distance_km,
    CASE WHEN merchant IS NOT NULL THEN m24 END AS merchant_tx_count_last_24h, CASE WHEN merchant IS NOT NULL THEN mn END AS merchant_prior_tx_count,
    CASE WHEN merchant IS NOT NULL AND mn > 0 THEN CAST(mf AS DOUBLE) / mn END AS merchant_prior_fraud_rate,
    CASE WHEN merchant IS NOT NULL THEN pn END AS card_merchant_repeat_count_prior,
    CASE WHEN ref_id IS NOT NULL THEN {_km("ref_lat", "ref_lon", *here)} ELSE {_km("blat", "blon", *here)} END AS distance_from_prev_km,
    CASE WHEN ref_id IS NOT NULL THEN (event_time_unix - ref_t) / 3600.0::DOUBLE ELSE (event_time_unix - bt) / 3600.0::DOUBLE END AS hours_since_prev
  FROM framed
),
two AS (
  SELECT *, day_of_week IN (1, 7) AS is_weekend, hour_of_day < 6 OR hour_of_day >= 22 AS is_night_transaction,
    CASE WHEN sd > 0 THEN (amount - am) / sd ELSE 0.0::DOUBLE END AS amount_zscore,
    CASE WHEN prior_tx_count_card > 1 AND prior_amount_std_card > 0 THEN (amount - prior_amount_mean_card) / prior_amount_std_card END AS prior_amount_zscore,
    CASE WHEN k_n > 0 THEN (k_n * prior_amount_mean_card_category + 5.0::DOUBLE * prior_amount_mean_card) / (k_n + 5.0::DOUBLE) ELSE prior_amount_mean_card END AS prior_amount_mean_card_category_shrunk,
    k_n >= 5 AND prior_amount_std_card_category > 0 AS prior_category_zscore_eligible,
    CASE WHEN hours_since_prev > 0 THEN distance_from_prev_km / hours_since_prev END AS speed_from_prev_kmh
  FROM one
),
gold AS (
  SELECT *, amount_zscore >= 3.0 AS is_amount_spike, coalesce(prior_amount_zscore >= 3.0, false) AS is_amount_spike_prior,
    CASE WHEN prior_category_zscore_eligible THEN (amount - prior_amount_mean_card_category) / prior_amount_std_card_category END AS prior_amount_zscore_card_category,
    CASE WHEN prior_category_zscore_eligible THEN (amount - prior_amount_mean_card_category) / prior_amount_std_card_category * sqrt(k_n / (k_n + 5.0::DOUBLE)) END AS prior_amount_zscore_card_category_damped,
    CASE WHEN prior_category_zscore_eligible THEN (amount - prior_amount_mean_card_category_shrunk) / prior_amount_std_card_category END AS prior_amount_zscore_card_category_shrunk
  FROM two
)"""


_WHOLE = {"hour_of_day", "day_of_week", "is_weekend", "is_night_transaction", "is_amount_spike", "is_amount_spike_prior", "prior_category_zscore_eligible", "low_history_card_category", "transaction_id", "card_id", "event_time", "event_time_unix", "merchant_category", "merchant", "anomaly_type", "is_fraud", "ref_transaction_id"}


def _col(c: str) -> str:
    return c if c in _WHOLE or "count" in c else f"round({c}, {FINER.get(c, 6)}) AS {c}"


WITH_TX = f"WITH {TX}"
WITH_GOLD = f"WITH {TX},{_gold()}"
# the features as the reports see them: rounded
WITH_ROUNDED = WITH_GOLD + f",\nr AS (SELECT {', '.join(map(_col, ('transaction_id', 'card_id', 'event_time_unix', 'amount', 'merchant_category', 'merchant', 'anomaly_type', 'is_fraud', 'ref_transaction_id', *GOLD_FEATURES)))} FROM gold)"


def _pick(*columns: str) -> str:
    return f"{WITH_GOLD} SELECT {', '.join(map(_col, ('transaction_id', *columns)))} FROM gold"


_N = "CAST(transaction_id AS BIGINT)"
DIRTY = f"""dirty AS (
  SELECT * REPLACE (
    CASE WHEN {_N} % 7 = 0 THEN NULL WHEN {_N} % 11 = 0 THEN 'abc' WHEN {_N} % 13 = 0 THEN '-0.01' WHEN {_N} % 29 = 0 THEN 'NaN' ELSE CAST(amount AS VARCHAR) END AS amount,
    CASE WHEN {_N} % 17 = 0 THEN '90.1' WHEN {_N} % 19 = 0 THEN '90' ELSE CAST(latitude AS VARCHAR) END AS latitude,
    CASE WHEN {_N} % 23 = 0 THEN '-180.5' WHEN {_N} % 31 = 0 THEN '180' ELSE CAST(longitude AS VARCHAR) END AS longitude,
    CASE WHEN {_N} % 37 = 0 THEN NULL ELSE card_id END AS card_id)
  FROM tx
)"""
_TYPED = "SELECT * REPLACE (TRY_CAST(amount AS DOUBLE) AS amount, TRY_CAST(latitude AS DOUBLE) AS latitude, TRY_CAST(longitude AS DOUBLE) AS longitude) FROM"
_VALID = "card_id IS NOT NULL AND amount IS NOT NULL AND NOT isnan(amount) AND amount >= 0 AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180"
_CLEAN = "transaction_id, card_id, event_time, amount, merchant_category, latitude, longitude, anomaly_type, merchant, is_fraud, event_time_unix"
_CONTENT = "card_id, event_time, amount, merchant_category, latitude, longitude, anomaly_type"

_MODEL_FLAGS = ("is_night_transaction", "prior_category_zscore_eligible", "low_history_card_category")
_MODEL_COUNTS = ("hour_of_day", "tx_count_last_15m", "tx_count_last_1h", "prior_tx_count_card_category")
_MODEL_DOUBLES = ("prior_amount_zscore", "amount_sum_last_1h", "merchant_prior_fraud_rate", "prior_amount_mean_card_category", "prior_amount_std_card_category", "prior_amount_zscore_card_category", "prior_amount_zscore_card_category_damped", "prior_amount_zscore_card_category_shrunk", "prior_category_log_prior_n")
MODEL = f"""filled AS (
  SELECT transaction_id, event_time_unix, is_fraud, amount, {", ".join(f"coalesce({c}, false) AS {c}" for c in _MODEL_FLAGS)}, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _MODEL_COUNTS)},
    {", ".join(f"coalesce({c}, 0.0::DOUBLE) AS {c}" for c in _MODEL_DOUBLES)}, CAST(is_fraud AS DOUBLE) AS label
  FROM r WHERE is_fraud IS NOT NULL
),
derived AS (SELECT *, greatest(-10.0::DOUBLE, least(10.0::DOUBLE, prior_amount_zscore)) AS prior_amount_zscore_clipped, ln(1 + amount_sum_last_1h) AS amount_sum_last_1h_log1p FROM filled),
model AS (
  SELECT *, prior_amount_zscore_clipped * CAST(low_history_card_category AS DOUBLE) AS amount_zscore_x_lowcat,
    round((prior_amount_zscore_clipped + 10) / 20.37::DOUBLE, 6) AS score, round(amount_sum_last_1h / (amount_sum_last_1h + 97.31::DOUBLE), 6) AS other_score
  FROM derived
)"""
WITH_MODEL = f"{WITH_ROUNDED},\n{MODEL}"


def _thresholds(source: str, score: str, at: tuple[float, ...]) -> str:
    return f"""c AS (
  SELECT t.threshold, count(*) FILTER ({score} >= threshold AND label = 1) AS tp, count(*) FILTER ({score} >= threshold AND label <> 1) AS fp,
    count(*) FILTER ({score} < threshold AND label <> 1) AS tn, count(*) FILTER ({score} < threshold AND label = 1) AS fn
  FROM {source}, (VALUES {", ".join(f"({t}::DOUBLE)" for t in at)}) t(threshold) GROUP BY 1
),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS recall FROM c),
m AS (SELECT threshold, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy,
  round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END, 6) AS f1 FROM p)"""


_TIES = "event_time_unix DESC NULLS LAST, transaction_id"


def _top_k(order: str) -> str:
    return f"""{WITH_MODEL},
q AS (SELECT *, row_number() OVER (ORDER BY {order}, {_TIES}) AS position FROM model),
n AS (SELECT sum(CAST(label = 1 AS INTEGER)) AS positives FROM model),
c AS (SELECT k, count(*) FILTER (position <= k) AS rows, count(*) FILTER (position <= k AND label = 1) AS tp, any_value(positives) AS positives FROM q, n, (VALUES {", ".join(f"({k})" for k in TOP_K)}) v(k) GROUP BY 1)
SELECT CAST(k AS INTEGER) AS k, rows, tp, round(CASE WHEN rows > 0 THEN tp::DOUBLE / rows ELSE 0.0::DOUBLE END, 6) AS precision,
  round(CASE WHEN positives > 0 THEN tp::DOUBLE / positives ELSE 0.0::DOUBLE END, 6) AS recall FROM c"""


def _reranked(key: str) -> str:
    return f"""{WITH_MODEL},
b AS (SELECT transaction_id, event_time_unix, label, score AS lr_score, other_score AS gbt_score, CAST(row_number() OVER (ORDER BY score DESC, {_TIES}) AS INTEGER) AS baseline_position FROM model),
h AS (SELECT * FROM b WHERE baseline_position <= {max(TOP_K)}),
z AS (SELECT *, CAST(row_number() OVER (ORDER BY CASE WHEN baseline_position <= {_SHORTLIST} THEN 0 ELSE 1 END, CASE WHEN baseline_position <= {_SHORTLIST} THEN {key} END DESC NULLS LAST,
  CASE WHEN baseline_position > {_SHORTLIST} THEN baseline_position END NULLS FIRST, lr_score DESC, {_TIES}) AS INTEGER) AS position FROM h)"""


def _sparse(by: str, source: str = "gold") -> str:
    head = f"{by}, " if by else ""
    shares = ", ".join(f"round(avg(CAST(prior_tx_count_card_category {'= 0' if k == 0 else f'< {k}'} AS DOUBLE)), 6) AS below_{k}" for k in SPARSE)
    return f"SELECT {head}count(*) AS rows, {shares} FROM {source}" + (f" GROUP BY {by}" if by else "")


def _discrete(columns: tuple[str, ...], at: tuple[float, ...]) -> str:
    return ", ".join(f"quantile_disc({c}, {p}) AS {c}_p{round(100 * p)}" for c in columns for p in at)


_CORRELATED = ("amount", "amount_zscore", "prior_amount_zscore", "tx_count_last_24h", "amount_sum_last_24h", "prior_tx_count_card", "is_fraud")
_PAIRS = [(a, b) for i, a in enumerate(_CORRELATED) for b in _CORRELATED[i + 1 :]]
def _alerts(k: int) -> str:
    return f"{WITH_MODEL},\na AS (SELECT m.*, tx.merchant_category, tx.merchant, CAST(row_number() OVER (ORDER BY score DESC, m.event_time_unix DESC NULLS LAST, m.transaction_id) AS INTEGER) AS position FROM model m JOIN tx USING (transaction_id)), h AS (SELECT * FROM a WHERE position <= {k})"
_NULLABLE = ("merchant", "ref_transaction_id", "time_since_last_tx_minutes", "prior_amount_zscore", "prior_amount_zscore_card_category", "speed_from_prev_kmh", "merchant_prior_fraud_rate")
_ORDERS = f"""WITH tx AS (
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS transaction_id, CAST(o_custkey AS VARCHAR) AS card_id, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS event_time_unix, o_totalprice AS amount,
    CAST(round(o_totalprice * 100) AS BIGINT) AS ct FROM orders
), w AS (
  SELECT transaction_id, count(*) OVER r5 AS tx_count_last_5m, count(*) OVER r24 AS tx_count_last_24h, CAST(sum(ct) OVER r24 AS DOUBLE) / 100.0::DOUBLE AS s24,
    count(amount) OVER cp AS c_n, sum(CAST(ct AS HUGEINT)) OVER cp AS c_s, sum(CAST(ct AS HUGEINT) * ct) OVER cp AS c_q
  FROM tx WINDOW r5 AS (PARTITION BY card_id ORDER BY event_time_unix RANGE BETWEEN 300 PRECEDING AND CURRENT ROW), r24 AS (PARTITION BY card_id ORDER BY event_time_unix RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW),
    cp AS (PARTITION BY card_id ORDER BY event_time_unix, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""
_CARRIED = ("card_id", "event_time", "event_time_unix", "amount", "merchant_category", "merchant", "latitude", "longitude", "customer_latitude", "customer_longitude", "anomaly_type", "is_fraud", "ref_transaction_id")

ORACLE_SQL: dict[str, str] = {
    "canonical_tx": f"{WITH_TX} SELECT * FROM tx",
    "velocity_counts": _pick("tx_count_last_5m", "tx_count_last_15m", "tx_count_last_1h", "tx_count_last_24h"),
    "velocity_sums": _pick("amount_sum_last_1h", "amount_sum_last_24h"),
    "prior_amount_stats": _pick("prior_tx_count_card", "prior_amount_mean_card", "prior_amount_std_card", "prior_amount_zscore", "is_amount_spike_prior"),
    "prior_spike_topk": f"{WITH_ROUNDED} SELECT transaction_id, card_id, amount, prior_amount_zscore, tx_count_last_1h FROM r ORDER BY prior_amount_zscore DESC NULLS LAST, transaction_id LIMIT 100",
    "silver_clean": f"{WITH_TX}, {DIRTY}, t AS ({_TYPED} dirty) SELECT {_CLEAN} FROM t WHERE {_VALID}",
    "silver_dedup": f"""{WITH_TX}, {DIRTY}, every AS (SELECT * FROM dirty UNION ALL SELECT * REPLACE ('z' || transaction_id AS transaction_id) FROM dirty WHERE {_N} % 5 = 0 UNION ALL SELECT * FROM dirty WHERE {_N} % 5 = 0),
        t AS ({_TYPED} every), v AS (SELECT *, row_number() OVER (PARTITION BY {_CONTENT} ORDER BY transaction_id) AS k FROM t WHERE {_VALID}) SELECT {_CLEAN} FROM v WHERE k = 1""",
    "silver_reject_counts": f"""{WITH_TX}, {DIRTY}, t AS ({_TYPED} dirty) SELECT CASE WHEN card_id IS NULL THEN 'missing_card_id' WHEN amount IS NULL OR isnan(amount) THEN 'missing_amount'
        WHEN amount < 0 THEN 'negative_amount' WHEN NOT latitude BETWEEN -90 AND 90 THEN 'latitude_out_of_range' WHEN NOT longitude BETWEEN -180 AND 180 THEN 'longitude_out_of_range' ELSE 'valid' END AS reason, count(*) AS rows FROM t GROUP BY 1""",
    "missing_columns": f"{WITH_TX} SELECT transaction_id, amount, is_fraud, false AS is_night_transaction, 0.0::DOUBLE AS prior_amount_zscore, 0::BIGINT AS prior_tx_count_card_category, NULL::INTEGER AS hour_of_day, NULL::VARCHAR AS merchant FROM tx",
    "parquet_round_trip": f"{WITH_TX}, {DIRTY}, t AS ({_TYPED} dirty) SELECT {_CLEAN} FROM t WHERE {_VALID}",
    "json_round_trip": f"{WITH_TX}, {DIRTY}, t AS ({_TYPED} dirty) SELECT transaction_id, card_id, event_time, amount, merchant_category, latitude, longitude, anomaly_type, ref_transaction_id, merchant, is_fraud FROM t",
    "bronze_lineage": "SELECT event_id, 'events.parquet' AS source_file, true AS stamped FROM events",
    "feature_sets": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {k}, '{c}')" for n, s in FEATURE_SETS.items() for k, c in enumerate(s)) + ") v(name, position, feature)",
    "speed_outlier_list": f"{WITH_ROUNDED} SELECT transaction_id, anomaly_type, speed_from_prev_kmh FROM r ORDER BY speed_from_prev_kmh DESC NULLS LAST, transaction_id LIMIT 20",
    "score_join": f"{WITH_MODEL} SELECT transaction_id, event_time_unix, label, score AS lr_score, other_score AS gbt_score FROM model",
    "sample_union": f"""{WITH_MODEL}, q AS (SELECT quantile_disc(event_time_unix, 0.70) AS lo, quantile_disc(event_time_unix, 0.85) AS hi FROM model),
        s AS (SELECT CASE WHEN event_time_unix <= lo THEN 'train' WHEN event_time_unix <= hi THEN 'validation' ELSE 'test' END AS split FROM model, q)
        SELECT split, count(*) AS rows, count(*) AS in_union, count(*) AS in_filter FROM s GROUP BY 1""",
    "csv_round_trip": f"""{WITH_TX} SELECT transaction_id, card_id, event_time, amount, merchant_category, latitude, longitude,
        CASE WHEN {_N} % 10 <> 0 AND is_fraud = 1 THEN 'fraud' ELSE 'none' END AS anomaly_type, merchant, CASE WHEN {_N} % 10 <> 0 THEN is_fraud END AS is_fraud, customer_latitude, customer_longitude, event_time_unix FROM tx""",
    "benchmark_normalize": f"""{WITH_TX} SELECT transaction_id, card_id, event_time, amount, merchant_category, latitude, longitude,
        CASE WHEN {_N} % 10 <> 0 AND is_fraud = 1 THEN 'fraud' ELSE 'none' END AS anomaly_type, merchant, CASE WHEN {_N} % 10 <> 0 THEN is_fraud END AS is_fraud, customer_latitude, customer_longitude, event_time_unix FROM tx""",
    "calendar_flags": _pick("hour_of_day", "day_of_week", "is_weekend", "is_night_transaction"),
    "inter_tx_gap": _pick("time_since_last_tx_minutes"),
    "card_zscore": _pick("amount_zscore", "is_amount_spike"),
    "category_prior": _pick("prior_tx_count_card_category", "prior_amount_mean_card_category", "prior_amount_std_card_category", "prior_category_zscore_eligible", "low_history_card_category", "prior_category_log_prior_n"),
    "category_shrunk_z": _pick("prior_amount_mean_card_category_shrunk", "prior_amount_zscore_card_category_shrunk"),
    "category_damped_z": _pick("prior_amount_zscore_card_category", "prior_amount_zscore_card_category_damped"),
    "customer_distance": _pick("customer_to_merchant_distance_km"),
    "travel_speed": f"WITH {TX}, own AS (SELECT * REPLACE (NULL::VARCHAR AS ref_transaction_id) FROM tx),{_gold('own')} SELECT {', '.join(map(_col, ('transaction_id', 'distance_from_prev_km', 'hours_since_prev', 'speed_from_prev_kmh')))} FROM gold",
    "travel_speed_ref": _pick("ref_transaction_id", "distance_from_prev_km", "hours_since_prev", "speed_from_prev_kmh"),
    "merchant_velocity": _pick("merchant_tx_count_last_24h", "merchant_prior_tx_count"),
    "merchant_prior_fraud": _pick("merchant_prior_fraud_rate"),
    "card_merchant_repeat": _pick("card_merchant_repeat_count_prior"),
    "gold_features": _pick(*_CARRIED, *GOLD_FEATURES),
    "order_velocity": f"{_ORDERS} SELECT transaction_id, tx_count_last_5m, tx_count_last_24h, round(s24, 6) AS amount_sum_last_24h, c_n AS prior_tx_count_card, round({_mean('c')}, 6) AS prior_amount_mean_card, round({_std('c')}, 6) AS prior_amount_std_card FROM w",
    "sliding_velocity": f"""{WITH_TX}, e AS (SELECT card_id, amount, (event_time_unix // 300) * 300 - 300 * k AS window_start FROM tx, range(12) g(k))
        SELECT card_id, CAST(window_start AS BIGINT) AS window_start, CAST(window_start + 3600 AS BIGINT) AS window_end, count(*) AS tx_count, round(sum(amount), 2) AS amount_sum FROM e GROUP BY 1, 2, 3""",
    "layer_counts": f"""{WITH_TX}, {DIRTY}, t AS ({_TYPED} dirty), v AS (SELECT DISTINCT {_CONTENT} FROM t WHERE {_VALID})
        SELECT 'bronze' AS layer, count(*) AS rows FROM dirty UNION ALL SELECT 'silver', count(*) FROM v UNION ALL SELECT 'gold', count(*) FROM tx""",
    "layer_coverage": f"{WITH_GOLD} SELECT count(*) AS rows, {', '.join(f'count(*) FILTER ({c} IS NULL) AS null_{c}' for c in _NULLABLE)}, count(*) FILTER (is_night_transaction) AS true_is_night_transaction, count(*) FILTER (prior_category_zscore_eligible) AS true_prior_category_zscore_eligible FROM gold",
    "label_distribution": f"{WITH_TX} SELECT anomaly_type, count(*) AS rows FROM tx GROUP BY 1",
    "feature_percentiles": f"{WITH_ROUNDED} SELECT anomaly_type, count(*) AS rows, {_discrete(('amount', 'amount_zscore', 'prior_amount_zscore', 'speed_from_prev_kmh'), (0.5, 0.9))} FROM r GROUP BY 1",
    "prior_n_quantiles": f"{WITH_GOLD} SELECT 'all' AS \"all\", count(*) AS rows, {', '.join(f'CAST(quantile_disc(prior_tx_count_card_category, {p}) AS DOUBLE) AS prior_tx_count_card_category_p{round(100 * p)}' for p in (0.1, 0.25, 0.5, 0.75, 0.9))} FROM gold",
    "velocity_extremes": f"""{WITH_ROUNDED} SELECT anomaly_type, count(*) AS rows, max(tx_count_last_1h) AS tx_count_last_1h_max, max(tx_count_last_24h) AS tx_count_last_24h_max, max(speed_from_prev_kmh) AS speed_from_prev_kmh_max,
        count(*) FILTER (tx_count_last_1h IS NULL) AS tx_count_last_1h_nulls, count(*) FILTER (tx_count_last_24h IS NULL) AS tx_count_last_24h_nulls, count(*) FILTER (speed_from_prev_kmh IS NULL) AS speed_from_prev_kmh_nulls FROM r GROUP BY 1""",
    "rule_alignment": f"""{WITH_ROUNDED}, c AS (SELECT anomaly_type, count(*) AS rows, count(*) FILTER (amount_zscore >= 3.0) AS spike_by_rule, count(*) FILTER (speed_from_prev_kmh > 1000.0) AS impossible_by_rule FROM r GROUP BY 1)
        SELECT *, round(spike_by_rule::DOUBLE / rows, 4) AS spike_by_rule_frac, round(impossible_by_rule::DOUBLE / rows, 4) AS impossible_by_rule_frac FROM c""",
    "travel_summary": f"""{WITH_ROUNDED} SELECT count(*) AS rows, count(ref_transaction_id) AS with_ref, count(*) FILTER (speed_from_prev_kmh IS NULL) AS null_speed, min(speed_from_prev_kmh) AS min_speed,
        quantile_disc(speed_from_prev_kmh, 0.5) AS median_speed, max(speed_from_prev_kmh) AS max_speed FROM r WHERE anomaly_type = 'fraud'""",
    "speed_threshold_sweep": f"""{WITH_ROUNDED}, c AS (SELECT anomaly_type, bound, count(*) AS n, count(*) FILTER (speed_from_prev_kmh > bound) AS above FROM r, (VALUES (250.0::DOUBLE), (500.0::DOUBLE), (1000.0::DOUBLE)) v(bound) GROUP BY 1, 2)
        SELECT anomaly_type, bound, above, round(above::DOUBLE / n, 4) AS above_frac FROM c""",
    "category_volume": f"""{WITH_TX}, c AS (SELECT merchant_category, count(*) AS rows, CAST(sum(is_fraud) AS BIGINT) AS fraud_rows FROM tx GROUP BY 1)
        SELECT merchant_category, rows, fraud_rows, round(fraud_rows::DOUBLE / rows, 5) AS fraud_rate, round(100.0::DOUBLE * rows / (SELECT count(*) FROM tx), 3) AS row_pct FROM c""",
    "top_categories": f"{WITH_TX} SELECT merchant_category, count(*) AS rows FROM tx GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "sparse_history": f"{WITH_GOLD} {_sparse('')}",
    "sparse_history_by_label": f"{WITH_GOLD} {_sparse('is_fraud')}",
    "sparse_history_by_category": f"{WITH_GOLD} {_sparse('merchant_category')}",
    "history_buckets": f"""{WITH_GOLD}, c AS (SELECT CASE WHEN k_n < 3 THEN CAST(k_n AS VARCHAR) WHEN k_n < 5 THEN '3-4' WHEN k_n < 10 THEN '5-9' WHEN k_n < 20 THEN '10-19' ELSE '20+' END AS bucket, count(*) AS rows FROM gold GROUP BY 1)
        SELECT bucket, rows, round(100.0::DOUBLE * rows / (SELECT count(*) FROM gold), 3) AS pct FROM c""",
    "feature_correlation": f"{WITH_ROUNDED}, z AS (SELECT {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0.0::DOUBLE) AS {c}' for c in _CORRELATED)} FROM r) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM z" for a, b in _PAIRS),
    "fraud_rate_bins": f"""{WITH_TX}, c AS (SELECT CAST(least(floor((amount - 0.0) / 10.0::DOUBLE), 19) AS INTEGER) AS bin, is_fraud FROM tx WHERE amount BETWEEN 0 AND 200)
        SELECT bin, round(bin * 10.0::DOUBLE, 6) AS low, round((bin + 1) * 10.0::DOUBLE, 6) AS high, count(*) AS rows, round(avg(is_fraud), 6) AS rate FROM c GROUP BY 1""",
    "quantile_clip": f"{WITH_TX}, q AS (SELECT quantile_disc(amount, 0.01) AS lo, quantile_disc(amount, 0.99) AS hi FROM tx) SELECT transaction_id, greatest(lo, least(hi, amount)) AS amount FROM tx, q",
    "outlier_list": f"{WITH_ROUNDED} SELECT transaction_id, is_fraud, prior_amount_zscore FROM r WHERE is_fraud = 0 ORDER BY prior_amount_zscore DESC NULLS LAST, transaction_id LIMIT 20",
    "model_frame": f"{WITH_MODEL} SELECT transaction_id, event_time_unix, is_fraud, {', '.join((*_MODEL_FLAGS, *_MODEL_COUNTS))}, {', '.join(f'round({c}, 6) AS {c}' for c in ('amount', *_MODEL_DOUBLES, 'label', 'prior_amount_zscore_clipped', 'amount_sum_last_1h_log1p', 'amount_zscore_x_lowcat'))} FROM model",
    "time_split_summary": f"""{WITH_MODEL}, q AS (SELECT quantile_disc(event_time_unix, 0.70) AS lo, quantile_disc(event_time_unix, 0.85) AS hi FROM model),
        s AS (SELECT CASE WHEN event_time_unix <= lo THEN 'train' WHEN event_time_unix <= hi THEN 'validation' ELSE 'test' END AS split, label FROM model, q)
        SELECT split, count(*) AS rows, CAST(sum(label) AS BIGINT) AS fraud_rows, round(avg(label), 6) AS fraud_rate FROM s GROUP BY 1""",
    "threshold_metrics": f"{WITH_MODEL}, {_thresholds('model', 'score', THRESHOLDS)} SELECT * FROM m",
    "best_threshold": f"{WITH_MODEL}, {_thresholds('model', 'score', THRESHOLDS)} SELECT * FROM m ORDER BY f1 DESC, threshold LIMIT 1",
    "topk_metrics": _top_k("score DESC"),
    "topk_secondary": _top_k("score DESC, -prior_category_log_prior_n DESC"),
    "topk_blended": _top_k("score + 0.05::DOUBLE * prior_amount_zscore DESC"),
    "alert_queue": f"{WITH_MODEL} SELECT transaction_id, event_time_unix, label, score, CAST(row_number() OVER (ORDER BY score DESC, {_TIES}) AS INTEGER) AS position FROM model ORDER BY position LIMIT 100",
    "class_weights": f"{WITH_MODEL}, c AS (SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM model) SELECT positives, negatives, round(CASE WHEN positives > 0 AND negatives > 0 THEN negatives::DOUBLE / positives ELSE 1.0::DOUBLE END, 6) AS positive_weight FROM c",
    "ranking_areas": f"""{WITH_MODEL}, s AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM model GROUP BY 1),
        x AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM s), y AS (SELECT *, tp::DOUBLE / (tp + fp) AS pr FROM x),
        z AS (SELECT *, coalesce(lag(pr) OVER (ORDER BY score DESC), pr) AS before FROM y)
        SELECT round(sum(n * (tp - p / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)::DOUBLE), 6) AS roc_auc, round(sum(p * (pr + before) / 2.0::DOUBLE) / sum(p)::DOUBLE, 6) AS pr_auc FROM z""",
    "rerank_pure": f"{_reranked('gbt_score')} SELECT * FROM z",
    "rerank_blended": f"{_reranked('gbt_score + 0.5::DOUBLE * lr_score')} SELECT * FROM z",
    "rerank_invariance": f"{_reranked('gbt_score')} SELECT {', '.join(f'count(*) FILTER ({p} <= {k} AND label = 1) AS {n}_tp_{k}' for k in (_SHORTLIST, max(TOP_K)) for p, n in (('baseline_position', 'before'), ('position', 'after')))} FROM z",
    "final_score_metrics": f"{WITH_MODEL}, b AS (SELECT *, row_number() OVER (ORDER BY score DESC, {_TIES}) AS position FROM model), fs AS (SELECT label, CASE WHEN position <= {_SHORTLIST} THEN other_score ELSE score END AS final_score FROM b), {_thresholds('fs', 'final_score', (0.3, 0.5, 0.7))} SELECT * FROM m",
    "min_gap_shift": f"""{WITH_TX}, o AS (SELECT transaction_id, card_id, event_time_unix AS t, row_number() OVER (PARTITION BY card_id ORDER BY event_time_unix, transaction_id) - 1 AS i FROM tx)
        SELECT transaction_id, card_id, CAST(max(t - i * 21600) OVER (PARTITION BY card_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + i * 21600 AS BIGINT) AS t FROM o""",
}

for k, suffix in ((100, ""), (5000, "_5000")):
    ORACLE_SQL |= {
        "alert_label_summary" + suffix: f"""{_alerts(k)} SELECT label, count(*) AS rows, round(avg(score), 4) AS avg_score, round(avg(amount), 2) AS avg_amount, round(avg(prior_amount_zscore), 2) AS avg_prior_amount_zscore, round(avg(amount_sum_last_1h), 2) AS avg_amount_sum_last_1h,
            round(avg(CAST(is_night_transaction AS DOUBLE)), 4) AS avg_is_night_transaction, round(avg(hour_of_day), 2) AS avg_hour_of_day, round(avg(merchant_prior_fraud_rate), 4) AS avg_merchant_prior_fraud_rate, round(avg(tx_count_last_1h), 2) AS avg_tx_count_last_1h FROM h GROUP BY 1""",
        "alert_fp_categories" + suffix: f"{_alerts(k)}, c AS (SELECT merchant_category, count(*) AS rows, round(avg(score), 4) AS avg_score, round(avg(amount), 2) AS avg_amount FROM h WHERE label = 0 GROUP BY 1) SELECT * FROM c ORDER BY rows DESC, avg_score DESC, merchant_category LIMIT 10",
        "alert_fp_sample" + suffix: f"{_alerts(k)} SELECT transaction_id, merchant_category, merchant, score, amount, position FROM h WHERE label = 0 ORDER BY position LIMIT 10",
    }
