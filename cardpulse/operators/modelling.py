"""Model frames, time splits, sampling, MLlib training and evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..plans.features import DAMP
from ..schema import gold_type
from . import ranking
from .clean import add_missing
from .quantiles import exact_quantiles

#: Named feature sets; order matters for vectors.
_A = ("prior_amount_zscore", "amount_sum_last_1h")
_AN = (*_A, "is_night_transaction")
_EL = ("prior_category_zscore_eligible", "prior_category_log_prior_n")
_Z, _DAMPED, _SHRUNK = (f"prior_amount_zscore_card_category{x}" for x in ("", "_damped", "_shrunk"))
FEATURE_SETS: dict[str, tuple[str, ...]] = {
    "amount_only": _A,
    "amount_plus_night": _AN,
    "amount_plus_night_hour": (*_AN, "hour_of_day"),
    "amount_plus_night_catz": (*_AN, _Z, "prior_category_zscore_eligible"),
    "amount_plus_night_catz_v2": (*_AN, _DAMPED, *_EL),
    "amount_plus_night_catz_v3_shrunk": (*_AN, _SHRUNK, *_EL),
    "amount_plus_night_catz_v3_damped_shrunk": (*_AN, _DAMPED, _SHRUNK, *_EL),
    "amount_plus_night_catz_v4_interact_clip": ("prior_amount_zscore_clipped", "amount_sum_last_1h_log1p", "is_night_transaction", _DAMPED, _SHRUNK, *_EL, "amount_zscore_x_lowcat"),
    "amount_plus_tx1h": (*_A, "tx_count_last_1h"),
    "amount_plus_merchant": (*_A, "merchant_prior_fraud_rate"),
    "amount_plus_velocity": (*_A, "tx_count_last_15m", "tx_count_last_1h"),
    "full_baseline": (*_AN, "merchant_prior_fraud_rate", "tx_count_last_15m", "tx_count_last_1h"),
}
#: Feature columns of a model frame.
MODEL_FEATURES = (
    "hour_of_day", "prior_amount_zscore", "amount_sum_last_1h", "is_night_transaction", "merchant_prior_fraud_rate", "tx_count_last_15m", "tx_count_last_1h",
    "prior_tx_count_card_category", "prior_amount_mean_card_category", "prior_amount_std_card_category", _Z, _DAMPED, _SHRUNK,
    "prior_category_zscore_eligible", "low_history_card_category", "prior_category_log_prior_n",
)
SPLITS = ("train", "validation", "test")
#: Hyperparameters.
TREES = {"maxIter": 30, "maxDepth": 5, "stepSize": 0.1, "seed": 42}
LOGISTIC = {"maxIter": 50, "regParam": 0.01, "elasticNetParam": 0.0}


def fill_defaults(df: DataFrame, columns: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    """NULL features as 0, 0.0 or FALSE by type; ids, time and amount stay as they are."""
    types = dict(df.dtypes)
    return df.na.fill({c: False if types[c] == "boolean" else 0 for c in columns if c in types})


def model_frame(gold: DataFrame) -> DataFrame:
    """Labelled rows of a feature table with filled features, ``label`` and three derived features."""
    gold = add_missing(gold, {c: gold_type(c) for c in (*MODEL_FEATURES, "is_fraud")}, false_flags=True)
    df = gold.where("is_fraud IS NOT NULL").select("transaction_id", "event_time_unix", "is_fraud", "amount", *MODEL_FEATURES)
    df = fill_defaults(df).withColumn("label", F.col("is_fraud").cast("double"))
    df = df.withColumns({"prior_amount_zscore_clipped": clip(F.col("prior_amount_zscore"), -10.0, 10.0), "amount_sum_last_1h_log1p": F.log1p("amount_sum_last_1h")})
    return df.withColumn("amount_zscore_x_lowcat", F.col("prior_amount_zscore_clipped") * F.col("low_history_card_category").cast("double"))


def split_bounds(df: DataFrame, exact: bool = False, at: tuple[float, float] = (0.70, 0.85)) -> tuple[int, int]:
    """The event times that end train and validation: sketched within 0.1 %, or exact discrete quantiles."""
    if exact:
        found = exact_quantiles(df, [("event_time_unix", p) for p in at]).get(None, (0, []))[1]
    else:
        found = df.approxQuantile("event_time_unix", list(at), 0.001)
    if len(found) != 2 or found[0] is None:
        raise ValueError("no event times to split by")
    return int(found[0]), int(found[1])


def time_split(df: DataFrame, bounds: tuple[int, int] | None = None, exact: bool = False) -> DataFrame:
    """``split``: train up to the first bound, validation up to the second, test beyond; rows without a time are test rows."""
    low, high = bounds or split_bounds(df, exact)
    t = F.col("event_time_unix")
    return df.withColumn("split", F.when(t <= low, "train").when(t <= high, "validation").otherwise("test"))


def hash_sample(df: DataFrame, fractions: dict[str, float], seed: int = 42, by: str = "split", id_col: str = "transaction_id") -> DataFrame:
    """Rows of each group of ``by`` with its fraction as chance, decided by a hash of the id: the same rows whatever the partitioning. One filter, no union.
    Groups that are not named stay whole."""
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    share = F.lit(1.0)
    for group, fraction in fractions.items():
        share = F.when(F.col(by) == group, F.lit(float(fraction))).otherwise(share)
    return df.where(draw < share)


def sampled_union(df: DataFrame, fractions: dict[str, float], seed: int = 42) -> DataFrame:
    """Stable samples of the splits as a union of one DataFrame each, in the order given: the rows of ``hash_sample``, which reads its input once."""
    return reduce(DataFrame.unionByName, [hash_sample(df.where(F.col("split") == s), {s: f}, seed) for s, f in fractions.items()])


def with_score(base: DataFrame, other: DataFrame, id_col: str = "transaction_id") -> DataFrame:
    """Inner join of two models' scores (``score`` in each) as ``lr_score`` and ``gbt_score``, for scores that come from different tables; ``two_stage``
    scores a row by both models in one pass instead."""
    return base.withColumnRenamed("score", "lr_score").join(other.select(id_col, F.col("score").alias("gbt_score")), id_col)


def split_and_sample(df: DataFrame, train: float = 1.0, validation: float = 1.0, test: float = 1.0, seed: int = 42, exact: bool = False) -> DataFrame:
    """``time_split``, and of each split a stable sample."""
    return hash_sample(time_split(df, exact=exact), dict(zip(SPLITS, (train, validation, test), strict=True)), seed)


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def fit(train: DataFrame, model_type: str = "logistic", features: str = "features", weighted: bool = False):
    """A logistic regression, or for any other type gradient-boosted trees (which take no class weights)."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression

    if model_type != "logistic":
        return GBTClassifier(labelCol="label", featuresCol=features, **TREES).fit(train)
    options = {"labelCol": "label", "featuresCol": features, **LOGISTIC}
    if weighted:
        weight = ranking.class_weights(train).first()["positive_weight"]
        train, options["weightCol"] = train.withColumn("class_weight", F.when(F.col("label") == 1, F.lit(float(weight))).otherwise(F.lit(1.0))), "class_weight"
    return LogisticRegression(**options).fit(train)


def scored(model, df: DataFrame, name: str = "score") -> DataFrame:
    """``df`` with the probability of label 1; the model's own columns are left out."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def evaluate(model_df: DataFrame, columns: Sequence[str], model_type: str = "logistic", thresholds: Sequence[float] = ranking.THRESHOLDS, full: bool = True, weighted: bool = False, secondary: str = "none", epsilon: float = 0.0, ks: Sequence[int] = ranking.TOP_K) -> dict[str, object]:
    """Train on train, choose the threshold with the best F1 on validation, report on test: areas, rates and top-K rows. Each split is scored once, each
    family of metrics takes one job. Without ``full`` only the top-K rows are filled in."""
    ranking.secondary_signal(secondary, epsilon)
    df = assemble(model_df, columns)
    model = fit(df.where("split = 'train'"), model_type, weighted=weighted)
    keep = ["transaction_id", "event_time_unix", "label", "score", "prior_category_log_prior_n", "prior_amount_zscore", "amount_sum_last_1h"]
    test = scored(model, df.where("split = 'test'")).select(*keep).cache()
    report: dict[str, object] = {"feature_set": "+".join(columns), "feature_count": len(columns), "model_type": model_type}
    names = ("pr_auc", "roc_auc", "precision", "recall", "f1")
    report |= {f"{split}_{n}": None for split in ("validation", "test") for n in names} | {"best_threshold": None}
    report["top_k_rows"] = [r.asDict() for r in ranking.top_k_table(test, ks, secondary, epsilon).orderBy("k").collect()]
    if full:
        validation = scored(model, df.where("split = 'validation'")).select(*keep).cache()
        best = ranking.best_threshold(ranking.threshold_table(validation, thresholds)).first()
        report["best_threshold"] = best["threshold"]
        at_best = ranking.threshold_table(test, [best["threshold"]]).first()
        for split, frame, row in (("validation", validation, best), ("test", test, at_best)):
            area = ranking.areas(frame).first()
            report |= {f"{split}_pr_auc": area["pr_auc"], f"{split}_roc_auc": area["roc_auc"], **{f"{split}_{n}": row[n] for n in ("precision", "recall", "f1")}}
        validation.unpersist()
    test.unpersist()
    return report


def category_gate(model_df: DataFrame, k: int) -> DataFrame:
    """Category features recomputed for a gate of ``k`` prior transactions (columns ending in ``_k``; damping keeps its own constant)."""
    n, std = F.col("prior_tx_count_card_category").cast("double"), F.col("prior_amount_std_card_category")
    open_ = (F.col("prior_tx_count_card_category") >= k) & (std > 0)
    z = F.when(open_, (F.col("amount") - F.col("prior_amount_mean_card_category")) / std)
    return model_df.withColumns(
        {
            "prior_category_zscore_eligible_k": F.coalesce(open_, F.lit(False)),
            f"{_Z}_k": F.coalesce(z, F.lit(0.0)),
            f"{_DAMPED}_k": F.coalesce(z * F.sqrt(n / (n + F.lit(DAMP))), F.lit(0.0)),
            "prior_category_log_prior_n_k": F.coalesce(F.log1p(n), F.lit(0.0)),
        }
    )


#: Feature columns of the gate sweep by variant.
GATE_SETS = {"raw": (*_AN, f"{_Z}_k", "prior_category_zscore_eligible_k"), "damped": (*_AN, f"{_DAMPED}_k", "prior_category_zscore_eligible_k", "prior_category_log_prior_n_k")}


def gate_sweep(model_df: DataFrame, grid: Sequence[int], variants: Sequence[str] = ("raw", "damped"), primary: int = 5000, tie: int = 10000, sanity: int = 100) -> list[dict[str, object]]:
    """Logistic models for every gate and variant, best first: by precision at ``primary``, then at ``tie``, then the smaller gate."""
    if not grid:
        raise ValueError("an empty grid of gates")
    if set(variants) - set(GATE_SETS):
        raise ValueError(f"a variant is one of {', '.join(GATE_SETS)}")
    out = []
    for k in grid:
        df = category_gate(model_df, int(k))
        for v in variants:
            rows = {r["k"]: r for r in evaluate(df, GATE_SETS[v], full=False, ks=sorted({primary, tie, sanity}))["top_k_rows"]}
            out.append({"variant": v, "k": int(k), "p_primary": rows[primary]["precision"], "p_tie": rows[tie]["precision"], "p_sanity": rows[sanity]["precision"]})
    return sorted(out, key=lambda r: (-r["p_primary"], -r["p_tie"], r["k"], r["variant"]))


def two_stage(model_df: DataFrame, base_columns: Sequence[str], rerank_columns: Sequence[str], shortlist: int = 5000, mode: str = "pure", alpha: float = 0.1, ks: Sequence[int] = ranking.TOP_K, weighted: bool = False, full: bool = False, thresholds: Sequence[float] = ranking.THRESHOLDS) -> dict[str, object]:
    """A logistic queue whose head boosted trees reorder: baseline and reranked top-K rows and, with ``full``, areas and best-threshold rates of the
    final scores. Both models score a row in one pass; there is no join of scores."""
    if not ks:
        raise ValueError("no K to report")
    df = assemble(assemble(model_df, base_columns, "base_features"), rerank_columns, "rerank_features")
    train = df.where("split = 'train'")
    base, other = fit(train, "logistic", "base_features", weighted), fit(train, "gbt", "rerank_features")

    def both(split: str) -> DataFrame:
        part = scored(other, scored(base, df.where(F.col("split") == split), "lr_score"), "gbt_score")
        return part.select("transaction_id", "event_time_unix", "label", "lr_score", "gbt_score")

    test = both("test").cache()
    queue, total = ranking.rerank(test, max(ks), shortlist, mode, alpha).cache(), ranking.positives(test)
    before = queue.withColumn("position", F.col("baseline_position"))
    out: dict[str, object] = {
        "baseline_top_k_rows": [r.asDict() for r in ranking.metrics_at(before, total, ks).orderBy("k").collect()],
        "reranked_top_k_rows": [r.asDict() for r in ranking.metrics_at(queue, total, ks).orderBy("k").collect()],
        "shortlist_n": min(int(shortlist), max(ks)),
        "rerank_mode": mode,
        "alpha": alpha if mode == "blended" else None,
        "full_metrics": None,
    }
    if full:
        metrics: dict[str, object] = {}
        finals = {s: ranking.final_scores(f, max(ks), shortlist, mode, alpha).withColumn("score", F.col("final_score")) for s, f in (("validation", both("validation")), ("test", test))}
        best = ranking.best_threshold(ranking.threshold_table(finals["validation"], thresholds)).first()
        for split, frame in finals.items():
            area, row = ranking.areas(frame).first(), best if split == "validation" else ranking.threshold_table(frame, [best["threshold"]]).first()
            metrics |= {f"{split}_pr_auc": area["pr_auc"], f"{split}_roc_auc": area["roc_auc"], **{f"{split}_{n}": row[n] for n in ("precision", "recall", "f1")}}
        out["full_metrics"] = metrics | {"best_threshold": best["threshold"]}
    queue.unpersist()
    test.unpersist()
    return out

