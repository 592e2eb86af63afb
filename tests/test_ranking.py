"""Alert queues, metrics and models."""

import random

import pytest

from cardpulse.operators import modelling, quantiles, ranking, reports
from cardpulse.plans.queries import model, query


def scores(spark, rows):
    return spark.createDataFrame([(f"t{k}", 100 + k, float(y), float(s), float(s) / 2, 0.0, 0.0) for k, (y, s) in enumerate(rows)], "transaction_id string, event_time_unix long, label double, score double, prior_amount_zscore double, prior_category_log_prior_n double, amount_sum_last_1h double")


ROWS = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (0, 0.1), (1, 0.0)]


def test_threshold_table(spark):
    got = {r["threshold"]: r for r in ranking.threshold_table(scores(spark, ROWS), (0.5, 0.95)).collect()}
    assert [got[0.5][c] for c in ("tp", "fp", "tn", "fn")] == [2, 2, 1, 1]
    assert got[0.5]["f1"] == pytest.approx(4 / 7)
    assert (got[0.95]["precision"], got[0.95]["f1"]) == (0.0, 0.0)
    best = ranking.best_threshold(ranking.threshold_table(scores(spark, ROWS))).first()
    assert best["threshold"] == 0.15  # the lowest of equals


def test_top_k(spark):
    got = {r["k"]: r for r in ranking.top_k_table(scores(spark, ROWS), (1, 3, 100)).collect()}
    assert (got[1]["tp"], got[3]["tp"], got[100]["rows"]) == (1, 1, 6)  # of equal scores the later row first
    assert got[3]["recall"] == pytest.approx(1 / 3)
    for r in got.values():
        assert r["precision"] * r["rows"] == pytest.approx(r["tp"])


def test_empty_queue(spark):
    empty = scores(spark, ROWS).where("false")
    assert [(r["rows"], r["precision"], r["recall"]) for r in ranking.top_k_table(empty, (5,)).collect()] == [(0, 0.0, 0.0)]
    assert ranking.areas(empty).first()["roc_auc"] is None
    assert ranking.class_weights(empty).first()["positive_weight"] == 1.0
    with pytest.raises(ValueError, match="no event times"):
        modelling.split_bounds(empty)


def test_secondary_signal_errors():
    for bad in (("nonsense", 0.0), ("none", 0.1), ("prior_amount_zscore", -1.0)):
        with pytest.raises(ValueError, match=r"secondary|weight"):
            ranking.secondary_signal(*bad)


def test_areas_by_hand(spark):
    row = ranking.areas(scores(spark, [(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)])).first()
    assert row["roc_auc"] == pytest.approx(0.875)
    assert row["pr_auc"] == pytest.approx(0.5 * 1 + 0.5 * (1 + 2 / 3) / 2)


def test_areas_over_many_ranges(spark, monkeypatch):
    """Running sums in ranges of scores equal those over all scores, and no window takes all rows to one task."""
    monkeypatch.setattr(ranking, "RANGES", 16)
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.3), round(rng.random() ** 3, 3)) for _ in range(3000)] + [(1, 0.5)] * 50
    df = scores(spark, rows)
    points, tp, fp = [], 0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        p, n = sum(y for y, t in rows if t == s), sum(1 - y for y, t in rows if t == s)
        tp, fp = tp + p, fp + n
        points.append((p, n, tp, tp / (tp + fp)))
    whole = sum(y for y, _ in rows)
    roc = sum(n * (t - p / 2) for p, n, t, _ in points) / (whole * (len(rows) - whole))
    pr = sum(p * (a[3] + b[3]) / 2 for (p, *_), a, b in zip(points, points, [points[0], *points], strict=False)) / whole
    got = ranking.areas(df).first()
    assert (got["roc_auc"], got["pr_auc"]) == (pytest.approx(roc), pytest.approx(pr))
    plan = ranking.areas(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 4  # the sums at the end, the sketch, and the window over ranges


def test_exact_quantiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice((None, rng.gauss(0, 1), 7.0, rng.randint(0, 50) / 4))) for _ in range(4000)] + [(None, 1.0), ("c", None), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = [("v", p) for p in (0.01, 0.1, 0.25, 0.5, 0.9, 1.0)]
    for most in (quantiles.MOST, 40):
        got = quantiles.exact_quantiles(df, wanted, "g", most)
        assert got.keys() == {"a", "b", "c", None, "d"}
        for g, (n, values) in got.items():
            own = sorted(v for x, v in rows if x == g and v is not None)
            assert n == sum(x == g for x, _ in rows)
            if g == "d":
                assert all(v != v for v in values)
            else:
                assert values == [own[quantiles.rank(p, len(own)) - 1] if own else None for _, p in wanted]
    everything = sorted(v for x, v in rows if v is not None and v == v)
    assert quantiles.exact_quantiles(df.where("NOT isnan(v)"), [("v", 0.5)], most=100)[None][1] == [everything[quantiles.rank(0.5, len(everything)) - 1]]
    assert quantiles.exact_quantiles(df.where("false"), wanted, "g") == {}
    assert (quantiles.rank(0.1, 30), quantiles.rank(0.5, 1), quantiles.rank(0.0, 5), quantiles.rank(0.7, 10)) == (3, 1, 1, 7)


@pytest.mark.parametrize("mode", ["pure", "blended"])
def test_rerank_keeps_the_shortlist_a_set(spark, mode):
    df = scores(spark, [(k % 3 == 0, (k * 7 % 20) / 20) for k in range(20)]).selectExpr("transaction_id", "event_time_unix", "label", "score AS lr_score", "1 - score AS gbt_score")
    rows = ranking.rerank(df, 15, 6, mode).collect()
    assert sorted(r["position"] for r in rows) == list(range(1, 16))
    assert {r["transaction_id"] for r in rows if r["position"] <= 6} == {r["transaction_id"] for r in rows if r["baseline_position"] <= 6}
    assert all(r["position"] == r["baseline_position"] for r in rows if r["baseline_position"] > 6)
    with pytest.raises(ValueError, match="mode"):
        ranking.rerank(df, 5, 5, "other")
    with pytest.raises(ValueError, match="alpha"):
        ranking.rerank(df, 5, 5, "blended", -1.0)


def test_hash_sample_is_stable(spark, sf):
    df = modelling.time_split(model(spark, sf), (0, 1 << 60))
    a = modelling.hash_sample(df, {"validation": 0.3})
    b = modelling.hash_sample(df.repartition(7), {"validation": 0.3})
    assert sorted(r[0] for r in a.select("transaction_id").collect()) == sorted(r[0] for r in b.select("transaction_id").collect())
    assert 0.2 < a.count() / df.count() < 0.4
    assert modelling.hash_sample(df, {}).count() == df.count()


def test_null_time_is_test(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "event_time_unix long")
    assert [r["split"] for r in modelling.time_split(df, (1, 4)).collect()] == ["train", "test", "test"]


def test_feature_sets():
    assert len(modelling.FEATURE_SETS) == 12
    assert modelling.FEATURE_SETS["full_baseline"] == ("prior_amount_zscore", "amount_sum_last_1h", "is_night_transaction", "merchant_prior_fraud_rate", "tx_count_last_15m", "tx_count_last_1h")
    assert modelling.FEATURE_SETS["amount_plus_night_catz_v4_interact_clip"][0] == "prior_amount_zscore_clipped"


def test_models_learn(spark, sf):
    df = modelling.time_split(model(spark, sf), exact=True).cache()
    report = modelling.evaluate(df, modelling.FEATURE_SETS["amount_only"], ks=(10, 50), weighted=True)
    assert report["test_roc_auc"] is None or 0 <= report["test_roc_auc"] <= 1
    assert [r["k"] for r in report["top_k_rows"]] == [10, 50]
    short = modelling.evaluate(df, modelling.FEATURE_SETS["amount_only"], full=False, ks=(10,))
    assert short["test_pr_auc"] is None
    both = modelling.two_stage(df, modelling.FEATURE_SETS["amount_only"], modelling.FEATURE_SETS["amount_plus_night"], 20, ks=(10, 20, 50), full=True)
    at = {q: {r["k"]: r["tp"] for r in both[f"{q}_top_k_rows"]} for q in ("baseline", "reranked")}
    assert at["baseline"][20] == at["reranked"][20]
    assert at["baseline"][50] == at["reranked"][50]
    assert set(both["full_metrics"]) >= {"test_pr_auc", "best_threshold"}
    sweep = modelling.gate_sweep(df, [3], ["raw"], 10, 20, 5)
    assert sweep[0]["variant"] == "raw"
    with pytest.raises(ValueError, match="grid"):
        modelling.gate_sweep(df, [])


def test_reports_on_empty_and_null(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "transaction_id string, amount double")
    assert reports.outliers(df, "amount", 5).first()["transaction_id"] == "b"
    assert reports.rate_bins(df.withColumn("is_fraud", df["amount"]).where("false"), "amount", 0, 1, 2).count() == 0


def test_registry_decorator_keeps_names():
    assert query(test_registry_decorator_keeps_names) is test_registry_decorator_keeps_names
    from cardpulse.plans.queries import QUERIES

    del QUERIES["test_registry_decorator_keeps_names"]
