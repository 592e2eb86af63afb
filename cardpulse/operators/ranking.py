"""Alert queues: total orders over scored rows, threshold and top-K metrics in one pass each, and the reranking of a shortlist.

A queue's head is found with orderBy + limit, which keeps K rows per task; only these few rows are numbered in one window. All K and all
thresholds are read in a single aggregation instead of a job each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio_or_zero

#: The K of reports, and the thresholds that are tried.
TOP_K = (100, 500, 1000, 5000, 10000)
THRESHOLDS = tuple(round(0.05 * k, 2) for k in range(1, 20))
#: Secondary signals of the queue order.
SECONDARY = ("none", "neg_prior_category_log_prior_n", "prior_amount_zscore", "amount_sum_last_1h")


def secondary_signal(name: str, epsilon: float = 0.0) -> Column | None:
    """The column of a secondary signal; None for ``none``. A blend needs a signal, and its weight is not negative."""
    if name not in SECONDARY:
        raise ValueError(f"unknown secondary signal {name!r}; one of {', '.join(SECONDARY)}")
    if epsilon < 0:
        raise ValueError("the blending weight is not negative")
    if name == "none":
        if epsilon > 0:
            raise ValueError("a blending weight needs a secondary signal")
        return None
    return -F.col("prior_category_log_prior_n") if name.startswith("neg_") else F.col(name)


def queue_order(secondary: str = "none", epsilon: float = 0.0, score: str = "score") -> list[Column]:
    """Score (alone, then the signal; or blended with it), later first, smaller transaction id first: a total order."""
    signal = secondary_signal(secondary, epsilon)
    if signal is None:
        head = [F.desc_nulls_last(score)]
    elif epsilon > 0:
        head = [(F.col(score) + F.lit(float(epsilon)) * signal).desc_nulls_last()]
    else:
        head = [F.desc_nulls_last(score), signal.desc_nulls_last()]
    return [*head, F.desc_nulls_last("event_time_unix"), F.asc_nulls_first("transaction_id")]


def queue_head(scored: DataFrame, k: int, order: Sequence[Column] | None = None) -> DataFrame:
    """The first ``k`` rows of the queue with ``position`` from 1. The window sees at most k rows."""
    order = list(order or queue_order())
    head = scored.orderBy(*order).limit(int(k))
    return head.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def top_k_table(scored: DataFrame, ks: Sequence[int] = TOP_K, secondary: str = "none", epsilon: float = 0.0, label: str = "label") -> DataFrame:
    """(k, rows, tp, precision, recall) for every K: rows may be fewer than K, recall is of all positives in ``scored``."""
    return metrics_at(queue_head(scored, max(ks), queue_order(secondary, epsilon)), positives(scored, label), ks, label)


def positives(scored: DataFrame, label: str = "label") -> DataFrame:
    """One row: the number of positive labels."""
    return scored.agg(F.coalesce(F.sum((F.col(label) == 1).cast("long")), F.lit(0)).alias("positives"))


def metrics_at(queue: DataFrame, total: DataFrame, ks: Sequence[int], label: str = "label") -> DataFrame:
    """(k, rows, tp, precision, recall) of a numbered queue, all K in one aggregation."""
    counts = [F.count_if(F.col("position") <= k).alias(f"rows_{k}") for k in ks] + [F.count_if((F.col("position") <= k) & (F.col(label) == 1)).alias(f"tp_{k}") for k in ks]
    row = queue.agg(*counts).crossJoin(F.broadcast(total))  # one row with one row
    each = F.explode(F.array(*[F.struct(F.lit(int(k)).alias("k"), F.col(f"rows_{k}").alias("rows"), F.col(f"tp_{k}").alias("tp"), F.col("positives")) for k in ks])).alias("m")
    out = row.select(each).select("m.*")
    return out.select("k", "rows", "tp", ratio_or_zero(F.col("tp"), F.col("rows")).alias("precision"), ratio_or_zero(F.col("tp"), F.col("positives")).alias("recall"))


def threshold_table(scored: DataFrame, thresholds: Sequence[float] = THRESHOLDS, label: str = "label") -> DataFrame:
    """(threshold, tp, fp, tn, fn, precision, recall, accuracy, f1) for every threshold (score >= it counts as positive), in one pass over the scores.
    Rates are 0.0 where their denominator is 0."""
    actual = F.col(label) == 1
    counts = []
    for k, t in enumerate(thresholds):
        said = F.coalesce(F.col("score") >= F.lit(float(t)), F.lit(False))
        counts += [F.count_if(said & actual).alias(f"tp{k}"), F.count_if(said & ~actual).alias(f"fp{k}"), F.count_if(~said & ~actual).alias(f"tn{k}"), F.count_if(~said & actual).alias(f"fn{k}")]
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}{k}").alias(n) for n in ("tp", "fp", "tn", "fn")]) for k, t in enumerate(thresholds)])).alias("m")
    out = scored.agg(*counts).select(each).select("m.*")
    tp, fp, tn, fn = (F.col(n) for n in ("tp", "fp", "tn", "fn"))
    out = out.withColumns({"precision": ratio_or_zero(tp, tp + fp), "recall": ratio_or_zero(tp, tp + fn), "accuracy": ratio_or_zero(tp + tn, tp + fp + tn + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio_or_zero(2 * p * r, p + r))


def best_threshold(table: DataFrame) -> DataFrame:
    """The row of ``threshold_table`` with the greatest F1, the lowest threshold of equals."""
    return table.orderBy(F.desc("f1"), F.asc("threshold")).limit(1)


def class_weights(labelled: DataFrame, label: str = "label") -> DataFrame:
    """One row: positives, negatives and the weight of a positive (negatives / positives, or 1.0 where either is absent)."""
    out = labelled.agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return out.withColumn("positive_weight", F.when(both, F.col("negatives") / F.col("positives")).otherwise(F.lit(1.0)))


#: Ranges of scores whose running sums are taken apart.
RANGES = 256


def areas(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: exact areas under the ROC curve and the precision-recall curve (trapezoids over distinct scores, the latter from the first
    point's precision at recall 0). NULL where a class is absent. Rows are first summed by distinct score. Running sums over them are taken
    within ranges of scores, which a sketch borders, on top of the totals of higher ranges: no task sees all scores."""
    grid = scored.agg(F.percentile_approx(score, [k / RANGES for k in range(1, RANGES)], 10000).alias("g")).first()["g"]
    borders = sorted({b for b in grid or ()})
    by_score = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    above = F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b >= F.col("s"))) if borders else F.lit(0)
    by_score = by_score.withColumn("range", above)
    whole = by_score.groupBy("range").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    higher = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over at most RANGES rows
    whole = whole.select("range", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"{c}_higher") for c in "pn"])
    down = Window.partitionBy("range").orderBy(F.desc("s"))
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    points = by_score.join(F.broadcast(whole), "range").select("range", "s", "p", "n", (F.col("p_higher") + F.sum("p").over(upto)).alias("tp"), (F.col("n_higher") + F.sum("n").over(upto)).alias("fp"))
    points = points.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
    tp0, all0 = F.col("tp") - F.col("p"), F.col("tp") - F.col("p") + F.col("fp") - F.col("n")
    points = points.withColumn("before", F.when(all0 > 0, tp0 / all0).otherwise(F.col("precision")))
    out = points.agg(F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)).alias("u"), F.sum(F.col("p") * (F.col("precision") + F.col("before")) / 2.0).alias("v"))
    return out.select(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N"))).alias("roc_auc"), F.when(F.col("P") > 0, F.col("v") / F.col("P")).alias("pr_auc"))


def rerank(scored: DataFrame, max_k: int, shortlist: int, mode: str = "pure", alpha: float = 0.1, base: str = "lr_score", other: str = "gbt_score") -> DataFrame:
    """The head of the base queue with ``baseline_position`` and, after reordering its first ``shortlist`` rows, ``position``.

    ``pure`` orders the shortlist by ``other`` then ``base``; ``blended`` by other + alpha * base, then base; both then later first, smaller id
    first. The shortlist is no longer than ``max_k``. The rest keeps its order, so that a metric at K >= shortlist does not change.
    """
    if mode not in ("pure", "blended"):
        raise ValueError(f"a rerank mode is pure or blended, not {mode!r}")
    if mode == "blended" and alpha < 0:
        raise ValueError("alpha is not negative")
    n = min(int(shortlist), int(max_k))
    head = queue_head(scored, max_k, queue_order(score=base)).withColumnRenamed("position", "baseline_position")
    key = F.col(other) if mode == "pure" else F.col(other) + F.lit(float(alpha)) * F.col(base)
    tail = [F.desc(base), F.desc_nulls_last("event_time_unix"), F.asc_nulls_first("transaction_id")]
    inside = F.col("baseline_position") <= n
    order = Window.orderBy(F.when(inside, 0).otherwise(1), F.when(inside, key).desc_nulls_last(), F.when(~inside, F.col("baseline_position")).asc_nulls_first(), *tail)
    return head.withColumn("position", F.row_number().over(order))


def final_scores(scored: DataFrame, max_k: int, shortlist: int, mode: str = "pure", alpha: float = 0.1, base: str = "lr_score", other: str = "gbt_score") -> DataFrame:
    """``scored`` with ``final_score``: the shortlist's key inside it, the base score outside; the two are on different scales, and a blend may
    exceed 1. The shortlist is a bounded set of ids, sent to the rows."""
    n = min(int(shortlist), int(max_k))
    ids = scored.orderBy(*queue_order(score=base)).limit(n).select(F.col("transaction_id").alias("_id")).withColumn("_in", F.lit(1))
    key = F.col(other) if mode == "pure" else F.col(other) + F.lit(float(alpha)) * F.col(base)
    joined = scored.join(F.broadcast(ids.dropDuplicates(["_id"])), F.col("transaction_id") == F.col("_id"), "left")
    return joined.withColumn("final_score", F.when(F.coalesce("_in", F.lit(0)) == 1, key).otherwise(F.col(base))).drop("_id", "_in")
