"""Exact discrete quantiles without a task, or a driver, that holds all values.

A quantile is the k-th smallest value. Sketches bracket it, a count says how many values lie below the bracket and inside it, and brackets are
narrowed until few values are left, which are sorted. A pass narrows by some hundred times, so that 10**12 values take four passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a bracket that are sorted in one place; steps of a bracketing sketch, and its accuracy.
MOST, STEPS, ACCURACY = 1 << 17, 200, 10000


def rank(share: float, n: int) -> int:
    """The place, from 1, of the discrete quantile among n values."""
    return max(n - floor(n - share * n), 1)


class _Bracket:
    def __init__(self, k: int, n: int):
        self.k, self.low, self.high, self.below, self.inside = k, None, None, 0, n

    def open(self, most: int) -> bool:
        return self.inside > most and (self.low is None or self.low != self.high)


def _within(i: int, v: Column) -> Column:
    low, high = F.col(f"low{i}"), F.col(f"high{i}")
    return v.isNotNull() & (low.isNull() | (v >= low)) & (high.isNull() | (v <= high))


def exact_quantiles(df: DataFrame, wanted: Sequence[tuple[str, float]], by: str | None = None, most: int = MOST) -> dict[object, tuple[int, list[float | None]]]:
    """For each group of ``by`` (None: for all rows, under None) its rows and the discrete quantile of every (column, share); None without values. NULLs do
    not count, NaN is the greatest value. The groups are few: a row of each reaches the driver."""
    place = {c: k for k, c in enumerate(dict.fromkeys(c for c, _ in wanted))}
    group = F.lit(None).cast("string") if by is None else F.col(by)
    own = df.select(group.alias("g"), *[F.col(c).cast("double").alias(f"v{k}") for c, k in place.items()]).persist()
    try:
        counts = own.groupBy("g").agg(F.count("*").alias("rows"), *[F.count(f"v{k}").alias(f"n{k}") for k in place.values()]).collect()
        found = {r["g"]: [_Bracket(rank(p, r[f"n{place[c]}"]), r[f"n{place[c]}"]) for c, p in wanted] for r in counts}
        kind = own.schema["g"].dataType.simpleString()

        def bounded() -> DataFrame:
            rows = [(g, *[x for b in own_brackets for x in (b.low, b.high)]) for g, own_brackets in found.items()]
            names = ", ".join(f"low{i} double, high{i} double" for i in range(len(wanted)))
            return own.join(F.broadcast(own.sparkSession.createDataFrame(rows, f"bound {kind}, {names}")), F.col("g").eqNullSafe(F.col("bound")))

        values = [F.col(f"v{place[c]}") for c, _ in wanted]
        while any(b.open(most) for brackets in found.values() for b in brackets):
            grid = [k / STEPS for k in range(STEPS + 1)]
            made = [F.percentile_approx(F.when(_within(i, v), v), grid, ACCURACY).alias(f"grid{i}") for i, v in enumerate(values)]
            before = {}
            for r in bounded().groupBy("g").agg(*made).collect():
                for i, b in enumerate(found[r["g"]]):
                    if b.open(most):
                        at = (b.k - b.below) / b.inside * STEPS
                        before[r["g"], i] = b.low, b.high
                        b.low, b.high = r[f"grid{i}"][max(floor(at) - 1, 0)], r[f"grid{i}"][min(floor(at) + 2, STEPS)]
            counted = [x for i, v in enumerate(values) for x in (F.count_if(v < F.col(f"low{i}")).alias(f"below{i}"), F.count_if(_within(i, v)).alias(f"inside{i}"))]
            for r in bounded().groupBy("g").agg(*counted).collect():
                for i, b in enumerate(found[r["g"]]):
                    b.below, b.inside = r[f"below{i}"], r[f"inside{i}"]
                    if (r["g"], i) in before and not b.below < b.k <= b.below + b.inside:  # the sketch was further off than it says
                        b.low, b.high = (before[r["g"], i][0], b.low) if b.k <= b.below else (b.high, before[r["g"], i][1])
                        b.below, b.inside = 0 if b.low is None else b.below, max(b.inside, most + 1)
        picked = [F.sort_array(F.collect_list(F.when(_within(i, v) & (F.col(f"low{i}").isNull() | (F.col(f"low{i}") != F.col(f"high{i}"))), v))).alias(f"all{i}") for i, v in enumerate(values)]
        rows = {r["g"]: r for r in bounded().groupBy("g").agg(*picked).collect()} if found else {}
        out = {}
        for r in counts:
            g = r["g"]
            each = [None if not r[f"n{place[c]}"] else b.low if b.low is not None and b.low == b.high else rows[g][f"all{i}"][b.k - b.below - 1] for i, ((c, _), b) in enumerate(zip(wanted, found[g], strict=True))]
            out[g] = r["rows"], each
        return out
    finally:
        own.unpersist()
