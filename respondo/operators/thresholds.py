"""Threshold sweeps: F1-optimal and profit-optimal cut-offs.

The reference re-scans the scored table once per threshold. Here each row
is binned once (``k`` = how many grid thresholds its score reaches, a
chain of comparisons inside codegen), the table is reduced to counts per
``(group, k)`` (map-side partial aggregation; at most ``len(grid)+1`` rows
per group and label), and every threshold's confusion counts are read off
that tiny table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respondo.functions.scalar import dbl, safe_div
from respondo.operators.metrics import f1_expr


def arange(start: float, stop: float, step: float) -> list[float]:
    """The reference's threshold grids, value for value (``numpy.arange``)."""
    return [float(x) for x in np.arange(start, stop, step)]


PROFIT_GRID = (0.1, 1.0, 0.05)   # 18 thresholds
F1_GRID = (0.3, 0.9, 0.05)       # 13 thresholds


def threshold_counts(df: DataFrame, thresholds: list[float], score: str = "score",
                     label: str = "y", by: list[str] | None = None) -> DataFrame:
    """``(by..., threshold_idx, threshold, tp, fp, tn, fn)`` for ``score >= t``."""
    by = list(by or [])
    ts = sorted(thresholds)
    s = F.col(score)
    k = sum((F.when(s >= dbl(t), 1).otherwise(0) for t in ts), F.lit(0))
    binned = df.where(s.isNotNull() & F.col(label).isNotNull()).select(*by, k.alias("k"), (F.col(label) == 1).alias("pos"))
    counts = binned.groupBy(*by, "k").agg(F.count_if("pos").alias("p"),
                                          F.count_if(~F.col("pos")).alias("n"))
    aggs = [F.sum("p").alias("P"), F.sum("n").alias("N")]
    for i in range(len(ts)):
        aggs += [F.sum(F.when(F.col("k") > i, F.col("p")).otherwise(0)).alias(f"tp{i}"),
                 F.sum(F.when(F.col("k") > i, F.col("n")).otherwise(0)).alias(f"fp{i}")]
    wide = counts.groupBy(*by).agg(*aggs)
    stack = ", ".join(f"{i}, CAST({t!r} AS DOUBLE), tp{i}, fp{i}" for i, t in enumerate(ts))
    long = wide.selectExpr(*[f"`{b}`" for b in by], "P", "N",
                           f"stack({len(ts)}, {stack}) AS (threshold_idx, threshold, tp, fp)")
    return long.select(*by, "threshold_idx", "threshold",
                       F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
                       (F.col("N") - F.col("fp")).cast("long").alias("tn"),
                       (F.col("P") - F.col("tp")).cast("long").alias("fn"))


def f1_sweep(df: DataFrame, score: str = "score", label: str = "y",
             by: list[str] | None = None, floor: float = 0.5,
             grid: tuple = F1_GRID) -> DataFrame:
    """F1/precision/recall per threshold; ``is_best`` marks the first
    F1 maximum, ``chosen_threshold`` is that threshold floored at ``floor``
    (the reported F1/P/R stay those of the unfloored optimum)."""
    by = list(by or [])
    c = threshold_counts(df, arange(*grid), score, label, by)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    prec, rec = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    m = c.select("*", prec.alias("precision"), rec.alias("recall"),
                 f1_expr(prec, rec).alias("f1"))
    # the sweep table has len(grid) rows per group: a bounded window
    w = Window.partitionBy(*[F.col(b) for b in by] or [F.lit(0)]).orderBy(
        F.desc("f1"), F.asc("threshold_idx"))
    m = m.withColumn("is_best", F.row_number().over(w) == 1)
    return m.withColumn("chosen_threshold", F.when(
        F.col("is_best"), F.greatest(F.col("threshold"), dbl(floor))))


# Campaign economics of the profit sweep.
CALL_COST = 5
REVENUE_PER_SUCCESS = 100
MISSED_COST = 20


def profit_sweep(df: DataFrame, score: str = "score", label: str = "y",
                 by: list[str] | None = None, grid: tuple = PROFIT_GRID,
                 call_cost: float = CALL_COST, revenue: float = REVENUE_PER_SUCCESS,
                 missed: float = MISSED_COST) -> DataFrame:
    """Business metrics per threshold and the first profit maximum."""
    by = list(by or [])
    c = threshold_counts(df, arange(*grid), score, label, by)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    calls = tp + fp
    cost = calls * F.lit(call_cost)
    rev = tp * F.lit(revenue)
    miss = fn * F.lit(missed)
    profit = rev - cost - miss
    m = c.select(
        "*", calls.alias("total_calls"), cost.alias("total_cost"), rev.alias("total_revenue"),
        miss.alias("missed_opportunity_cost"), profit.alias("profit"),
        F.when(cost > 0, profit.cast("double") / cost).otherwise(dbl(0.0)).alias("roi"),
        F.when(tp > 0, cost.cast("double") / tp).otherwise(dbl(float("inf")))
        .alias("cost_per_acquisition"))
    w = Window.partitionBy(*[F.col(b) for b in by] or [F.lit(0)]).orderBy(
        F.desc("profit"), F.asc("threshold_idx"))
    return m.withColumn("is_best", F.row_number().over(w) == 1)


def profit_simple(df: DataFrame, thresholds: list[float], score: str = "score",
                  label: str = "y", call_cost: float = CALL_COST,
                  revenue: float = REVENUE_PER_SUCCESS) -> DataFrame:
    """Variant without the missed-opportunity term, with quality metrics."""
    c = threshold_counts(df, thresholds, score, label)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    prec, rec = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    calls = tp + fp
    costs = calls * F.lit(call_cost)
    conv = tp * F.lit(revenue)
    net = conv - costs
    return c.select(
        "threshold", safe_div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"), f1_expr(prec, rec).alias("f1"),
        F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"),
        calls.alias("total_calls"), costs.alias("call_costs"),
        conv.alias("conversion_profits"), net.alias("net_profit"),
        F.when(costs > 0, net.cast("double") / costs).otherwise(dbl(0.0)).alias("roi"))
