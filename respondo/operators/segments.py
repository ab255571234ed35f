"""Segment analysis: response rates of categories and of predicate-defined
segments. Every operator is a single aggregation pass (partial aggregation
on the map side, so only one small row per group and task is shuffled),
instead of one scan per segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondo.functions.scalar import pct


def unpivot_categories(df: DataFrame, columns: list[str], target: str | None = None,
                       name: str = "feature", value: str = "value") -> DataFrame:
    """Long ``(column, value[, target])`` rows, one per input row and column."""
    ids = [target] if target else []
    return df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns]) \
        .unpivot(ids, columns, name, value)


def segment_response_rate(df: DataFrame, columns: list[str], target: str = "y") -> DataFrame:
    """Per category of each column: rows, positives and positives/rows in %.

    One shuffle for all columns together (unpivot -> group by column, value).
    """
    long = unpivot_categories(df, columns, target)
    return long.groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(target)).cast("long").alias("positives"),
        pct(F.sum(F.col(target)), F.count(F.lit(1))).alias("rate_pct"),
    )


def topk_segments(rates: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best categories per column by rate (ties: smaller value).
    The per-column input is already aggregated (one row per category)."""
    from pyspark.sql import Window
    w = Window.partitionBy("feature").orderBy(F.desc("rate_pct"), F.asc("value"))
    return rates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def conditional_rates(df: DataFrame, segments: dict[str, Column], target: str = "y") -> DataFrame:
    """P(target | segment) for named predicates, in one pass.

    Returns ``(segment, rows, positives, rate_pct)``; ``rate_pct`` is NULL for
    an empty segment (the reference skips those). A row may fall in several
    segments, so this is conditional aggregation, not a group-by.
    """
    aggs = []
    for name, pred in segments.items():
        hit = F.coalesce(pred, F.lit(False))
        aggs += [F.count_if(hit).alias(f"{name}__n"),
                 F.count_if(hit & (F.col(target) == 1)).alias(f"{name}__p")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{n}', `{n}__n`, `{n}__p`" for n in segments)
    long = wide.selectExpr(f"stack({len(segments)}, {stack}) AS (segment, rows, positives)")
    return long.select("segment", "rows", "positives",
                       pct(F.col("positives"), F.col("rows")).alias("rate_pct"))


def share_within_class(df: DataFrame, predicates: dict[str, Column], target: str = "y",
                       cls: int = 1) -> DataFrame:
    """P(predicate | target == cls) in %, one pass."""
    in_cls = F.col(target) == cls
    aggs = [F.count_if(in_cls).alias("__class_rows")]
    for name, pred in predicates.items():
        aggs.append(F.count_if(in_cls & F.coalesce(pred, F.lit(False))).alias(f"{name}__n"))
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{n}', `{n}__n`" for n in predicates)
    return wide.selectExpr("__class_rows", f"stack({len(predicates)}, {stack}) AS (segment, hits)") \
        .select("segment", "hits", F.col("__class_rows").alias("class_rows"),
                pct(F.col("hits"), F.col("__class_rows")).alias("share_pct"))


def group_stats(df: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Mean and exact 75th percentile of each metric per outcome class."""
    from respondo.operators.quantiles import percentiles_wide
    means = df.groupBy(by).agg(*[F.avg(F.col(m).cast("double")).alias(f"mean_{m}")
                                 for m in metrics])
    q = percentiles_wide(df, metrics, [0.75], [by])
    p75 = q.groupBy(by).agg(*[F.max(F.when(F.col("feature") == m, F.col("q0"))).alias(f"p75_{m}")
                              for m in metrics])
    return means.join(p75, by)


def group_mode(df: DataFrame, by: str, value: str) -> DataFrame:
    """Most frequent ``value`` per group; smallest value on a tie.

    Count per (group, value) first (map-side partial counts), then take the
    minimum of ``(-count, value)`` per group, which is the largest count
    with the smallest value, without sorting or collecting a group.
    """
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("cnt"))
    best = counts.groupBy(by).agg(
        F.min(F.struct(F.negative(F.col("cnt")).alias("nc"), F.col(value).alias("v"))).alias("m"))
    return best.select(by, F.col("m.v").alias("mode_value"),
                       F.negative(F.col("m.nc")).alias("mode_count"))


def crosstab_normalized(df: DataFrame, columns: list[str], target: str = "y",
                        classes: tuple = (0, 1)) -> DataFrame:
    """Row-normalised category x target table (share of each class) of every
    column, in one grouped count."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in classes:
        aggs.append(F.count_if(F.col(target) == c).alias(f"n_{c}"))
    long = df.select(target, *[F.col(c).cast("string").alias(c) for c in columns]) \
        .unpivot([target], columns, "feature", "value")
    t = long.groupBy("feature", "value").agg(*aggs)
    return t.select("feature", "value", "rows", *[
        F.round(F.col(f"n_{c}") / F.col("rows"), 9).alias(f"share_{c}") for c in classes])
