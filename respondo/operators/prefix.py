"""Distributed running sums (ROC curves, rank statistics).

A window ``ORDER BY x`` without ``PARTITION BY`` runs in one task. Here the
ordered domain is cut into ``ranges`` value ranges whose boundaries are
approximate quantiles of ``x`` (``ranges - 1`` numbers on the driver), so
each range holds about the same number of rows. Each range gets its
running sum from a window partitioned by range id, and the exclusive offset
of each range comes from a table with one row per range (and group), which
is broadcast back. Range ids come from the value itself (binary search in
``Bucketizer``), so every branch of the plan assigns the same range.
Inputs are expected to be pre-aggregated (one row per distinct ``x``), so a
hot value is a single row, never a skewed range.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_ids(df: DataFrame, order_col: str, ranges: int, out: str = "_range") -> DataFrame:
    if ranges < 2:
        return df.withColumn(out, F.lit(0))
    probs = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(F.col(order_col).cast("double"), probs, 10_000)).first()[0]
    splits = [float("-inf")] + sorted(set(float(c) for c in (cuts or []))) + [float("inf")]
    tmp = df.withColumn("_x", F.col(order_col).cast("double"))
    b = Bucketizer(splits=splits, inputCol="_x", outputCol=out, handleInvalid="keep")
    return b.transform(tmp).drop("_x").withColumn(out, F.col(out).cast("int"))


def running_sums(df: DataFrame, order_col: str, value_cols: list[str],
                 by: list[str] | None = None, ranges: int | None = None,
                 suffix: str = "_cum") -> DataFrame:
    """Add inclusive running sums ``<v><suffix>`` of ``value_cols`` ordered
    by ``order_col`` ascending (within each ``by`` group)."""
    by = list(by or [])
    spark = df.sparkSession
    n = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
    r = range_ids(df, order_col, n)

    # per (group, range) totals: at most n rows per group, so the offset
    # window and the broadcast below stay small
    tot = r.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    wo = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy("_range") \
        .rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*by, "_range", *[
        F.coalesce(F.sum(f"_t_{v}").over(wo), F.lit(0)).alias(f"_o_{v}") for v in value_cols])

    wi = Window.partitionBy("_range", *by).orderBy(order_col) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = r.select("*", *[F.sum(v).over(wi).alias(f"_w_{v}") for v in value_cols])
    out = within.join(F.broadcast(off), [*by, "_range"])
    return out.select(*df.columns, *[
        (F.col(f"_w_{v}") + F.col(f"_o_{v}")).alias(f"{v}{suffix}") for v in value_cols])
