"""A reproducible shuffle into shards by a Feistel permutation.

Rows get their global row number from the files they lie in. A Feistel
network over Z_a x Z_b (a * b the next product at or above the number of
rows n) permutes 0 .. a*b - 1; a value at or beyond n is permuted again
until it falls below n (cycle walking), which permutes 0 .. n - 1. Value y
goes to shard y mod s, slot y div s: counts differ by at most one, slots
have no gaps, and both can be computed for any row (and inverted) without
looking at other rows. No row moves and no Python runs on rows.

Defined results: a null text has no bytes (size 16, crc32 0); equal texts
and repeated rows are separate rows; null ids are kept; an empty table
gives no rows; extra columns are kept, except those with the names of the
added columns, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from respondo.llm.common import numbered, stage

ROUNDS = 4


def domain(n: int) -> tuple[int, int]:
    """Factors a, b of the permuted domain: a * b >= n, less than a beyond it."""
    a = max(1, math.isqrt(max(n, 1)))
    return a, -(-max(n, 1) // a)


def round_value(part: Column, seed: int, k: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(part, F.lit(seed * 1000 + k)), F.lit(modulus))


def permuted(df: DataFrame, col: str, n: int, seed: int, inverse: bool = False,
             only_from: int | None = None) -> DataFrame:
    """Replace ``col`` (a value below a*b) by its permutation; with
    ``only_from``, only values at or above it. Each round is a projection
    of its own, so that the expressions stay small."""
    a, b = domain(n)
    left, right = "__left", "__right"
    df = df.withColumns({left: F.expr(f"`{col}` div {b}L"), right: F.col(col) % F.lit(b)})
    sign = -1 if inverse else 1
    steps = [(k, side) for k in range(ROUNDS) for side in (left, right)]
    for k, side in reversed(steps) if inverse else steps:
        other, modulus = (right, a) if side == left else (left, b)
        moved = F.pmod(F.col(side) + sign * round_value(F.col(other), seed, 2 * k + (side == right),
                                                        modulus), F.lit(modulus))
        df = df.withColumn(side, moved)
    out = F.col(left) * b + F.col(right)
    if only_from is not None:
        out = F.when(F.col(col) >= only_from, out).otherwise(F.col(col))
    return df.withColumn(col, out).drop(left, right)


def walks(spark: SparkSession, n: int, seed: int, inverse: bool = False) -> int:
    """How many times at most a row is permuted again: the longest chain of
    values at or beyond n that starts behind a value below n. There are
    fewer than sqrt(n) + 1 such values."""
    a, b = domain(n)
    if a * b == n:
        return 0
    beyond = spark.range(n, a * b).withColumn("v", F.col("id"))
    # written between the steps: a filter on ``v`` would repeat its whole expression
    start = stage(permuted(beyond, "v", n, seed, not inverse), "walks").where(
        F.col("v") < n).select(F.col("id").alias("v"))
    count = 0
    while start.limit(1).count():
        count += 1
        start = stage(permuted(start, "v", n, seed, inverse), "walks").where(F.col("v") >= n)
    return count


def shuffled(df: DataFrame, col: str, n: int, seed: int, inverse: bool = False) -> DataFrame:
    """Replace row numbers 0 .. n - 1 in ``col`` by their permutation."""
    out = permuted(df, col, n, seed, inverse)
    for _ in range(walks(df.sparkSession, n, seed, inverse)):
        out = permuted(out, col, n, seed, inverse, only_from=n)
    return out


def shard(df: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """Add ``row_number``, ``shard`` and ``slot``."""
    rows, n = numbered(df.drop("row_number", "shard", "slot"), "row_number")
    out = shuffled(rows.withColumn("__at", F.col("row_number")), "__at", n, seed)
    return (out.withColumn("shard", (F.col("__at") % shards).cast("int"))
            .withColumn("slot", F.expr(f"`__at` div {shards}")).drop("__at"))


def source_row(places: DataFrame, n: int, shards: int, seed: int = 1) -> DataFrame:
    """Add the ``row_number`` that stands at each (``shard``, ``slot``)."""
    at = places.withColumn("row_number", F.col("slot") * shards + F.col("shard"))
    return shuffled(at, "row_number", n, seed, inverse=True)
