"""Registry of named queries (one per SURVEY §2 operator id) and their
DuckDB oracle SQL. Each query takes ``(spark, sf_dir)`` and returns a
DataFrame over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _filtered_counts(sql: str) -> str:
    """``count_if(cond)`` -> ``(COUNT(*) FILTER (WHERE cond))``: DuckDB's
    count_if is HUGEINT while the filtered count is BIGINT, like Spark's."""
    out, i, token = [], 0, "count_if("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k = 1, j + len(token)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = _filtered_counts(sql[j + len(token):k - 1])
        out.append(f"(COUNT(*) FILTER (WHERE {inner}))")
        i = k


def register(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is its exact oracle (omit for
    operators with no SQL form, which get a rows-only check)."""
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query id {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = _filtered_counts(sql)
        return fn
    return deco
