"""Column-expression helpers. All of them are built-in Spark expressions,
so they stay inside whole-stage codegen (no Python per row)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(x: float) -> Column:
    """A DOUBLE literal (SQL ``1.0`` would be DECIMAL and truncate)."""
    return F.lit(float(x))


def sigmoid(x: ColumnOrName, slope: float = 4.0, mid: float = 0.5) -> Column:
    """``1 / (1 + exp(-slope * (x - mid)))``."""
    return dbl(1.0) / (dbl(1.0) + F.exp(dbl(-slope) * (col(x) - dbl(mid))))


def logistic(z: ColumnOrName) -> Column:
    return dbl(1.0) / (dbl(1.0) + F.exp(-col(z)))


def clip(x: ColumnOrName, lo: float, hi: float) -> Column:
    return F.greatest(dbl(lo), F.least(dbl(hi), col(x)))


def safe_div(num: ColumnOrName, den: ColumnOrName, default: float | None = 0.0) -> Column:
    """``num / den`` with ``default`` when the denominator is 0 (ANSI-safe)."""
    q = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return q if default is None else F.coalesce(q, dbl(default))


def pct(num: ColumnOrName, den: ColumnOrName, digits: int | None = 9) -> Column:
    """Percentage ``num / den * 100``; NULL on an empty denominator."""
    p = safe_div(num, den, None) * dbl(100.0)
    return F.round(p, digits) if digits is not None else p


DIGITS = 9


def r6(x: ColumnOrName) -> Column:
    """Round doubles to ``DIGITS`` places: removes last-bit differences
    between engines, yet never lands on the half-way point of values
    derived from the 2-decimal source data."""
    return F.round(col(x).cast("double"), DIGITS)


def str_replace(x: ColumnOrName, old: str, new: str) -> Column:
    return F.replace(col(x), F.lit(old), F.lit(new))


NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def coerce_numeric(x: ColumnOrName) -> Column:
    """Text to DOUBLE the way the reference coerces: decimal comma -> point,
    anything that is not a plain number -> NULL. The ``rlike`` guard keeps
    Spark from accepting Java suffixes such as ``'1d'``/``'1f'``."""
    s = F.replace(col(x).cast("string"), F.lit(","), F.lit("."))
    return F.when(s.rlike(NUMERIC_TEXT), s.try_cast("double"))


def first_match(conds: Iterable[tuple[Column, object]], default=None) -> Column:
    """Chained ``CASE WHEN`` in the given order (first true wins)."""
    expr = None
    for cond, val in conds:
        v = val if isinstance(val, Column) else F.lit(val)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return expr.otherwise(d) if expr is not None else d
