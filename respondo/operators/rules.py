"""Row-level scoring and decision rules as column expressions.

Everything here is a pure projection (no shuffle), so it runs inside one
codegen stage next to the scan, and works unchanged on a streaming
DataFrame. Column names follow the reference vocabulary (``duration`` in
seconds, ``poutcome``, ``pdays`` with -1 for "never contacted", ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondo.functions.scalar import clip, dbl, first_match, sigmoid

# Auto-approval rules, in evaluation order (first match wins).
EDUCATED = ["university.degree", "professional.course"]
AUTO_RULES = [
    (1, "prev_success_long_call", "poutcome = 'success' AND duration >= 300"),
    (2, "student_long_call", "job = 'student' AND duration >= 400"),
    (3, "retired_cellular_long_call",
     "job = 'retired' AND contact = 'cellular' AND duration >= 350"),
    (4, "graduate_prior_contact_long_call",
     "education = 'university.degree' AND previous > 0 AND duration >= 400"),
    (5, "very_long_call", "duration >= 600"),
    (6, "recent_contact_long_call", "pdays <> -1 AND pdays < 30 AND duration >= 300"),
    (7, "high_potential_profile",
     "job IN ('admin.', 'management') AND education IN ('university.degree', "
     "'professional.course') AND duration >= 400 AND contact = 'cellular'"),
    (8, "young_educated_single",
     "age <= 35 AND education IN ('university.degree', 'professional.course') "
     "AND marital = 'single' AND duration >= 450"),
]


def auto_rule_sql() -> str:
    """The rule chain as one SQL CASE (used by Spark and the oracle)."""
    return "CASE " + " ".join(f"WHEN {c} THEN {i}" for i, _, c in AUTO_RULES) + " ELSE 0 END"


def auto_reason_sql() -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for _, n, c in AUTO_RULES) + " END"


def auto_approval(df: DataFrame) -> DataFrame:
    """Adds ``auto_rule`` (0 = none, else the first matching rule),
    ``auto_reason`` and ``auto_approved``."""
    return df.withColumn("auto_rule", F.expr(auto_rule_sql())) \
        .withColumn("auto_reason", F.expr(auto_reason_sql())) \
        .withColumn("auto_approved", F.col("auto_rule") > 0)


def decide(df: DataFrame, threshold: float | Column, prob: str = "p") -> DataFrame:
    """``approved = p >= threshold OR auto``; the shown probability is 0.70
    for auto-approved rows."""
    t = threshold if isinstance(threshold, Column) else dbl(threshold)
    return df.withColumn("approved", (F.col(prob) >= t) | F.col("auto_approved")) \
        .withColumn("display_p", F.when(F.col("auto_approved"), dbl(0.7)).otherwise(F.col(prob)))


# Probability bands (lower bounds, inclusive).
BANDS = [(0.75, "very_high"), (0.5, "high"), (0.25, "medium"), (0.0, "low")]


def probability_band(p: Column) -> Column:
    return first_match([(p >= dbl(lo), name) for lo, name in BANDS], "very_low")


def recommendation_band(p: Column, threshold: float | Column) -> Column:
    """Action tier with strict ``>`` bounds: >0.7, >threshold, >0.3, else."""
    t = threshold if isinstance(threshold, Column) else dbl(threshold)
    return first_match([(p > dbl(0.7), "high_potential"), (p > t, "medium_high_potential"),
                        (p > dbl(0.3), "low_medium_potential")], "low_potential")


# Fixed-domain scaling of raw inputs, name -> (offset, divisor, cap at 1).
DOMAIN_SCALE = {
    "duration": (0.0, 1000.0, True),
    "pdays": (0.0, 400.0, True),        # -1 ("never") maps to 0
    "previous": (0.0, 10.0, True),
    "emp_var_rate": (3.4, 4.8, False),
    "cons_price_idx": (-92.0, 3.0, False),
    "cons_conf_idx": (50.0, 24.0, False),
    "euribor3m": (-0.6, 4.4, False),
    "nr_employed": (-4950.0, 300.0, False),
    "age": (-18.0, 80.0, False),
    "campaign": (0.0, 10.0, True),
}


def domain_scale(name: str, x: Column) -> Column:
    off, div, cap = DOMAIN_SCALE[name]
    v = (x + dbl(off)) / dbl(div) if off else x / dbl(div)
    v = F.least(dbl(1.0), v) if cap else v
    if name == "pdays":
        v = F.when(x == -1, dbl(0.0)).otherwise(v)
    return v


def minmax_domain_scale(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = [c for c in (columns or DOMAIN_SCALE) if c in df.columns]
    return df.select("*", *[domain_scale(c, F.col(c).cast("double")).alias(f"{c}_scaled")
                            for c in cols])


def one_hot_probe(column: Column, value: str) -> Column:
    """1.0 when the category equals the one-hot feature's suffix."""
    return (column == F.lit(value)).cast("double")


def base_rate_score(dur_s: Column, pdays_s: Column, prev_s: Column) -> Column:
    """Formula scorer on scaled inputs: 0.11 + (sigmoid(dur) - 0.5) * 0.15
    * pdays factor * previous factor, clipped to [0.05, 0.7] (per row)."""
    pdays_f = F.when(pdays_s <= 0, dbl(0.8)).otherwise(dbl(1.1))
    prev_f = first_match([((prev_s > 0) & (prev_s <= dbl(0.3)), dbl(1.1)),
                          (prev_s > dbl(0.3), dbl(0.9))], dbl(1.0))
    raw = dbl(0.11) + (sigmoid(dur_s) - dbl(0.5)) * dbl(0.15) * pdays_f * prev_f
    return clip(raw, 0.05, 0.7)


def fallback_score(dur_s: Column) -> Column:
    """0.11 + (sigmoid(dur) - 0.5) * 0.12, clipped to [0.05, 0.6]."""
    return clip(dbl(0.11) + (sigmoid(dur_s) - dbl(0.5)) * dbl(0.12), 0.05, 0.6)


# Preference order when the chosen model has no score.
FALLBACK_ORDER = ["stacking", "xgboost", "random_forest", "logistic"]


def score_with_fallback(chosen: str, available: dict[str, Column], formula: Column) -> tuple[Column, Column]:
    """First non-null score of chosen, then the fallback order, then the
    formula; returns (score, name of the source used)."""
    order = [chosen] + [m for m in FALLBACK_ORDER if m != chosen]
    cols = [(m, available[m]) for m in order if m in available]
    score = F.coalesce(*[c for _, c in cols], formula)
    source = first_match([(c.isNotNull(), m) for m, c in cols], "formula")
    return score, source


def negative_signal_adjust(p: Column, duration: Column, poutcome: Column,
                           previous: Column, pdays: Column) -> Column:
    """Long call with p > 0.5 but >= 2 negative signals -> max(0.3, 0.7 p)."""
    signals = (F.when(poutcome.isin("nonexistent", "failure"), 1).otherwise(0)
               + F.when(previous == 0, 1).otherwise(0) + F.when(pdays == -1, 1).otherwise(0))
    hit = (duration > 500) & (p > dbl(0.5)) & (signals >= 2)
    return F.when(hit, F.greatest(dbl(0.3), p * dbl(0.7))).otherwise(p)


# Duration bands in seconds (upper bounds inclusive).
DURATION_BANDS = [(100, "0-100"), (200, "101-200"), (300, "201-300"), (500, "301-500"),
                  (1000, "501-1000")]


def duration_band(duration: Column) -> Column:
    return first_match([(duration <= b, name) for b, name in DURATION_BANDS], ">1000")


def reliability_bin(p: Column) -> Column:
    """0.1-wide score bin, 0..9 (1.0 falls into the last bin)."""
    return F.least(F.lit(9), F.floor(p * dbl(10.0)).cast("int"))
