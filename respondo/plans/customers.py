"""``customers``: the contacts view translated into the reference's
vocabulary and units, for the rule-based decisioning operators.

The scoring rules speak of call seconds, ``poutcome = 'success'``,
``job = 'student'`` and so on; this plan maps the star-schema values onto
those categories once (a CASE per column inside the scan's projection), so
the rule operators keep the reference's literal conditions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respondo.plans.contacts import KEY, contacts
from respondo.plans.scores import PRIMARY, score_sql

# Data value -> reference category, per column.
VOCAB = {
    "job": {"BUILDING": "student", "AUTOMOBILE": "retired", "HOUSEHOLD": "admin.",
            "MACHINERY": "management", "FURNITURE": "technician"},
    "education": {"1-URGENT": "university.degree", "2-HIGH": "professional.course",
                  "3-MEDIUM": "high.school", "4-NOT SPECIFIED": "unknown", "5-LOW": "basic.9y"},
    "contact": {"O": "cellular", "F": "telephone"},
    "poutcome": {"F": "success", "O": "failure", "P": "nonexistent"},
    "marital": {"ASIA": "single", "EUROPE": "married", "AFRICA": "married",
                "AMERICA": "divorced", "MIDDLE EAST": "unknown"},
}

# Spark SQL / DuckDB expressions (same text both sides) for the unit changes
DERIVED = {
    "duration_s": "duration / CAST(100.0 AS DOUBLE)",
    "previous_n": "previous - 1",
    "pdays_n": "CASE WHEN previous = 1 THEN -1 ELSE abs(pdays) END",
    "age": "CAST(campaign AS INTEGER) + 17",
    "emp_var_rate": "discount * CAST(100.0 AS DOUBLE) - CAST(5.0 AS DOUBLE)",
    "euribor3m": "tax * CAST(100.0 AS DOUBLE)",
}
SOURCE_COLS = ["y", "duration", "previous", "pdays", "campaign", "discount", "tax",
               "job", "education", "contact", "poutcome", "marital"]
OUT_COLS = ["y", "duration", "pdays", "previous", "age", "emp_var_rate", "euribor3m",
            "job", "education", "contact", "poutcome", "marital", "p"]


def _case(col: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VOCAB[col].items())
    return f"CASE {col} {whens} ELSE 'other' END"


def _select_list() -> list[tuple[str, str]]:
    """(alias, expression) pairs shared by the Spark plan and the oracle."""
    return [
        ("y", "y"),
        ("duration", DERIVED["duration_s"]),
        ("pdays", DERIVED["pdays_n"]),
        ("previous", DERIVED["previous_n"]),
        ("age", DERIVED["age"]),
        ("emp_var_rate", DERIVED["emp_var_rate"]),
        ("euribor3m", DERIVED["euribor3m"]),
        *[(c, _case(c)) for c in ("job", "education", "contact", "poutcome", "marital")],
        ("p", score_sql(PRIMARY)),
    ]


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = contacts(spark, sf_dir, SOURCE_COLS)
    return base.select(*KEY, *[F.expr(e).alias(a) for a, e in _select_list()])


CUSTOMERS_SQL = ("customers AS (SELECT " + ", ".join(KEY) + ", "
                 + ", ".join(f"{e} AS {a}" for a, e in _select_list()) + " FROM contacts)")
