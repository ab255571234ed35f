"""Deterministic score tables over ``contacts``.

The decisioning operators (metrics, thresholds, voting, rules) consume a
score column. For exact, engine-independent checks the scores here are
closed-form: ``sigmoid`` of a fixed linear form of contact columns, one
form per named model (the six model families of the reference). Trained
``pyspark.ml`` models produce the same ``(key, y, model, score)`` shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respondo.plans.contacts import KEY, contacts, with_contacts

# Coefficients of the closed-form scorers
# (bias, duration/1e5, discount*10, tax*10, campaign/50, previous/7).
MODELS = {
    "logistic_regression": (-1.5, 2.0, 1.0, 0.0, 0.5, -0.3),
    "decision_tree": (-1.0, 1.5, 0.0, 1.0, 0.0, 0.0),
    "random_forest": (-2.0, 2.5, 0.5, 0.5, 0.5, 0.0),
    "xgboost": (-1.2, 1.0, 1.5, 0.0, 0.0, 0.5),
    "svm": (-0.8, 0.5, 0.5, 0.5, 0.5, 0.5),
    "gradient_boosting": (-1.6, 2.2, 0.2, 0.2, 1.0, -0.2),
}
INPUTS = ["duration", "discount", "tax", "campaign", "previous"]
PRIMARY = "random_forest"


def _d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def score_sql(model: str) -> str:
    """``1 / (1 + exp(-z))`` as SQL text, valid in Spark SQL and DuckDB
    alike (DOUBLE literals, the same evaluation order)."""
    b0, b1, b2, b3, b4, b5 = MODELS[model]
    z = (f"({_d(b0)} + {_d(b1)} * (duration / {_d(1e5)}) + {_d(b2)} * (discount * {_d(10)}) "
         f"+ {_d(b3)} * (tax * {_d(10)}) + {_d(b4)} * (campaign / {_d(50)}) "
         f"+ {_d(b5)} * (previous / {_d(7)}))")
    # quantised to 1e-10 so both engines see the same value (and ties);
    # floor arithmetic instead of ROUND, which is a decimal op per row
    p = f"({_d(1)} / ({_d(1)} + exp(-{z})))"
    return f"(floor({p} * {_d(1e10)} + {_d(0.5)}) / {_d(1e10)})"


def scored_contacts(spark: SparkSession, sf_dir: str, extra: list[str] | None = None,
                    models: list[str] | None = None) -> DataFrame:
    """``contacts`` key + ``y`` + one score column per model (wide)."""
    models = models or list(MODELS)
    cols = sorted(set(["y", *INPUTS, *(extra or [])]), key=lambda c: c)
    df = contacts(spark, sf_dir, cols)
    return df.select(*KEY, *cols, *[F.expr(score_sql(m)).alias(f"p_{m}") for m in models])


def score_table(spark: SparkSession, sf_dir: str, models: list[str] | None = None) -> DataFrame:
    """Long ``(key, y, model, score)``: one row per contact and model
    (explode of a fixed-size array, no join)."""
    models = models or list(MODELS)
    wide = scored_contacts(spark, sf_dir, models=models)
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("score"))
                    for m in models])
    return wide.select(*KEY, "y", F.explode(arr).alias("s")).select(*KEY, "y", "s.model", "s.score")


def scored_sql(models: list[str] | None = None, extra: str = "") -> str:
    """CTE ``scored`` for the oracle: contacts + ``p_<model>`` columns."""
    models = models or list(MODELS)
    cols = ", ".join(f"{score_sql(m)} AS p_{m}" for m in models)
    return f"scored AS (SELECT *, {cols}{extra} FROM contacts)"


def score_table_sql(models: list[str] | None = None) -> str:
    """CTEs ``scored`` and ``score_long`` (model, score) for the oracle."""
    models = models or list(MODELS)
    parts = " UNION ALL ".join(
        f"SELECT {', '.join(KEY)}, y, '{m}' AS model, p_{m} AS score FROM scored" for m in models)
    return scored_sql(models) + f",\nscore_long AS ({parts})"


def with_scores(sql: str, *ctes: str, models: list[str] | None = None) -> str:
    return with_contacts(sql, score_table_sql(models), *ctes)
