"""Per-row explanations as arrays of structs, exploded to long rows.

Each input row yields a fixed, small number of output rows (no group is
ever gathered); ranking inside a row is arithmetic over the row's own
values, inside the projection (no window, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondo.functions.scalar import dbl, first_match


def _fact(kind: Column | str, factor: str, code: Column | str) -> Column:
    k = kind if isinstance(kind, Column) else F.lit(kind)
    c = code if isinstance(code, Column) else F.lit(code)
    return F.struct(k.alias("kind"), F.lit(factor).alias("factor"), c.alias("code"))


def factor_explain(df: DataFrame, key: list[str]) -> DataFrame:
    """Primary / supporting / contradicting factors from seven feature rules
    -> ``(key..., ordinal, kind, factor, code)``."""
    d, po, pd_, pr = F.col("duration"), F.col("poutcome"), F.col("pdays"), F.col("previous")
    facts = F.array(
        _fact("primary", "duration", first_match(
            [(d > 500, "very_long"), (d > 300, "long"), (d > 180, "average")], "short")),
        F.when(po == "success", _fact("primary", "poutcome", "success"))
         .when(po == "failure", _fact("supporting", "poutcome", "failure"))
         .otherwise(_fact("supporting", "poutcome", "none")),
        _fact("supporting", "pdays", first_match(
            [(pd_ == -1, "never_contacted"), (pd_ < 30, "recent")], "long_ago")),
        F.when(pr == 0, _fact("supporting", "previous", "none"))
         .when(pr <= 3, _fact("supporting", "previous", "some"))
         .otherwise(_fact("contradicting", "previous", "many")),
        _fact("supporting", "contact",
              F.when(F.col("contact") == "cellular", "cellular").otherwise("landline")),
        F.when(F.col("emp_var_rate") > 0, _fact("contradicting", "emp_var_rate", "high"))
         .otherwise(_fact("supporting", "emp_var_rate", "low")),
        F.when(F.col("euribor3m") > 4, _fact("supporting", "euribor3m", "high"))
         .otherwise(_fact("contradicting", "euribor3m", "low")),
    )
    return df.select(*key, F.posexplode(facts).alias("ordinal", "f")) \
        .select(*key, "ordinal", "f.kind", "f.factor", "f.code")


# Importance and impact label of six key factors.
def _ranked(factor: str, importance: Column, impact: Column, ordinal: int) -> Column:
    return F.struct(F.lit(factor).alias("factor"), importance.alias("importance"),
                    impact.alias("impact"), F.lit(ordinal).alias("ordinal"))


def factor_ranking(df: DataFrame, key: list[str]) -> DataFrame:
    """Six factors with importance and impact, ranked by importance
    (descending, stable) -> ``(key..., rank, factor, importance, impact)``."""
    d, pd_, po = F.col("duration"), F.col("pdays"), F.col("poutcome")
    pr, ct, eu = F.col("previous"), F.col("contact"), F.col("euribor3m")
    items = F.array(
        _ranked("duration", F.when(d > 300, dbl(0.95)).otherwise(dbl(0.5)),
                first_match([(d > 500, "high_positive"), (d > 300, "positive"),
                             (d > 180, "neutral")], "negative"), 0),
        _ranked("pdays", dbl(0.40), first_match(
            [(pd_ == -1, "slightly_negative"), (pd_ < 30, "positive")], "slightly_negative"), 1),
        _ranked("poutcome", F.when(po == "success", dbl(0.85)).otherwise(dbl(0.30)),
                first_match([(po == "success", "high_positive"), (po == "failure", "negative")],
                            "neutral"), 2),
        _ranked("previous", F.when((pr > 0) & (pr <= 3), dbl(0.60)).otherwise(dbl(0.15)),
                first_match([((pr > 0) & (pr <= 3), "positive"), (pr > 3, "negative")],
                            "slightly_negative"), 3),
        _ranked("contact", F.when(ct == "cellular", dbl(0.35)).otherwise(dbl(0.20)),
                F.when(ct == "cellular", "positive").otherwise("slightly_negative"), 4),
        _ranked("euribor3m", F.when(eu > 4.0, dbl(0.45)).otherwise(dbl(0.25)),
                F.when(eu > 4.0, "positive").otherwise("neutral"), 5),
    )
    # stable descending rank: 1 + number of items ahead (higher importance,
    # or equal importance and earlier) -- comparisons of the row's own
    # values on materialised columns, no sort and no window
    n = 6
    cols = df.select(*key, *[items[i]["importance"].alias(f"_imp{i}") for i in range(n)],
                     *[items[i]["impact"].alias(f"_impact{i}") for i in range(n)],
                     *[items[i]["factor"].alias(f"_factor{i}") for i in range(n)])
    imp = [F.col(f"_imp{i}") for i in range(n)]
    ranks = []
    for i in range(n):
        ahead = [F.when((imp[j] > imp[i]) | ((imp[j] == imp[i]) & F.lit(j < i)), 1).otherwise(0)
                 for j in range(n) if j != i]
        ranks.append(F.lit(1) + sum(ahead[1:], ahead[0]))
    ranked = F.array(*[F.struct(ranks[i].alias("rank"), F.col(f"_factor{i}").alias("factor"),
                                imp[i].alias("importance"), F.col(f"_impact{i}").alias("impact"))
                       for i in range(n)])
    return cols.select(*key, F.inline(ranked))


def interaction_flags(df: DataFrame, key: list[str]) -> DataFrame:
    """Conjunctive patterns per row; ``none`` when no pattern applies."""
    d, po = F.col("duration"), F.col("poutcome")
    flags = F.array_compact(F.array(
        F.when((d > 400) & (po == "success"), "strong_positive"),
        F.when((d < 200) & (po == "failure"), "strong_negative"),
        F.when((F.col("pdays") == -1) & (F.col("previous") == 0), "new_relationship"),
        F.when((d > 300) & (F.col("contact") == "cellular") & (F.col("euribor3m") > 4.0),
               "opportunity"),
    ))
    flags = F.when(F.size(flags) == 0, F.array(F.lit("none"))).otherwise(flags)
    return df.select(*key, F.explode(flags).alias("flag"))


def _verdict(feature: str, verdict: Column) -> Column:
    return F.struct(F.lit(feature).alias("feature"), verdict.alias("verdict"))


def profile_compare(df: DataFrame, key: list[str]) -> DataFrame:
    """This row vs. typical subscriber thresholds, five features ->
    ``(key..., feature, verdict)`` with verdict positive/negative/neutral."""
    d, pd_, po = F.col("duration"), F.col("pdays"), F.col("poutcome")
    rows = F.array(
        _verdict("duration", first_match([(d > 400, "positive"), (d < 250, "negative")],
                                         "neutral")),
        _verdict("pdays", F.when((pd_ != -1) & (pd_ < 60), "positive").otherwise("neutral")),
        _verdict("poutcome", first_match(
            [(po == "success", "positive"), (po == "failure", "negative")], "neutral")),
        _verdict("contact", F.when(F.col("contact") == "cellular", "positive")
                 .otherwise("neutral")),
        _verdict("euribor3m", F.when(F.col("euribor3m") > 4.0, "positive").otherwise("neutral")),
    )
    return df.select(*key, F.inline(rows))
