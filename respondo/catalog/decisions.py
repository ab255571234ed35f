"""Evaluation and decisioning queries over
the deterministic score table and the ``customers`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from respondo.catalog.registry import register
from respondo.functions.scalar import dbl, r6
from respondo.operators import explain, metrics, rules, thresholds
from respondo.plans.contacts import KEY, with_contacts
from respondo.plans.customers import CUSTOMERS_SQL, customers
from respondo.plans.scores import (MODELS, PRIMARY, score_table, scored_contacts, scored_sql,
                                   with_scores)

CUT = 0.5          # default decision threshold for predictions
KEYS = ", ".join(KEY)
SCORES = {m: f"p_{m}" for m in MODELS}  # model -> its column of the wide scores


def _pred(df, t=CUT):
    return df.withColumn("pred", (F.col("score") >= dbl(t)).cast("int"))


def _conf_sql(src: str = "score_long", by: str = "model", t: float = CUT) -> str:
    return (f"SELECT {by}, count_if(y = 1 AND score >= {t!r}) AS tp, "
            f"count_if(y <> 1 AND score >= {t!r}) AS fp, count_if(y <> 1 AND score < {t!r}) AS tn, "
            f"count_if(y = 1 AND score < {t!r}) AS fn FROM {src} GROUP BY {by}")


def _metric_cols_sql(prefix: str = "") -> str:
    tp, fp, tn, fn = (f"{prefix}{c}" for c in ("tp", "fp", "tn", "fn"))
    prec = f"COALESCE(CAST({tp} AS DOUBLE) / NULLIF({tp} + {fp}, 0), 0.0)"
    rec = f"COALESCE(CAST({tp} AS DOUBLE) / NULLIF({tp} + {fn}, 0), 0.0)"
    return (f"ROUND(COALESCE(CAST({tp} + {tn} AS DOUBLE) / NULLIF({tp} + {fp} + {tn} + {fn}, 0), 0.0), 9) AS accuracy, "
            f"ROUND({prec}, 9) AS precision, ROUND({rec}, 9) AS recall, "
            f"ROUND(COALESCE(2.0 * {prec} * {rec} / NULLIF({prec} + {rec}, 0), 0.0), 9) AS f1")


@register("confusion_matrix", with_scores(_conf_sql()))
def q_confusion_matrix(spark, sf):
    return metrics.confusion(_pred(score_table(spark, sf)), by=["model"])


@register("binary_metrics", with_scores(
    f"SELECT model, tp, fp, tn, fn, {_metric_cols_sql()} FROM ({_conf_sql()})"))
def q_binary_metrics(spark, sf):
    conf = metrics.confusion(_pred(score_table(spark, sf)), by=["model"])
    return metrics.with_binary_metrics(conf)


def _auc_sql(src: str = "score_long", by: str = "model") -> str:
    return (f"SELECT {by}, ROUND(SUM(CAST(pos AS DOUBLE) * CAST(2 * neg_below + neg AS DOUBLE)) "
            f"/ (CAST(SUM(pos) AS DOUBLE) * SUM(neg) * 2.0), 9) AS roc_auc FROM ("
            f"SELECT {by}, score, pos, neg, COALESCE(SUM(neg) OVER (PARTITION BY {by} ORDER BY score "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM ("
            f"SELECT {by}, score, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM {src} "
            f"GROUP BY {by}, score)) GROUP BY {by}")


@register("roc_auc", with_scores(_auc_sql()))
def q_roc_auc(spark, sf):
    return metrics.roc_auc_wide(scored_contacts(spark, sf), SCORES)


@register("roc_curve", with_scores(
    "SELECT ROUND(score, 9) AS threshold, "
    "ROUND(CAST(P - pos_cum + pos AS DOUBLE) / P, 9) AS tpr, "
    "ROUND(CAST(N - neg_cum + neg AS DOUBLE) / N, 9) AS fpr FROM ("
    "SELECT score, pos, neg, SUM(pos) OVER w AS pos_cum, SUM(neg) OVER w AS neg_cum, "
    "SUM(pos) OVER () AS P, SUM(neg) OVER () AS N FROM ("
    "SELECT score, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM score_long "
    f"WHERE model = '{PRIMARY}' GROUP BY score) WINDOW w AS (ORDER BY score ROWS BETWEEN "
    "UNBOUNDED PRECEDING AND CURRENT ROW))"))
def q_roc_curve(spark, sf):
    s = score_table(spark, sf, [PRIMARY]).drop("model")
    pts = metrics.roc_points(s)
    return pts.select(r6("threshold").alias("threshold"), r6("tpr").alias("tpr"),
                      r6("fpr").alias("fpr"))


@register("classification_report", with_scores(
    "SELECT model, label, ROUND(precision, 9) AS precision, ROUND(recall, 9) AS recall, "
    "ROUND(f1_score, 9) AS f1_score, ROUND(support, 9) AS support FROM ("
    "SELECT model, '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM m UNION ALL "
    "SELECT model, '1', p1, r1, f1, s1 FROM m UNION ALL "
    "SELECT model, 'accuracy', acc, acc, acc, n FROM m UNION ALL "
    "SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM m UNION ALL "
    "SELECT model, 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, "
    "(f0 * s0 + f1 * s1) / n, n FROM m)",
    "c AS (" + _conf_sql() + ")",
    "b AS (SELECT model, tp, fp, tn, fn, CAST(tp + fp + tn + fn AS DOUBLE) AS n, "
    "CAST(tp + fn AS DOUBLE) AS s1, CAST(tn + fp AS DOUBLE) AS s0, "
    "COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0) AS p1, "
    "COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0) AS r1, "
    "COALESCE(CAST(tn AS DOUBLE) / NULLIF(tn + fn, 0), 0.0) AS p0, "
    "COALESCE(CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0), 0.0) AS r0, "
    "COALESCE(CAST(tp + tn AS DOUBLE) / NULLIF(tp + fp + tn + fn, 0), 0.0) AS acc FROM c)",
    "m AS (SELECT *, COALESCE(2.0 * p1 * r1 / NULLIF(p1 + r1, 0), 0.0) AS f1, "
    "COALESCE(2.0 * p0 * r0 / NULLIF(p0 + r0, 0), 0.0) AS f0 FROM b)"))
def q_classification_report(spark, sf):
    conf = metrics.confusion(_pred(score_table(spark, sf)), by=["model"])
    return metrics.classification_report(conf, by=["model"])


def _comparison_sql() -> str:
    return (f"SELECT c.model AS model_name, {_metric_cols_sql('c.')}, a.roc_auc, "
            f"row_number() OVER (ORDER BY COALESCE(2.0 * COALESCE(CAST(c.tp AS DOUBLE) / NULLIF(c.tp + c.fp, 0), 0.0) "
            f"* COALESCE(CAST(c.tp AS DOUBLE) / NULLIF(c.tp + c.fn, 0), 0.0) / NULLIF("
            f"COALESCE(CAST(c.tp AS DOUBLE) / NULLIF(c.tp + c.fp, 0), 0.0) + "
            f"COALESCE(CAST(c.tp AS DOUBLE) / NULLIF(c.tp + c.fn, 0), 0.0), 0), 0.0) DESC, c.model) = 1 AS is_best "
            f"FROM ({_conf_sql()}) c JOIN ({_auc_sql()}) a ON c.model = a.model")


@register("model_comparison", with_scores(_comparison_sql()))
def q_model_comparison(spark, sf):
    wide = scored_contacts(spark, sf)
    m = metrics.with_binary_metrics(metrics.confusion_wide(wide, SCORES, CUT), digits=None)
    auc = metrics.roc_auc_wide(wide, SCORES)
    from pyspark.sql import Window
    # one row per model: a bounded window
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("f1"), F.asc("model"))
    out = m.join(auc, "model").withColumn("is_best", F.row_number().over(w) == 1)
    return out.select(F.col("model").alias("model_name"),
                      *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")],
                      "roc_auc", "is_best")


N_MODELS = len(MODELS)


@register("vote_hard", with_contacts(
    f"SELECT 'hard_voting' AS model_name, {_metric_cols_sql()}, CAST(NULL AS DOUBLE) AS roc_auc "
    "FROM (SELECT count_if(y = 1 AND v = 1) AS tp, count_if(y <> 1 AND v = 1) AS fp, "
    "count_if(y <> 1 AND v = 0) AS tn, count_if(y = 1 AND v = 0) AS fn FROM ("
    f"SELECT y, CASE WHEN (" + " + ".join(f"CAST(p_{m} >= {CUT!r} AS INTEGER)" for m in MODELS)
    + f") * 2 > {N_MODELS} THEN 1 ELSE 0 END AS v FROM scored))",
    scored_sql()))
def q_vote_hard(spark, sf):
    wide = scored_contacts(spark, sf)
    votes = sum((F.col(f"p_{m}") >= dbl(CUT)).cast("int") for m in MODELS)
    # majority of n models; a tie goes to class 0
    v = wide.select("y", F.when(votes * 2 > N_MODELS, 1).otherwise(0).alias("pred"))
    m = metrics.with_binary_metrics(metrics.confusion(v))
    return m.select(F.lit("hard_voting").alias("model_name"), "accuracy", "precision",
                    "recall", "f1", F.lit(None).cast("double").alias("roc_auc"))


_AVG_SQL = "(" + " + ".join(f"p_{m}" for m in MODELS) + f") / {float(N_MODELS)!r}"


@register("vote_soft", with_contacts(
    f"SELECT 'soft_voting' AS model_name, {_metric_cols_sql('c.')}, a.roc_auc FROM "
    f"({_conf_sql('soft', 'g')}) c JOIN ({_auc_sql('soft', 'g')}) a ON c.g = a.g",
    scored_sql(),
    f"soft AS (SELECT 1 AS g, y, {_AVG_SQL} AS score FROM scored)"))
def q_vote_soft(spark, sf):
    wide = scored_contacts(spark, sf)
    # same summation order as the SQL: ((p1 + p2) + ...) / n
    avg = F.expr(_AVG_SQL)
    s = wide.select(F.lit(1).alias("g"), "y", avg.alias("score"))
    m = metrics.with_binary_metrics(metrics.confusion(_pred(s), by=["g"]))
    auc = metrics.roc_auc(s, by=["g"])
    return m.join(auc, "g").select(F.lit("soft_voting").alias("model_name"), "accuracy",
                                   "precision", "recall", "f1", "roc_auc")


# 70/30 hash split on the row key; integer arithmetic reproducible in SQL
SPLIT_BUCKET_SQL = (
    "((((l_orderkey % 1000003) * 7919 + (l_partkey % 1000003) * 104729 "
    "+ (l_suppkey % 1000003) * 1299709 + CAST(l_linenumber AS BIGINT) * 15485863) % 1000003) "
    "* 2654435761 % 4294967296) % 100")
TEST_PCT = 30


@register("accuracy_train_test", with_scores(
    "SELECT model, split, ROUND(AVG(CAST(CAST(score >= 0.5 AS INTEGER) = y AS DOUBLE)), 9) AS accuracy, "
    "COUNT(*) AS rows FROM (SELECT *, CASE WHEN " + SPLIT_BUCKET_SQL + f" < {TEST_PCT} THEN 'test' "
    "ELSE 'train' END AS split FROM score_long) GROUP BY model, split"))
def q_accuracy_train_test(spark, sf):
    st = _pred(score_table(spark, sf))
    split = F.when(F.expr(SPLIT_BUCKET_SQL) < TEST_PCT, "test").otherwise("train")
    return st.withColumn("split", split).groupBy("model", "split").agg(
        F.round(F.avg((F.col("pred") == F.col("y")).cast("double")), 9).alias("accuracy"),
        F.count(F.lit(1)).alias("rows"))


def _grid_sql(grid) -> str:
    vals = ", ".join(f"({i}, CAST({t!r} AS DOUBLE))"
                     for i, t in enumerate(thresholds.arange(*grid)))
    return f"grid AS (SELECT * FROM (VALUES {vals}) AS g(threshold_idx, threshold))"


def _sweep_counts_sql() -> str:
    return ("SELECT CAST(threshold_idx AS INTEGER) AS threshold_idx, threshold, "
            "count_if(y = 1 AND score >= threshold) AS tp, count_if(y <> 1 AND score >= threshold) AS fp, "
            "count_if(y <> 1 AND score < threshold) AS tn, count_if(y = 1 AND score < threshold) AS fn "
            f"FROM score_long, grid WHERE model = '{PRIMARY}' GROUP BY threshold_idx, threshold")


def _primary(spark, sf):
    return score_table(spark, sf, [PRIMARY]).drop("model")


@register("f1_threshold", with_scores(
    "SELECT threshold_idx, ROUND(threshold, 9) AS threshold, tp, fp, tn, fn, "
    "ROUND(precision, 9) AS precision, ROUND(recall, 9) AS recall, ROUND(f1, 9) AS f1, is_best, "
    "CASE WHEN is_best THEN ROUND(GREATEST(threshold, 0.5), 9) END AS chosen_threshold FROM ("
    "SELECT *, row_number() OVER (ORDER BY f1 DESC, threshold_idx) = 1 AS is_best FROM ("
    "SELECT *, COALESCE(2.0 * precision * recall / NULLIF(precision + recall, 0), 0.0) AS f1 FROM ("
    "SELECT *, COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0) AS precision, "
    "COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0) AS recall FROM ("
    + _sweep_counts_sql() + "))))", _grid_sql(thresholds.F1_GRID)))
def q_f1_threshold(spark, sf):
    s = thresholds.f1_sweep(_primary(spark, sf))
    return s.select("threshold_idx", r6("threshold").alias("threshold"), "tp", "fp", "tn", "fn",
                    r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1").alias("f1"), "is_best",
                    r6("chosen_threshold").alias("chosen_threshold"))


@register("pr_curve", with_scores(
    "SELECT threshold_idx, ROUND(threshold, 9) AS threshold, "
    "ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0), 9) AS precision, "
    "ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0), 9) AS recall FROM ("
    + _sweep_counts_sql() + ")", _grid_sql(thresholds.PROFIT_GRID)))
def q_pr_curve(spark, sf):
    c = thresholds.threshold_counts(_primary(spark, sf), thresholds.arange(*thresholds.PROFIT_GRID))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    from respondo.functions.scalar import safe_div
    return c.select("threshold_idx", r6("threshold").alias("threshold"),
                    r6(safe_div(tp, tp + fp)).alias("precision"),
                    r6(safe_div(tp, tp + fn)).alias("recall"))


C, R, M = thresholds.CALL_COST, thresholds.REVENUE_PER_SUCCESS, thresholds.MISSED_COST


@register("profit_sweep", with_scores(
    "SELECT threshold_idx, ROUND(threshold, 9) AS threshold, tp, fp, tn, fn, total_calls, total_cost, "
    "total_revenue, missed_opportunity_cost, profit, "
    "ROUND(CASE WHEN total_cost > 0 THEN CAST(profit AS DOUBLE) / total_cost ELSE 0.0 END, 9) AS roi, "
    "ROUND(CASE WHEN tp > 0 THEN CAST(total_cost AS DOUBLE) / tp ELSE CAST('inf' AS DOUBLE) END, 9) "
    "AS cost_per_acquisition, row_number() OVER (ORDER BY profit DESC, threshold_idx) = 1 AS is_best "
    f"FROM (SELECT *, tp + fp AS total_calls, (tp + fp) * {C} AS total_cost, tp * {R} AS total_revenue, "
    f"fn * {M} AS missed_opportunity_cost, tp * {R} - (tp + fp) * {C} - fn * {M} AS profit FROM ("
    + _sweep_counts_sql() + "))", _grid_sql(thresholds.PROFIT_GRID)))
def q_profit_sweep(spark, sf):
    s = thresholds.profit_sweep(_primary(spark, sf))
    return s.select("threshold_idx", r6("threshold").alias("threshold"), "tp", "fp", "tn", "fn",
                    "total_calls", "total_cost", "total_revenue", "missed_opportunity_cost",
                    "profit", r6("roi").alias("roi"),
                    r6("cost_per_acquisition").alias("cost_per_acquisition"), "is_best")


SIMPLE_THRESHOLDS = [0.1, 0.3, 0.5]


@register("profit_simple", with_scores(
    "SELECT ROUND(threshold, 9) AS threshold, "
    "ROUND(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 9) AS accuracy, "
    "ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0), 9) AS precision, "
    "ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0), 9) AS recall, "
    "ROUND(COALESCE(2.0 * (CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0)) * (CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0)) "
    "/ NULLIF(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) + CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0), 0.0), 9) AS f1, "
    f"tp AS true_positives, fp AS false_positives, tp + fp AS total_calls, (tp + fp) * {C} AS call_costs, "
    f"tp * {R} AS conversion_profits, tp * {R} - (tp + fp) * {C} AS net_profit, "
    f"ROUND(CASE WHEN (tp + fp) * {C} > 0 THEN CAST(tp * {R} - (tp + fp) * {C} AS DOUBLE) / ((tp + fp) * {C}) "
    "ELSE 0.0 END, 9) AS roi FROM (" + _sweep_counts_sql() + ")",
    "grid AS (SELECT * FROM (VALUES " + ", ".join(
        f"({i}, CAST({t!r} AS DOUBLE))" for i, t in enumerate(SIMPLE_THRESHOLDS))
    + ") AS g(threshold_idx, threshold))"))
def q_profit_simple(spark, sf):
    s = thresholds.profit_simple(_primary(spark, sf), SIMPLE_THRESHOLDS)
    return s.select(*[r6(c).alias(c) if c in ("threshold", "accuracy", "precision", "recall",
                                              "f1", "roi") else F.col(c) for c in s.columns])


# ---- customer-level rules, scores, bands and explanations ----------------

def with_customers(sql: str, *ctes: str) -> str:
    return with_contacts(sql, CUSTOMERS_SQL, *ctes)


@register("auto_approval", with_customers(
    f"SELECT {KEYS}, {rules.auto_rule_sql()} AS auto_rule, {rules.auto_reason_sql()} AS auto_reason, "
    f"({rules.auto_rule_sql()}) > 0 AS auto_approved FROM customers"))
def q_auto_approval(spark, sf):
    return rules.auto_approval(customers(spark, sf)).select(
        *KEY, "auto_rule", "auto_reason", "auto_approved")


DECISION_T = 0.5


@register("decide", with_customers(
    f"SELECT {KEYS}, (p >= {DECISION_T!r} OR ({rules.auto_rule_sql()}) > 0) AS approved, "
    f"ROUND(CASE WHEN ({rules.auto_rule_sql()}) > 0 THEN 0.7 ELSE p END, 9) AS display_p FROM customers"))
def q_decide(spark, sf):
    d = rules.decide(rules.auto_approval(customers(spark, sf)), DECISION_T)
    return d.select(*KEY, "approved", r6("display_p").alias("display_p"))


def _band_case(x: str) -> str:
    return ("CASE " + " ".join(f"WHEN {x} >= {lo!r} THEN '{n}'" for lo, n in rules.BANDS)
            + " ELSE 'very_low' END")


@register("probability_band", with_customers(
    f"SELECT {KEYS}, {_band_case('dp')} AS band FROM (SELECT *, CASE WHEN ({rules.auto_rule_sql()}) > 0 "
    "THEN 0.7 ELSE p END AS dp FROM customers)"))
def q_probability_band(spark, sf):
    d = rules.decide(rules.auto_approval(customers(spark, sf)), DECISION_T)
    return d.select(*KEY, rules.probability_band(F.col("display_p")).alias("band"))


@register("recommendation_band", with_customers(
    f"SELECT {KEYS}, CASE WHEN p > 0.7 THEN 'high_potential' WHEN p > {DECISION_T!r} THEN "
    "'medium_high_potential' WHEN p > 0.3 THEN 'low_medium_potential' ELSE 'low_potential' END "
    "AS recommendation FROM customers"))
def q_recommendation_band(spark, sf):
    c = customers(spark, sf)
    return c.select(*KEY, rules.recommendation_band(F.col("p"), DECISION_T).alias("recommendation"))


def _scaled_sql(name: str, x: str) -> str:
    off, div, cap = rules.DOMAIN_SCALE[name]
    v = f"({x} + {off!r}) / {div!r}" if off else f"{x} / {div!r}"
    v = f"LEAST(1.0, {v})" if cap else v
    if name == "pdays":
        v = f"CASE WHEN {x} = -1 THEN 0.0 ELSE {v} END"
    return v


SCALED = ["duration", "pdays", "previous", "age", "emp_var_rate", "euribor3m"]


@register("minmax_domain_scale", with_customers(
    f"SELECT {KEYS}, " + ", ".join(
        f"ROUND({_scaled_sql(c, f'CAST({c} AS DOUBLE)')}, 9) AS {c}_scaled" for c in SCALED)
    + " FROM customers"))
def q_minmax_domain_scale(spark, sf):
    s = rules.minmax_domain_scale(customers(spark, sf), SCALED)
    return s.select(*KEY, *[r6(f"{c}_scaled").alias(f"{c}_scaled") for c in SCALED])


def _sig_sql(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-4.0 * ({x} - 0.5))))"


_DUR_S = _scaled_sql("duration", "CAST(duration AS DOUBLE)")
_PD_S = _scaled_sql("pdays", "CAST(pdays AS DOUBLE)")
_PR_S = _scaled_sql("previous", "CAST(previous AS DOUBLE)")


def _base_rate_sql() -> str:
    pf = f"CASE WHEN {_PD_S} <= 0 THEN 0.8 ELSE 1.1 END"
    rf = (f"CASE WHEN {_PR_S} > 0 AND {_PR_S} <= 0.3 THEN 1.1 WHEN {_PR_S} > 0.3 THEN 0.9 "
          "ELSE 1.0 END")
    raw = f"(0.11 + ({_sig_sql(_DUR_S)} - 0.5) * 0.15 * {pf} * {rf})"
    return f"GREATEST(0.05, LEAST(0.7, {raw}))"


def _fallback_sql() -> str:
    return f"GREATEST(0.05, LEAST(0.6, 0.11 + ({_sig_sql(_DUR_S)} - 0.5) * 0.12))"


def _scaled_inputs(c):
    return (rules.domain_scale("duration", F.col("duration").cast("double")),
            rules.domain_scale("pdays", F.col("pdays").cast("double")),
            rules.domain_scale("previous", F.col("previous").cast("double")))


@register("base_rate_score", with_customers(
    f"SELECT {KEYS}, ROUND({_base_rate_sql()}, 9) AS base_rate_p FROM customers"))
def q_base_rate_score(spark, sf):
    c = customers(spark, sf)
    d, pd_, pr = _scaled_inputs(c)
    return c.select(*KEY, r6(rules.base_rate_score(d, pd_, pr)).alias("base_rate_p"))


@register("fallback_score", with_customers(
    f"SELECT {KEYS}, ROUND({_fallback_sql()}, 9) AS fallback_p FROM customers"))
def q_fallback_score(spark, sf):
    c = customers(spark, sf)
    d, _, _ = _scaled_inputs(c)
    return c.select(*KEY, r6(rules.fallback_score(d)).alias("fallback_p"))


# Which model scores exist for a row: a model is "unavailable" (NULL score)
# for rows missing one of its inputs, simulated here by value conditions.
@register("score_with_fallback", with_contacts(
    f"SELECT {KEYS}, ROUND(COALESCE(s_xgboost, s_stacking, s_random_forest, s_logistic, fb), 9) AS score, "
    "CASE WHEN s_xgboost IS NOT NULL THEN 'xgboost' WHEN s_stacking IS NOT NULL THEN 'stacking' "
    "WHEN s_random_forest IS NOT NULL THEN 'random_forest' WHEN s_logistic IS NOT NULL THEN 'logistic' "
    "ELSE 'formula' END AS source FROM (SELECT *, CASE WHEN discount <> 0 THEN p_xgboost END AS s_xgboost, "
    "CASE WHEN tax <> 0 THEN p_gradient_boosting END AS s_stacking, "
    "CASE WHEN campaign > 25 THEN p_random_forest END AS s_random_forest, "
    "CASE WHEN campaign > 45 THEN p_logistic_regression END AS s_logistic, "
    f"GREATEST(0.05, LEAST(0.6, 0.11 + ({_sig_sql('LEAST(1.0, duration / CAST(100.0 AS DOUBLE) / 1000.0)')} "
    "- 0.5) * 0.12)) AS fb FROM scored)",
    scored_sql()))
def q_score_with_fallback(spark, sf):
    w = scored_contacts(spark, sf)
    avail = {
        "xgboost": F.when(F.col("discount") != 0, F.col("p_xgboost")),
        "stacking": F.when(F.col("tax") != 0, F.col("p_gradient_boosting")),
        "random_forest": F.when(F.col("campaign") > 25, F.col("p_random_forest")),
        "logistic": F.when(F.col("campaign") > 45, F.col("p_logistic_regression")),
    }
    dur_s = F.least(dbl(1.0), F.col("duration") / dbl(100.0) / dbl(1000.0))
    score, source = rules.score_with_fallback("xgboost", avail, rules.fallback_score(dur_s))
    return w.select(*KEY, r6(score).alias("score"), source.alias("source"))


@register("negative_signal_adjust", with_customers(
    f"SELECT {KEYS}, ROUND(CASE WHEN duration > 500 AND p > 0.5 AND "
    "((CASE WHEN poutcome IN ('nonexistent', 'failure') THEN 1 ELSE 0 END) + "
    "(CASE WHEN previous = 0 THEN 1 ELSE 0 END) + (CASE WHEN pdays = -1 THEN 1 ELSE 0 END)) >= 2 "
    "THEN GREATEST(0.3, p * 0.7) ELSE p END, 9) AS adjusted_p FROM customers"))
def q_negative_signal_adjust(spark, sf):
    c = customers(spark, sf)
    adj = rules.negative_signal_adjust(F.col("p"), F.col("duration"), F.col("poutcome"),
                                       F.col("previous"), F.col("pdays"))
    return c.select(*KEY, r6(adj).alias("adjusted_p"))


@register("bucket_response", with_customers(
    "SELECT band, COUNT(*) AS rows, CAST(SUM(y) AS BIGINT) AS positives, "
    "ROUND(CAST(SUM(y) AS DOUBLE) / COUNT(*) * 100.0, 9) AS rate_pct, ROUND(AVG(p), 9) AS mean_p FROM ("
    "SELECT *, CASE " + " ".join(f"WHEN duration <= {b} THEN '{n}'" for b, n in rules.DURATION_BANDS)
    + " ELSE '>1000' END AS band FROM customers) GROUP BY band"))
def q_bucket_response(spark, sf):
    from respondo.functions.scalar import pct
    c = customers(spark, sf)
    return c.groupBy(rules.duration_band(F.col("duration")).alias("band")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y").cast("long").alias("positives"),
        pct(F.sum("y"), F.count(F.lit(1))).alias("rate_pct"), r6(F.avg("p")).alias("mean_p"))


@register("reliability_bins", with_customers(
    "SELECT LEAST(9, CAST(FLOOR(p * 10.0) AS INTEGER)) AS bin, COUNT(*) AS rows, "
    "ROUND(AVG(p), 9) AS mean_p, ROUND(AVG(CAST(y AS DOUBLE)), 9) AS observed FROM customers GROUP BY bin"))
def q_reliability_bins(spark, sf):
    c = customers(spark, sf)
    return c.groupBy(rules.reliability_bin(F.col("p")).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), r6(F.avg("p")).alias("mean_p"),
        r6(F.avg(F.col("y").cast("double"))).alias("observed"))


@register("factor_explain", with_customers(
    f"SELECT {KEYS}, ordinal, kind, factor, code FROM ("
    f"SELECT {KEYS}, 0 AS ordinal, 'primary' AS kind, 'duration' AS factor, CASE WHEN duration > 500 THEN "
    "'very_long' WHEN duration > 300 THEN 'long' WHEN duration > 180 THEN 'average' ELSE 'short' END AS code FROM customers "
    f"UNION ALL SELECT {KEYS}, 1, CASE WHEN poutcome = 'success' THEN 'primary' ELSE 'supporting' END, 'poutcome', "
    "CASE WHEN poutcome = 'success' THEN 'success' WHEN poutcome = 'failure' THEN 'failure' ELSE 'none' END FROM customers "
    f"UNION ALL SELECT {KEYS}, 2, 'supporting', 'pdays', CASE WHEN pdays = -1 THEN 'never_contacted' "
    "WHEN pdays < 30 THEN 'recent' ELSE 'long_ago' END FROM customers "
    f"UNION ALL SELECT {KEYS}, 3, CASE WHEN previous <= 3 THEN 'supporting' ELSE 'contradicting' END, 'previous', "
    "CASE WHEN previous = 0 THEN 'none' WHEN previous <= 3 THEN 'some' ELSE 'many' END FROM customers "
    f"UNION ALL SELECT {KEYS}, 4, 'supporting', 'contact', CASE WHEN contact = 'cellular' THEN 'cellular' "
    "ELSE 'landline' END FROM customers "
    f"UNION ALL SELECT {KEYS}, 5, CASE WHEN emp_var_rate > 0 THEN 'contradicting' ELSE 'supporting' END, "
    "'emp_var_rate', CASE WHEN emp_var_rate > 0 THEN 'high' ELSE 'low' END FROM customers "
    f"UNION ALL SELECT {KEYS}, 6, CASE WHEN euribor3m > 4 THEN 'supporting' ELSE 'contradicting' END, "
    "'euribor3m', CASE WHEN euribor3m > 4 THEN 'high' ELSE 'low' END FROM customers)"))
def q_factor_explain(spark, sf):
    return explain.factor_explain(customers(spark, sf), KEY)


def _ranking_sql() -> str:
    items = [
        ("duration", "CASE WHEN duration > 300 THEN 0.95 ELSE 0.5 END",
         "CASE WHEN duration > 500 THEN 'high_positive' WHEN duration > 300 THEN 'positive' "
         "WHEN duration > 180 THEN 'neutral' ELSE 'negative' END"),
        ("pdays", "0.40", "CASE WHEN pdays = -1 THEN 'slightly_negative' WHEN pdays < 30 THEN "
                          "'positive' ELSE 'slightly_negative' END"),
        ("poutcome", "CASE WHEN poutcome = 'success' THEN 0.85 ELSE 0.30 END",
         "CASE WHEN poutcome = 'success' THEN 'high_positive' WHEN poutcome = 'failure' THEN "
         "'negative' ELSE 'neutral' END"),
        ("previous", "CASE WHEN previous > 0 AND previous <= 3 THEN 0.60 ELSE 0.15 END",
         "CASE WHEN previous > 0 AND previous <= 3 THEN 'positive' WHEN previous > 3 THEN "
         "'negative' ELSE 'slightly_negative' END"),
        ("contact", "CASE WHEN contact = 'cellular' THEN 0.35 ELSE 0.20 END",
         "CASE WHEN contact = 'cellular' THEN 'positive' ELSE 'slightly_negative' END"),
        ("euribor3m", "CASE WHEN euribor3m > 4.0 THEN 0.45 ELSE 0.25 END",
         "CASE WHEN euribor3m > 4.0 THEN 'positive' ELSE 'neutral' END"),
    ]
    parts = " UNION ALL ".join(
        f"SELECT {KEYS}, {i} AS ordinal, '{f}' AS factor, CAST({imp} AS DOUBLE) AS importance, "
        f"{imp_l} AS impact, rid FROM customers_r" for i, (f, imp, imp_l) in enumerate(items))
    # ranks are per input row: ``rid`` tells rows apart even if a key repeats
    return (f"SELECT {KEYS}, CAST(row_number() OVER (PARTITION BY rid ORDER BY importance DESC, "
            f"ordinal) AS INTEGER) AS rank, factor, importance, impact FROM ({parts})")


@register("factor_ranking", with_customers(
    _ranking_sql(), "customers_r AS (SELECT *, row_number() OVER () AS rid FROM customers)"))
def q_factor_ranking(spark, sf):
    r = explain.factor_ranking(customers(spark, sf), KEY)
    return r.select(*KEY, F.col("rank").cast("int"), "factor", "importance", "impact")


@register("interaction_flags", with_customers(
    f"SELECT {KEYS}, flag FROM (SELECT {KEYS}, UNNEST(CASE WHEN len(f) = 0 THEN ['none'] ELSE f END) AS flag "
    "FROM (SELECT *, list_filter([CASE WHEN duration > 400 AND poutcome = 'success' THEN 'strong_positive' END, "
    "CASE WHEN duration < 200 AND poutcome = 'failure' THEN 'strong_negative' END, "
    "CASE WHEN pdays = -1 AND previous = 0 THEN 'new_relationship' END, "
    "CASE WHEN duration > 300 AND contact = 'cellular' AND euribor3m > 4.0 THEN 'opportunity' END], "
    "lambda x: x IS NOT NULL) AS f FROM customers))"))
def q_interaction_flags(spark, sf):
    return explain.interaction_flags(customers(spark, sf), KEY)


@register("profile_compare", with_customers(
    f"SELECT {KEYS}, 'duration' AS feature, CASE WHEN duration > 400 THEN 'positive' WHEN duration < 250 "
    "THEN 'negative' ELSE 'neutral' END AS verdict FROM customers UNION ALL "
    f"SELECT {KEYS}, 'pdays', CASE WHEN pdays <> -1 AND pdays < 60 THEN 'positive' ELSE 'neutral' END FROM customers "
    f"UNION ALL SELECT {KEYS}, 'poutcome', CASE WHEN poutcome = 'success' THEN 'positive' WHEN poutcome = "
    "'failure' THEN 'negative' ELSE 'neutral' END FROM customers UNION ALL "
    f"SELECT {KEYS}, 'contact', CASE WHEN contact = 'cellular' THEN 'positive' ELSE 'neutral' END FROM customers "
    f"UNION ALL SELECT {KEYS}, 'euribor3m', CASE WHEN euribor3m > 4.0 THEN 'positive' ELSE 'neutral' END FROM customers"))
def q_profile_compare(spark, sf):
    return explain.profile_compare(customers(spark, sf), KEY)
