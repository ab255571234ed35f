"""Projection, filter, join, sort, set and scalar queries plus feature
preparation (SURVEY §2.2, 2.3, 2.6-2.9; all S-checked)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from respondo.catalog.registry import register
from respondo.functions.scalar import pct, r6, sigmoid
from respondo.operators import features, profile, rules, splits, thresholds
from respondo.operators.segments import segment_response_rate
from respondo.plans.contacts import DOMAINS, KEY, NUMERIC, ROLES, contacts, with_contacts
from respondo.plans.customers import CUSTOMERS_SQL, customers
from respondo.plans.documents import LABELLED_SQL, labelled_documents
from respondo.sources.tables import load

KEYS = ", ".join(KEY)
ALL_COLS = KEY + ROLES


def _cols(cols):
    return ", ".join(cols)


# ---- projections ------------------------------------------------------------

@register("project_drop", with_contacts(
    f"SELECT {_cols([c for c in ALL_COLS if c != 'y'])} FROM contacts"))
def q_project_drop(spark, sf):
    return contacts(spark, sf).drop("y")


@register("project_by_type", with_contacts(
    f"SELECT {_cols(KEY + NUMERIC)} FROM contacts"))
def q_project_by_type(spark, sf):
    df = contacts(spark, sf)
    nums = [c for c in profile.numeric_columns(df) if c not in KEY and c != "y"]
    return df.select(*KEY, *nums)


PROJECT_LIST = ["duration", "pdays", "previous", "y"]


@register("project_list", with_contacts(f"SELECT {_cols(KEY + PROJECT_LIST)} FROM contacts"))
def q_project_list(spark, sf):
    return contacts(spark, sf).select(*KEY, *PROJECT_LIST)


POSITIONS = [0, 1, 2, 3, 4, 5, 9, 14]


@register("project_positions", with_contacts(
    f"SELECT {_cols([ALL_COLS[i] for i in POSITIONS])} FROM contacts"))
def q_project_positions(spark, sf):
    df = contacts(spark, sf)
    return df.select(*[df.columns[i] for i in POSITIONS])


# ---- filters -------------------------------------------------------------------

FILTERS = {
    "filter_eq": "y = 1",
    "filter_range": "duration >= 50000",
    "filter_conjunction": "poutcome = 'F' AND duration >= 50000 AND pdays < 30",
    "filter_membership": "job IN ('HOUSEHOLD', 'MACHINERY')",
}


def _filter_query(pred: str):
    def q(spark, sf):
        df = contacts(spark, sf, ["y", "duration", "poutcome", "pdays", "job"])
        return df.where(F.expr(pred)).select(*KEY, "duration")
    return q


for _name, _pred in FILTERS.items():
    register(_name, with_contacts(f"SELECT {KEYS}, duration FROM contacts WHERE {_pred}"))(
        _filter_query(_pred))


@register("recode_map", with_contacts(
    f"SELECT {KEYS}, CASE y WHEN 1 THEN 'yes' ELSE 'no' END AS y_label, "
    "CASE CASE y WHEN 1 THEN 'yes' ELSE 'no' END WHEN 'yes' THEN 1 ELSE 0 END AS y_back FROM contacts"))
def q_recode_map(spark, sf):
    df = contacts(spark, sf, ["y"])
    lab = F.create_map(F.lit(1), F.lit("yes"), F.lit(0), F.lit("no"))[F.col("y")]
    back = F.create_map(F.lit("yes"), F.lit(1), F.lit("no"), F.lit(0))
    return df.select(*KEY, lab.alias("y_label")).withColumn("y_back", back[F.col("y_label")])


@register("label_encode", with_contacts(
    f"SELECT {KEYS}, job, CAST(dense_rank() OVER (ORDER BY job) - 1 AS INTEGER) AS job_code FROM contacts"))
def q_label_encode(spark, sf):
    df = contacts(spark, sf, ["job"])
    return features.label_encode(df, "job").select(*KEY, "job", "job_code")


# ---- joins ------------------------------------------------------------------------

ONEHOT_COLS = list(DOMAINS)


def _onehot_sql(drop_first: bool = True) -> list[str]:
    out = []
    for c, vals in DOMAINS.items():
        for v in (vals[1:] if drop_first else vals):
            out.append(f"COALESCE(CAST({c} = '{v}' AS DOUBLE), 0.0) AS \"{c}_{v}\"")
    return out


@register("align_features", with_contacts(
    f"SELECT {KEYS}, {_cols(NUMERIC)}, {', '.join(_onehot_sql())} FROM contacts"))
def q_align_features(spark, sf):
    """The reference concatenates a numeric and an encoded block by row
    position; here both blocks come out of one projection (no join)."""
    df = contacts(spark, sf)
    vocab = features.fit_categories(df, ONEHOT_COLS)
    return df.select(*KEY, *NUMERIC, *features.one_hot(vocab))


@register("align_target", with_contacts(
    f"SELECT {KEYS}, duration, pdays, y FROM contacts"))
def q_align_target(spark, sf):
    """Features and target come out of one projection: the key is not unique,
    so a join on it would multiply rows."""
    return contacts(spark, sf, ["duration", "pdays", "y"]).select(*KEY, "duration", "pdays", "y")


# ---- sorts / top-k / set ops ------------------------------------------------------

@register("head_n", with_contacts(
    f"SELECT {KEYS}, duration, y FROM contacts ORDER BY {KEYS} LIMIT 5"))
def q_head_n(spark, sf):
    return contacts(spark, sf, ["duration", "y"]).orderBy(*KEY).limit(5)


def _rates_sql(cols=("job", "education")) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, y "
                               f"FROM contacts" for c in cols)
    return (f"SELECT feature, value, ROUND(CAST(SUM(y) AS DOUBLE) / COUNT(*) * 100.0, 9) AS rate_pct "
            f"FROM ({parts}) GROUP BY feature, value")


@register("sort_desc", with_contacts(
    "SELECT feature, value, rate_pct, CAST(row_number() OVER (ORDER BY rate_pct DESC, feature, value) "
    f"AS INTEGER) AS position FROM ({_rates_sql()})"))
def q_sort_desc(spark, sf):
    r = segment_response_rate(contacts(spark, sf, ["y", "job", "education"], key=False),
                              ["job", "education"]).select("feature", "value", "rate_pct")
    # ordering an aggregated table (one row per category)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("rate_pct"), "feature", "value")
    return r.withColumn("position", F.row_number().over(w).cast("int"))


@register("argmax_row", with_contacts(
    "SELECT feature, value, rate_pct FROM (" + _rates_sql() + ") ORDER BY rate_pct DESC, feature, value LIMIT 1"))
def q_argmax_row(spark, sf):
    r = segment_response_rate(contacts(spark, sf, ["y", "job", "education"], key=False),
                              ["job", "education"]).select("feature", "value", "rate_pct")
    return r.orderBy(F.desc("rate_pct"), "feature", "value").limit(1)


@register("union_results", with_contacts(
    "SELECT 'job' AS source, feature, value, rate_pct FROM (" + _rates_sql(["job"]) + ") UNION ALL "
    "SELECT 'education', feature, value, rate_pct FROM (" + _rates_sql(["education"]) + ")"))
def q_union_results(spark, sf):
    df = contacts(spark, sf, ["y", "job", "education"], key=False)
    parts = []
    for c in ["job", "education"]:
        r = segment_response_rate(df, [c]).select(F.lit(c).alias("source"), "feature", "value",
                                                  "rate_pct")
        parts.append(r)
    return parts[0].unionByName(parts[1])


# ---- scalar expressions -----------------------------------------------------------

@register("str_replace",
          "SELECT o_orderkey, replace(o_orderpriority, '-', ' ') AS priority_text FROM orders")
def q_str_replace(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", F.replace("o_orderpriority", F.lit("-"), F.lit(" "))
                    .alias("priority_text"))


@register("str_split",
          "SELECT o_orderkey, CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS priority_rank, "
          "split_part(o_orderpriority, '-', 2) AS priority_name FROM orders")
def q_str_split(spark, sf):
    o = load(spark, sf, "orders")
    parts = F.split("o_orderpriority", "-", 2)
    return o.select("o_orderkey", parts.getItem(0).cast("int").alias("priority_rank"),
                    parts.getItem(1).alias("priority_name"))


PARSE_PREFIXES = ["job", "contact", "poutcome", "day_of_week"]


def _feature_names_df(spark, sf):
    df = contacts(spark, sf, PARSE_PREFIXES, key=False)
    long = df.select(*[F.col(c).cast("string").alias(c) for c in PARSE_PREFIXES]) \
        .unpivot([], PARSE_PREFIXES, "feature", "value").distinct()
    return long.select(F.concat_ws("_", "feature", "value").alias("feature_name"))


def _parse_expr(name):
    """``prefix_parse``: the source column by prefix and the category taken
    from the ``_``-split name. As in the reference, ``day_of_week_*`` names
    read the 3rd part (which is ``week``), other prefixes the 2nd."""
    n = F.col(name)
    src = F.when(n.startswith("day_of_week_"), "day_of_week")
    val = F.when(n.startswith("day_of_week_"), F.split_part(n, F.lit("_"), F.lit(3)))
    for p in ["job", "contact", "poutcome"]:
        src = src.when(n.startswith(f"{p}_"), p)
        val = val.when(n.startswith(f"{p}_"), F.split_part(n, F.lit("_"), F.lit(2)))
    return src.alias("source_column"), val.alias("category")


@register("prefix_parse", with_contacts(
    "SELECT feature_name, CASE WHEN starts_with(feature_name, 'day_of_week_') THEN 'day_of_week' "
    + " ".join(f"WHEN starts_with(feature_name, '{p}_') THEN '{p}'" for p in ["job", "contact", "poutcome"])
    + " END AS source_column, CASE WHEN starts_with(feature_name, 'day_of_week_') THEN "
    "split_part(feature_name, '_', 3) "
    + " ".join(f"WHEN starts_with(feature_name, '{p}_') THEN split_part(feature_name, '_', 2)"
               for p in ["job", "contact", "poutcome"])
    + " END AS category FROM (SELECT DISTINCT feature || '_' || value AS feature_name FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM contacts"
                         for c in PARSE_PREFIXES) + "))"))
def q_prefix_parse(spark, sf):
    names = _feature_names_df(spark, sf)
    src, val = _parse_expr("feature_name")
    return names.select("feature_name", src, val)


@register("pct_round", with_contacts(
    "SELECT feature, value, CAST(ROUND(CAST(CAST(SUM(y) AS DOUBLE) / COUNT(*) * 100.0 AS DECIMAL(38, 10)), 2) "
    "AS DOUBLE) AS rate_pct_2 FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, y FROM contacts"
        for c in ["job", "education", "marital"]) + ") GROUP BY feature, value"))
def q_pct_round(spark, sf):
    df = contacts(spark, sf, ["y", "job", "education", "marital"], key=False)
    r = segment_response_rate(df, ["job", "education", "marital"])
    raw = pct(F.col("positives"), F.col("rows"), digits=None)
    # decimal rounding (HALF_UP on the decimal value), identical in any engine
    return r.select("feature", "value", F.round(raw.cast("decimal(38,10)"), 2).cast("double")
                    .alias("rate_pct_2"))


PROBES = {"contact_telephone": ("contact", "telephone"),
          "poutcome_nonexistent": ("poutcome", "nonexistent"),
          "poutcome_success": ("poutcome", "success"),
          "job_student": ("job", "student")}


def with_customers(sql: str, *ctes: str) -> str:
    return with_contacts(sql, CUSTOMERS_SQL, *ctes)


@register("one_hot_probe", with_customers(
    f"SELECT {KEYS}, " + ", ".join(f"CAST({c} = '{v}' AS DOUBLE) AS {n}" for n, (c, v) in PROBES.items())
    + " FROM customers"))
def q_one_hot_probe(spark, sf):
    c = customers(spark, sf)
    return c.select(*KEY, *[rules.one_hot_probe(F.col(col), v).alias(n)
                            for n, (col, v) in PROBES.items()])


@register("sigmoid", with_customers(
    f"SELECT {KEYS}, ROUND(1.0 / (1.0 + exp(-4.0 * (LEAST(1.0, duration / 1000.0) - 0.5))), 9) "
    "AS duration_factor FROM customers"))
def q_sigmoid(spark, sf):
    c = customers(spark, sf)
    x = rules.domain_scale("duration", F.col("duration"))
    return c.select(*KEY, r6(sigmoid(x)).alias("duration_factor"))


@register("clip", with_customers(
    f"SELECT {KEYS}, ROUND(GREATEST(0.05, LEAST(0.7, p)), 9) AS p_clipped FROM customers"))
def q_clip(spark, sf):
    from respondo.functions.scalar import clip
    c = customers(spark, sf)
    return c.select(*KEY, r6(clip(F.col("p"), 0.05, 0.7)).alias("p_clipped"))


def _grid_rows():
    rows = []
    for name, g in (("profit", thresholds.PROFIT_GRID), ("f1", thresholds.F1_GRID)):
        rows += [(name, i, t) for i, t in enumerate(thresholds.arange(*g))]
    return rows


@register("grid_range", with_customers(
    "SELECT grid, threshold_idx, ROUND(threshold, 9) AS threshold, count_if(p >= threshold) AS rows_at_or_above "
    "FROM customers, (VALUES " + ", ".join(f"('{n}', {i}, CAST({t!r} AS DOUBLE))" for n, i, t in _grid_rows())
    + ") AS g(grid, threshold_idx, threshold) GROUP BY grid, threshold_idx, threshold"))
def q_grid_range(spark, sf):
    c = customers(spark, sf)
    parts = []
    for name, g in (("profit", thresholds.PROFIT_GRID), ("f1", thresholds.F1_GRID)):
        t = thresholds.threshold_counts(c.select(F.col("p").alias("score"), "y"), thresholds.arange(*g))
        parts.append(t.select(F.lit(name).alias("grid"), F.col("threshold_idx").cast("int"),
                              r6("threshold").alias("threshold"),
                              (F.col("tp") + F.col("fp")).alias("rows_at_or_above")))
    return parts[0].unionByName(parts[1])


# ---- feature preparation ------------------------------------------------------------

@register("impute_median", "WITH " + LABELLED_SQL + " SELECT doc_id, "
          "COALESCE(CAST(quality AS DOUBLE), median(quality) OVER ()) AS quality, "
          "COALESCE(CAST(toxic AS DOUBLE), median(toxic) OVER ()) AS toxic, "
          "COALESCE(CAST(n_chars AS DOUBLE), median(n_chars) OVER ()) AS n_chars FROM docs")
def q_impute_median(spark, sf):
    d = labelled_documents(spark, sf).select("doc_id", "quality", "toxic", "n_chars")
    med = features.fit_medians(d, ["quality", "toxic", "n_chars"])
    return features.impute(d, med)


@register("impute_mode", "WITH " + LABELLED_SQL + ", modes AS (SELECT feature, value FROM ("
          "SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY COUNT(*) DESC, value) AS rn "
          "FROM (SELECT 'verdict' AS feature, verdict AS value FROM docs UNION ALL "
          "SELECT 'lang', lang FROM docs) WHERE value IS NOT NULL GROUP BY feature, value) WHERE rn = 1) "
          "SELECT doc_id, COALESCE(verdict, (SELECT value FROM modes WHERE feature = 'verdict')) AS verdict, "
          "COALESCE(lang, (SELECT value FROM modes WHERE feature = 'lang')) AS lang FROM docs")
def q_impute_mode(spark, sf):
    d = labelled_documents(spark, sf).select("doc_id", "verdict", "lang")
    modes = features.fit_modes(d, ["verdict", "lang"])
    return features.impute(d, modes)


def _onehot_query(drop_first: bool):
    def q(spark, sf):
        df = contacts(spark, sf, ONEHOT_COLS)
        vocab = features.fit_categories(df, ONEHOT_COLS)
        return df.select(*KEY, *features.one_hot(vocab, drop_first))
    return q


register("one_hot_drop_first", with_contacts(
    f"SELECT {KEYS}, {', '.join(_onehot_sql(True))} FROM contacts"))(_onehot_query(True))
register("one_hot_all", with_contacts(
    f"SELECT {KEYS}, {', '.join(_onehot_sql(False))} FROM contacts"))(_onehot_query(False))

SCALE_COLS = ["duration", "campaign", "previous", "pdays", "discount", "tax", "totalprice",
              "acctbal"]


@register("standard_scale", with_contacts(
    f"SELECT {KEYS}, " + ", ".join(
        f"ROUND((CAST({c} AS DOUBLE) - AVG(CAST({c} AS DOUBLE)) OVER ()) / "
        f"STDDEV_POP(CAST({c} AS DOUBLE)) OVER (), 9) AS {c}" for c in SCALE_COLS) + " FROM contacts"))
def q_standard_scale(spark, sf):
    df = contacts(spark, sf, SCALE_COLS)
    params = features.fit_standard(df, SCALE_COLS)
    scaled = df.select(*KEY, *features.standardize(params))
    return scaled.select(*KEY, *[r6(c).alias(c) for c in SCALE_COLS])


SELECT_NUMERIC = ["duration", "campaign", "previous", "pdays", "discount", "tax", "totalprice",
                  "acctbal"]
K_BEST = 10


def _kbest_features():
    """(name, SQL expression) in column order: numerics, then one-hot."""
    feats = [(c, f"CAST({c} AS DOUBLE)") for c in SELECT_NUMERIC]
    for c, vals in DOMAINS.items():
        feats += [(f"{c}_{v}", f"CAST({c} = '{v}' AS DOUBLE)") for v in vals[1:]]
    return feats


def _kbest_sql() -> str:
    per = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, {i} AS position, y, COUNT(*) AS n, AVG({e}) AS mean, "
        f"var_samp({e}) AS var FROM contacts GROUP BY y" for i, (n, e) in enumerate(_kbest_features()))
    return (
        "SELECT feature, position, ROUND(f_score, 6) AS f_score, rank, rank <= " + str(K_BEST)
        + " AS selected FROM (SELECT *, CAST(row_number() OVER (ORDER BY f_score DESC NULLS LAST, position) AS INTEGER) "
        "AS rank FROM (SELECT feature, CAST(position AS INTEGER) AS position, "
        "(SUM(n * (mean - gm) * (mean - gm)) / (COUNT(*) - 1)) / "
        "NULLIF(SUM((n - 1) * COALESCE(var, 0.0)) / (SUM(n) - COUNT(*)), 0) AS f_score FROM ("
        "SELECT *, SUM(mean * n) OVER (PARTITION BY feature) / SUM(n) OVER (PARTITION BY feature) AS gm "
        f"FROM ({per})) GROUP BY feature, position))")


def _kbest_scores(spark, sf):
    df = contacts(spark, sf, ["y", *SELECT_NUMERIC, *ONEHOT_COLS], key=False)
    return features.encoded_anova_f(df, SELECT_NUMERIC, ONEHOT_COLS)


@register("select_k_best", with_contacts(_kbest_sql()))
def q_select_k_best(spark, sf):
    scores = _kbest_scores(spark, sf)
    sel = features.select_k_best(scores, K_BEST)
    return sel.select("feature", F.col("position").cast("int"),
                      F.round("f_score", 6).alias("f_score"), F.col("rank").cast("int"),
                      "selected")


@register("nested_topk_by_f", with_contacts(
    "SELECT CAST(k AS INTEGER) AS top_k, feature, rank FROM (" + _kbest_sql() + "), "
    "(VALUES (5), (10), (15), (20)) AS s(k) WHERE rank <= k"))
def q_nested_topk_by_f(spark, sf):
    """Nested top-5/10/15/20 feature sets, ranked once by ANOVA F."""
    scores = _kbest_scores(spark, sf)
    ranked = features.select_k_best(scores, K_BEST)
    sets = F.array(*[F.lit(k) for k in (5, 10, 15, 20)])
    return ranked.select("feature", F.col("rank").cast("int").alias("rank"),
                         F.explode(sets).alias("top_k")) \
        .where(F.col("rank") <= F.col("top_k")).select("top_k", "feature", "rank")


@register("train_test_split", with_contacts(
    f"SELECT {KEYS}, CASE WHEN {splits.bucket_sql(KEY)} < 20 THEN 'test' ELSE 'train' END AS split "
    "FROM contacts"))
def q_train_test_split(spark, sf):
    df = contacts(spark, sf, ["y"])
    return splits.train_test_split(df, KEY, 20).select(*KEY, "split")


@register("stratified_split", with_contacts(
    f"SELECT {KEYS}, y, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY h, {KEYS}) <= "
    "FLOOR(COUNT(*) OVER (PARTITION BY y) * 0.3 + 0.5) THEN 'test' ELSE 'train' END AS split "
    f"FROM (SELECT *, {splits.key_hash_sql(KEY)} AS h FROM contacts)"))
def q_stratified_split(spark, sf):
    df = contacts(spark, sf, ["y"])
    return splits.stratified_split(df, KEY, "y", 0.3).select(*KEY, "y", "split")


@register("class_weights", with_contacts(
    "SELECT y, n_c, ROUND(CAST(SUM(n_c) OVER () AS DOUBLE) / (COUNT(*) OVER () * n_c), 9) AS balanced_weight, "
    "ROUND(CAST(SUM(CASE WHEN y = 0 THEN n_c END) OVER () AS DOUBLE) / SUM(CASE WHEN y = 1 THEN n_c END) OVER (), 9) "
    "AS scale_pos_weight FROM (SELECT y, COUNT(*) AS n_c FROM contacts GROUP BY y)"))
def q_class_weights(spark, sf):
    cw = features.class_weights(contacts(spark, sf, ["y"], key=False), "y")
    return cw.select("y", "n_c", r6("balanced_weight").alias("balanced_weight"),
                     r6("scale_pos_weight").alias("scale_pos_weight"))
