"""Sources and sinks.

The driver's tables are parquet, so the delimited-text readers are checked
on text that Spark first writes from ``lineitem`` (whole table) into the
shared folder: a tab file with a header, a ``;`` file read as one text
column, and a decimal-comma column. Stage and metric sinks write and read
back through :class:`StageStore`.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from respondo.catalog import decisions, profiling  # noqa: F401  (their queries are used below)
from respondo.catalog.registry import ORACLE, QUERIES, register
from respondo.catalog.segments import SEGMENT_COLUMNS, _segment_rates_sql
from respondo.functions.scalar import coerce_numeric, r6
from respondo.operators import features, models, profile, splits
from respondo.operators.segments import segment_response_rate
from respondo.plans.contacts import CATEGORICAL, KEY, NUMERIC, ROLES, contacts, with_contacts
from respondo.session import scratch_path, staged
from respondo.sources.delimited import (coerce_columns, read_delimited, split_single_column)
from respondo.sources.stages import StageStore
from respondo.sources.tables import load

EXPORT_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
               "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus"]
INT_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
NUM_COLS = INT_COLS + ["l_quantity", "l_extendedprice", "l_tax"]


def _export(spark, sf, sep: str) -> str:
    """lineitem as delimited text with a header; ``l_tax`` written with a
    decimal comma (the damage the coercion repairs)."""
    li = load(spark, sf, "lineitem").select(*[
        F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")).alias(c) if c == "l_tax"
        else F.col(c).cast("string").alias(c) for c in EXPORT_COLS])
    path = scratch_path(spark, "export")
    li.write.option("header", True).option("sep", sep).csv(path)
    return path


# integer columns back to their stored types
INT_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint",
             "l_linenumber": "int"}


def _typed(df):
    c = coerce_columns(df, NUM_COLS)
    return c.select(*[F.col(x).cast(INT_TYPES[x]).alias(x) if x in INT_TYPES else F.col(x)
                      for x in EXPORT_COLS])


EXPORT_SQL = ("SELECT " + ", ".join(
    c if c in INT_COLS or c in ("l_returnflag", "l_linestatus") else f"CAST({c} AS DOUBLE) AS {c}"
    for c in EXPORT_COLS) + " FROM lineitem")


@register("scan_delimited", EXPORT_SQL)
def q_scan_delimited(spark, sf):
    return _typed(read_delimited(spark, _export(spark, sf, "\t")))


@register("scan_delimiter_fallback", EXPORT_SQL)
def q_scan_delimiter_fallback(spark, sf):
    """A ';' file read without naming the separator: the header line
    decides it (tab is tried first, as in the reference)."""
    return _typed(read_delimited(spark, _export(spark, sf, ";")))


@register("split_single_column", EXPORT_SQL)
def q_split_single_column(spark, sf):
    text = spark.read.text(_export(spark, sf, ";"))
    return _typed(split_single_column(text, "value"))


@register("coerce_numeric",
          "SELECT event_id, TRY_CAST(replace(replace(props, '{\"k\": ', ''), '}', '') AS DOUBLE) AS k, "
          "value AS value_back, CAST(NULL AS DOUBLE) AS event_type_num FROM events")
def q_coerce_numeric(spark, sf):
    ev = load(spark, sf, "events")
    payload = F.replace(F.replace("props", F.lit('{"k": '), F.lit("")), F.lit("}"), F.lit(""))
    comma = F.replace(F.col("value").cast("string"), F.lit("."), F.lit(","))
    return ev.select("event_id", coerce_numeric(payload).alias("k"),
                     coerce_numeric(comma).alias("value_back"),
                     coerce_numeric("event_type").alias("event_type_num"))


@register("scan_intermediate", _segment_rates_sql())
def q_scan_intermediate(spark, sf):
    """Write a stage table, then read it back by name."""
    store = StageStore(spark)
    df = contacts(spark, sf, ["y", *SEGMENT_COLUMNS], key=False)
    store.write("segment_rates", segment_response_rate(df, SEGMENT_COLUMNS))
    return store.read("segment_rates")


@register("scan_with_fallback", with_contacts(f"SELECT {', '.join(KEY)}, y, duration FROM contacts"))
def q_scan_with_fallback(spark, sf):
    """The selected-features stage was never written here, so the reader
    falls back to the raw contacts table."""
    store = StageStore(spark)
    return store.read_or("selected_features", lambda: contacts(spark, sf, ["y", "duration"]))


def _sealed(store: StageStore, name: str, df):
    """Write a stage table and read it back: (stage, rows, whether every row
    read gives the hash it was written with, its column ``_seal``). A seal
    and not an observed metric: once a session has observed one, the fitted
    models of ``pyspark.ml`` that hold a training summary, and so the
    session, cannot be sent to tasks any more."""
    def seal(columns):
        return F.xxhash64(*[F.col(f"`{c}`") for c in columns])

    store.write(name, df.withColumn("_seal", seal(df.columns)))
    back = store.read(name).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("_seal").eqNullSafe(seal(df.columns))).alias("changed")).first()
    return name, back["rows"], back["changed"] == 0


STAGE_CATEGORIES = ["job", "education", "contact", "poutcome", "marital"]


@register("sink_stage_tables", with_contacts(
    "SELECT stage, rows, TRUE AS same FROM ("
    "SELECT 'basic' AS stage, COUNT(*) AS rows FROM contacts UNION ALL SELECT 'selected', COUNT(*) FROM contacts "
    "UNION ALL SELECT 'pca', COUNT(*) FROM contacts UNION ALL SELECT 'components', 8 + "
    + " + ".join(f"COUNT(DISTINCT {c}) - 1" for c in STAGE_CATEGORIES) + " FROM train "
    "UNION ALL SELECT 'smote', CAST(2 * MAX(n) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM train GROUP BY y))",
    "train AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, " + ", ".join(KEY) + ") AS place, "
    "FLOOR(COUNT(*) OVER (PARTITION BY y) * 0.3 + 0.5) AS wanted "
    f"FROM (SELECT *, {splits.key_hash_sql(KEY)} AS h FROM contacts)) WHERE place > wanted)"))
def q_sink_stage_tables(spark, sf):
    """The five stage tables: encoded and scaled features (basic), the K best
    of them (selected), all rows on the principal components (pca), the
    loadings of these (components), and the balanced training rows (smote)."""
    from respondo.catalog import modelling
    from respondo.operators.resample import smote
    store = StageStore(spark)
    prep = models.prepare(contacts(spark, sf, ["y", *modelling.NUMERIC, *STAGE_CATEGORIES]), KEY, "y",
                          modelling.NUMERIC, STAGE_CATEGORIES, k_best=None)
    names, rest = prep.feature_names, [*KEY, models.LABEL, "split"]
    train = prep.rows.where(F.col("split") == "train")
    best = {r["feature"] for r in features.select_k_best(features.anova_f(train, names, models.LABEL), 10)
            .where("selected").collect()}
    chosen = [n for n in names if n in best]
    pca, ratios = modelling.components(prep)
    k = len(ratios)
    loadings = pca.pc.toArray()[:, :k].tolist()  # a row per feature
    pcs = vector_to_array("pcs")
    tables = {
        "basic": prep.rows.select(*rest, *names),
        "selected": prep.rows.select(*rest, *chosen),
        "pca": pca.transform(prep.rows).select(*rest, *[pcs[i].alias(f"pc_{i + 1}") for i in range(k)]),
        "components": spark.createDataFrame([(n, *map(float, v)) for n, v in zip(names, loadings)],
                                            "feature string" + "".join(f", pc_{i + 1} double" for i in range(k))),
        "smote": smote(train.select(*KEY, *chosen, models.LABEL), KEY, chosen, models.LABEL, k=5),
    }
    return spark.createDataFrame([_sealed(store, n, t) for n, t in tables.items()],
                                 "stage string, rows long, same boolean")


@register("sink_metrics_csv", ORACLE["model_comparison"])
def q_sink_metrics_csv(spark, sf):
    from respondo.catalog.decisions import q_model_comparison
    store = StageStore(spark)
    store.write_csv("model_comparison", q_model_comparison(spark, sf))
    return store.read_csv("model_comparison", "model_name string, accuracy double, "
                          "precision double, recall double, f1 double, roc_auc double, "
                          "is_best boolean")


@register("sink_test_split", with_contacts(
    f"SELECT {', '.join(KEY)}, y, duration, pdays, job, 'test' AS split FROM ("
    "SELECT *, row_number() OVER (PARTITION BY y ORDER BY h, " + ", ".join(KEY) + ") AS place, "
    "FLOOR(COUNT(*) OVER (PARTITION BY y) * 0.2 + 0.5) AS wanted "
    f"FROM (SELECT *, {splits.key_hash_sql(KEY)} AS h FROM contacts)) WHERE place <= wanted"))
def q_sink_test_split(spark, sf):
    """The stratified test split is written on first use and read after."""
    store = StageStore(spark)

    def build():
        df = contacts(spark, sf, ["y", "duration", "pdays", "job"])
        return splits.stratified_split(df, KEY, "y", 0.2).where(F.col("split") == "test")
    store.write_if_absent("test_split", build)
    return store.write_if_absent("test_split", build)


#: section -> (query whose rows it has, its key, its figures)
REPORT = {
    "shape": ("shape_count", "'contacts'", ["rows"]),
    "nulls": ("null_profile", "feature", ["count", "pct"]),
    "unknowns": ("unknown_profile", "feature", ["count", "pct"]),
    "describe": ("describe_numeric", "feature", ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]),
    "value_counts": ("value_counts", "concat(feature, '=', value)", ["count", "pct"]),
    "class_balance": ("class_balance", "CAST(y AS {string})", ["rows", "pct"]),
    "correlations": ("correlation_matrix", "concat(a, ' ', b)", ["corr"]),
    "segments": ("segment_response_rate", "concat(feature, '=', value)", ["rows", "positives", "rate_pct"]),
    "models": ("model_comparison", "model_name", ["accuracy", "precision", "recall", "f1", "roc_auc"]),
    "thresholds": ("profit_sweep", "CAST(ROUND(threshold, 2) AS {string})", ["profit", "roi"]),
}


def _report_sql() -> str:
    parts = [f"SELECT '{section}' AS section, {key.format(string='VARCHAR')} AS key, '{v}' AS metric, "
             f"CAST({v} AS DOUBLE) AS value FROM ({ORACLE[name]})"
             for section, (name, key, values) in REPORT.items() for v in values]
    return "\nUNION ALL\n".join(parts)


@register("report_tables", _report_sql())
def q_report_tables(spark, sf):
    """Every section's figures as one long ``(section, key, metric, value)``
    table; each section is one pass for all of its figures. Sections of the same
    joins read one written input: the whole star, or orders with their customers
    (rows without a nation or region count there, so they are not the same rows)."""
    star = staged(contacts(spark, sf, ["y", *CATEGORICAL], key=False), "report-star")
    numbers = staged(contacts(spark, sf, NUMERIC, key=False), "report-numbers")
    shared = {"shape": profile.shape(star, len(ROLES) + len(KEY)),
              "unknowns": profile.unknown_profile(star.select(*CATEGORICAL), profiling.PLACEHOLDER),
              "describe": profiling.described(numbers, written=True),
              "value_counts": profile.value_counts(star, CATEGORICAL),
              "correlations": profiling.correlated(numbers),
              "segments": segment_response_rate(star, SEGMENT_COLUMNS)}
    out = None
    for section, (name, key, values) in REPORT.items():
        each = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value"))
                                   for v in values])).alias("e")
        rows = shared[section] if section in shared else QUERIES[name](spark, sf)
        part = rows.select(F.lit(section).alias("section"), F.expr(key.format(string="STRING"))
                                               .alias("key"), each).select("section", "key", "e.*")
        out = part if out is None else out.unionByName(part)
    return out


def _save_preparation(store: StageStore, name: str, params: dict) -> dict:
    """Fitted preparation parameters as a stage table of one row, and what is read back."""
    store.write(name, store.spark.createDataFrame([(json.dumps(params),)], "params string"))
    return json.loads(store.read(name).first()["params"])


def _save_models(store: StageStore, fitted: dict) -> dict:
    """Fitted models, each saved and loaded back."""
    for name, model in fitted.items():
        if isinstance(model, dict):  # trees: a row each, and one of the rest
            rows = [(-1, json.dumps({k: v for k, v in model.items() if k != "trees"})),
                    *((i, json.dumps(t)) for i, t in enumerate(model["trees"]))]
            store.write(name, store.spark.createDataFrame(rows, "tree int, params string"))
        else:
            store.save_model(name, PipelineModel(stages=[model]))

    def load(name):
        if not isinstance(fitted[name], dict):
            return store.load_model(name)
        rest, *trees = [json.loads(r["params"]) for r in store.read(name).orderBy("tree").collect()]
        return {**rest, "trees": trees}
    return {name: load(name) for name in fitted}


@register("save_load_models")
def q_save_load_models(spark, sf):
    """Save the preparation parameters (imputers, encoder, scaler, selector),
    the principal components of 95 % of the variance and the six base models
    to the shared folder, load them back, prepare the raw rows and score:
    metrics of every model, and the variance the loaded components keep."""
    from respondo.catalog import modelling
    store = StageStore(spark)
    prep, whole = modelling._prepared(spark, sf), modelling._prepared(spark, sf, k_best=None)
    pca = modelling.fewest_components(whole)
    k = pca.getK()
    selected = _save_preparation(store, "preparation", prep.params)
    encoded = _save_preparation(store, "preparation_all_features", whole.params)
    saved = modelling._fitted(prep)
    loaded = _save_models(store, {**saved, "pca": pca})
    components = loaded.pop("pca")

    raw = splits.stratified_split(modelling._input(spark, sf), KEY, "y", 0.3)
    rows = models.with_scores(loaded, models.apply_preparation(raw, selected))
    again = rows.select(models.FEATURES, *[F.col(f"p_{n}").alias(f"loaded_{n}") for n in loaded])
    differ = models.with_scores(saved, again).agg(
        *[F.max(F.abs(F.col(f"p_{n}") - F.col(f"loaded_{n}"))).alias(n) for n in loaded]).first()
    projected = components.transform(models.apply_preparation(raw, encoded)).where(F.col("split") == "train")
    pcs = vector_to_array("pcs")
    share = projected.agg(sum(F.variance(pcs[i]) for i in range(k))).first()[0]
    out = None
    for name in loaded:
        one = models.evaluate(rows.select("split", "y", F.col(f"p_{name}").alias("score"),
                                          F.col(f"v_{name}").cast("int").alias("pred")), f"{name}_reloaded")
        one = one.withColumn("max_score_difference", F.lit(float(differ[name])))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("pca_variance", F.lit(float(share)))
