"""Feature preparation as fitted parameters + column expressions.

Every ``fit_*`` runs one aggregation over the data and brings back only
parameters (one number or one category list per column, bounded by the
column count or the category cardinality); every ``apply`` is a projection
that stays in codegen. This is the Spark form of fit/transform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respondo.functions.scalar import dbl
from respondo.session import staged

MAX_CATEGORIES = 10_000


# ---- imputation -------------------------------------------------------------

def fit_medians(df: DataFrame, columns: list[str], written: bool = False,
                some: DataFrame | None = None) -> dict[str, float | None]:
    """Exact median per column (interpolated, as ``median``), computed by
    :func:`exact_percentiles` so no column is gathered in one task.
    ``written`` tells that ``df`` reads a stage table already; ``some`` of
    its rows, where given, are where the search starts."""
    from respondo.operators.quantiles import exact_percentiles
    band = {} if some is None else {"max_band": 1_000_000, "some": some}
    got = {r["feature"]: r["value"]
           for r in exact_percentiles(df, columns, [0.5], written=written, **band).collect()}
    return {c: got.get(c) for c in columns}


def impute(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Fill NULLs of each column with its fitted value. A column filled with
    a number becomes DOUBLE: a median may lie between two integers."""
    def filled(c):
        kind = "double" if isinstance(values[c], float) else df.schema[c].dataType
        return F.coalesce(F.col(c).cast(kind), F.lit(values[c]).cast(kind)).alias(c)
    return df.select(*[filled(c) if values.get(c) is not None else F.col(c) for c in df.columns])


def fit_modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent non-null value per column, smallest on a tie; all
    columns in one unpivot + count (one shuffle of partial counts)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]) \
        .unpivot([], columns, "feature", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("feature").agg(
        F.min(F.struct(F.negative("n").alias("nn"), F.col("value").alias("v"))).alias("m"))
    return {r["feature"]: r["m"]["v"] for r in best.collect()}


def fit_values(df: DataFrame, columns: list[str], max_categories: int | None = None
               ) -> tuple[dict[str, object], dict[str, list[str]]]:
    """:func:`fit_modes` and :func:`fit_categories` of the same rows from one
    count of ``(column, value)``. Filling NULLs with the mode adds no value,
    so these are the categories of the filled columns as well."""
    modes, vocab, _ = fit_class_values(df, columns, max_categories=max_categories)
    return modes, vocab


def fit_class_values(df: DataFrame, columns: list[str], target: str | None = None, max_categories: int | None = None
                     ) -> tuple[dict[str, object], dict[str, list[str]], dict[tuple, int]]:
    """:func:`fit_values` with the rows of each (column, value, class of
    ``target``) once NULLs are filled with the mode."""
    max_categories = MAX_CATEGORIES if max_categories is None else max_categories
    long = df.select(F.col(target).alias("class") if target else F.lit(None).cast("double").alias("class"),
                     *[F.col(c).cast("string").alias(c) for c in columns]) \
        .unpivot(["class"], columns, "feature", "value")
    counts = staged(long.groupBy("feature", "value", "class").agg(F.count(F.lit(1)).alias("n")), "category-counts")
    values = counts.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.sum("n").alias("n"))
    best = values.groupBy("feature").agg(
        F.count("*").alias("values"), F.min(F.struct(F.negative("n").alias("nn"), F.col("value").alias("v"))).alias("m"))
    found = best.collect()
    big = [r["feature"] for r in found if r["values"] > max_categories]
    if big:
        raise ValueError(f"columns with more than {max_categories} categories: {big}")
    modes = {r["feature"]: r["m"]["v"] for r in found}
    vocab: dict[str, set[str]] = {c: set() for c in columns}
    rows: dict[tuple, int] = {}
    for r in counts.collect():
        if r["value"] is not None:
            vocab[r["feature"]].add(r["value"])
        k = (r["feature"], modes.get(r["feature"]) if r["value"] is None else r["value"], r["class"])
        rows[k] = rows.get(k, 0) + r["n"]
    return modes, {c: sorted(v) for c, v in vocab.items()}, rows


# ---- categorical encoding -----------------------------------------------------

def fit_categories(df: DataFrame, columns: list[str],
                   max_categories: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted distinct values per column (the encoder's vocabulary).

    One grouped pass over all columns; the vocabulary size is checked before
    it is brought to the driver, so a high-cardinality column fails fast
    instead of flooding the driver.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]) \
        .unpivot([], columns, "feature", "value").where(F.col("value").isNotNull())
    distinct = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    sizes = distinct.groupBy("feature").count().collect()
    big = [r["feature"] for r in sizes if r["count"] > max_categories]
    if big:
        raise ValueError(f"columns with more than {max_categories} categories: {big}")
    vocab: dict[str, list[str]] = {c: [] for c in columns}
    for r in distinct.select("feature", "value").collect():
        vocab[r["feature"]].append(r["value"])
    return {c: sorted(v) for c, v in vocab.items()}


def one_hot(vocab: dict[str, list[str]], drop_first: bool = True,
            sep: str = "_") -> list[Column]:
    """``{col}_{value}`` indicator columns; with ``drop_first`` the first
    (smallest) category is the all-zero baseline. Unseen values and NULLs
    encode as all zeros."""
    out = []
    for c, values in vocab.items():
        for v in (values[1:] if drop_first else values):
            hit = (F.col(c).cast("string") == F.lit(v)).cast("double")
            out.append(F.coalesce(hit, F.lit(0.0)).alias(f"{c}{sep}{v}"))
    return out


def label_encode(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Sorted distinct values -> 0..k-1, for any number of values: they are
    sorted over all tasks, numbered inside each, and moved up by the number
    of values in earlier tasks (one row per task). The code table is
    broadcast only where it has at most ``MAX_CATEGORIES`` rows. NULL has no
    code."""
    from respondo.session import staged
    from respondo.sources.tables import sized_broadcast
    out = out or f"{column}_code"
    placed = staged(df.select(column).where(F.col(column).isNotNull()).distinct()
                    .repartitionByRange(column).sortWithinPartitions(column)
                    .select(column, F.spark_partition_id().alias("_part"),
                            F.monotonically_increasing_id().alias("_at")), "distinct-values")
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = placed.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).select(
        "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    codes = placed.join(F.broadcast(spans), "_part").select(
        column, (F.col("_at") + F.col("_shift")).cast("int").alias(out))
    return df.join(sized_broadcast(codes, MAX_CATEGORIES), column, "left")


# ---- scaling -------------------------------------------------------------------

def fit_standard(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column (what a z-score scaler uses)."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__m"), F.stddev_pop(x).alias(f"{c}__s")]
    row = df.agg(*aggs).first()
    return {c: (row[f"{c}__m"], row[f"{c}__s"]) for c in columns}


def class_moments(df: DataFrame, columns: list[str], target: str) -> list[dict]:
    """One pass: per class of ``target`` its rows ``n`` and, for each column,
    (mean, population variance, smallest, largest)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"z{i}")]
    return [{"class": r["class"], "n": r["n"],
             **{c: (r[f"m{i}"], r[f"v{i}"], r[f"a{i}"], r[f"z{i}"]) for i, c in enumerate(columns)}}
            for r in df.groupBy(F.col(target).alias("class")).agg(*aggs).collect()]


def standard_of_classes(moments: list[dict], columns: list[str]) -> dict[str, tuple[float, float]]:
    """:func:`fit_standard` from the moments of the classes (of columns
    without NULLs; None where a column has no value at all)."""
    n, out = sum(r["n"] for r in moments), {}
    for c in columns:
        if not n or any(r[c][0] is None for r in moments):
            out[c] = (None, None)
            continue
        mean = sum(r["n"] * r[c][0] for r in moments) / n
        var = sum(r["n"] * (r[c][1] + (r[c][0] - mean) * (r[c][0] - mean)) for r in moments) / n
        # a constant column has no spread, whatever the rounding of its means
        constant = min(r[c][2] for r in moments) == max(r[c][3] for r in moments)
        out[c] = (mean, 0.0 if constant else var ** 0.5)
    return out


def standardize(params: dict[str, tuple[float, float]]) -> list[Column]:
    """``(x - mean) / std``; a zero std leaves the centred value (as the
    reference scaler does)."""
    out = []
    for c, (m, s) in params.items():
        d = s if s else 1.0
        out.append(((F.col(c).cast("double") - dbl(m)) / dbl(d)).alias(c))
    return out


# ---- ANOVA F feature scores ----------------------------------------------------

def anova_f(df: DataFrame, features: list[str], target: str = "y") -> DataFrame:
    """One-way ANOVA F of each feature against the class, from per-class
    count, mean and sample variance (one grouped aggregation, numerically
    stable moments). Returns ``(feature, position, f_score)``."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in features:
        x = F.col(f).cast("double")
        aggs += [F.avg(x).alias(f"{f}__m"), F.var_samp(x).alias(f"{f}__v")]
    per_class = df.groupBy(target).agg(*aggs)
    stack = ", ".join(f"'{f}', {i}, `{f}__m`, `{f}__v`" for i, f in enumerate(features))
    long = per_class.selectExpr(target, "n", f"stack({len(features)}, {stack}) "
                                "AS (feature, position, mean, var)")
    return f_scores(long)


def f_scores(long: DataFrame) -> DataFrame:
    """F of each feature from one row per class and feature: ``(n, feature,
    position, mean, var)``."""
    w = Window.partitionBy("feature")
    # grand mean from class means (weighted), then between / within sums
    g = long.withColumn("gm", F.sum(F.col("mean") * F.col("n")).over(w) / F.sum("n").over(w))
    stats = g.groupBy("feature", "position").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("gm")) ** 2).alias("ssb"),
        F.sum((F.col("n") - 1) * F.coalesce(F.col("var"), dbl(0.0))).alias("ssw"),
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    between = F.col("ssb") / (F.col("k") - 1)
    within = F.col("ssw") / (F.col("n") - F.col("k"))
    return stats.select("feature", "position", F.try_divide(between, within).alias("f_score"))


def encoded_anova_f(df: DataFrame, numeric: list[str], categorical: list[str], target: str = "y",
                    max_categories: int = MAX_CATEGORIES, sep: str = "_") -> DataFrame:
    """:func:`anova_f` of the numeric columns and of the one-hot indicators
    of the categorical ones (:func:`one_hot`, first category dropped) from a
    single scan: moments per class of the numerics and counts per class of
    every value come from one grouped pass, which also gives the vocabulary.
    An indicator's moments follow from its counts.

    NULL categories count in their class and have no indicator; a column
    with fewer than two categories has none either; a column with more than
    ``max_categories`` raises. An empty table gives no rows.
    """
    def entry(c: str, value: Column, x: Column) -> Column:
        return F.struct(F.lit(c).alias("column"), value.cast("string").alias("value"),
                        x.cast("double").alias("x"))

    null = F.lit(None)
    entries = [entry(c, null, F.col(c)) for c in numeric] + [entry(c, F.col(c), null) for c in categorical]
    counts = staged(
        df.select(F.struct(F.col(target)).alias("class"), F.explode(F.array(*entries)).alias("e"))
        .select("class", "e.*").groupBy("class", "column", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var")),
        "class-values")
    place = {c: i for i, c in enumerate(numeric)}
    moments = counts.where(F.col("column").isin(numeric)).select(
        "n", F.col("column").alias("feature"), _looked_up(F.col("column"), place).alias("position"),
        "mean", "var")
    hits = counts.where(F.col("column").isin(categorical))
    values = hits.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.sum("n").alias("in_all"))
    sizes = {r["column"]: r["count"] for r in values.groupBy("column").count().collect()}
    big = [c for c, n in sizes.items() if n > max_categories]
    if big:
        raise ValueError(f"columns with more than {max_categories} categories: {big}")
    before, start = len(numeric), {}
    for c in categorical:
        start[c] = before
        before += max(0, sizes.get(c, 0) - 1)
    # at most ``max_categories`` rows per window, as many again per class
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    named = values.withColumn("rank", rank).where(F.col("rank") > 1).select(
        "column", "value", F.concat_ws(sep, "column", "value").alias("feature"),
        (_looked_up(F.col("column"), start) + F.col("rank") - 2).alias("position"))
    totals = hits.groupBy("class", "column").agg(F.sum("n").alias("n"))
    found = hits.select("class", "column", "value", F.col("n").alias("k"))
    # a class without the value has it zero times
    p = F.coalesce(F.col("k"), F.lit(0)) / F.col("n")
    indicators = named.join(totals, "column").join(found, ["class", "column", "value"], "left").select(
        "n", "feature", "position", p.alias("mean"),
        F.try_divide(F.col("n") * p * (1 - p), F.col("n") - 1).alias("var"))
    return f_scores(moments.union(indicators))


def anova_of_classes(spark, moments: list[dict], params: dict[str, tuple[float, float]], vocab: dict[str, list[str]],
                     rows: dict[tuple, int]) -> DataFrame:
    """:func:`anova_f` of the standardized numeric columns (``params``) and of
    the one-hot indicators of ``vocab``, from :func:`class_moments` and the
    counts of :func:`fit_class_values`: no pass over the rows. An indicator's
    moments follow from its count."""
    out = []
    for r in moments:
        n, place = r["n"], 0
        for c, (m, s) in params.items():
            d = s if s else 1.0
            out.append((n, c, place, (r[c][0] - m) / d, r[c][1] / d / d * n / (n - 1) if n > 1 else None))
            place += 1
        for c, values in vocab.items():
            for v in values[1:]:
                p = rows.get((c, v, r["class"]), 0) / n
                out.append((n, f"{c}_{v}", place, p, n * p * (1 - p) / (n - 1) if n > 1 else None))
                place += 1
    return f_scores(spark.createDataFrame(out, "n long, feature string, position int, mean double, var double"))


def _looked_up(name: Column, places: dict[str, int]) -> Column:
    pairs = [F.lit(x) for item in places.items() for x in item]
    return F.create_map(*pairs)[name] if pairs else F.lit(None).cast("int")


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    """Top ``k`` features by F (ties: earlier position), reported in the
    original column order; the ranking runs over the small score table."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("f_score"), "position")
    ranked = scores.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("selected", F.col("rank") <= k)


# ---- class weights -------------------------------------------------------------

def class_weights(df: DataFrame, target: str = "y") -> DataFrame:
    """'balanced' weight ``n / (k * n_c)`` per class and the positive-class
    weight ``n_neg / n_pos``; windows run over the per-class counts."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy(F.lit(0))
    n, k = F.sum("n_c").over(w), F.count(F.lit(1)).over(w)
    neg = F.sum(F.when(F.col(target) == 0, F.col("n_c"))).over(w)
    pos = F.sum(F.when(F.col(target) == 1, F.col("n_c"))).over(w)
    return counts.select(target, "n_c", (n / (k * F.col("n_c"))).alias("balanced_weight"),
                         F.try_divide(neg.cast("double"), pos).alias("scale_pos_weight"))


def weight_column(df: DataFrame, target: str = "y", out: str = "w",
                  fit_on: DataFrame | None = None) -> DataFrame:
    """Per-row 'balanced' weight (for ``weightCol``), fitted on ``fit_on``
    (the training rows), via the tiny per-class weight table joined by
    broadcast. A class without training rows has weight 1."""
    cw = class_weights(df if fit_on is None else fit_on, target).select(
        target, F.col("balanced_weight").alias(out))
    return df.join(F.broadcast(cw), target, "left").withColumn(out, F.coalesce(out, F.lit(1.0)))
