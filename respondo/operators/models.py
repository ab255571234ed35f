"""Classifier training, tuning and combination with ``pyspark.ml``.

Data preparation is fitted on the training split only (the reference fits
its scaler/selector before splitting). Models train on executors; the
driver holds only fitted parameters. Evaluation reuses the distributed
metric operators of :mod:`respondo.operators.metrics` on the prediction
table, so an evaluation never collects predictions.
"""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondo.operators import features, metrics, splits, trees
from respondo.session import staged

LABEL, FEATURES, WEIGHT = "label", "features", "w"

#: Rows of a table of more than twice as many rows that are written apart,
#: those with the smallest ``order_hash``: searches for exact medians and for
#: the rows with the smallest hashes start from them.
LOW_ROWS = 1_000_000


def order_hash(key: list[str]) -> F.Column:
    """Order in which rows are taken for samples: a hash of its own, as the
    split took the training rows by ``splits.key_hash``."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 32))


@dataclass
class Prepared:
    every: DataFrame          # key, label, split, w, features (+ raw feature cols), projected from a stage table
    feature_names: list[str]  # selected, in original order
    n_train: int
    params: dict              # what was fitted, as numbers, strings, lists and dicts of them
    key: list[str]
    folds: int
    raw: DataFrame            # key, label, split and raw feature cols, as they are in the stage table
    counts: DataFrame         # rows per label and hash bucket, of ``raw``
    low: DataFrame | None     # training rows of ``raw`` whose ``order_hash`` is at most ``low_hash``
    low_hash: int

    @property
    def rows(self) -> DataFrame:
        """The rows with a whole key; others only count where folds are dealt."""
        return self.every.where(splits.key_hash(self.key).isNotNull())

    @cached_property
    def frame(self) -> DataFrame:
        """``rows`` with their folds, which take a shuffle of all rows; what
        needs the folds of a few of them asks :func:`splits.folds_of`."""
        return splits.stratified_folds(self.every, self.key, LABEL, self.folds)


def model_input(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that a preparation reads, written once: a plan with joins runs once."""
    return staged(df.select(*columns), "model-input")


def prepare(df: DataFrame, key: list[str], target: str, numeric: list[str],
            categorical: list[str], k_best: int | None = 10, test_pct: int = 30,
            folds: int = 5, written: bool = False) -> Prepared:
    """Split by class, impute, encode, scale, select, weight and assemble;
    every fit (medians, modes, vocabulary, scaling, selection, class weights)
    on the training rows only. The input is written before anything reads it
    (``written``: it reads a stage table already); all else is a projection of
    that table with the fitted numbers, so no row is shuffled or written twice."""
    base = df if written else model_input(df, [*key, target, *numeric, *categorical])
    counts = splits.bucket_counts(base, key, target)
    base = splits.stratified_split(base, key, target, test_pct / 100, counts=counts)
    base = base.withColumn(LABEL, F.col(target).cast("double"))
    raw = base.select(*key, LABEL, "split", *numeric, *categorical)
    counts = counts.groupBy(F.col(target).cast("double").alias(LABEL), "_b").agg(F.sum("_n").alias("_n"))
    # rows without a whole key have no place in the order of the folds
    fitted_on = (F.col("split") == "train") & splits.key_hash(key).isNotNull()
    train = base.where(fitted_on)
    n, low, low_hash = counts.agg(F.sum("_n")).first()[0] or 0, None, -1
    if n > 2 * LOW_ROWS:
        low_hash = (LOW_ROWS << 32) // n
        low = staged(raw.where(order_hash(key) <= low_hash).where(fitted_on), "low-rows")
    modes, vocab, class_values = features.fit_class_values(train, categorical, LABEL)
    filled = {**features.fit_medians(train, numeric, written=True, some=low), **modes}
    base = features.impute(base, filled)
    enc = base.select(*key, LABEL, "split", *numeric, *features.one_hot(vocab))
    moments = features.class_moments(base.where(fitted_on), numeric, LABEL)
    params = features.standard_of_classes(moments, numeric)
    onehots = [c for c in enc.columns if c not in {*key, LABEL, "split", *numeric}]
    scaled = enc.select(*key, LABEL, "split", *features.standardize(params), *onehots)
    names = numeric + onehots
    if k_best is not None and k_best < len(names):
        scores = features.anova_of_classes(df.sparkSession, moments, params, vocab, class_values)
        chosen = {r["feature"] for r in
                  features.select_k_best(scores, k_best).where("selected").collect()}
        names = [n for n in names if n in chosen]
    n_train = sum(r["n"] for r in moments)
    weight = F.lit(1.0)  # of a class without training rows
    for r in moments:
        if r["class"] is not None:
            balanced = n_train / (len(moments) * r["n"])
            weight = F.when(F.col(LABEL) == r["class"], F.lit(balanced)).otherwise(weight)
    every = VectorAssembler(inputCols=names, outputCol=FEATURES).transform(scaled.withColumn(WEIGHT, weight))
    return Prepared(every, names, n_train,
                    {"impute": filled, "categories": vocab,
                     "standard": {c: list(map(float, v)) for c, v in params.items()}, "selected": names}, key, folds,
                    raw, counts, low, low_hash)


def apply_preparation(df: DataFrame, params: dict) -> DataFrame:
    """``df`` with the raw columns made ``features`` by what ``prepare`` fitted."""
    numeric, categorical = list(params["standard"]), list(params["categories"])
    rest = [c for c in df.columns if c not in {*numeric, *categorical}]
    base = features.impute(df, params["impute"])
    enc = base.select(*rest, *numeric, *features.one_hot(params["categories"]))
    onehots = [c for c in enc.columns if c not in {*rest, *numeric}]
    scaled = enc.select(*rest, *features.standardize(params["standard"]), *onehots)
    return VectorAssembler(inputCols=params["selected"], outputCol=FEATURES).transform(scaled)


def active():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


# ---- estimators (reference best settings, re-aimed to Spark) ----------------------

def logistic(n_train: int, c: float = 1.0, balanced: bool = True) -> LogisticRegression:
    """sklearn's ``C`` maps to ``regParam = 1 / (C * n)`` (L2)."""
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, maxIter=100,
                            regParam=1.0 / (c * n_train), elasticNetParam=0.0)
    return lr.setWeightCol(WEIGHT) if balanced else lr


def tree(max_depth: int = 3, min_leaf: int = 1) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(featuresCol=FEATURES, labelCol=LABEL, maxDepth=max_depth,
                                  minInstancesPerNode=min_leaf, seed=42)


def forest(num_trees: int = 50, max_depth: int = 10, balanced: bool = True) -> RandomForestClassifier:
    if max_depth > 30:
        raise ValueError("Spark trees have at most 30 levels")
    # a larger node budget per pass trains more tree nodes per data scan
    rf = RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, numTrees=num_trees,
                                maxDepth=max_depth, seed=42, maxMemoryInMB=1024)
    return rf.setWeightCol(WEIGHT) if balanced else rf


def gbt(max_iter: int = 50, max_depth: int = 5, step: float = 0.1,
        subsample: float = 1.0) -> GBTClassifier:
    return GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, maxIter=max_iter,
                         maxDepth=max_depth, stepSize=step, subsamplingRate=subsample, seed=42)


def boosted(max_iter: int = 200, max_depth: int = 3, step: float = 0.01,
            subsample: float = 0.8) -> GBTClassifier:
    """The reference's XGBoost settings as Spark GBT; ``scale_pos_weight``
    becomes the balanced weight column."""
    return gbt(max_iter, max_depth, step, subsample).setWeightCol(WEIGHT)


def linear_svm(n_train: int, c: float = 10.0) -> LinearSVC:
    return LinearSVC(featuresCol=FEATURES, labelCol=LABEL, regParam=1.0 / (c * n_train),
                     maxIter=100, weightCol=WEIGHT)


# ---- scoring / evaluation ------------------------------------------------------------

def positive_score(pred: DataFrame) -> F.Column:
    """P(class 1) from ``probability``, or the raw margin for SVMs."""
    if "probability" in pred.columns:
        return vector_to_array("probability")[1]
    return vector_to_array("rawPrediction")[1]


def scored(model, frame: DataFrame, key: list[str]) -> DataFrame:
    """``(key, y, score, pred)`` for every row of ``frame``."""
    p = model.transform(frame)
    return p.select(*key, "split", F.col(LABEL).cast("int").alias("y"),
                    positive_score(p).alias("score"), F.col("prediction").cast("int").alias("pred"))


def evaluate(pred: DataFrame, name: str, split: str = "test", with_auc: bool = True) -> DataFrame:
    """accuracy / precision / recall / F1 (+ AUC) of one model on a split."""
    s = pred.where(F.col("split") == split)
    m = metrics.with_binary_metrics(metrics.confusion(s, "y", "pred"))
    m = m.withColumn("model_name", F.lit(name))
    if with_auc:
        auc = metrics.roc_auc(s.withColumn("_g", F.lit(0)), "score", "y", ["_g"])
        m = m.withColumn("_g", F.lit(0)).join(auc, "_g").drop("_g")
    else:
        m = m.withColumn("roc_auc", F.lit(None).cast("double"))
    return m.select("model_name", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall",
                    "f1", "roc_auc")


def permuted_counts(model, shifted: DataFrame, names: list[str]) -> DataFrame:
    """Confusion counts of ``model`` by ``variant``: -1 with all features
    (``names``) as they are, i with the i-th taken from the struct ``_moved``.
    One pass: each row becomes its variants inside its task, and only the
    counts of each variant are shuffled."""
    rows = shifted.withColumn("variant", F.explode(F.array(*map(F.lit, range(-1, len(names))))))
    rows = rows.select(LABEL, "variant", *[
        F.when(F.col("variant") == i, F.col(f"_moved.`{f}`")).otherwise(F.col(f"`{f}`")).alias(f)
        for i, f in enumerate(names)])
    scored_rows = model.transform(VectorAssembler(inputCols=names, outputCol=FEATURES).transform(rows))
    return metrics.confusion(scored_rows, LABEL, "prediction", ["variant"])


def f1_positive() -> MulticlassClassificationEvaluator:
    """Positive-class F1 (the reference's ``scoring='f1'``)."""
    return MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol="prediction",
                                             metricName="fMeasureByLabel", metricLabel=1.0)


# ---- tuning ---------------------------------------------------------------------

def grid_search(estimator, grid: list[dict], train: DataFrame, parallelism: int = 4):
    """Exhaustive grid with the fold column of :func:`prepare`; metric is
    the positive-class F1. Returns (best model, [(params, mean F1)])."""
    folds = train.agg(F.max("fold")).first()[0] + 1
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=f1_positive(),
                        foldCol="fold", numFolds=folds, parallelism=parallelism, seed=42)
    m = cv.fit(train)
    return m, list(zip(grid, m.avgMetrics))


def sample_params(estimator, distributions: dict, n_iter: int, seed: int = 42) -> list[dict]:
    """``n_iter`` parameter maps drawn on the driver from integer ranges
    ``("int", lo, hi)``, uniform ranges ``("uniform", lo, width)`` or lists."""
    rnd = random.Random(seed)
    maps = []
    for _ in range(n_iter):
        pm = {}
        for name, dist in distributions.items():
            param = estimator.getParam(name)
            if isinstance(dist, tuple) and dist[0] == "int":
                pm[param] = rnd.randrange(dist[1], dist[2])
            elif isinstance(dist, tuple) and dist[0] == "uniform":
                pm[param] = dist[1] + rnd.random() * dist[2]
            else:
                pm[param] = rnd.choice(list(dist))
        maps.append(pm)
    return maps


def parallel_map(fn, items, parallelism: int = 4) -> list:
    """Run independent fits from driver threads: each is its own set of
    Spark jobs, so their tasks interleave on the executors."""
    items = list(items)
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(items)))) as pool:
        return list(pool.map(fn, items))


def _per_fold(fn, folds: int, parallelism: int = 4) -> list:
    return parallel_map(fn, range(folds), parallelism)


# The reference's random-search space, in Spark GBT terms
# (n_estimators -> maxIter, max_depth -> maxDepth, learning_rate -> stepSize,
# subsample -> subsamplingRate, min_child_weight -> minInstancesPerNode,
# gamma -> minInfoGain).
GBT_SPACE = {
    "maxIter": ("int", 50, 500),
    "maxDepth": ("int", 3, 15),
    "stepSize": ("uniform", 0.01, 0.3),
    "subsamplingRate": ("uniform", 0.6, 0.4),
    "minInstancesPerNode": ("int", 1, 10),
    "minInfoGain": ("uniform", 0.0, 5.0),
}


def random_search(train: DataFrame, estimator=None, space: dict | None = None,
                  n_iter: int = 100, seed: int = 42, parallelism: int = 4):
    """Randomised search (default: GBT over the reference's space, 100
    draws, the training split's fold column, positive-class F1)."""
    est = estimator or gbt()
    maps = sample_params(est, space or GBT_SPACE, n_iter, seed)
    return grid_search(est, maps, train, parallelism)


def cv_scores(estimator, train: DataFrame, folds: int = 5) -> list[float]:
    """Positive-class F1 of each fold (fit on the others)."""
    def one(k):
        fit = estimator.copy().fit(train.where(F.col("fold") != k))
        return f1_positive().evaluate(fit.transform(train.where(F.col("fold") == k)))
    return _per_fold(one, folds)


# ---- calibration, voting, stacking -------------------------------------------------

def named_outputs(estimator, name: str):
    """A copy that writes its own columns (``v_`` prediction, ``r_`` margins,
    ``q_`` probabilities), so that models score one frame one after another
    without joins."""
    est = estimator.copy().setPredictionCol(f"v_{name}").setRawPredictionCol(f"r_{name}")
    return est.setProbabilityCol(f"q_{name}") if est.hasParam("probabilityCol") else est


def with_scores(fitted: dict, frame: DataFrame) -> DataFrame:
    """``frame`` with the positive score ``p_`` and prediction ``v_`` of
    every model; a margin becomes a probability by the logistic function."""
    for name, model in fitted.items():
        if isinstance(model, dict):  # of ``trees``
            frame = frame.withColumn(f"p_{name}", trees.score(model, frame.sparkSession, FEATURES)) \
                .withColumn(f"v_{name}", (F.col(f"p_{name}") > 0.5).cast("double"))
            continue
        frame = model.transform(frame)
        p = (vector_to_array(f"q_{name}")[1] if f"q_{name}" in frame.columns
             else 1 / (1 + F.exp(-vector_to_array(f"r_{name}")[1])))
        frame = frame.withColumn(f"p_{name}", p).drop(f"r_{name}", f"q_{name}")
    return frame


def fit_all(estimators: dict, train: DataFrame, parallelism: int = 4) -> dict:
    """Fit independent models, submitted together."""
    names = list(estimators)
    return dict(zip(names, parallel_map(
        lambda n: named_outputs(estimators[n], n).fit(train), names, parallelism)))


def out_of_fold_scores(estimators: dict, train: DataFrame, folds: int = 5) -> DataFrame:
    """``train`` with every model's out-of-fold score: inside a fold all
    models score one frame in turn, then the folds are united. No join."""
    parts = [with_scores(fit_all(estimators, train.where(F.col("fold") != k)),
                         train.where(F.col("fold") == k)) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def out_of_fold(estimator, train: DataFrame, key: list[str], folds: int = 5,
                name: str = "score") -> DataFrame:
    """Out-of-fold positive scores ``(key, name)``: each fold scored by a
    model fitted on the other folds (no row scores itself)."""
    def one(k):
        fit = estimator.copy().fit(train.where(F.col("fold") != k))
        p = fit.transform(train.where(F.col("fold") == k))
        return p.select(*key, positive_score(p).alias(name))
    parts = _per_fold(one, folds)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def platt(train_scores: DataFrame, score: str = "score") -> PipelineModel:
    """Sigmoid (Platt) calibration: a one-feature logistic regression on
    out-of-fold scores."""
    asm = VectorAssembler(inputCols=[score], outputCol="_s")
    lr = LogisticRegression(featuresCol="_s", labelCol=LABEL, regParam=0.0)
    return Pipeline(stages=[asm, lr]).fit(train_scores)


def stacked_frame(frame: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    asm = VectorAssembler(inputCols=names, outputCol="meta_features")
    return asm.transform(frame)
