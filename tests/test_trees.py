"""Forests and boosted trees over all rows, against ``pyspark.ml`` and plain counts."""

import json

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from respondo.operators import models, trees

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def train(spark):
    u = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000 for i in range(4)]
    df = spark.range(6000).select(F.round(u[0] * 20).alias("a"), F.round(u[1] * 4).alias("b"), (u[2] > 0.99).cast("double").alias("c"),
                                  u[3].alias("u"))
    p = 0.1 + 0.5 * (F.col("a") > 8).cast("int") + 0.1 * (F.col("b") > 2).cast("int")
    df = df.withColumn(models.LABEL, (F.col("u") < p).cast("double")).withColumn(
        models.WEIGHT, F.when(F.col(models.LABEL) == 1, 1.4).otherwise(0.8)).drop("u")
    return VectorAssembler(inputCols=NAMES, outputCol=models.FEATURES).transform(df).repartition(3).cache()


@pytest.fixture(scope="module")
def data(train):
    return trees.packed(train, NAMES, models.FEATURES, models.LABEL, models.WEIGHT)


def test_blocks_hold_every_row_and_rare_values_keep_a_cut(train, data):
    got = data.blocks.collect()
    assert sum(r["n"] for r in got) == train.count()
    bins = np.concatenate([trees.opened(r, 3)[0] for r in got], 1)
    assert bins.max() < trees.BINS
    want = [train.where(F.col("c") == v).count() for v in (0, 1)]
    assert np.bincount(bins[2], minlength=2).tolist() == want and want[1] < 100
    assert len({r["block"] for r in got}) == len(got)


def test_boosting_is_that_of_pyspark(train, data):
    model = trees.boosted(data, 12, 3, 0.1)  # more rounds than the margins are left behind
    got = train.withColumn("p", trees.score(model, train.sparkSession, models.FEATURES))
    want = models.gbt(12, 3, 0.1).fit(train).transform(got)
    gap = want.select(F.avg(F.abs(F.col("p") - models.positive_score(want)))).first()[0]
    assert gap < 1e-6  # few values: both cut between all of them


def test_late_margins_change_nothing(train, data, monkeypatch):
    one = trees.boosted(data, 7, 3, 0.1, subsample=0.8, balanced=True)
    monkeypatch.setattr(trees, "REFRESH", 2)
    assert trees.boosted(data, 7, 3, 0.1, subsample=0.8, balanced=True)["trees"] == one["trees"]


def test_plans_do_not_grow_with_the_rounds(data, monkeypatch):
    plans, own = [], trees._sums

    def noted(frame, *rest):
        plans.append(len(frame._jdf.queryExecution().toString()))
        return own(frame, *rest)
    monkeypatch.setattr(trees, "REFRESH", 2)
    monkeypatch.setattr(trees, "_sums", noted)
    trees.boosted(data, 10, 1, 0.1)
    assert len(plans) == 10 and plans[-1] < 1.2 * plans[2]


@pytest.mark.parametrize("balanced", [False, True])
def test_forest_scores_as_that_of_pyspark(train, data, balanced):
    model = trees.forest(data, 30, 5, balanced)
    got = train.withColumn("p", trees.score(model, train.sparkSession, models.FEATURES))
    ml = models.forest(30, 5, balanced).fit(train)
    want = ml.transform(got)
    gap = want.select(F.avg(F.abs(F.col("p") - models.positive_score(want)))).first()[0]
    assert gap < 0.03
    assert np.abs(np.array(trees.importances(model)) - ml.featureImportances.toArray()).max() < 0.15
    assert json.loads(json.dumps(model)) == model  # as saved and loaded


def test_forest_of_many_passes_is_the_same(data, monkeypatch):
    one = trees.forest(data, 4, 4, False)
    monkeypatch.setattr(trees, "COUNTED_BYTES", 1)
    monkeypatch.setattr(trees, "NODES", 2)
    assert trees.forest(data, 4, 4, False) == one


def test_permuted_counts_equal_single_scores(train, data):
    model = trees.forest(data, 5, 4, False)
    shifted = train.withColumn("_moved", F.struct((20 - F.col("a")).alias("a"), (4 - F.col("b")).alias("b"),
                                                  (1 - F.col("c")).alias("c")))
    got = {r.variant: (r.tp, r.fp, r.tn, r.fn)
           for r in trees.permuted_counts(model, shifted, NAMES, models.LABEL).collect()}
    for i in range(-1, 3):
        rows = shifted.drop(models.FEATURES)
        if i >= 0:
            rows = rows.withColumn(NAMES[i], F.col(f"_moved.{NAMES[i]}"))
        rows = VectorAssembler(inputCols=NAMES, outputCol=models.FEATURES).transform(rows)
        hit = trees.score(model, train.sparkSession, models.FEATURES) > 0.5
        n = {(r[0], r[1]): r[2] for r in rows.groupBy(models.LABEL, hit).count().collect()}
        assert got[i] == tuple(n.get(k, 0) for k in ((1.0, True), (0.0, True), (0.0, False), (1.0, False)))
