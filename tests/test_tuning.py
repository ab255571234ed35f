"""Tuning kernels and queries: splits against brute force, prefix reuse
against separate runs, models against the probabilities the response was
drawn from, and whole result tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from respondo.catalog import QUERIES, modelling
from respondo.operators import features, learners, metrics, models, tuning
from respondo.plans.contacts import KEY, contacts
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def toy():
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 5))
    x[:, 4] = r.integers(0, 3, 600)
    y = (r.random(600) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] * (x[:, 4] > 0))))).astype(float)
    cuts = learners.bin_cuts(x)
    w = (np.arange(600) % 5 > 0).astype(float)
    return {"x": x, "b": learners.binned(x, cuts), "y": y, "fold": np.arange(600) % 5}, w


def test_first_split_is_the_best_of_all(toy):
    data, w = toy
    b, g = data["b"], w * (data["y"] - .4)
    levels, (feature, cut, _) = learners.grow(b, g, w, 1, ridge=1.0)

    def score(rows):
        return g[rows].sum() ** 2 / (w[rows].sum() + 1.0)

    gains = {(f, c): score(b[:, f] <= c) + score(b[:, f] > c)
             for f in range(5) for c in range(learners.BINS - 1) if 0 < w[b[:, f] <= c].sum() < w.sum()}
    assert (feature[0], cut[0]) == max(gains, key=gains.get)
    assert (learners.route(b, (feature, cut, np.array([1, 0, 0]))) == levels[-1]).all()


def test_limits_of_trees(toy):
    data, w = toy
    levels, tree = learners.grow(data["b"], w * data["y"], w, 30, w, min_leaf=20, min_split=60)
    sizes = np.bincount(levels[-1], w)
    assert sizes[sizes > 0].min() >= 20
    assert (learners.route(data["b"], tree) == levels[-1]).all()
    assert len(learners.grow(data["b"], w * data["y"], w, 30, least_gain=1e9)[0]) == 1


def test_one_run_answers_for_shorter_ones(toy):
    data, w = toy
    b, y = data["b"], data["y"]
    for newton in (True, False):
        p = {"learning_rate": .2, "max_depth": 3, "subsample": .8, "colsample": .8, "newton": newton}
        long = learners.boosted(b, y, w, p, [5, 20])[0]
        assert np.array_equal(long[5], learners.boosted(b, y, w, p, [5])[0][5])
    for p in ({}, {"min_leaf": 4, "class_weight": "balanced"}):
        deep = learners.decision_tree(b, y, w, p, [2, 5, 30])[0]
        assert all(np.array_equal(deep[d], learners.decision_tree(b, y, w, p, [d])[0][d]) for d in deep)
    whole = learners.forest(b, y, w, {"class_weight": "balanced_subsample"}, [3, 6], [4, 30])[0]
    assert np.array_equal(whole[3, 30], learners.forest(b, y, w, {"class_weight": "balanced_subsample"}, [3], [30])[0][3, 30])


@pytest.mark.parametrize("name", sorted(tuning.BEST))
def test_kept_models_score_like_their_fit(toy, name):
    data, w = toy
    score, model = tuning.fitted(name, tuning.BEST[name], data, w)
    assert np.allclose(tuning.probability(model, data["x"], data["b"]), score)
    held = w == 0
    pos, neg = score[held & (data["y"] == 1)], score[held & (data["y"] == 0)]
    assert (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2 > .62  # 120 held-out rows


def test_held_out_labels_are_not_learned(toy):
    data, w = toy
    other = {**data, "y": np.where(w > 0, data["y"], 1 - data["y"])}
    for name, p in tuning.BEST.items():
        assert np.allclose(tuning.fitted(name, p, data, w)[0], tuning.fitted(name, p, other, w)[0]), name


def test_grids_have_every_point():
    sizes = {"logistic_regression": 16, "decision_tree": 90, "random_forest": 108, "boosted_trees": 324, "svm": 24,
             "gradient_boosting": 216}
    for name, size in sizes.items():
        points = 1
        for values in tuning.GRIDS[name].values():
            points *= len(values)
        assert points == size
    draws = tuning.drawn_runs(100)
    assert len({json.dumps(p) for _, p in draws}) == 100
    assert all(set(p) == set(tuning.SPACE) and 50 <= p["n_estimators"][0] < 500 and 3 <= p["max_depth"] < 15
               and 0 <= p["gamma"] <= 5 and .6 <= p["colsample"] <= 1 for _, p in draws)


@pytest.fixture(scope="module")
def prepared(spark):
    return modelling._prepared(spark, SF_SMALL)


@pytest.fixture(scope="module")
def true_auc(spark):
    """The best AUC that any model can expect: that of the probabilities."""
    df = modelling.responses(contacts(spark, SF_SMALL, [*modelling.NUMERIC, *modelling.CATEGORICAL]))
    return metrics.roc_auc(df.select("y", F.col("p_true").alias("score"), F.lit(0).alias("g")), by=["g"]).first()[1]


def test_the_sample_is_bounded_and_whole(spark, prepared):
    s = tuning.sample(prepared, KEY, 1000)
    assert s.rows == 1000 and s.folds == 5
    assert tuning.sample(prepared, KEY, 10 ** 6).rows == prepared.n_train


def test_stacking_equals_a_sequential_run(spark, prepared, true_auc):
    s = tuning.sample(prepared, KEY, 600)
    small = {k: v for k, v in tuning.BEST.items() if k != "boosted_trees"}
    fits = tuning.all_fits(s, small)
    data = s.told.value
    for name, p in small.items():
        for k in range(5):
            own = tuning.fitted(name, p, data, (data["fold"] != k).astype(float))[0]
            assert np.allclose(own[data["fold"] == k], fits[name]["oof"][data["fold"] == k])
    meta = tuning.stack(s, fits)
    out = tuning.scored(prepared, s, KEY, fits, meta=meta).toPandas()
    assert len(out) == prepared.frame.count()
    z = np.stack([out[f"p_{n}"] for n in small], 1)
    assert np.allclose(out["stacked"], 1 / (1 + np.exp(-(z @ meta["beta"][:-1] + meta["beta"][-1]))))


def test_combined_models_come_near_the_truth(spark, true_auc):
    stacked = QUERIES["stacking"](spark, SF_SMALL).first()
    assert true_auc - .05 < stacked.roc_auc < true_auc + .05
    rows = QUERIES["calibrate_sigmoid"](spark, SF_SMALL).collect()
    assert len(rows) == 6
    assert all(r.roc_auc > .75 and r.brier_calibrated < r.brier_raw + .002 for r in rows)
    assert sum(r.brier_calibrated for r in rows) < sum(r.brier_raw for r in rows)
    folds = QUERIES["cross_val_score"](spark, SF_SMALL).collect()
    assert [r.fold for r in sorted(folds, key=lambda r: r.fold)] == list(range(5))
    assert np.isclose(folds[0].std_f1, np.std([r.f1 for r in folds])) and folds[0].mean_f1 > .55


@pytest.mark.parametrize("name", ["logistic_regression", "svm", "decision_tree"])
def test_a_whole_grid(spark, prepared, name):
    s = tuning.sample(prepared, KEY, 500)
    out = tuning.points(tuning.cross_validated(s, tuning.grid_runs(name))).collect()
    want = 1
    for values in tuning.GRIDS[name].values():
        want *= len(values)
    assert len(out) == len({r.params for r in out}) == want and all(r.folds == 5 for r in out)
    assert all(set(json.loads(r.params)) == set(tuning.GRIDS[name]) for r in out)


def test_draws_are_cross_validated(spark, prepared):
    s = tuning.sample(prepared, KEY, 400)
    out = tuning.points(tuning.cross_validated(s, tuning.drawn_runs(6))).collect()
    assert len(out) == 6 and all(r.folds == 5 for r in out)
    data = s.told.value
    for r in out:
        p = json.loads(r.params)
        f1 = []
        for k in range(5):
            held = data["fold"] == k
            score = learners.boosted(data["b"], data["y"], (~held) * 1.0, {**p, "newton": True}, [p["n_estimators"]])[0]
            f1.append(tuning.f1_score(data["y"][held], score[p["n_estimators"]][held] >= .5))
        assert np.isclose(np.mean(f1), r.mean_f1)


def test_base_models_learn(spark, prepared, true_auc):
    """The models of the whole training split rank almost as well as the truth."""
    for est in (models.logistic(prepared.n_train), models.tree(5)):
        got = models.evaluate(models.scored(est.fit(modelling._train(prepared)), prepared.frame, KEY), "m").first()
        assert true_auc - .08 < got.roc_auc < true_auc + .04


def test_scores_of_one_split_are_those_of_all_rows(spark, prepared):
    s = tuning.sample(prepared, KEY, 400)
    fits = tuning.all_fits(s, {n: tuning.BEST[n] for n in ("decision_tree", "svm")})
    parts = tuning.calibrated(s, fits)
    every = tuning.scored(prepared, s, KEY, fits, calibration=parts).where("split = 'test'").toPandas()
    some = tuning.scored(prepared, s, KEY, fits, calibration=parts, split="test").toPandas()
    assert len(some) == len(every) > 0 and set(some.split) == {"test"}
    each = [f.sort_values(KEY).reset_index(drop=True) for f in (every, some)]
    assert all(np.allclose(each[0][c], each[1][c]) for c in ("p_svm", "c_svm", "c_decision_tree"))


def test_routes_step_by_step(toy):
    data, w = toy
    for depth in (0, 1, 9):
        _, tree = learners.grow(data["b"], w * data["y"], w, depth)
        feature, cut, left = tree
        for i, at in enumerate(learners.route(data["b"], tree)):
            node = 0
            while feature[node] >= 0:
                node = left[node] + int(data["b"][i, feature[node]] > cut[node])
            assert node == at


def test_label_codes_of_many_values(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.format_string("v%06d", F.col("id") * 7919 % 20_011))
                                      .alias("v"))
    out = features.label_encode(rows, "v", "code").distinct().collect()
    values = sorted(r.v for r in out if r.v is not None)
    assert len(values) > features.MAX_CATEGORIES
    assert {r.v: r.code for r in out} == {**{v: i for i, v in enumerate(values)}, None: None}


def test_running_sums_over_many_ranges(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(float(np.round(r.random(), 3)), int(r.random() < .3), g) for g in ("a", "b") for _ in range(900)]
    df = spark.createDataFrame(rows, "score double, y int, g string")
    one = {x.g: x.roc_auc for x in metrics.roc_auc(df, by=["g"]).collect()}
    curve = sorted(map(tuple, metrics.roc_points(df, by=["g"]).collect()))
    monkeypatch.setattr(metrics, "RANGE_ROWS", 50)
    assert {x.g: x.roc_auc for x in metrics.roc_auc(df, by=["g"]).collect()} == one
    assert sorted(map(tuple, metrics.roc_points(df, by=["g"]).collect())) == curve
    for g in one:
        pos, neg = (np.array([s for s, y, k in rows if k == g and y == v]) for v in (1, 0))
        assert np.isclose(one[g], (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)


def test_auc_from_many_blocks_and_ranges(spark, monkeypatch):
    """Ties across blocks, missing and endless scores, rows without a label, groups of
    which one lies in a small part of the scores: blocks and ranges change nothing."""
    r = np.random.default_rng(4)
    rows = [(None if r.random() < .05 else float(np.round(r.random() * (.01 if g == "b" else 1), 4)),
             None if r.random() < .05 else int(r.random() < .3), g) for g in ("a", "b", None) for _ in range(1500)]
    rows += [(v, y, "a") for v in (float("inf"), float("-inf"), float("nan"), -0.0) for y in (0, 1, 0)]
    df = spark.createDataFrame(rows, "score double, y int, g string").repartition(3)
    one = {x.g: x.roc_auc for x in metrics.roc_auc(df, by=["g"]).collect()}
    for g in one:
        # without a score: below all others; not a number: above
        place = [(-1e30 if s is None else 1e30 if s != s else max(min(s, 1e20), -1e20), y)
                 for s, y, k in rows if k == g]
        pos, neg = (np.array([s for s, y in place if y == v]) for v in (1, 0))
        assert one[g] == round((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2, 9)
    blocks = metrics._score_blocks(df, ["score"], "y", ["g"])
    assert blocks.count() < 40  # arrays of scores travel, not a row for each of them
    monkeypatch.setattr(metrics, "BLOCK_ROWS", 200)
    monkeypatch.setattr(metrics, "MERGED_ROWS", 300)
    many = metrics._score_blocks(df, ["score"], "y", ["g"])
    assert metrics._range_sums(many, ["g"]).select("range").distinct().count() > 8
    assert {x.g: x.roc_auc for x in metrics.roc_auc(df, by=["g"]).collect()} == one


def test_metrics_of_several_score_columns_equal_those_of_long_rows(spark):
    r = np.random.default_rng(5)
    rows = [(float(r.random()), None if r.random() < .1 else float(r.random()), int(r.random() < .4))
            for _ in range(400)]
    df = spark.createDataFrame(rows, "p_a double, p_b double, y int")
    long = df.select("y", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("score"))
                                              for m in "ab"])).alias("s")).select("y", "s.*")
    pred = long.withColumn("pred", (F.col("score") >= .5).cast("int"))
    names = {"a": "p_a", "b": "p_b"}
    assert sorted(metrics.confusion_wide(df, names, .5).collect()) == \
        sorted(metrics.confusion(pred, by=["model"]).collect())
    assert sorted(metrics.roc_auc_wide(df, names).collect()) == sorted(metrics.roc_auc(long, by=["model"]).collect())
    assert not metrics.confusion_wide(df.limit(0), names, .5).collect()
    assert not metrics.roc_auc_wide(df.limit(0), names).collect()


def test_rows_without_a_score_count_alike_at_every_size(spark):
    """Below all others, in P and in N, on either side of 100,000 distinct scores."""
    for n in (900, 150_000):
        y = F.when(F.col("id") % 3 == 0, 1).otherwise(0)
        df = spark.range(n).select(F.when(F.col("id") % 4 > 0, (F.col("id") * 7919 % n).cast("double")).alias("score"),
                                   y.alias("y"))
        i = np.arange(n)
        score, pos = np.where(i % 4 > 0, i * 7919 % n, -1.0), i % 3 == 0
        order = np.argsort(score, kind="stable")
        _, at, size = np.unique(score[order], return_index=True, return_counts=True)
        rank = np.empty(n)
        rank[order] = np.repeat(at + (size + 1) / 2, size)
        want = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (n - pos.sum()))
        assert metrics.roc_auc_wide(df, {"a": "score"}).first().roc_auc == round(want, 9)
