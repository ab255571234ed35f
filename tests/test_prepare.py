"""Model preparation and edge semantics: NULLs, NaN, negative keys, ragged
rows, fractional medians, rows without a prediction."""

import pytest
from pyspark.sql import functions as F

from respondo.operators import features, metrics, models, quantiles, splits, thresholds, tuning
from respondo.sources.delimited import read_delimited, split_single_column

KEY = ["k"]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i - 200, int(i % 9 == 0), None if i % 7 == 0 else float(i % 9 == 0) * 3 + i % 5,
             None if i % 11 == 0 else "abc"[i % 3]) for i in range(400)]
    return spark.createDataFrame(rows, "k long, y int, x double, c string")


def test_prepare_fits_on_training_rows_and_learns(frame):
    prep = models.prepare(frame, KEY, "y", ["x"], ["c"], k_best=None)
    rows = prep.frame.collect()
    assert len(rows) == 400
    train = [r for r in rows if r["split"] == "train"]
    pos = sum(r["label"] for r in train)
    for r in rows:
        n_c = pos if r["label"] else len(train) - pos
        assert r["w"] == pytest.approx(len(train) / (2 * n_c))
    n_pos = sum(r["label"] for r in rows)
    assert sum(r["label"] for r in rows if r["split"] == "test") == int(0.3 * n_pos + 0.5)
    model = models.logistic(prep.n_train).fit(prep.frame.where("split = 'train'"))
    auc = models.evaluate(models.scored(model, prep.frame, KEY), "m").first()["roc_auc"]
    assert auc > 0.8  # the label follows x, so a working learner finds it


def test_voting_and_stacking_columns_without_joins(frame):
    prep = models.prepare(frame, KEY, "y", ["x"], ["c"], k_best=None)
    train = prep.frame.where("split = 'train'")
    bases = {"lr": models.logistic(prep.n_train), "svm": models.linear_svm(prep.n_train)}
    out = models.with_scores(models.fit_all(bases, train), prep.frame)
    assert out.count() == 400 and {"p_lr", "v_lr", "p_svm", "v_svm"} <= set(out.columns)
    oof = models.out_of_fold_scores(bases, train, 5)
    assert oof.count() == train.count()
    assert oof.where("p_svm < 0 or p_svm > 1 or p_lr is null").count() == 0


def test_folds_are_stratified_with_negative_keys(frame):
    out = splits.stratified_folds(frame, KEY, "y", 5)
    for y in (0, 1):
        sizes = [r["count"] for r in out.where(F.col("y") == y).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    plain = {r["fold"] for r in splits.fold_ids(frame, KEY, 5).collect()}
    assert plain == set(range(5))
    n = splits.train_test_split(frame.where("k < 0"), KEY, 30).where("split = 'test'").count()
    assert 30 <= n <= 90


def test_one_hot_of_null_is_zero(frame):
    out = frame.where("c is null").select(*features.one_hot({"c": ["a", "b", "c"]})).collect()
    assert out and all(tuple(r) == (0.0, 0.0) for r in out)


def test_fractional_median_of_integers(spark):
    df = spark.createDataFrame([(4,), (5,), (None,)], "v int")
    out = features.impute(df, features.fit_medians(df, ["v"])).collect()
    assert sorted(r["v"] for r in out) == [4.0, 4.5, 5.0]


def test_percentiles_leave_nan_out(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(float("nan"),), (None,)], "v double")
    got = {r["p_idx"]: r["value"] for r in quantiles.exact_percentiles(df, ["v"], [0.5, 1.0]).collect()}
    assert got == {0: 5.0, 1: 10.0}


def test_rows_without_prediction_are_in_no_count(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.8), (1, None, None), (None, 1, 0.7)],
                               "y int, pred int, score double")
    r = metrics.confusion(df).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (1, 1, 0, 0)
    t = thresholds.threshold_counts(df, [0.5]).first()
    assert (t["tp"], t["fp"], t["tn"], t["fn"]) == (1, 1, 0, 0)


def test_ragged_rows_are_errors(spark, tmp_path):
    path = tmp_path / "ragged.tsv"
    path.write_text("a\tb\n1\t2\n3\t4\t5\n")
    with pytest.raises(Exception):
        read_delimited(spark, str(path)).collect()
    one = spark.createDataFrame([("a;b",), ("1;2",), ("3;4;5",)], "value string").coalesce(1)
    with pytest.raises(Exception):
        split_single_column(one, "value").collect()


def test_damaged_table(spark, tmp_path):
    """A contact table with the damages of real exports: a decimal comma, a
    spreadsheet date in a number, an empty field, quoted headers."""
    from respondo.sources.delimited import read_raw_contacts
    path = tmp_path / "raw.xls"
    path.write_text('"age"\t"job"\t"duration"\t"emp.var.rate"\n30\tadmin.\t100\t1,4\n'
                    "41\tunknown\t1.Oca\t-0.1\n\tservices\t7\t\n")
    out = [tuple(r) for r in read_raw_contacts(spark, str(path)).collect()]
    assert out == [(30.0, "admin.", 100.0, 1.4), (41.0, "unknown", None, -0.1), (None, "services", 7.0, None)]


def test_saved_models_and_preparation_score_raw_rows_alike(spark):
    from respondo.catalog import io, modelling
    from respondo.operators import models
    from conftest import SF_SMALL
    out = {r.model_name: r for r in io.q_save_load_models(spark, SF_SMALL).collect()}
    prep = modelling._prepared(spark, SF_SMALL)
    assert set(out) == {f"{n}_reloaded" for n in modelling._base_models(prep)}
    rows = modelling._base_scores(prep)
    for name in ("logistic_regression", "random_forest", "linear_svm"):  # as before they were saved
        want = models.evaluate(rows.select("split", "y", F.col(f"p_{name}").alias("score"),
                                           F.col(f"v_{name}").cast("int").alias("pred")), name).first()
        got = out[f"{name}_reloaded"]
        assert (got.tp, got.fp, got.tn, got.fn) == (want.tp, want.fp, want.tn, want.fn)
        assert abs(got.roc_auc - want.roc_auc) < 1e-9
    assert all(r.pca_variance > 0 for r in out.values())


def test_preparation_reads_one_table_without_shuffles(frame, monkeypatch):
    written = []

    def staged(df, name, write=models.staged):
        written.append(name)
        return write(df, name)
    monkeypatch.setattr(models, "staged", staged)
    prep = models.prepare(frame, KEY, "y", ["x"], ["c"], k_best=None)
    assert written == ["model-input"]
    plan = prep.rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Window" not in plan


def test_folds_of_some_rows_are_those_of_all(spark):
    # keys that come twice or are null, classes that are null
    rows = [(i * 7919 % 100_003 if i % 50 else None, i % 3 if i % 17 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, y int, v int")
    every = {r["v"]: r["fold"] for r in splits.stratified_folds(df, KEY, "y", 5).collect()}
    some = splits.folds_of(df, F.col("v") % 13 == 0, KEY, "y", 5).collect()
    assert {r["v"]: r["fold"] for r in some} == {v: k for v, k in every.items() if v % 13 == 0}
    few = {r["v"]: r["fold"] for r in splits.folds_of(df, F.col("v") < 40, KEY, "y", 5, bits=2).collect()}
    assert few == {v: k for v, k in every.items() if v < 40}


def test_rows_without_key_count_in_folds_only(spark, frame):
    df = frame.withColumn("k", F.when(F.col("k") % 16 != 5, F.col("k"))).withColumn("x", F.coalesce("x", F.lit(0.5)))
    prep = models.prepare(df, KEY, "y", ["x"], ["c"], k_best=None)
    want = {r["k"]: r["fold"] for r in splits.stratified_folds(df, KEY, "y", 5).collect()}
    assert {r["k"]: r["fold"] for r in prep.frame.collect()} == want and None not in want
    s = tuning.sample(prep, KEY, 1000)
    train = [r["k"] for r in prep.rows.where("split = 'train'").collect()]
    assert s.rows == prep.n_train == len(train)
    assert sorted(s.told.value["fold"].tolist()) == sorted(want[k] for k in train)


def test_modes_and_categories_from_one_count(frame, monkeypatch):
    modes, vocab = features.fit_values(frame, ["c"])
    assert modes == features.fit_modes(frame, ["c"])
    assert vocab == features.fit_categories(features.impute(frame, modes), ["c"])
    with pytest.raises(ValueError):
        features.fit_values(frame, ["c"], max_categories=2)


def test_components_take_one_fit(spark, monkeypatch):
    from conftest import SF_SMALL
    from respondo.catalog import modelling
    prep = modelling._prepared(spark, SF_SMALL, k_best=None)
    want = modelling.fewest_components(prep)
    fits = []

    class Counted(modelling.PCA):
        def fit(self, *args, **kw):
            fits.append(self.getK())
            return super().fit(*args, **kw)
    monkeypatch.setattr(modelling, "PCA", Counted)
    rows = modelling.q_pca_95(spark, SF_SMALL).orderBy("component").collect()
    assert fits == [len(prep.feature_names)] and len(rows) == want.getK() < len(prep.feature_names)
    for row, loadings in zip(rows, want.pc.toArray().T):
        assert [row.loadings[n] for n in prep.feature_names] == pytest.approx(loadings.tolist(), abs=1e-9)


def test_report_reads_each_join_from_one_written_input(spark):
    """No section joins orders again: they read the two tables written for them."""
    from conftest import SF_SMALL
    from respondo.catalog import QUERIES
    plan = QUERIES["report_tables"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "c_custkey" not in plan


def test_preparation_of_many_rows_starts_from_few(spark, monkeypatch):
    """Rows written apart, where there are many, change no number, no fold and no sampled row; the
    fits of the classes are those of the plain operators. Keys come twice or are null."""
    rows = [(i // 2 if i % 31 else None, None if i % 41 == 0 else int(i * 37 % 100 < 30 + i % 7 * 5),
             None if i % 13 == 0 else i * 7919 % 1009 / 8 + (i % 7 > 4) * 30, float(i % 7), 0.1,
             None if i % 11 == 0 else "abc"[i * i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, y int, x double, u double, same double, c string")
    numeric = ["x", "u", "same"]
    one = models.prepare(df, KEY, "y", numeric, ["c"], k_best=3)
    whole = tuning.sample(one, KEY, 150).told.value
    sketched = []
    sketch = F.percentile_approx
    monkeypatch.setattr(models, "LOW_ROWS", 800)
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: sketched.append(a[0]) or sketch(*a))
    monkeypatch.setattr(quantiles, "staged", None)
    prep = models.prepare(df, KEY, "y", numeric, ["c"], k_best=3)
    assert sketched == numeric and 0 < prep.low.count() < prep.n_train / 2  # one sketch, of the few rows
    assert (prep.n_train, prep.feature_names) == (one.n_train, one.feature_names)
    assert prep.params["impute"] == one.params["impute"]
    few = tuning.sample(prep, KEY, 150).told.value
    for name in ("y", "x"):
        assert few[name] == pytest.approx(whole[name], nan_ok=True)
    train = prep.raw.where("split = 'train' and k is not null")
    filled = features.impute(train, prep.params["impute"])
    want = features.fit_standard(filled, numeric)
    assert want["same"][1] == 0.0 == prep.params["standard"]["same"][1]
    assert all(prep.params["standard"][c] == pytest.approx(want[c]) for c in numeric)
    enc = filled.select(models.LABEL, *features.standardize(want), *features.one_hot(prep.params["categories"]))
    scores = {r.feature: r.f_score for r in features.anova_f(enc, enc.columns[1:], models.LABEL).collect()}
    _, vocab, counts = features.fit_class_values(train, ["c"], models.LABEL)
    moments = features.class_moments(filled, numeric, models.LABEL)
    got = {r.feature: r.f_score for r in features.anova_of_classes(spark, moments, want, vocab, counts).collect()}
    assert got.keys() == scores.keys() and all(got[f] == pytest.approx(scores[f]) for f in got)
    weights = {r[models.LABEL]: r["balanced_weight"] for r in features.class_weights(train, models.LABEL).collect()}
    for r in prep.rows.select(models.LABEL, "w").distinct().collect():
        assert r["w"] == (1.0 if r[models.LABEL] is None else weights[r[models.LABEL]])


def test_percentiles_from_misleading_rows_are_exact(spark):
    df = spark.createDataFrame([(float(i * 7919 % 5003), None if i % 9 else float(i), 3.0, None) for i in range(5003)],
                               "a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    want = {(r["feature"], r["p_idx"]): r["value"] for r in quantiles.exact_percentiles(df, cols, [0.3, 0.5]).collect()}
    assert want["a", 1] == 2501.0
    for some in (df.where("a < 50"), df.where("a < 0"), df.where("a % 3 = 0")):
        for band in (40, 100_000):
            got = quantiles.exact_percentiles(df, cols, [0.3, 0.5], max_band=band, some=some).collect()
            assert {(r["feature"], r["p_idx"]): r["value"] for r in got} == want


def test_folds_from_known_counts_and_few_rows(spark):
    rows = [(i * 7919 % 100_003 if i % 50 else None, i % 3 if i % 17 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, y int, v int")
    every = {r["v"]: r["fold"] for r in splits.stratified_folds(df, KEY, "y", 5).collect()}
    counts = splits.bucket_counts(df, KEY, "y")
    for some in (None, df.where("v % 13 < 4")):
        out = splits.folds_of(df, F.col("v") % 13 == 0, KEY, "y", 5, counts=counts, some=some).collect()
        assert {r["v"]: r["fold"] for r in out} == {v: k for v, k in every.items() if v % 13 == 0}
    split = {r["v"]: r["split"] for r in splits.stratified_split(df, KEY, "y").collect()}
    assert {r["v"]: r["split"] for r in splits.stratified_split(df, KEY, "y", counts=counts).collect()} == split
