"""Operator semantics on small hand-made frames, against published or
hand-computed values (the reference has no tests; its committed outputs
are the goldens)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from respondo.functions.scalar import coerce_numeric
from respondo.operators import features, metrics, prefix, rules, segments, splits, thresholds


def knn_pairs_brute(rows: list[tuple[int, list[float]]], k: int) -> dict[int, list[int]]:
    """kNN on a small list: id -> k nearest ids."""
    out = {}
    for i, xi in rows:
        ds = sorted((math.dist(xi, xj), j) for j, xj in rows if j != i)
        out[i] = [j for _, j in ds[:k]]
    return out


def conf_frame(spark, tp, fp, tn, fn):
    return spark.createDataFrame([(tp, fp, tn, fn)], "tp long, fp long, tn long, fn long")


@pytest.mark.parametrize("counts,expected", [
    # (TP, FP, FN, TN) -> accuracy, precision, recall, F1 of the published metrics
    ((48, 26, 87, 1075), (0.9086, 0.6486, 0.3556, 0.4593)),
    ((64, 55, 71, 1046), (0.8981, 0.5378, 0.4741, 0.5039)),
    ((103, 96, 32, 1005), (0.8964, 0.5176, 0.7630, 0.6168)),
])
def test_binary_metrics_match_published(spark, counts, expected):
    tp, fp, fn, tn = counts
    r = metrics.with_binary_metrics(conf_frame(spark, tp, fp, tn, fn)).first()
    got = (r.accuracy, r.precision, r.recall, r.f1)
    assert [round(x, 4) for x in got] == list(expected)


def test_metrics_zero_when_undefined(spark):
    r = metrics.with_binary_metrics(conf_frame(spark, 0, 0, 10, 5)).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_classification_report_rows(spark):
    rep = {r.label: r for r in metrics.classification_report(
        conf_frame(spark, 48, 26, 1075, 87)).collect()}
    assert set(rep) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert rep["1"].support == 135 and rep["0"].support == 1101
    p0, p1 = 1075 / (1075 + 87), 48 / 74
    assert rep["macro avg"].precision == pytest.approx((p0 + p1) / 2, abs=1e-9)
    assert rep["weighted avg"].precision == pytest.approx((p0 * 1101 + p1 * 135) / 1236, abs=1e-9)


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_perfect_constant_and_ties(spark):
    perfect = [(i / 10, int(i >= 5)) for i in range(10)]
    const = [(0.3, i % 2) for i in range(10)]
    rnd = random.Random(7)
    tied = [(rnd.choice([0.1, 0.2, 0.3, 0.4]), rnd.randint(0, 1)) for _ in range(300)]
    for rows, want in ((perfect, 1.0), (const, 0.5), (tied, brute_auc(tied))):
        df = spark.createDataFrame(rows, "score double, y int")
        got = metrics.roc_auc(df).first().roc_auc
        assert got == pytest.approx(want, abs=1e-9)


def test_running_sums_match_brute_force(spark):
    rnd = random.Random(3)
    rows = [(g, float(rnd.randint(0, 50)), rnd.randint(0, 5)) for g in ("a", "b") for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, x double, v long")
    agg = df.groupBy("g", "x").agg(F.sum("v").alias("v"))
    got = {(r.g, r.x): r.v_cum for r in prefix.running_sums(agg, "x", ["v"], ["g"], 4).collect()}
    for (g, x), cum in got.items():
        assert cum == sum(v for gg, xx, v in rows if gg == g and xx <= x)


def test_profit_sweep_reproduces_published_row(spark):
    # 107 + 104 rows above every threshold up to 0.5, 28 + 997 at score 0
    rows = [(0.55, 1)] * 107 + [(0.55, 0)] * 104 + [(0.0, 1)] * 28 + [(0.0, 0)] * 997
    df = spark.createDataFrame(rows, "score double, y int")
    sweep = {r.threshold_idx: r for r in thresholds.profit_sweep(df).collect()}
    assert len(sweep) == 18
    r = sweep[0]
    assert (r.tp, r.fp, r.tn, r.fn) == (107, 104, 997, 28)
    assert (r.total_calls, r.total_cost, r.total_revenue, r.missed_opportunity_cost, r.profit) == \
        (211, 1055, 10700, 560, 9085)
    assert r.roi == pytest.approx(8.611374407582938)
    assert r.cost_per_acquisition == pytest.approx(9.85981308411215)
    assert sweep[1].threshold == 0.15000000000000002
    assert r.is_best
    assert math.isinf(sweep[17].cost_per_acquisition)  # no positive predicted at 0.95


def test_f1_grid_and_floor(spark):
    grid = thresholds.arange(*thresholds.F1_GRID)
    assert len(grid) == 13
    rows = [(0.32, 1)] * 50 + [(0.32, 0)] * 10 + [(0.1, 0)] * 40
    s = thresholds.f1_sweep(spark.createDataFrame(rows, "score double, y int"))
    best = [r for r in s.collect() if r.is_best]
    assert len(best) == 1 and best[0].threshold == 0.3
    assert best[0].chosen_threshold == 0.5  # floored, F1 stays the optimum's
    assert best[0].f1 == pytest.approx(2 * (50 / 60) * 1.0 / (50 / 60 + 1.0))


def test_auto_approval_first_match(spark):
    cols = "duration double, poutcome string, pdays int, previous int, job string, " \
           "education string, contact string, marital string, age int"
    rows = [
        (700.0, "success", 999, 1, "student", "x", "cellular", "single", 30),  # rules 1,2,5 -> 1
        (450.0, "failure", 999, 0, "student", "x", "telephone", "married", 40),  # rule 2
        (360.0, "failure", 999, 0, "retired", "x", "cellular", "married", 40),   # rule 3
        (610.0, "failure", 999, 0, "services", "x", "telephone", "married", 40),  # rule 5
        (310.0, "failure", 10, 1, "services", "x", "telephone", "married", 40),  # rule 6
        (460.0, "failure", 999, 0, "admin.", "university.degree", "telephone", "single", 30),  # 8
        (100.0, "success", 999, 0, "admin.", "x", "cellular", "single", 30),  # none
    ]
    got = [r.auto_rule for r in rules.auto_approval(spark.createDataFrame(rows, cols)).collect()]
    assert got == [1, 2, 3, 5, 6, 8, 0]


def test_scores_and_bands(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 0.5, 0.2), (0.5, 0.0, 0.9)],
                               "d double, pd double, pr double")
    out = df.select(rules.base_rate_score(F.col("d"), F.col("pd"), F.col("pr")).alias("b"),
                    rules.fallback_score(F.col("d")).alias("f")).collect()
    sig = lambda x: 1 / (1 + math.exp(-4 * (x - 0.5)))
    assert out[0].b == pytest.approx(max(0.05, 0.11 + (sig(0) - 0.5) * 0.15 * 0.8))
    assert out[1].b == pytest.approx(0.11 + (sig(1) - 0.5) * 0.15 * 1.1 * 1.1)
    assert out[2].b == pytest.approx(0.11)
    assert out[1].f == pytest.approx(0.11 + (sig(1) - 0.5) * 0.12)
    bands = spark.createDataFrame([(0.8,), (0.5,), (0.3,), (0.0,)], "p double") \
        .select(rules.probability_band(F.col("p")).alias("b")).collect()
    assert [b.b for b in bands] == ["very_high", "high", "medium", "low"]


def test_coerce_numeric_like_reference(spark):
    vals = ["1.Oca", "1,5", "1d", " 2 ", "-0.1", "1e3", "Nis.96", None, "4.Ara", "5191"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.x for r in df.select(coerce_numeric("s").alias("x")).collect()]
    assert got == [None, 1.5, None, 2.0, -0.1, 1000.0, None, None, None, 5191.0]


def test_group_mode_smallest_on_tie(spark):
    df = spark.createDataFrame([(1, 31), (1, 30), (1, 31), (1, 30), (1, 45), (0, 5)],
                               "y int, age int")
    got = {r.y: (r.mode_value, r.mode_count) for r in segments.group_mode(df, "y", "age").collect()}
    assert got == {1: (30, 2), 0: (5, 1)}


def test_conditional_rates_empty_segment(spark):
    df = spark.createDataFrame([(1, 10.0), (0, 20.0), (1, 30.0)], "y int, d double")
    got = {r.segment: (r.rows, r.positives, r.rate_pct) for r in segments.conditional_rates(
        df, {"long": F.col("d") >= 20, "none": F.col("d") > 100}).collect()}
    assert got == {"long": (2, 1, 50.0), "none": (0, 0, None)}


def test_stratified_split_exact_counts(spark):
    rows = [(i, int(i % 7 == 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, y int")
    out = splits.stratified_split(df, ["k"], "y", 0.3, coarse_bits=4)
    got = {(r.y, r.split): r["count"] for r in out.groupBy("y", "split").count().collect()}
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    assert got[(1, "test")] == math.floor(n1 * 0.3 + 0.5)
    assert got[(0, "test")] == math.floor(n0 * 0.3 + 0.5)
    assert out.count() == 2000 and out.select("k").distinct().count() == 2000


def test_anova_f_matches_numpy(spark):
    import numpy as np
    rnd = np.random.default_rng(1)
    y = rnd.integers(0, 2, 500)
    x = rnd.normal(size=500) + y * 0.5
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, x)], "y int, x double")
    f = features.anova_f(df, ["x"]).first().f_score
    groups = [x[y == c] for c in (0, 1)]
    gm = x.mean()
    ssb = sum(len(g) * (g.mean() - gm) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert f == pytest.approx((ssb / 1) / (ssw / (500 - 2)), rel=1e-9)


def test_encoded_anova_f_equals_two_scans(spark):
    import numpy as np
    rnd = np.random.default_rng(3)
    rows = [(int(y), float(rnd.normal() + y), None if i % 11 == 0 else float(i % 5),
             None if i % 13 == 0 else "abc"[i % 3] if y else "bd"[i % 2], "one")
            for i, y in enumerate(rnd.integers(0, 3, 400))] + [(9, 1.0, None, "a", None)]
    df = spark.createDataFrame(rows, "y int, u double, v double, c string, only string")
    vocab = features.fit_categories(df, ["c", "only"])
    encoded = df.select("y", "u", "v", *features.one_hot(vocab))
    want = {r.feature: r for r in features.anova_f(encoded, encoded.columns[1:]).collect()}
    got = {r.feature: r for r in features.encoded_anova_f(df, ["u", "v"], ["c", "only"]).collect()}
    assert set(got) == set(want) == {"u", "v", "c_b", "c_c", "c_d"}
    for name, r in want.items():
        assert got[name].position == r.position
        assert got[name].f_score == pytest.approx(r.f_score, rel=1e-9)
    assert features.encoded_anova_f(df.limit(0), ["u"], ["c"]).count() == 0
    with pytest.raises(ValueError):
        features.encoded_anova_f(df, [], ["c"], max_categories=3)


def test_permuted_counts_equal_single_runs(spark):
    from pyspark.ml.feature import VectorAssembler
    from respondo.operators import metrics, models
    df = spark.range(300).selectExpr(
        "cast(id % 7 as double) as a", "cast(id % 5 as double) as b",
        f"cast(id % 7 + id % 5 > 5 as double) as {models.LABEL}",
        "named_struct('a', cast((id + 1) % 7 as double), 'b', cast((id + 1) % 5 as double)) as _moved")

    def assembled(frame):
        return VectorAssembler(inputCols=["a", "b"], outputCol=models.FEATURES).transform(frame)

    model = models.tree(max_depth=4).fit(assembled(df))
    got = {r.variant: tuple(r)[1:] for r in models.permuted_counts(model, df, ["a", "b"]).collect()}
    for i, one in ((-1, df), (0, df.withColumn("a", F.col("_moved.a"))), (1, df.withColumn("b", F.col("_moved.b")))):
        want = metrics.confusion(model.transform(assembled(one)), models.LABEL, "prediction").first()
        assert got[i] == tuple(want)
    assert got[0] != got[-1] != got[1]


def test_one_hot_drop_first_and_unseen(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "job string")
    vocab = features.fit_categories(df, ["job"])
    assert vocab == {"job": ["a", "b", "c"]}
    new = spark.createDataFrame([("a",), ("c",), ("zzz",)], "job string")
    rows = new.select(*features.one_hot(vocab)).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    assert new.select(*features.one_hot(vocab)).columns == ["job_b", "job_c"]


def test_exact_knn_matches_brute_force(spark):
    from respondo.operators.resample import exact_knn
    from respondo.session import cut_lineage
    rnd = random.Random(11)
    pts = [(i, [rnd.random() for _ in range(3)]) for i in range(300)]
    df = cut_lineage(spark.createDataFrame(pts, "mid long, x array<double>"))
    knn, _ = exact_knn(df, 3, k=5, split_dims=2, cell_rows=20)   # many cells: halos matter
    got = {}
    for r in knn.orderBy("mid", "rank").collect():
        got.setdefault(r.mid, []).append(r.nb)
    assert got == knn_pairs_brute(pts, 5)


def test_smote_balances_inside_minority_box(spark):
    from respondo.operators.resample import smote
    rnd = random.Random(5)
    rows = [(i, rnd.random(), rnd.random(), int(i % 5 == 0)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y int")
    out = smote(df, ["k"], ["a", "b"], "y", k=5, cell_rows=30)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 400
    mins = [r for r in rows if r[3] == 1]
    box = [(min(r[i] for r in mins), max(r[i] for r in mins)) for i in (1, 2)]
    syn = out.where("synthetic").collect()
    assert len(syn) == 300
    for r in syn:
        assert box[0][0] - 1e-12 <= r.a <= box[0][1] + 1e-12
        assert box[1][0] - 1e-12 <= r.b <= box[1][1] + 1e-12


@pytest.mark.parametrize("accuracy,max_band", [(10_000, 100_000), (50, 40)])
def test_exact_percentiles_equal_spark_percentile(spark, accuracy, max_band):
    from respondo.operators.quantiles import exact_percentiles
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 2), float(rnd.randint(0, 300)), rnd.gauss(0, 1)) for _ in range(5000)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r.g, r.feature, r.p_idx): r.value for r in exact_percentiles(
        df, ["a", "b"], probs, ["g"], accuracy=accuracy, max_band=max_band).collect()}
    want = df.groupBy("g").agg(*[F.percentile(c, probs).alias(c) for c in ("a", "b")]).collect()
    for r in want:
        for c in ("a", "b"):
            for i, v in enumerate(r[c]):
                assert got[(r.g, c, i)] == pytest.approx(v, rel=0, abs=1e-12)


def test_threshold_counts_match_brute_force_with_ties_on_grid(spark):
    grid = thresholds.arange(*thresholds.PROFIT_GRID)
    rnd = random.Random(9)
    # scores drawn partly exactly on grid values (ties with the thresholds)
    rows = [((rnd.choice(grid) if rnd.random() < 0.4 else rnd.random()), rnd.randint(0, 1))
            for _ in range(2000)]
    df = spark.createDataFrame(rows, "score double, y int")
    got = {r.threshold_idx: (r.tp, r.fp, r.tn, r.fn)
           for r in thresholds.threshold_counts(df, grid).collect()}
    for i, t in enumerate(grid):
        tp = sum(1 for s, y in rows if s >= t and y == 1)
        fp = sum(1 for s, y in rows if s >= t and y == 0)
        tn = sum(1 for s, y in rows if s < t and y == 0)
        fn = sum(1 for s, y in rows if s < t and y == 1)
        assert got[i] == (tp, fp, tn, fn)


def test_smote_of_a_lone_minority_row(spark):
    from respondo.operators.resample import smote
    df = spark.createDataFrame([(0, 1.0, 2.0, 1)] + [(i, float(i), 0.0, 0) for i in range(1, 11)],
                               "k long, a double, b double, label int")
    out = smote(df, ["k"], ["a", "b"], "label").where("label = 1").collect()
    assert len(out) == 10 and {(r["a"], r["b"]) for r in out} == {(1.0, 2.0)}


def test_knn_with_a_crowd_of_copies_and_few_values(spark):
    from respondo.operators.resample import exact_knn, median_cells
    rng = random.Random(4)
    pts = [(i, [1.0, 2.0, 0.0] if i % 3 == 0 else
            [float(rng.randrange(4)), round(rng.uniform(0, 9), 2), float(rng.randrange(2))]) for i in range(900)]
    df = spark.createDataFrame(pts, "mid long, x array<double>").checkpoint()
    cells = median_cells(df.select("x").distinct(), 40).groupBy("cell").count().collect()
    assert max(r["count"] for r in cells) <= 40 and len(cells) > 10
    knn, _ = exact_knn(df, 3, k=5, cell_rows=40)
    got = {}
    for r in knn.orderBy("mid", "rank").collect():
        got.setdefault(r["mid"], []).append(r["nb"])
    assert got == knn_pairs_brute(pts, 5)


def test_smote_with_one_hot_point_makes_no_large_group(spark):
    """Half of the minority is one point: its copies are one row of a cell."""
    from respondo.operators.resample import smote
    rng = random.Random(5)
    rows = [(i, 0, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(40_000)]
    rows += [(i, 1, 3.0, 4.0) if i % 2 else (i, 1, rng.gauss(3, 1), rng.gauss(4, 1)) for i in range(16_000)]
    df = spark.createDataFrame(rows, "k long, y int, a double, b double")
    out = smote(df, ["k"], ["a", "b"], "y", cell_rows=500)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 40_000, 1: 40_000}
    # rows on the hot point draw that point again
    assert out.where("synthetic and a = 3.0 and b = 4.0").count() >= 10_000


def test_visits_to_other_cells_travel_as_one_row_for_each_pair_of_cells(spark, monkeypatch):
    from respondo.operators import resample
    rng = random.Random(6)
    pts = [(i, [rng.random() for _ in range(4)]) for i in range(1500)]
    df = spark.createDataFrame(pts, "mid long, x array<double>").checkpoint()
    written, staged = {}, resample.staged

    def noted(frame, name):
        written[name] = staged(frame, name)
        return written[name]
    monkeypatch.setattr(resample, "staged", noted)
    knn, _ = resample.exact_knn(df, 4, k=5, cell_rows=300)
    got = {}
    for r in knn.orderBy("mid", "rank").collect():
        got.setdefault(r["mid"], []).append(r["nb"])
    assert got == knn_pairs_brute(pts, 5)
    cells = written["boxes"].count()
    assert 4 < cells and written["visits"].count() <= cells * (cells - 1)


def test_nearest_rows_of_far_shifted_features_are_exact():
    import numpy as np
    from respondo.operators.resample import _search_kernel
    rng = np.random.default_rng(3)
    # large values with small differences, where a product of matrices rounds
    x = np.column_stack([1e6 + rng.normal(size=700), 1e-3 * rng.normal(size=700), rng.integers(0, 2, 700)])
    ids = rng.permutation(700)
    row, nb, d = _search_kernel(5, 40)(x, np.full(700, np.inf), x, ids, True)
    got = list(zip(row.tolist(), nb.tolist()))
    pts = dict(zip(ids.tolist(), x.tolist()))
    brute = knn_pairs_brute(sorted(pts.items()), 5)
    assert got == [(i, n) for i, own in enumerate(ids.tolist()) for n in brute[own]]
