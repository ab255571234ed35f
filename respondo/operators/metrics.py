"""Classifier evaluation as aggregations: confusion counts, derived metrics,
class report, exact ROC/AUC with ties."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respondo.functions.scalar import safe_div
from respondo.operators.prefix import running_sums
from respondo.session import staged

# the kernels travel with the tasks, so that executors need numpy and pyarrow only
register_pickle_by_value(sys.modules[__name__])


def confusion(df: DataFrame, label: str = "y", pred: str = "pred",
              by: list[str] | None = None) -> DataFrame:
    """TP/FP/TN/FN (per ``by`` group) with four conditional counts in one
    aggregation. Rows without a label or a prediction are in none of them;
    threshold counts leave rows without a score out in the same way."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    aggs = [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
            F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn")]
    return df.groupBy(*(by or [])).agg(*aggs)


def confusion_wide(df: DataFrame, scores: dict[str, str], cut: float, label: str = "y") -> DataFrame:
    """:func:`confusion` by ``model`` of several score columns (name ->
    column) at one threshold: one aggregation, no row per model."""
    y = F.col(label) == 1
    aggs = [F.struct(F.lit(name).alias("model"), *[F.count_if(c).alias(n) for n, c in (
        ("tp", y & hit), ("fp", ~y & hit), ("tn", ~y & ~hit), ("fn", y & ~hit))])
        for name, hit in ((m, F.col(c) >= F.lit(float(cut))) for m, c in scores.items())]
    out = df.agg(F.count(F.lit(1)).alias("_rows"), F.array(*aggs).alias("_c"))
    return out.where("_rows > 0").select(F.inline("_c"))


def f1_expr(precision, recall):
    return F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0))


def with_binary_metrics(conf: DataFrame, digits: int | None = 9) -> DataFrame:
    """accuracy, precision, recall, F1 from confusion counts (0 when a
    denominator is 0, like the reference's ``zero_division`` default)."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    acc = safe_div(tp + tn, tp + fp + tn + fn)
    prec = safe_div(tp, tp + fp)
    rec = safe_div(tp, tp + fn)
    f1 = f1_expr(prec, rec)
    rnd = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return conf.select("*", rnd(acc).alias("accuracy"), rnd(prec).alias("precision"),
                       rnd(rec).alias("recall"), rnd(f1).alias("f1"))


def _row(label, p, r, f, s):
    return F.struct(F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"),
                    f.alias("f1_score"), s.alias("support"))


def classification_report(conf: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per class (0, 1) precision / recall / f1-score / support, plus
    accuracy, macro avg and weighted avg rows, from confusion counts."""
    by = list(by or [])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    # class 1 and class 0 (for class 0 the roles of TP/TN swap)
    p1, r1 = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    p0, r0 = safe_div(tn, tn + fn), safe_div(tn, tn + fp)
    f1_1, f1_0 = f1_expr(p1, r1), f1_expr(p0, r0)
    s1, s0 = (tp + fn).cast("double"), (tn + fp).cast("double")
    acc = safe_div(tp + tn, n)
    rows = F.array(
        _row("0", p0, r0, f1_0, s0),
        _row("1", p1, r1, f1_1, s1),
        _row("accuracy", acc, acc, acc, n.cast("double")),
        _row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n.cast("double")),
        _row("weighted avg", safe_div(p0 * s0 + p1 * s1, n), safe_div(r0 * s0 + r1 * s1, n),
             safe_div(f1_0 * s0 + f1_1 * s1, n), n.cast("double")),
    )
    out = conf.select(*by, F.inline(rows))
    return out.select(*by, "label", *[F.round(c, 9).alias(c) for c in
                                     ("precision", "recall", "f1_score", "support")])


def score_counts(df: DataFrame, score: str = "score", label: str = "y",
                 by: list[str] | None = None) -> DataFrame:
    """Positives / negatives per distinct score (per group)."""
    return df.groupBy(*(by or []), score).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) != 1).alias("neg"))


#: Distinct scores in each range of a running sum.
RANGE_ROWS = 100_000


def staged_counts(df: DataFrame, score: str, label: str, by: list[str]) -> tuple[DataFrame, int]:
    """The counts per distinct score, written once (range cuts, offsets,
    running sums and totals read them), and the number of ranges, which
    follows their number."""
    counts = staged(score_counts(df, score, label, by), "score-counts")
    return counts, max(1, -(-counts.count() // RANGE_ROWS))


def roc_points(df: DataFrame, score: str = "score", label: str = "y",
               by: list[str] | None = None) -> DataFrame:
    """One ROC point per distinct score: TPR and FPR of ``score >= s``.

    Distinct scores first (bounded by the data, ties merged), then the
    distributed running sums of :func:`running_sums`.
    """
    keep = list(by or [])
    by = keep or ["_all"]
    src = df if keep else df.withColumn("_all", F.lit(0))
    counts, ranges = staged_counts(src, score, label, by)
    cum = running_sums(counts, score, ["pos", "neg"], by, ranges)
    # one row per group (model names): a bounded broadcast
    tot = counts.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = cum.join(F.broadcast(tot), by)
    # rows with score >= s = total - rows strictly below s
    above_pos = F.col("P") - F.col("pos_cum") + F.col("pos")
    above_neg = F.col("N") - F.col("neg_cum") + F.col("neg")
    return j.select(*keep, F.col(score).alias("threshold"),
                    safe_div(above_pos, F.col("P")).alias("tpr"),
                    safe_div(above_neg, F.col("N")).alias("fpr"))


#: The range of scores that are not a number, above all others.
LAST_RANGE = 1 << 30
#: Rows that a task sorts at a time, and scores of a range that is merged.
BLOCK_ROWS, MERGED_ROWS = 1 << 20, 2_000_000
_BLOCK = "which int, missing boolean, n long, scores binary, pos binary, neg binary"


def _counted(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct scores in order, with their sums of ``pos`` and ``neg``."""
    order = np.argsort(scores, kind="stable")
    scores = scores[order]
    # not a number is one score, above all others
    new = np.append(True, (scores[1:] != scores[:-1]) & ~(np.isnan(scores[1:]) & np.isnan(scores[:-1])))
    at = np.flatnonzero(new)
    return scores[at], np.add.reduceat(pos[order], at), np.add.reduceat(neg[order], at)


def _score_blocks(df: DataFrame, scores: list[str], label: str, by: list[str]) -> DataFrame:
    """Counts of positives and negatives per distinct score, for ``BLOCK_ROWS``
    rows at a time inside their task: a row per block, group and score column
    (``which``), holding the scores in order. ``missing``: of the rows without."""
    block_rows = BLOCK_ROWS
    y = F.when(F.col(label) == 1, 1).when(F.col(label) != 1, 0).otherwise(2)
    frame = df.select(*by, y.cast("int").alias("_y"),
                      *[F.col(c).cast("double").alias(f"_s{i}") for i, c in enumerate(scores)])

    def block(t: pa.Table) -> pa.RecordBatch:
        code = np.zeros(len(t), np.int64)
        for c in by:
            values = t[c].combine_chunks().dictionary_encode(null_encoding="encode")
            code = code * len(values.dictionary) + values.indices.to_numpy()
            code = np.unique(code, return_inverse=True)[1]
        _, first, group = np.unique(code, return_index=True, return_inverse=True)
        told = t["_y"].to_numpy()
        out, kept = [], []
        for i in range(len(scores)):
            column = t[f"_s{i}"]
            score, null = pc.fill_null(column, 0.0).to_numpy(), pc.is_null(column).to_numpy()
            for g, at in enumerate(first):
                for missing in (False, True):
                    rows = np.flatnonzero((group == g) & (null == missing))
                    if len(rows):
                        s, p, n = _counted(score[rows], (told[rows] == 1).astype(np.int32),
                                          (told[rows] == 0).astype(np.int32))
                        kept.append(at)
                        out.append((i, missing, len(s), s.tobytes(), *(v.astype(np.int32).tobytes() for v in (p, n))))
        kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        held = t.select(by).take(pa.array(kept, pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [*(held[c].combine_chunks() for c in by), *(pa.array(v, k) for v, k in zip(zip(*out), kinds))],
            [*by, "which", "missing", "n", "scores", "pos", "neg"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= block_rows:
                yield block(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield block(pa.Table.from_batches(held))

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema.fields)
    return staged(frame.mapInArrow(kernel, kinds + _BLOCK), "score-blocks")


def _range_sums(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by..., which, range, num, pos, neg): the sum of ``pos * (2 * negatives
    below + neg)`` inside each range of scores. Ranges are cut at quantiles of the
    blocks' scores, so that none holds many more than ``MERGED_ROWS`` entries,
    however the scores of one group lie. Rows without a score are range -1."""
    kinds = ((np.float64, "scores"), (np.int32, "pos"), (np.int32, "neg"))
    total = blocks.agg(F.sum("n")).first()[0] or 0
    ranges, cuts, last = -(-total // MERGED_ROWS), np.zeros(0), LAST_RANGE
    groups = [*by, "which"]

    if ranges > 1:
        def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in batch.column("scores").to_pylist():
                    s = np.frombuffer(s, np.float64)
                    # one of so many entries, whatever the block's size
                    at = s[len(s) // 2 % step::step]
                    yield pa.RecordBatch.from_arrays([pa.array(at)], ["score"])
        step = max(1, MERGED_ROWS // 1000)
        picks = blocks.where("not missing").select("scores").mapInArrow(picked, "score double") \
            .where(~F.isnan("score"))
        got = picks.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
        cuts = np.unique(np.array(got or [], np.float64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["missing", "scores", "pos", "neg"]).to_pylist()):
                parts = [np.frombuffer(row[c], kind) for kind, c in kinds]
                at = np.concatenate([[0], np.searchsorted(parts[0], np.append(cuts, np.nan)), [len(parts[0])]])
                held = [j for j in range(len(at) - 1) if at[j] < at[j + 1]]
                key = batch.select(groups).slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.repeat(c[0], len(held)) for c in key.columns),
                     pa.array([-1 if row["missing"] else last if j == len(at) - 2 else j for j in held], pa.int32()),
                     *(pa.array([v[at[j]:at[j + 1]].tobytes() for j in held], pa.binary()) for v in parts)],
                    [*groups, "range", "scores", "pos", "neg"])

    def merged(t: pa.Table) -> pa.Table:
        parts = [np.concatenate([np.frombuffer(v, kind) for v in t[c].to_pylist()]) for kind, c in kinds]
        _, pos, neg = _counted(parts[0], parts[1].astype(np.int64), parts[2].astype(np.int64))
        below = np.cumsum(neg) - neg
        # as double: exact while the sums stay below 2**53, and never too large
        num = (pos.astype(float) * (2 * below + neg).astype(float)).sum()
        return t.select([*groups, "range"]).slice(0, 1) \
            .append_column("num", pa.array([num])) \
            .append_column("pos", pa.array([pos.sum()])).append_column("neg", pa.array([neg.sum()]))

    key = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in blocks.select(*groups).schema.fields)
    dealt = blocks.mapInArrow(cut, key + "range int, scores binary, pos binary, neg binary")
    return dealt.groupBy(*groups, "range").applyInArrow(
        merged, key + "range int, num double, pos long, neg long")


def _auc(df: DataFrame, scores: list[str], label: str, by: list[str]) -> DataFrame:
    """(by..., which, roc_auc) of each score column."""
    sums = _range_sums(_score_blocks(df, scores, label, by), by)
    # a row per range and group; rows without a score are below all others, however many there are
    before = Window.partitionBy(*by, "which").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(before), F.lit(0))
    num = F.col("num") + 2.0 * F.col("pos").cast("double") * F.col("below")
    agg = sums.withColumn("below", below).groupBy(*by, "which").agg(
        F.sum(num).alias("num"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return agg.select(*by, "which", F.round(
        safe_div(F.col("num"), F.col("P").cast("double") * F.col("N") * 2.0, None), 9).alias("roc_auc"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "y",
            by: list[str] | None = None) -> DataFrame:
    """Exact ROC AUC with ties (Mann-Whitney): for each distinct score s,
    ``pos(s) * (2 * neg_below(s) + neg(s))``, summed as integers, over
    ``2 * P * N``. Scores are sorted and counted inside their tasks and travel
    once, as arrays by value range; a range's sum needs nothing of the others
    but how many negatives are below it."""
    return _auc(df, [score], label, list(by or [])).drop("which")


def roc_auc_wide(df: DataFrame, scores: dict[str, str], label: str = "y") -> DataFrame:
    """:func:`roc_auc` by ``model`` of several score columns (name -> column)."""
    names = F.array(*map(F.lit, scores))
    return _auc(df, list(scores.values()), label, []).select(
        F.get(names, F.col("which")).alias("model"), "roc_auc")
