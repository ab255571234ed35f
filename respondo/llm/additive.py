"""Quality classifier: a generalised additive model with pairwise
interactions.

A text's score is the logistic function of a sum of table entries: one
table per feature, looked up by the feature's bin, and one per chosen pair
of features. The tables are learned by cyclic boosting: round after round,
each feature in turn gets a shallow tree (three leaves) on what the sum so
far leaves over, and the tree's values are added to the feature's table. The
pairs are those whose best four quadrants leave least over; they are boosted
likewise afterwards, with trees of four leaves.

All labelled rows are learned from: they are dealt into bags of about
``BAG_ROWS`` rows, each bag is boosted by one task, and the tables, being
additive, are averaged by an aggregation. What reaches the driver has one
number per feature and bin, whatever the number of rows. Texts are read
once: their features are a written table, which the fit and the scores use.

Defined results: a null text is an empty one and is scored like any other;
labels that are null or of unknown ids are not used; several labels of an
id count as their mean, and its equal rows as one row with a weight; with
no labelled rows at all every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondo.llm.common import slices, stage, sums, text_array, word_codes
from respondo.llm.quality import duplicate_lines, repeated_words

FEATURES = ("words", "word_length", "longest_word", "distinct_words", "top_word", "repeated_windows",
            "letter_words", "duplicate_lines", "line_words", "capitals", "digits", "marks", "symbols",
            "calls", "spaces", "high_bytes")
BINS, COARSE, PAIRS = 64, 16, 10
BAG_ROWS = 25_000
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 300, 100, 0.05, 1.0


def shares(texts: pa.Array) -> list[np.ndarray]:
    """The columns of ``FEATURES`` for one slice of texts."""
    codes, first, words = word_codes(texts)
    n = np.diff(first)
    some = np.maximum(n, 1)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    alpha = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(n)), n)
    longest, top, distinct = (np.zeros(len(n), np.int64) for _ in range(3))
    if len(codes):
        np.maximum.at(longest, owner, chars[codes])
        pair, times = np.unique(owner * len(words) + codes, return_counts=True)
        np.maximum.at(top, pair // len(words), times)
        distinct = np.bincount(pair // len(words), minlength=len(n))
    lines, dup_lines = duplicate_lines(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.maximum(np.diff(offsets), 1)

    def of(chosen) -> np.ndarray:
        table = np.zeros(256, np.int8)
        table[list(chosen)] = 1
        return sums(table[raw], offsets)

    capitals, small = of(range(65, 91)), of(range(97, 123))
    per_word = lambda x: sums(x[codes] if len(codes) else np.zeros(0, np.int64), first)
    return [np.log1p(n), per_word(chars) / some, np.log1p(longest), distinct / some, top / some,
            repeated_words(codes, first, len(words)) / some, per_word(alpha) / some,
            dup_lines / np.maximum(lines, 1), n / np.maximum(lines, 1),
            capitals / np.maximum(capitals + small, 1), of(range(48, 58)) / size,
            of(b".,;:'\"()-") / some, of(b"#*$%&|<>@=+~^_\\/{}[]`") / some, of(b"!?") / some,
            of(b" \t\n\r") / size, of(range(128, 256)) / size]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the features of every whole text, in order."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                x = np.stack([np.asarray(v, np.float64) for v in shares(text_array(rows.column("text")))], 1)
                ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))],
                    ["doc_id", "x"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(kernel, "doc_id long, x array<double>"))


@dataclass
class Model:
    """``cuts`` of every feature, and tables by feature and by pair."""
    cuts: list[np.ndarray]
    base: float
    main: dict[int, np.ndarray]
    pair: dict[tuple[int, int], np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)], 1)

    def logits(self, b: np.ndarray) -> np.ndarray:
        """The sum of what the bins look up."""
        out = np.full(len(b), self.base)
        for i, table in self.main.items():
            out += table[b[:, i]]
        for (i, j), table in self.pair.items():
            out += table[coarse(b[:, i]), coarse(b[:, j])]
        return out


def coarse(b: np.ndarray) -> np.ndarray:
    return b * COARSE // BINS


def three_leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with at most three leaves for the gradients
    and curvatures summed by bin: the best cut, then the best further cut."""
    def cut(lo: int, hi: int) -> tuple[float, int]:
        a, b = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        if not len(a):
            return 0.0, lo
        ga, gb = g[lo:hi].sum(), h[lo:hi].sum()
        gain = a * a / (b + RIDGE) + (ga - a) ** 2 / (gb - b + RIDGE) - ga * ga / (gb + RIDGE)
        k = int(np.argmax(gain))
        return float(gain[k]), lo + k + 1

    ends = [0, len(g)]
    for _ in range(2):
        gain, at = max(cut(lo, hi) for lo, hi in zip(ends[:-1], ends[1:]))
        if gain > 1e-9:
            ends = sorted({*ends, at})
    sizes = np.diff(ends)
    total = np.add.reduceat(g, ends[:-1]), np.add.reduceat(h, ends[:-1])
    return np.repeat(-total[0] / (total[1] + RIDGE), sizes)


def four_leaves(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and the values of the best tree that cuts the first feature
    once and each side once along the second, or the other way round."""
    best_gain, best = -1.0, np.zeros_like(g)
    for turned in (False, True):
        p, q = (g.T, h.T) if turned else (g, h)
        n = len(p)
        gain = np.zeros(n - 1)
        parts = []
        for side in (slice(None), slice(None, None, -1)):  # cut sums from either end
            a = np.cumsum(np.cumsum(p[side], 0), 1)[:-1]
            b = np.cumsum(np.cumsum(q[side], 0), 1)[:-1]
            both = (a[:, :-1] ** 2 / (b[:, :-1] + RIDGE)
                    + (a[:, -1:] - a[:, :-1]) ** 2 / (b[:, -1:] - b[:, :-1] + RIDGE))
            if side.step:
                a, b, both = a[::-1], b[::-1], both[::-1]
            k = np.argmax(both, 1)
            gain += both[np.arange(n - 1), k]
            parts.append((a, b, k))
        top = int(np.argmax(gain))
        value = float(gain[top] - g.sum() ** 2 / (h.sum() + RIDGE))
        if value > best_gain:
            out = np.zeros_like(p)
            for rows, (a, b, k) in zip((slice(0, top + 1), slice(top + 1, n)), parts):
                left, weight = a[top, k[top]], b[top, k[top]]
                out[rows, :k[top] + 1] = -left / (weight + RIDGE)
                out[rows, k[top] + 1:] = -(a[top, -1] - left) / (b[top, -1] - weight + RIDGE)
            best_gain, best = value, out.T if turned else out
    return best_gain, best


def gradients(logit: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-logit))
    return w * (p - y), w * p * (1 - p)


def boost_features(b: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The base and the table of every feature, by cyclic boosting."""
    mean = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    logit = np.full(len(y), base)
    tables = np.zeros((b.shape[1], BINS))
    for _ in range(ROUNDS):
        for i in range(b.shape[1]):
            g, h = gradients(logit, y, w)
            new = RATE * three_leaves(np.bincount(b[:, i], g, BINS), np.bincount(b[:, i], h, BINS))
            tables[i] += new
            logit += new[b[:, i]]
    return base, tables


def squares(b: np.ndarray, i: int, j: int, *weights: np.ndarray) -> list[np.ndarray]:
    at = coarse(b[:, i]) * COARSE + coarse(b[:, j])
    return [np.bincount(at, x, COARSE * COARSE).reshape(COARSE, COARSE) for x in weights]


def boost_pairs(b: np.ndarray, y: np.ndarray, w: np.ndarray, logit: np.ndarray,
                pairs: list[tuple[int, int]]) -> np.ndarray:
    tables = np.zeros((len(pairs), COARSE, COARSE))
    logit = logit.copy()
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(pairs):
            new = RATE * four_leaves(*squares(b, i, j, *gradients(logit, y, w)))[1]
            tables[k] += new
            logit += new[coarse(b[:, i]), coarse(b[:, j])]
    return tables


def columns(batch: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch["x"].combine_chunks()
    flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    return flat, batch["y"].to_numpy(), batch["w"].to_numpy().astype(np.float64)


def averaged(bags: DataFrame, work, numbers: int) -> list[np.ndarray]:
    """The mean over the bags of the vector that ``work(x, y, w)`` returns
    for each, by bag weight; one row per position reaches the driver."""
    def kernel(table: pa.Table) -> pa.Table:
        # equal results whatever order the rows came in
        x, y, w = columns(table)
        order = np.lexsort((w, y, *x.T[::-1]))
        out = work(x[order], y[order], w[order])
        return pa.table({"at": pa.array(np.arange(len(out))), "v": pa.array(out),
                         "weight": pa.array(np.full(len(out), w.sum()))})

    rows = stage(bags.groupBy("bag").applyInArrow(kernel, "at long, v double, weight double"), "bag-tables")
    got = rows.groupBy("at").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("v")).collect()
    out = np.zeros(numbers)
    for r in got:
        out[r["at"]] = r["v"]
    return out


def fit(rows: DataFrame) -> Model:
    """Learn from ``rows`` (doc_id, x, y), y between 0 and 1."""
    f = len(FEATURES)
    rows = stage(rows.groupBy("doc_id", "x", "y").agg(F.count("*").alias("w")), "labelled")
    total = rows.count()
    if not total:
        return Model([np.zeros(0)] * f, 0.0, {}, {})
    # the cuts: quantiles of every feature over all labelled rows
    steps = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(i)), steps, 10_000).alias(n)
                       for i, n in enumerate(FEATURES)]).first()
    model = Model([np.unique(found[n]) for n in FEATURES], 0.0, {}, {})
    bags = rows.withColumn("bag", F.pmod(F.xxhash64("doc_id", "x"), F.lit(-(-total // BAG_ROWS))).cast("int"))
    every = [(i, j) for i in range(f) for j in range(i)]

    def first(x, y, w):
        b = model.bins(x)
        base, tables = boost_features(b, y, w)
        # how much each pair's best quadrants would take off what is left over
        logit = base + sum(tables[i][b[:, i]] for i in range(f))
        gains = [four_leaves(*squares(b, i, j, *gradients(logit, y, w)))[0] for i, j in every]
        return np.concatenate([[base], tables.ravel(), gains])

    got = averaged(bags, first, 1 + f * BINS + len(every))
    model.base = float(got[0])
    model.main = dict(enumerate(got[1:1 + f * BINS].reshape(f, BINS)))
    best = np.argsort(-got[1 + f * BINS:], kind="stable")[:PAIRS]
    pairs = [every[k] for k in best]

    def second(x, y, w):
        b = model.bins(x)
        return boost_pairs(b, y, w, model.logits(b), pairs).ravel()

    tables = averaged(bags, second, PAIRS * COARSE * COARSE).reshape(PAIRS, COARSE, COARSE)
    model.pair = dict(zip(pairs, tables))
    return model


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (doc_id, x, ...) with ``score``; the tables that tasks get
    have one number per feature and bin."""
    told = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(x: pa.Array) -> pa.Array:
        flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        m = told.value
        return pa.array(1 / (1 + np.exp(-m.logits(m.bins(flat)))))

    return rows.withColumn("score", scored("x"))


def labelled(rows: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``rows`` that have a label, with it as ``y``."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(
        F.avg(F.col(label).cast("double")).alias("y"))
    return rows.join(known, F.col("doc_id") == F.col("__id")).drop("__id")


def classify(docs: DataFrame, labels: DataFrame, held_out, at_least: float = 0.7) -> DataFrame:
    """Every document's score, learned from the labelled documents that
    ``held_out`` (a condition on doc_id) doesn't hold."""
    rows = stage(features(docs).withColumn("held_out", held_out), "features")
    model = fit(labelled(rows.where(~F.col("held_out")), labels).select("doc_id", "x", "y"))
    return score(rows, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= at_least).cast("int").alias("predicted"))
