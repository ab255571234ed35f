"""Random forests and boosted trees over all training rows.

``pyspark.ml`` keeps a boxed point per row, with a counter per tree, and sends
the statistics of every node from every partition; beyond a few million rows
that spills, and each of the many passes reads it back. Here

1. features are cut into at most ``BINS`` bins at quantiles of all training
   rows, and the rows are written once as blocks: a binary per block that holds
   a byte per row and feature, feature by feature (``packed``);
2. a forest grows all trees by one level per pass: tasks count the classes by
   (tree, open node, drawn feature, bin), the counts are shuffled by tree and
   summed, and the best cut of every node is chosen there (``forest``);
3. boosting makes one pass per level too. The margins of the rows travel in the
   blocks, which are written anew with them every ``REFRESH`` rounds, so that the
   plan of a late round is as short as that of the first; the few trees since
   then are added to them inside each pass (``boosted``).

Every tree sees all training rows, by the laws of ``pyspark.ml``: Poisson
counts per row and tree and a fresh draw of sqrt(features) features per node
for a forest (Gini); residuals of the logistic loss, split on their variance,
for boosting. Draws depend on (seed, tree, block), so a pass that runs again
draws alike. The driver holds trees only, and for boosting one small histogram
per task, whose number follows the cores and the rows.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondo.session import staged

register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pandas only

BINS = 32
BLOCK = 1 << 15         # rows of a block
TASK_ROWS = 1 << 22     # rows of a task, where there are more rows than that for every core
NODES = 512             # open nodes of a tree in one counted row
COUNTED_BYTES = 1 << 27  # counts that a task holds at once
REFRESH = 16

# uniform 16-bit numbers -> Poisson(1) counts
POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)]),
                          (np.arange(1 << 16) + .5) / (1 << 16)).astype(np.uint8)


@dataclass
class Data:
    """The training rows as blocks (block, n, bins, y), and what they were made with."""
    blocks: DataFrame
    cuts: list[list[float]]
    weights: tuple[float, float]  # of the classes, where a fit balances them


def packed(train: DataFrame, names: list[str], features: str, label: str, weight: str) -> Data:
    """``train`` in bins, written once. A value up to a cut lies left of it."""
    asked = train.agg(
        F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col(label) == c, F.col(weight))).alias(f"w{c}") for c in (0, 1)],
        *cut_columns(names)).first()
    if not asked["n"]:
        raise ValueError("no training rows")
    cuts = [sorted(asked[f"c{i}"]) for i in range(len(names))]
    bounds = [np.array(c) for c in cuts]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, at = [], 0, TaskContext.get().partitionId() << 32

        def block():
            bins, y = (np.concatenate(v, -1) for v in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([rows], pa.int32()),
                                               pa.array([bins.tobytes()], pa.binary()),
                                               pa.array([y.tobytes()], pa.binary())], ["block", "n", "bins", "y"])
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((binned(rows_of(batch.column(0), len(bounds)), bounds),
                         batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)))
            rows += batch.num_rows
            if rows >= BLOCK:
                yield block()
                held, rows, at = [], 0, at + 1
        if rows:
            yield block()

    spark = train.sparkSession
    blocks = staged(train.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"))
                    .mapInArrow(kernel, "block long, n int, bins binary, y binary"), "binned")
    # a byte per row and feature, dealt evenly whatever files the rows came from
    tasks = max(spark.sparkContext.defaultParallelism, -(-asked["n"] // TASK_ROWS))
    blocks = blocks.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    return Data(blocks, cuts, tuple(1.0 if asked[f"w{c}"] is None else asked[f"w{c}"] for c in (0, 1)))


def cut_columns(names: list[str]) -> list[Column]:
    """Aggregates ``c0``, ``c1``...: where each feature is cut."""
    steps = [i / (BINS - 1) for i in range(1, BINS - 1)]
    return [F.array_distinct(F.concat(F.array(F.min(f"`{f}`").cast("double")), F.percentile_approx(
        F.col(f"`{f}`").cast("double"), steps, 10_000))).alias(f"c{i}") for i, f in enumerate(names)]


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins feature by feature: (features, rows)."""
    return np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)]).astype(np.uint8)


def opened(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(row["bins"], np.uint8).reshape(width, row["n"]), np.frombuffer(row["y"], np.uint8))


# ---- forests ------------------------------------------------------------------------

def new_tree() -> dict:
    """A tree as lists by node: feature (-1: a leaf), cut, left child (the
    right one follows it), counts of both classes, gain of its cut."""
    return {"feature": [-1], "cut": [255], "left": [0], "n0": [0.0], "n1": [0.0], "gain": [0.0]}


def stepping(tree: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays by which all rows step down alike; a leaf leads to itself."""
    feature = np.array(tree["feature"], np.int64)
    leaf = feature < 0
    return (np.where(leaf, 0, feature), np.where(leaf, 255, tree["cut"]).astype(np.uint8),
            np.where(leaf, np.arange(len(leaf)), tree["left"]))


def walk(flat: np.ndarray, rows: np.ndarray, size: int, steps: tuple, depth: int) -> np.ndarray:
    """The node of ``rows`` after ``depth`` steps (``flat``: all bins of ``size`` rows)."""
    feature, cut, left = steps
    at = np.zeros(len(rows), np.int64)
    for _ in range(depth):
        at = left[at] + (flat[feature[at] * size + rows] > cut[at])
    return at


def forest(data: Data, num_trees: int, max_depth: int, balanced: bool, columns: list[int] | None = None,
           seed: int = 42) -> dict:
    """``num_trees`` bagged trees on the features at ``columns``."""
    columns = list(range(len(data.cuts))) if columns is None else list(columns)
    width, per = len(data.cuts), max(1, math.ceil(math.sqrt(len(columns))))
    weights = data.weights if balanced else (1.0, 1.0)
    trees = [new_tree() for _ in range(num_trees)]
    open_ = [[0] for _ in trees]
    rng = np.random.default_rng(seed)
    source = data.blocks
    for depth in range(max_depth):
        drawn = [np.array([np.sort(rng.permutation(columns)[:per]) for _ in nodes]) for nodes in open_]
        todo = [t for t, nodes in enumerate(open_) if nodes]
        while todo:
            # as many trees at once as a task can count for
            group, cells = [], 0
            while todo and (not group or (cells + len(open_[todo[0]]) * per * BINS * 2) * 8 <= COUNTED_BYTES):
                group.append(todo.pop(0))
                cells += len(open_[group[-1]]) * per * BINS * 2
            for t, found in _level(source, width, {t: (stepping(trees[t]), open_[t], drawn[t]) for t in group},
                                   depth, per, weights, seed):
                open_[t] = _grown(trees[t], open_[t], drawn[t], found)
    return {"kind": "forest", "cuts": data.cuts, "trees": trees, "depth": max_depth, "weights": list(weights)}


def _level(source: DataFrame, width: int, state: dict, depth: int, per: int, weights: tuple, seed: int):
    """One pass over the rows: (tree, the best cut of each of its open nodes)."""
    sc = source.sparkSession.sparkContext
    told = sc.broadcast({t: (steps, _ranks(steps, nodes), drawn) for t, (steps, nodes, drawn) in state.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, total = told.value, {}
        for batch in batches:
            for row in batch.to_pylist():
                bins, y = opened(row, width)
                flat, size = bins.ravel(), row["n"]
                for t, (steps, ranks, drawn) in state.items():
                    rng = np.random.default_rng([seed, t, row["block"]])
                    times = POISSON[rng.integers(0, 1 << 16, size, np.uint16)]
                    used = np.flatnonzero(times)
                    rank = ranks[walk(flat, used, size, steps, depth)]
                    if depth:
                        still = rank >= 0
                        used, rank = used[still], rank[still]
                    base, by = rank * (BINS * 2) + y[used], times[used].astype(np.float64)
                    sums = total.setdefault(t, np.zeros((per, len(drawn) * BINS * 2)))
                    for j in range(per):
                        cell = base + flat[drawn[:, j][rank] * size + used].astype(np.int64) * 2
                        sums[j] += np.bincount(cell, by, sums.shape[1])
        for t, sums in total.items():
            # by node, drawn feature, bin and class
            by_node = sums.reshape(per, -1, BINS * 2).transpose(1, 0, 2).astype(np.uint32)
            parts = [by_node[i:i + NODES].tobytes() for i in range(0, len(by_node), NODES)]
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(parts), pa.int32()),
                                              pa.array(range(len(parts)), pa.int32()),
                                              pa.array(parts, pa.binary())], ["tree", "part", "counts"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        n = sum(np.frombuffer(c, np.uint32).astype(np.float64) for c in pdf["counts"]).reshape(-1, per, BINS, 2)
        left = n.cumsum(2)
        whole = left[:, :, -1:, :]
        gain, left = _gini_gain(left[:, :, :-1], whole, weights)
        best = gain.reshape(len(n), -1).argmax(1)
        j, cut, at = best // (BINS - 1), best % (BINS - 1), np.arange(len(n))
        out = {"gain": gain[at, j, cut], "j": j, "cut": cut, "l0": left[at, j, cut, 0], "l1": left[at, j, cut, 1],
               "n0": whole[at, j, 0, 0], "n1": whole[at, j, 0, 1]}
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "part": [pdf["part"].iloc[0]],
                             "found": [json.dumps({k: v.tolist() for k, v in out.items()})]})

    counts = source.select("block", "n", "bins", "y").mapInArrow(count, "tree int, part int, counts binary")
    got = sorted(tuple(r) for r in counts.groupBy("tree", "part").applyInPandas(
        choose, "tree int, part int, found string").collect())
    told.destroy()
    out = {}
    for t, _, found in got:
        for k, v in json.loads(found).items():
            out.setdefault(t, {}).setdefault(k, []).extend(v)
    return out.items()


def _ranks(steps: tuple, nodes: list[int]) -> np.ndarray:
    ranks = np.full(len(steps[0]), -1, np.int64)
    ranks[nodes] = np.arange(len(nodes))
    return ranks


def _gini_gain(left: np.ndarray, whole: np.ndarray, weights: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Decrease of the weighted Gini impurity; -inf where a side is empty."""
    def impurity(n):
        v = n * np.array(weights)
        s = v.sum(-1)
        return s, 1 - (v ** 2).sum(-1) / np.maximum(s, 1e-150) ** 2
    right = whole - left
    (sl, il), (sr, ir), (s, i) = impurity(left), impurity(right), impurity(whole)
    gain = i - (sl * il + sr * ir) / np.maximum(s, 1e-300)
    gain[(left.sum(-1) == 0) | (right.sum(-1) == 0)] = -np.inf
    return gain, left


def _grown(tree: dict, nodes: list[int], drawn: np.ndarray, found: dict) -> list[int]:
    """Cuts the open ``nodes`` that gain by it; returns their children."""
    fresh = []
    for i, node in enumerate(nodes):
        n = (found["n0"][i], found["n1"][i])
        tree["n0"][node], tree["n1"][node] = n
        if not found["gain"][i] > 1e-12:
            continue
        kid = len(tree["feature"])
        tree["feature"][node], tree["cut"][node] = int(drawn[i][found["j"][i]]), int(found["cut"][i])
        tree["left"][node], tree["gain"][node] = kid, found["gain"][i]
        low = (found["l0"][i], found["l1"][i])
        for a, b in (low, (n[0] - low[0], n[1] - low[1])):
            for k, v in zip(("feature", "cut", "left", "n0", "n1", "gain"), (-1, 255, 0, a, b, 0.0)):
                tree[k].append(v)
            # a node of one class stays a leaf
            if a and b:
                fresh.append(len(tree["feature"]) - 1)
    return fresh


def importances(model: dict) -> list[float]:
    """Mean decrease of impurity, each tree's made to sum to 1, as in ``pyspark.ml``."""
    total = np.zeros(len(model["cuts"]))
    w0, w1 = model["weights"]
    for tree in model["trees"]:
        own = np.zeros(len(total))
        for f, gain, n0, n1 in zip(tree["feature"], tree["gain"], tree["n0"], tree["n1"]):
            if f >= 0:
                own[f] += gain * (n0 * w0 + n1 * w1)
        total += own / own.sum() if own.sum() else 0
    return (total / total.sum() if total.sum() else total).tolist()


# ---- boosting -----------------------------------------------------------------------

def place(bins: np.ndarray, tree: dict, levels: int) -> np.ndarray:
    """Each row's place among the 2 ** levels nodes of that level, by
    comparisons of whole feature columns; rows of a leaf go on to its left."""
    at = np.zeros(bins.shape[1], np.uint8 if levels <= 8 else np.int64)
    for level in range(levels):
        right = np.zeros(len(at), bool)
        for i in range(1 << level):
            f = tree["feature"][(1 << level) - 1 + i]
            if f >= 0:
                right |= (bins[f] > tree["cut"][(1 << level) - 1 + i]) & (at == i)
        at = at * 2 + right if levels > 8 else (at << 1) | right
    return at


def add_trees(margin: np.ndarray, bins: np.ndarray, trees: list[dict], depth: int) -> np.ndarray:
    for tree in trees:
        margin = margin + np.array(tree["value"])[place(bins, tree, depth)]
    return margin


def boosted(data: Data, rounds: int, max_depth: int, step: float, subsample: float = 1.0, balanced: bool = False,
            seed: int = 42) -> dict:
    """Boosted regression trees on the logistic loss of labels -1 and 1: the
    first is fitted to the labels and taken whole, the others to the residuals
    and taken by ``step``; each sees a draw of ``subsample`` of the rows."""
    width, weights = len(data.cuts), data.weights if balanced else (1.0, 1.0)
    frame, trees, since = data.blocks.withColumn("margin", F.lit(None).cast("binary")), [], 0
    for k in range(rounds):
        if k and k % REFRESH == 0:
            frame, since = _refreshed(frame, width, trees[since:], max_depth), k
        tree = {"feature": [-1] * ((1 << max_depth) - 1), "cut": [255] * ((1 << max_depth) - 1)}
        live = [True]
        for level in range(max_depth):
            sums = _sums(frame, width, trees[since:], tree, max_depth, level, k, subsample, weights, seed)
            live = _cut_level(tree, level, sums, live)
            if not any(live):
                break
        tree["value"] = (np.array(_leaf_values(tree, max_depth)) * (step if k else 1.0)).tolist()
        tree.pop("mean")
        trees.append(tree)
    return {"kind": "boosted", "cuts": data.cuts, "trees": trees, "depth": max_depth}


def _refreshed(frame: DataFrame, width: int, trees: list[dict], depth: int) -> DataFrame:
    told = frame.sparkSession.sparkContext.broadcast(trees)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [add_trees(_margin(row), opened(row, width)[0], told.value, depth).tobytes()
                   for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, pa.binary())], batch.schema.names)

    out = staged(frame.mapInArrow(kernel, frame.schema), "margins")
    told.destroy()
    return out


def _margin(row: dict) -> np.ndarray:
    return np.zeros(row["n"]) if row["margin"] is None else np.frombuffer(row["margin"])


def _sums(frame: DataFrame, width: int, trees: list[dict], tree: dict, depth: int, level: int, k: int,
          subsample: float, weights: tuple, seed: int) -> np.ndarray:
    """One pass: the weights and weighted residuals by (node, feature, bin)."""
    told = frame.sparkSession.sparkContext.broadcast((trees, tree))
    shape = (1 << level, width, BINS, 2)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, tree = told.value
        total, first = np.zeros(shape), -1
        for batch in batches:
            for row in batch.to_pylist():
                first = row["block"] if first < 0 else min(first, row["block"])
                bins, y = opened(row, width)
                sign = 2.0 * y - 1
                rest = sign if not k else 4 * sign / (1 + np.exp(np.minimum(
                    2 * sign * add_trees(_margin(row), bins, trees, depth), 700)))
                h = np.where(y > 0, weights[1], weights[0])
                at = place(bins, tree, level).astype(np.int64) * BINS
                if subsample < 1:
                    rng = np.random.default_rng([seed, k, row["block"]])
                    some = np.flatnonzero(rng.integers(0, 1 << 16, row["n"], np.uint16) < subsample * (1 << 16))
                    rest, h, at, bins = rest[some], h[some], at[some], bins[:, some]
                g = h * rest
                for f in range(width):
                    cell = at + bins[f]
                    total[:, f, :, 0] += np.bincount(cell, h, shape[0] * BINS).reshape(-1, BINS)
                    total[:, f, :, 1] += np.bincount(cell, g, shape[0] * BINS).reshape(-1, BINS)
        if first >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([total.tobytes()], pa.binary())],
                                             ["first", "sums"])

    # in the order of the blocks, wherever they were read from
    got = sorted(tuple(r) for r in frame.mapInArrow(kernel, "first long, sums binary").collect())
    told.destroy()
    return sum(np.frombuffer(sums) for _, sums in got).reshape(shape)


def _cut_level(tree: dict, level: int, sums: np.ndarray, live: list[bool]) -> list[bool]:
    """Cuts the nodes of a level where that lessens the variance."""
    low = sums.cumsum(2)
    whole = low[:, :, -1:]
    low = low[:, :, :-1]
    high = whole - low
    if level == 0:
        tree["mean"] = [float(whole[0, 0, 0, 1] / max(whole[0, 0, 0, 0], 1e-300))]

    def score(v):
        return v[..., 1] ** 2 / np.maximum(v[..., 0], 1e-300)
    tiny = 1e-9 * np.maximum(whole[..., 0], 1e-300)
    gain = score(low) + score(high) - score(whole)
    gain[(low[..., 0] <= tiny) | (high[..., 0] <= tiny)] = -np.inf
    below, means = [], []
    for i in range(len(live)):
        f, cut = np.unravel_index(gain[i].argmax(), gain[i].shape)
        mean = tree["mean"][(1 << level) - 1 + i]
        if live[i] and gain[i, f, cut] > 1e-12 * max(whole[i, f, 0, 0], 1e-300):
            at = (1 << level) - 1 + i
            tree["feature"][at], tree["cut"][at] = int(f), int(cut)
            means += [float(v[i, f, cut, 1] / v[i, f, cut, 0]) for v in (low, high)]
            below += [True, True]
        else:
            means += [mean, mean]
            below += [False, False]
    tree["mean"] += means
    return below


def _leaf_values(tree: dict, depth: int) -> list[float]:
    """Means by place after ``depth`` steps; a growth that ended early hands
    its means down."""
    level = (len(tree["mean"]) + 1).bit_length() - 2
    last = tree["mean"][(1 << level) - 1:]
    return [last[i >> (depth - level)] for i in range(1 << depth)]


# ---- scoring ------------------------------------------------------------------------

def probability(model: dict, bins: np.ndarray) -> np.ndarray:
    """P(class 1) of rows in bins (features, rows)."""
    size = bins.shape[1]
    if model["kind"] == "boosted":
        return 1 / (1 + np.exp(np.clip(-2 * add_trees(np.zeros(size), bins, model["trees"], model["depth"]), -700, 700)))
    flat, rows, out = bins.ravel(), np.arange(size), np.zeros(size)
    w0, w1 = model["weights"]
    for tree in model["trees"]:
        n0, n1 = np.array(tree["n0"]) * w0, np.array(tree["n1"]) * w1
        out += (n1 / np.maximum(n0 + n1, 1e-300))[walk(flat, rows, size, stepping(tree), model["depth"])]
    return out / len(model["trees"])


def score(model: dict, spark, features: str) -> Column:
    """P(class 1) by the vector column ``features``."""
    told = spark.sparkContext.broadcast(model)
    width = len(model["cuts"])

    @F.arrow_udf("double")
    def of(x: pa.Array) -> pa.Array:
        cuts = [np.array(c) for c in told.value["cuts"]]
        return pa.array(probability(told.value, binned(rows_of(x, width), cuts)))
    return of(vector_to_array(features))


def permuted_counts(model: dict, shifted: DataFrame, names: list[str], label: str) -> DataFrame:
    """Confusion counts by ``variant``: -1 with all features (``names``) as they
    are, i with the i-th taken from the struct ``_moved``. A task bins a row and
    its moved values once and scores the variants one after another."""
    told = shifted.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = [np.array(c) for c in told.value["cuts"]]
        total = np.zeros((len(cuts) + 1, 4), np.int64)
        for batch in batches:
            own, moved = (binned(rows_of(batch.column(i), len(cuts)), cuts) for i in (0, 1))
            y = batch.column(2).to_numpy(zero_copy_only=False)
            for i in range(-1, len(cuts)):
                bins = own.copy()
                if i >= 0:
                    bins[i] = moved[i]
                hit = probability(told.value, bins) > .5
                total[i + 1] += np.bincount(np.where(y > 0, 0, 2) + ~hit, minlength=4)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(cuts)), pa.int32()),
                                          *[pa.array(total[:, j]) for j in (0, 1, 2, 3)]],
                                         ["variant", "tp", "fn", "fp", "tn"])

    def listed(of: str) -> Column:
        return F.array(*[F.col(f"{of}`{f}`").cast("double") for f in names])
    return shifted.select(listed("").alias("x"), listed("_moved.").alias("m"), F.col(label).cast("int").alias("y")) \
        .mapInArrow(kernel, "variant int, tp long, fn long, fp long, tn long") \
        .groupBy("variant").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])
