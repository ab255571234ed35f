"""Near-duplicate embeddings by a robust-pruned flat graph.

1. Equal vectors form a class; one representative goes on, with its count.
2. Centres are fitted on a bounded sample; every vector joins its nearest
   shard (its home) and the next one (overlap). A shard is dealt into units
   of bounded size.
3. In each unit a graph is built by robust pruning: of a vector's nearest
   candidates, one is dropped if a chosen one is clearly nearer to it. The
   adjacency lists of a vector's units are united into one flat graph.
4. Search: every vector visits the units of its nearest shards. From a
   unit's medoid, a beam walks the graph towards it; from what it finds
   within the range (and a little beyond) it expands to all neighbours
   until nothing new is in range. Every hit is verified in double
   precision, and counted in the unit where it is at home, so that no pair
   is counted twice or written. A hit that is at home elsewhere, and the
   hit's own way back, become new visits; rounds go on until there are none.
5. Audit: for a sample of vectors, linked vectors are counted by brute force
   over all vectors; the sample grows until ``ENOUGH`` vectors with at most
   ``FEW`` links and as many with more are in it, or to ``AUDIT[-1]``. Each of
   the two classes must reach ``least_recall`` as the mean over its vectors,
   copies counted once; else every vector visits twice as many shards and
   the search is done again. For a class too rare to be audited, the visits
   must let that share of planted pairs at the range's edge meet in a shard.

What is broadcast: at most ``MAX_CENTRES`` centres and ``AUDIT[-1]`` vectors
(not those that the centres were fitted on, where there are enough others).

Vectors of different dimensions never link. Each dimension with more classes
than a unit holds has shards and centres of its own, one after the other;
the others are compared whole, a dimension at a time, in one job.

Defined results: vectors that are null, of zero length, all zeros, or with null
or non-finite components link with nothing; equal vectors and repeated rows link with each other; null ids are
named as in ``components.named``; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from respondo.llm.common import numbered, stage
from respondo.llm.components import components, named
from respondo.llm.minhash import Union

SAMPLE, MAX_CENTRES = 20_000, 4096
AUDIT, ENOUGH, FEW = (400, 1600, 6400), 100, 10
UNIT, VISITORS = 1500, 6000       # vectors in a unit, searches in one task
DEGREE, BACK, FAN, CANDIDATES, ALPHA = 16, 16, 8, 64, 1.2
BEAM, BEYOND = 12, 0.08           # width of the walk; how far below the range it expands


def unit_vectors(column: pa.Array, dimension: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    # by a power of two, which rounds nothing, so that no square overflows or vanishes
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means on the sample, started from evenly spaced rows."""
    out = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(8):
        near = np.concatenate([np.argmax(sample[i:i + 2048] @ out.T, axis=1)
                               for i in range(0, len(sample), 2048)])
        total = np.zeros_like(out)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        out = np.where(size > 1e-9, total / np.maximum(size, 1e-9), out)
    return out


def assigned(vectors: DataFrame, fitted: Broadcast, dimension: int, visits: int) -> DataFrame:
    """Add ``near``: the nearest shards, nearest first."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = fitted.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_vectors(batch.column("vec"), dimension)
            k = min(visits, len(c))
            near = np.concatenate([np.argsort(-(x[i:i + 1024] @ c.T), axis=1, kind="stable")[:, :k]
                                   for i in range(0, len(x), 1024)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k),
                                             pa.array(near.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "near"])

    return vectors.mapInArrow(kernel, f"node long, copies long, vec {vectors.schema['vec'].dataType.simpleString()}, near array<int>")


def pruned(x: np.ndarray) -> np.ndarray:
    """Adjacency lists (padded with -1): for each vector at most ``DEGREE``
    robustly pruned neighbours, at most ``BACK`` that chose it, and at most ``FAN`` others."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    out = np.full((n, DEGREE), -1, np.int64)
    if k < 1:
        return out
    x32 = x.astype(np.float32)
    for lo in range(0, n, 256):
        sim = x32[lo:lo + 256] @ x32.T
        rows = np.arange(len(sim))
        sim[rows, lo + rows] = -2
        cand = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(sim, cand, 1)
        order = np.argsort(-near, axis=1)
        cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
        vec = x32[cand]
        far = 2 - 2 * (vec @ vec.transpose(0, 2, 1))   # squared distances among candidates
        own = 2 - 2 * near
        alive = np.ones(cand.shape, bool)
        for d in range(DEGREE):
            some = alive.any(axis=1)
            pick = np.argmax(alive, axis=1)
            out[lo + rows[some], d] = cand[rows, pick][some]
            alive &= ALPHA * ALPHA * far[rows, pick] > own
            alive[rows, pick] = False
    source, slot = np.nonzero(out >= 0)
    target = out[source, slot]
    # ways back, so that every vector can be reached: first to those whose
    # nearest neighbour this is, then by closeness
    closeness = np.einsum("ij,ij->i", x[source], x[target])
    order = np.lexsort((-closeness, slot, target))
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((n, BACK), -1, np.int64)
    use = rank < BACK
    back[target[use], rank[use]] = source[use]
    # a vector can be the nearest of very many: those beyond its list hang
    # below others of the same kind, as a tree of bounded degree
    late = ~use & (slot[order] == 0)
    fan = np.full((n, FAN), -1, np.int64)
    above = source[np.searchsorted(target, target[late]) + (rank[late] - BACK) // FAN]
    fan[above, (rank[late] - BACK) % FAN] = source[late]
    return np.concatenate([out, back, fan], axis=1)


def graph_kernel(dimension: int):
    def kernel(unit: pa.Table) -> pa.Table:
        x = unit_vectors(unit["vec"].combine_chunks(), dimension)
        node = unit["node"].to_numpy()
        links = pruned(x)
        lists = [node[row[row >= 0]] for row in links]
        return pa.table({"node": pa.array(node), "nbrs": pa.array(lists, pa.list_(pa.int64()))})
    return kernel


def walk(q: np.ndarray, x: np.ndarray, links: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search for all rows of ``q`` side by side, then range
    expansion: (query, vector) pairs with similarity of ``least`` or more."""
    n, m = len(x), len(q)
    centre = x.mean(axis=0)
    medoid = int(np.argmax(x @ centre))
    seen = np.zeros((m, n), bool)
    seen[:, medoid] = True
    ids = np.full((m, BEAM), -1, np.int64)
    sim = np.full((m, BEAM), -2.0)
    done = np.ones((m, BEAM), bool)
    ids[:, 0], sim[:, 0], done[:, 0] = medoid, q @ x[medoid], False
    rows = np.arange(m)
    pairs_q, pairs_x, pairs_s = [rows], [ids[:, 0].copy()], [sim[:, 0].copy()]
    while True:
        open_sim = np.where(done, -3.0, sim)
        best = np.argmax(open_sim, axis=1)
        go = np.flatnonzero(open_sim[rows, best] > -2.5)
        if not len(go):
            break
        done[go, best[go]] = True
        new = links[ids[go, best[go]]]
        valid = (new >= 0) & ~seen[go[:, None], np.maximum(new, 0)]
        a, b = np.nonzero(valid)
        who, what = go[a], new[a, b]
        # a list may name a vector twice
        key = np.unique(who * n + what)
        who, what = key // n, key % n
        seen[who, what] = True
        s = np.einsum("ij,ij->i", q[who], x[what])
        pairs_q.append(who), pairs_x.append(what), pairs_s.append(s)
        # the best of the beam and the new ones
        start = np.searchsorted(who, go)
        count = np.searchsorted(who, go, side="right") - start
        wide = max(1, int(count.max(initial=0)))
        more_id, more_sim = np.full((len(go), wide), -1, np.int64), np.full((len(go), wide), -2.0)
        place = np.arange(len(who)) - np.repeat(start, count)
        line = np.repeat(np.arange(len(go)), count)
        more_id[line, place], more_sim[line, place] = what, s
        all_id = np.concatenate([ids[go], more_id], axis=1)
        all_sim = np.concatenate([sim[go], more_sim], axis=1)
        all_done = np.concatenate([done[go], more_id < 0], axis=1)
        top = np.argsort(-all_sim, axis=1, kind="stable")[:, :BEAM]
        ids[go], sim[go] = np.take_along_axis(all_id, top, 1), np.take_along_axis(all_sim, top, 1)
        done[go] = np.take_along_axis(all_done, top, 1)
    who, what, s = (np.concatenate(p) for p in (pairs_q, pairs_x, pairs_s))
    use = s >= least - BEYOND
    who, what, s = who[use], what[use], s[use]
    hit_q, hit_x = [who[s >= least]], [what[s >= least]]
    while len(who):
        new = links[what]
        a, b = np.nonzero(new >= 0)
        key = np.unique(who[a] * n + new[a, b])
        who, what = key // n, key % n
        fresh = ~seen[who, what]
        who, what = who[fresh], what[fresh]
        seen[who, what] = True
        s = np.einsum("ij,ij->i", q[who], x[what])
        hit_q.append(who[s >= least]), hit_x.append(what[s >= least])
        use = s >= least - BEYOND
        who, what = who[use], what[use]
    return np.concatenate(hit_q), np.concatenate(hit_x)


FOUND = "kind int, a long, b long"
COUNT, LINK, VISIT, AUDITED = 0, 1, 2, 3


def search_kernel(dimension: int, least: float, audit: Broadcast):
    """One unit and some of its visitors: (COUNT, visitor, linked vectors at
    home here), (LINK, a, b) as a spanning forest, (VISIT, vector, unit), and
    (AUDITED, visitor, linked vectors at home here, copies counted once)."""
    def kernel(unit: pa.Table, visitors: pa.Table) -> pa.Table:
        if not len(unit) or not len(visitors):
            return pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()),
                             "b": pa.array([], pa.int64())})
        x = unit_vectors(unit["vec"].combine_chunks(), dimension)
        node, home, copies = (unit[c].to_numpy() for c in ("node", "home", "copies"))
        here = home == unit["unit"][0].as_py()
        order = np.argsort(node)
        nbrs = unit["nbrs"].combine_chunks()
        width = np.diff(nbrs.offsets.to_numpy())
        flat = nbrs.flatten().to_numpy(zero_copy_only=False)
        place = np.minimum(np.searchsorted(node[order], flat), len(node) - 1)
        flat = np.where(node[order][place] == flat, order[place], -1)  # a neighbour in other units only
        links = np.full((len(node), max(1, int(width.max(initial=0)))), -1, np.int64)
        links[np.repeat(np.arange(len(node)), width),
              np.arange(len(flat)) - np.repeat(np.cumsum(width) - width, width)] = flat
        q = unit_vectors(visitors["vec"].combine_chunks(), dimension)
        q_node, q_home = visitors["node"].to_numpy(), visitors["home"].to_numpy()
        out_kind, out_a, out_b = [], [], []
        ids = np.unique(np.concatenate([node, q_node]))
        united = Union(len(ids))

        def put(kind: int, a: np.ndarray, b: np.ndarray) -> None:
            if len(a):
                both = np.unique(np.stack([a, b], axis=1), axis=0)
                out_kind.append(np.full(len(both), kind, np.int32))
                out_a.append(both[:, 0]), out_b.append(both[:, 1])

        for lo in range(0, len(q), 1024):
            who, what = walk(q[lo:lo + 1024], x, links, least)
            who = who + lo
            other = q_node[who] != node[what]
            who, what = who[other], what[other]
            mine = here[what]
            n = np.bincount(who[mine], weights=copies[what[mine]], minlength=len(q)).astype(np.int64)
            got = np.flatnonzero(n)
            put(COUNT, q_node[got], n[got])
            got = got[np.isin(q_node[got], audit.value)]
            put(AUDITED, q_node[got], np.bincount(who[mine], minlength=len(q))[got])
            united.unite(np.searchsorted(ids, q_node[who]), np.searchsorted(ids, node[what]))
            away = q_home[who] != home[what]
            put(VISIT, node[what[away]], q_home[who[away]])
            put(VISIT, q_node[who[~mine]], home[what[~mine]])
        below = np.flatnonzero(united.up != np.arange(len(ids)))
        put(LINK, ids[united.up[below]], ids[below])
        empty = np.zeros(0, np.int64)
        return pa.table({"kind": pa.array(np.concatenate([empty.astype(np.int32), *out_kind])),
                         "a": pa.array(np.concatenate([empty, *out_a])),
                         "b": pa.array(np.concatenate([empty, *out_b]))})
    return kernel


def searched(members: DataFrame, visits: DataFrame, dimension: int, least: float,
             audit: Broadcast) -> DataFrame:
    """Search rounds until no visit is new; all ``FOUND`` rows."""
    schema_kernel = search_kernel(dimension, least, audit)
    # new names for the same columns: visitors meet these members again below
    homes = members.where("unit = home").select(*[F.col(c).alias(c) for c in ("node", "home", "vec")])
    all_found, done = None, None
    while True:
        size = visits.groupBy("unit").agg(F.ceil(F.count("*") / VISITORS).alias("parts"))
        sized = stage(size, "unit-visits")
        guests = (visits.join(sized, "unit")
                  .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
                  .join(homes, "node").select("unit", "part", "node", "home", "vec"))
        hosts = members.join(sized, "unit").withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
        found = stage(hosts.select("unit", "part", "node", "home", "copies", "vec", "nbrs")
                      .groupBy("unit", "part").cogroup(guests.groupBy("unit", "part"))
                      .applyInArrow(schema_kernel, FOUND), "found")
        all_found = found if all_found is None else all_found.union(found)
        done = visits if done is None else done.union(visits)
        new = found.where(F.col("kind") == VISIT).select(
            F.col("a").alias("node"), F.col("b").alias("unit")).distinct()
        visits = stage(new.join(done, ["node", "unit"], "left_anti"), "visits")
        if not visits.limit(1).count():
            return all_found


def exact_counts(vectors: DataFrame, sample: Broadcast, dimension: int, least: float) -> dict[int, int]:
    """Linked vectors of the sampled ones by brute force over all vectors,
    copies counted once."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sample.value
        q32 = q.astype(np.float32)
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = unit_vectors(part.column("vec"), dimension)
                sim = q32 @ x.astype(np.float32).T
                hit = sim >= least
                a, b = np.nonzero(np.abs(sim - least) < 1e-5)  # too close for single precision
                hit[a, b] = np.einsum("ij,ij->i", q[a], x[b]) >= least
                total += hit.sum(axis=1)
                place = found_at(part.column("node").to_numpy(), ids)
                own = np.flatnonzero(place >= 0)
                total[place[own]] -= hit[place[own], own]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "n"])

    rows = (vectors.select("node", "vec").mapInArrow(kernel, "node long, n long")
            .groupBy("node").agg(F.sum("n").alias("n")).collect())
    return {r[0]: r[1] for r in rows}


def found_at(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Place of each key in ``ids``, or -1."""
    order = np.argsort(ids)
    at = order[np.minimum(np.searchsorted(ids[order], keys), len(ids) - 1)]
    return np.where(ids[at] == keys, at, -1)


def by_links(exact: dict[int, int]) -> list[list[int]]:
    """The audited vectors with few links, and those with many."""
    return [[v for v, n in exact.items() if 1 <= n <= FEW], [v for v, n in exact.items() if n > FEW]]


def audited(classes: DataFrame, nodes: np.ndarray, x: np.ndarray, dimension: int,
            least: float) -> dict[int, int]:
    """Exact counts of enough sampled vectors of each class."""
    exact: dict[int, int] = {}
    for size in AUDIT:
        more = slice(len(exact), min(size, len(nodes)))
        if more.start < more.stop:
            part = classes.sparkSession.sparkContext.broadcast((nodes[more], x[more]))
            exact |= exact_counts(classes, part, dimension, least)
        if min(map(len, by_links(exact))) >= ENOUGH:
            break
    return exact


def planted(x: np.ndarray, c: np.ndarray, visits: int, least: float) -> float:
    """Share of planted pairs, as far apart as a link allows, of which one
    vector visits a shard that the other joins."""
    side = np.random.default_rng(7).normal(size=x.shape)
    side -= np.einsum("ij,ij->i", side, x)[:, None] * x
    norm = np.linalg.norm(side, axis=1, keepdims=True)
    y = least * x + math.sqrt(max(0.0, 1 - least * least)) * side / np.maximum(norm, 1e-12)
    near = [np.argsort(-(v @ c.T), axis=1, kind="stable")[:, :max(2, visits)] for v in (x, y)]
    meet = lambda p, q: (p[:, :visits, None] == q[:, None, :2]).any(axis=(1, 2))
    return float((meet(*near) | meet(*near[::-1])).mean())


def whole_kernel(least: float):
    """All vectors of one dimension that fit into a unit, each with all."""
    def kernel(part: pa.Table) -> pa.Table:
        x = unit_vectors(part["vec"].combine_chunks(), part["d"][0].as_py())
        node, copies = part["node"].to_numpy(), part["copies"].to_numpy()
        near = np.zeros((len(x), len(x)), bool)
        for lo in range(0, len(x), 512):
            near[lo:lo + 512] = x[lo:lo + 512] @ x.T >= least
        np.fill_diagonal(near, False)
        a, b = np.nonzero(near)
        united = Union(len(x))
        united.unite(a, b)
        below = np.flatnonzero(united.up != np.arange(len(x)))
        got = np.flatnonzero(near.any(axis=1))
        return pa.table({
            "kind": np.repeat([COUNT, LINK], [len(got), len(below)]).astype(np.int32),
            "a": np.concatenate([node[got], node[united.up[below]]]),
            "b": np.concatenate([(near @ copies)[got], node[below]])})
    return kernel


def one_dimension(classes: DataFrame, dimension: int, n: int, least: float, visits: int,
                  least_recall: float) -> DataFrame:
    """The found rows for the ``n`` classes of one dimension."""
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(min(n, SAMPLE + AUDIT[-1])).select("node", "vec").toArrow()
    x = unit_vectors(sample["vec"].combine_chunks(), dimension)
    k = max(1, min(MAX_CENTRES, len(x[:SAMPLE]), math.ceil(n / (UNIT // 2))))
    fitted = spark.sparkContext.broadcast(centres(x[:SAMPLE], k))
    x = x[::-1]  # those that the centres were not fitted on come first
    exact = audited(classes, sample["node"].to_numpy()[::-1], x, dimension, least)
    if min(map(len, by_links(exact))) < ENOUGH:  # a class that the audit does not measure well
        while visits < k and planted(x[:2000], fitted.value, visits, least) < least_recall:
            visits *= 2
    while True:
        found, recall = one_search(classes, fitted, dimension, least, min(visits, k), exact)
        if recall >= least_recall or visits >= k:
            return found
        visits *= 2


def near_duplicates(table: DataFrame, least: float = 0.9, id_col: str = "vec_id",
                    vector_col: str = "embedding", visits: int = 3,
                    least_recall: float = 0.95) -> DataFrame:
    """One row per vector: ``row``, ``vec_id``, ``n_links``, ``component_id``,
    ``kept``, ``first``. Single-precision columns stay so, all others are
    read as doubles; cosines are computed in doubles either way."""
    element = getattr(table.schema[vector_col].dataType, "elementType", None)
    kind = "array<float>" if isinstance(element, FloatType) else "array<double>"
    rows, _ = numbered(table.select(F.col(id_col).cast("long").alias("id"),
                                    F.col(vector_col).cast(kind).alias("vec")), "row")
    rows = stage(rows, "vectors")
    fine = (F.size("vec") > 0) & F.forall(
        "vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(
        "vec", lambda v: v != 0)
    classes = stage(rows.where(F.coalesce(fine, F.lit(False))).groupBy("vec").agg(
        F.min("row").alias("node"), F.count("*").alias("copies"))
        .withColumn("d", F.size("vec")), "vector-classes")
    sizes = stage(classes.groupBy("d").agg(F.count("*").alias("n")), "dimensions")
    small = classes.join(sizes.where(F.col("n").between(2, UNIT)).select("d"), "d")
    found = stage(small.select("d", "node", "copies", "vec").groupBy("d")
                  .applyInArrow(whole_kernel(least), FOUND), "found")
    for d, n in sizes.where(F.col("n") > UNIT).orderBy("d").collect():
        found = found.union(one_dimension(classes.where(F.col("d") == d).select("vec", "node", "copies"),
                                          d, n, least, visits, least_recall))
    counts = (found.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("node"))
              .agg(F.sum("b").alias("linked")))
    linked = components(found.where(F.col("kind") == LINK).select("a", "b"))
    by_class = classes.join(counts, "node", "left").join(linked, "node", "left").select(
        "vec", F.coalesce("component", "node").alias("component"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = rows.join(stage(by_class, "class-links"), "vec", "left").select(
        "row", "id", F.coalesce("component", "row").alias("component"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return finished(joined)


def finished(rows: DataFrame) -> DataFrame:
    return named(stage(rows, "vector-links")).select(
        "row", F.col("id").alias("vec_id"), "n_links", "component_id", "kept", "first")


def one_search(classes: DataFrame, fitted: Broadcast, dimension: int, least: float, visits: int,
               exact: dict[int, int]) -> tuple[DataFrame, float]:
    """Build and search with ``visits`` shards per vector; the found rows and
    the audited recall, that of the worse class."""
    near = stage(assigned(classes.select("node", "copies", "vec"), fitted, dimension, max(2, visits)), "near")
    joins = near.select("node", "copies", "vec", "near",
                        F.explode(F.slice("near", 1, 2)).alias("shard"))
    # units of a shard: by the vectors that join it, at home or not
    shards = stage(joins.groupBy("shard").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("units")), "shards")
    unit = (F.col("shard").cast("long") * F.lit(1 << 32)
            + F.pmod(F.xxhash64("node"), F.col("units")).cast("long"))
    placed = joins.join(F.broadcast(shards), "shard").withColumn("unit", unit)  # at most MAX_CENTRES rows
    is_home = F.col("shard") == F.get("near", F.lit(0))
    homes = stage(placed.where(is_home).select("node", F.col("unit").alias("home")), "homes")
    members = stage(placed.join(homes, "node").select("unit", "home", "node", "copies", "vec"), "members")
    graph = stage(members.select("unit", "node", "vec").groupBy("unit")
                  .applyInArrow(graph_kernel(dimension), "node long, nbrs array<long>")
                  .groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs")),
                  "flat-graph")
    members = stage(members.join(graph, "node"), "unit-graphs")
    first = (near.select("node", F.explode(F.slice("near", 1, visits)).alias("shard"))
             .join(F.broadcast(shards), "shard")
             .select("node", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("u"), "shard")
             .select("node", (F.col("shard").cast("long") * F.lit(1 << 32) + F.col("u")).alias("unit")))
    audit = classes.sparkSession.sparkContext.broadcast(np.array(sorted(exact), np.int64))
    found = searched(members, stage(first, "visits"), dimension, least, audit)
    got = {r["a"]: r["n"] for r in found.where(F.col("kind") == AUDITED).groupBy("a")
           .agg(F.sum("b").alias("n")).collect()}  # at most AUDIT[-1] rows
    return found, min((sum(got.get(v, 0) / exact[v] for v in group) / len(group)
                       for group in by_links(exact) if group), default=1.0)
