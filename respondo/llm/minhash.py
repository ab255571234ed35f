"""MinHash near-duplicates by min-max hashing.

Each permutation of the shingles gives two signature values, the smallest
and the largest hash, so half as many hash evaluations are needed; both
agree between two texts with the probability of their Jaccard similarity.
Signature values are banded; texts that share a band meet in its bucket.

The work, for n texts:

1. Signatures: one pass over whole texts. Texts with equal shingle sets
   form a class; one representative of each goes on, so copies never meet
   in a bucket however many there are.
2. Buckets with two or more representatives compare 8-bit sketches of the
   signatures; pairs whose estimate cannot come from a link (see
   ``SLACK``) are not followed. Links inside a bucket are written as a
   spanning forest, never as all pairs. Their components are clusters.
3. Inside each cluster the full shingle sets are intersected exactly, and
   what reaches the threshold is united.

Buckets and clusters of any size are dealt in bounded blocks (``blocks``),
without a cap on partners. A pair at the threshold shares no band with
probability ``MISS`` or less, and far less above it; everything behind the
bands is exact but for 64-bit shingle hashes and the sketch bound (1e-9).

Defined results: a null or empty text, or one without words, has an empty
set and links with nothing; equal texts and repeated rows link with each
other; a null id takes part, but is never the name of a component (a
component without any id has a null one, and its rows are not kept); an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondo.llm.blocks import in_blocks
from respondo.llm.common import (broadcast_rows, gather, in_rows, numbered, slices, stage, sums,
                                 text_array, word_codes)
from respondo.llm.components import components, named

SLACK = 6.0                    # standard deviations below the threshold that a sketch may fall
BUCKET_BLOCK = 256             # members of a bucket in one block
SET_BLOCK, ROW_BLOCK = 200_000, 512  # shingles and sets of a cluster in one block


MISS = 1.5e-5


def banding(percent: int) -> tuple[int, int]:
    """Values per band and bands (an even number of values in all)."""
    rows = 6 if percent >= 85 else 5
    bands = math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows))
    return rows, bands + (rows * bands) % 2


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one text after
    another, and where each begins. A-Z are lower-cased; a text with fewer
    words is one shingle."""
    codes, first, distinct = word_codes(pc.ascii_lower(texts))
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, pc.cast(distinct, pa.large_binary()).to_pylist()),
                         np.uint64, len(distinct))[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    starts = gather(first[:-1], count)
    owner = np.repeat(np.arange(len(n)), count)
    length = np.minimum(n, words)[owner]
    padded = np.concatenate([hashed, np.zeros(words, np.uint64)])
    value = length.astype(np.uint64)
    for k in range(words):
        step = value * np.uint64(0x9E3779B97F4A7C15) + padded[starts + k]
        value = np.where(k < length, step, value)
    value = mix(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(np.bincount(owner[new], minlength=len(n)), out=at[1:])
    return value[new], at


def signatures(value: np.ndarray, at: np.ndarray, values: int) -> np.ndarray:
    """Smallest and largest hash under each permutation, a row per text."""
    odd = mix(np.arange(1, values // 2 + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros((len(at) - 1, values), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for k, a in enumerate(odd):
            h = value * a
            h ^= h >> np.uint64(32)
            h *= odd[k - 1]
            out[full, k] = np.minimum.reduceat(h, at[full])
            out[full, values // 2 + k] = np.maximum.reduceat(h, at[full])
    return out


def band_keys(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    order = np.arange(rows * bands).reshape(rows, bands).T  # band b takes values b, b + bands, ...
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, order[:, k]])
    return key.view(np.int64)


def signed(docs: DataFrame, words: int, per_band: int, n_bands: int) -> DataFrame:
    """(row, id, n_shingles, set_a, set_b, bands, sketch) of every text;
    ``set_a``/``set_b`` identify the shingle set."""
    values = per_band * n_bands

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                value, at = shingles(text_array(rows.column("text")), words)
                sig = signatures(value, at, values)
                n = np.diff(at)
                with np.errstate(over="ignore"):
                    a, b = sums(value, at), sums(mix(value + np.uint64(1)), at)
                keys = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(n) + 1, dtype=np.int32) * n_bands),
                    pa.array(band_keys(sig, per_band, n_bands).reshape(-1)))
                raw = (mix(sig) & np.uint64(255)).astype(np.uint8).tobytes()
                sketch = pa.array([raw[i:i + values] for i in range(0, len(raw), values)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("row"), rows.column("id"), pa.array(n.astype(np.int64)),
                     pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), keys, sketch],
                    ["row", "id", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    return docs.mapInArrow(kernel, "row long, id long, n_shingles long, set_a long, set_b long, "
                                   "bands array<long>, sketch binary")


class Union:
    """Components of a few members inside one kernel."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.up[a], self.up[b]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(self.up, hi, lo)
            while True:
                flat = self.up[self.up]
                if (flat == self.up).all():
                    break
                self.up = flat
            left = self.up[a] != self.up[b]
            a, b = a[left], b[left]


LINKS = "a long, b long"


def forest(ids: np.ndarray, united: Union) -> pa.RecordBatch:
    """Each member's link to the first of its component: fewer links than members."""
    below = np.flatnonzero(united.up != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[united.up[below]]), pa.array(ids[below])],
                                      ["a", "b"])


def sketch_links(least: int, values: int):
    """Kernel: unite members whose sketches agree in ``least`` values or more."""
    def kernel(left: pa.StructArray, right: pa.StructArray | None) -> Iterator[pa.RecordBatch]:
        parts = [left] if right is None else [left, right]
        ids = np.concatenate([p.field("member").to_numpy() for p in parts])
        bits = [np.frombuffer(b"".join(p.field("sketch").to_pylist()), np.uint8).reshape(len(p), values)
                for p in parts]
        united = Union(len(ids))
        for i in range(len(left)):
            other = bits[0][i + 1:] if right is None else bits[1]
            hit = np.flatnonzero((other == bits[0][i]).sum(axis=1) >= least)
            base = i + 1 if right is None else len(left)
            united.unite(np.full(len(hit), i), hit + base)
        yield forest(ids, united)
    return kernel


def exact_links(percent: int):
    """Kernel: unite sets whose intersection is ``percent`` per cent of their
    union or more, counted over all their shingles."""
    def kernel(left: pa.StructArray, right: pa.StructArray | None) -> Iterator[pa.RecordBatch]:
        parts = [left] if right is None else [left, right]
        ids = np.concatenate([p.field("member").to_numpy() for p in parts])
        raw = [x for p in parts for x in p.field("shingles").to_pylist()]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 8
        value = np.frombuffer(b"".join(raw), np.uint64)
        owner = np.repeat(np.arange(len(raw)), size)
        _, column, times = np.unique(value, return_inverse=True, return_counts=True)
        shared = times[column] > 1  # a shingle of one set alone counts in no intersection
        order = np.argsort(column[shared], kind="stable")
        owner, column = owner[shared][order], column[shared][order]
        column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]])) if len(column) else column
        k = len(left)
        rows, cols = (len(raw), len(raw)) if right is None else (k, len(raw) - k)
        common = np.zeros((rows, cols), np.float32)
        step, end = 4096, int(column[-1]) + 1 if len(column) else 0
        for start in range(0, end, step):
            lo, hi = np.searchsorted(column, (start, start + step))
            dense = np.zeros((len(raw), step), np.float32)
            dense[owner[lo:hi], column[lo:hi] - start] = 1
            common += dense @ dense.T if right is None else dense[:k] @ dense[k:].T
        mine, theirs = (size, size) if right is None else (size[:k], size[k:])
        union = mine[:, None] + theirs[None, :] - common
        i, j = np.nonzero(100 * common.astype(np.int64) >= percent * union.astype(np.int64))
        if right is None:
            i, j = i[i < j], j[i < j]
        else:
            j = j + k
        united = Union(len(raw))
        united.unite(i, j)
        yield forest(ids, united)
    return kernel


def chosen_sets(rows: DataFrame, chosen: Broadcast, words: int) -> DataFrame:
    """(member, shingles) of the rows in ``chosen``; other texts stay where
    they are."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = in_rows(batch.column("row").to_numpy(), chosen.value)
            for some in slices(batch.filter(pa.array(wanted)), "text"):
                value, at = shingles(text_array(some.column("text")), words)
                raw, ends = value.tobytes(), (at * 8).tolist()
                sets = pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("row"), sets], ["member", "shingles"])

    return rows.select("row", "text").mapInArrow(kernel, "member long, shingles binary")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: ``row`` (its global row number in ``docs``),
    ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by
    links), ``kept`` (its id is that) and ``first`` (true for exactly one
    row of each component)."""
    rows, total = numbered(docs.select(F.col(id_col).cast("long").alias("id"),
                                   F.col(text_col).alias("text")), "row")
    per_band, bands = banding(percent)
    values = per_band * bands
    all_rows = stage(signed(rows.select("row", "id", "text"), words, per_band, bands), "signatures")
    same = ["n_shingles", "set_a", "set_b"]
    classes = stage(all_rows.where("n_shingles > 0").groupBy(*same)
                    .agg(F.min("row").alias("rep")), "classes")
    reps = (all_rows.join(classes, same).where("row = rep")
            .select("row", "n_shingles", "bands", "sketch"))
    reps = stage(reps, "representatives")

    in_bands = reps.select("row", F.explode("bands").alias("grp"))
    buckets = in_bands.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select(
        "grp", F.ceil(F.col("n") / BUCKET_BLOCK).alias("n_blocks"))
    met = stage(in_bands.join(stage(buckets, "buckets"), "grp"), "met")
    members = met.join(reps.select("row", "sketch"), "row").withColumnRenamed("row", "member")
    s = percent / 100
    least = int(values * s - SLACK * (values * s * (1 - s)) ** 0.5)
    likely = in_blocks(members.select("grp", "n_blocks", "member", "sketch"), ["sketch"],
                       sketch_links(least, values), LINKS)
    clusters = components(likely)

    sizes = (clusters.join(reps.select(F.col("row").alias("node"), "n_shingles"), "node")
             .groupBy("component").agg(F.greatest(
                 F.ceil(F.sum("n_shingles") / SET_BLOCK),
                 F.ceil(F.count("*") / ROW_BLOCK)).alias("n_blocks")))
    wanted = stage(clusters.join(stage(sizes, "cluster-sizes"), "component").select(
        F.col("node").alias("row"), F.col("component").alias("grp"), "n_blocks"), "clusters")
    sets = (chosen_sets(rows, broadcast_rows(wanted, "row", total), words)
            .join(wanted.withColumnRenamed("row", "member"), "member"))
    linked = components(in_blocks(sets, ["shingles"], exact_links(percent), LINKS))

    # every row's component is named by its class's representative
    by_class = (classes.join(linked, F.col("rep") == F.col("node"), "left")
                .select(*same, F.coalesce("component", "rep").alias("component")))
    rows = (all_rows.select("row", "id", *same).join(stage(by_class, "class-components"), same, "left")
            .select("row", "id", "n_shingles", F.coalesce("component", "row").alias("component")))
    return named(stage(rows, "rows")).select("row", F.col("id").alias("doc_id"), "n_shingles",
                                             "component_id", "kept", "first")
