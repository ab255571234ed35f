"""Best-fit packing of tokenised documents by minimum bin slack.

A sequence is filled by choosing, among the lengths still available, the
combination that leaves the least slack; the combination is then removed.
Which lengths go together depends only on how many pieces of each length
there are, so the choice is made on the length histogram (at most
``capacity`` rows, whatever the input's size): a bitset subset-sum dynamic
programme finds the fullest feasible combination that holds the longest
remaining length, and the combination is removed as many times as the
counts allow. Pieces then find their places by their rank among the pieces
of their length, without meeting in one task.

Defined results: a null text is empty (one separator id); equal documents
and repeated rows are separate pieces; an empty table gives no rows; extra
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respondo.llm.common import SLICE_BYTES, gather, slices, stage, text_array
from respondo.llm.word_bpe import token_ids

#: Text bytes encoded at once: the larger, the fewer words are looked up twice.
#: Where the ids are returned, they are held too, and slices are smaller.
PACKED_BYTES = 12 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: Broadcast, capacity: int = 2048,
               separator: int = 0, id_col: str = "doc_id", text_col: str = "text",
               with_ids: bool = False) -> DataFrame:
    """Encode every whole text, append ``separator`` and cut what is longer
    than ``capacity`` into pieces. Returns one row per piece with its rank
    among the pieces of its length in the same task (``part``, ``rank``);
    ``with_ids`` adds the ids themselves."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES if with_ids else PACKED_BYTES):
                ids, first = token_ids(text_array(rows.column("text")), vocabulary.value)
                n = np.diff(first)
                # the separator goes behind each text's last id
                ids = np.insert(ids, first[1:], separator).astype("<u4")
                first = first + np.arange(len(first))
                n = n + 1
                pieces = -(-n // capacity)
                owner = np.repeat(np.arange(len(n)), pieces)
                number = gather(np.zeros(len(n), np.int64), pieces)
                start = number * capacity
                length = np.minimum(n[owner] - start, capacity)
                raw, at = memoryview(ids.tobytes()), (first[owner] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist())]
                # rank among equal lengths: order inside the slice, after earlier slices
                order = np.argsort(length, kind="stable")
                run = length[order]
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(run)) - np.searchsorted(run, run) + used[run]
                used += np.bincount(length, minlength=capacity + 1)
                out = [rows.column("doc_id").cast(pa.int64()).take(pa.array(owner)),
                       pa.array(number.astype(np.int32)), pa.array(start), pa.array(length),
                       pa.array(crc, pa.int64()),
                       pa.array(np.full(len(length), part, np.int64)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(length)])
                    out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)),
                                                        pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = PIECES + ", part long, rank long" + (", ids array<int>" if with_ids else "")
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.col(text_col).alias("text"))
            .mapInArrow(kernel, schema))


def fullest(counts: dict[int, int], slack: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum of at most
    ``slack``: bit s of a reach set tells whether some combination of the
    lengths taken so far (longest first) sums to s."""
    mask = (1 << (slack + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= slack), reverse=True):
        steps.append((length, reach))
        left, chunk = min(counts[length], slack // length), 1
        while left:  # up to ``left`` copies, in doubling chunks
            take = min(chunk, left)
            reach |= (reach << (take * length)) & mask
            left, chunk = left - take, chunk * 2
        if reach >> slack & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):  # the shortest lengths are used least
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            used[length] = n
    return used


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Fill sequences until no piece is left: (times, lengths with their
    numbers) for each combination. It holds the longest remaining length
    and the fullest combination for the slack beside it."""
    left = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = fullest({k: v for k, v in left.items() if v}, capacity - longest)
        left[longest] += 1
        used = dict(rest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        out.append((times, used))
    return out


def slots(filled: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: rows (length, first
    rank, pieces per sequence, first sequence, offset), sorted."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for times, used in filled:
        offset = 0
        for length in sorted(used, reverse=True):
            rows.append((length, given.get(length, 0), used[length], sequence, offset))
            given[length] = given.get(length, 0) + times * used[length]
            offset += length * used[length]
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "per", "sequence", "offset"), cols))


def pack(docs: DataFrame, vocabulary: Broadcast, capacity: int = 2048, separator: int = 0,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Place every piece: the columns of ``PIECES`` (and ``ids``), then
    ``sequence_id`` and ``offset`` (gapless from 0 in each sequence)."""
    pieces = stage(cut_pieces(docs, vocabulary, capacity, separator, id_col, text_col, with_ids),
                   "pieces")
    spark = docs.sparkSession
    per_part = pieces.groupBy("part", "length").count()
    counts = stage(per_part, "piece-counts")
    # at most ``capacity`` rows: a bounded summary, not the pieces
    histogram = {r["length"]: r["n"] for r in
                 counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = spark.sparkContext.broadcast(slots(patterns(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length",
                            F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = places.value
        base = int(s["rank"].max(initial=0)) + 1
        keys = s["length"] * base + s["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * base + np.minimum(rank, base - 1), "right") - 1
            copy, k = np.divmod(rank - s["rank"][at], s["per"][at])
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(s["sequence"][at] + copy), pa.array(s["offset"][at] + k * length)],
                keep + ["sequence_id", "offset"])

    extra = ["ids"] if with_ids else []
    return (pieces.join(offsets, ["part", "length"])
            .select("doc_id", "piece", "start", "length", "ids_crc32", *extra,
                    (F.col("rank") + F.col("earlier")).alias("rank"))
            .mapInArrow(place, PIECES + (", ids array<int>" if with_ids else "")
                        + ", sequence_id long, offset long"))
