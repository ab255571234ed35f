"""Helpers shared by the operators: stage tables in the shared folder, row
positions, vocabulary broadcasts and bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from respondo.session import scratch_path, shared_dir

#: Text bytes handled at once inside a task; bounds the kernels' memory.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs read
    files instead of recomputing, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable lineage cut in ``spark.checkpoint.dir``."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scan_positions(df: DataFrame, file_col: str, row_col: str) -> DataFrame:
    """Add the file and the row number inside it. They come from the scan
    when ``df`` reads Parquet files; otherwise ``df`` is staged first. The
    position of a row never changes, however often the files are read."""
    def positions(d: DataFrame) -> DataFrame:
        return d.select("*", F.col("_metadata.file_path").alias(file_col),
                        F.col("_metadata.row_index").alias(row_col))
    if "_metadata" not in df.columns:
        try:
            return positions(df)
        except AnalysisException:
            pass
    return positions(stage(df, "positions"))


def numbered(df: DataFrame, name: str = "row_number") -> tuple[DataFrame, int]:
    """Add the global row number (0, 1, ... without gaps, by file name and
    place in the file) as ``name``, and count the rows. The counting job
    reads no column; what is broadcast has one row per file, like the file
    listing the driver holds anyway. No row moves."""
    placed = scan_positions(df, "__file", "__place")
    per_file = stage(placed.groupBy(F.col("__file").alias("__path")).agg(
        F.count("*").alias("__n")), "files")
    total = per_file.agg(F.sum("__n")).first()[0] or 0
    earlier = Window.orderBy("__path").rowsBetween(Window.unboundedPreceding, -1)
    first = per_file.select("__path", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__first"))
    return (placed.join(F.broadcast(first), F.col("__file") == F.col("__path"))
            .withColumn(name, F.col("__first") + F.col("__place"))
            .drop("__file", "__place", "__first", "__path", "__n")), total


def broadcast_rows(rows: DataFrame, col: str, total: int, max_bits: int = 1 << 28) -> Broadcast:
    """Broadcast which row numbers below ``total`` are in ``rows``: one bit
    each, and at most ``max_bits`` (32 MB). Beyond that, rows share bits: a
    test may then say yes for a row that is not there, never no for one that
    is. Tasks set the bits; one row per 64 of them reaches the driver."""
    bits = max(64, min(max_bits, total))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy() % bits)
            word, start = np.unique(at >> 6, return_index=True)
            bit = np.uint64(1) << (at & 63).astype(np.uint64)
            value = np.bitwise_or.reduceat(bit, start) if len(at) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))],
                                             ["word", "value"])

    table = (rows.select(F.col(col).cast("long")).mapInArrow(kernel, "word long, value long")
             .groupBy("word").agg(F.bit_or("value").alias("value"))).toArrow()
    words = np.zeros(-(-bits // 64), np.uint64)
    words[table["word"].to_numpy()] = table["value"].to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast({"words": words, "bits": bits})


def in_rows(numbers: np.ndarray, chosen: dict) -> np.ndarray:
    """Whether each row number may be in what ``broadcast_rows`` was given."""
    at = numbers % chosen["bits"]
    return (chosen["words"][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def without_rows(df: DataFrame, gone: DataFrame, col: str = "row") -> DataFrame:
    """``df`` without the rows whose numbers (see ``numbered``) ``gone`` lists.
    Rows that a bitmap rules out stay where they are; only the others are
    joined, so the table is not shuffled for a few rows."""
    rows, total = numbered(df, "__number")
    chosen = broadcast_rows(gone, col, total)

    @F.arrow_udf("boolean")
    def maybe(number: pa.Array) -> pa.Array:
        return pa.array(in_rows(number.to_numpy(), chosen.value))

    flagged = rows.withColumn("__maybe", maybe("__number"))
    listed = gone.select(F.col(col).alias("__gone"))
    left = flagged.where("__maybe").join(listed, F.col("__number") == F.col("__gone"), "left_anti")
    return (flagged.where("not __maybe").unionByName(left)
            .select(*[F.col(f"`{c}`") for c in df.columns]))


def broadcast_file(spark: SparkSession, path: str, max_bytes: int = 64 << 20) -> Broadcast:
    """Broadcast a vocabulary file. Its size does not depend on the data and
    is checked against ``max_bytes``. The value is a dict; a worker keeps
    what it builds from the file in it, so it is built once per process."""
    with open(path, "rb") as f:
        data = f.read(max_bytes + 1)
    if len(data) > max_bytes:
        raise ValueError(f"{path} has more than {max_bytes} bytes")
    return spark.sparkContext.broadcast({"file": data})


def text_array(column: pa.Array) -> pa.Array:
    """A string column as an array of its own; null texts become empty. The
    rows are copied: some string kernels read a slice's offsets wrongly."""
    own = column.take(pa.array(np.arange(len(column))))
    return pc.fill_null(own.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, column: str,
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of at most ``max_bytes`` bytes of ``column``
    (or one longer row)."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()  # give back what the slices took


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words (runs without 0x20 and 0x09-0x0D) of every text, in order: the
    code of each word, the first word of each text (one more at the end),
    and the distinct words the codes point to."""
    parts = pc.ascii_split_whitespace(texts)
    offsets = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets, values = offsets - offsets[0], parts.flatten()
    real = pc.not_equal(pc.binary_length(values), 0)
    seen = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    coded = values.filter(real).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, seen[offsets].astype(np.int64), coded.dictionary


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values[offsets[i]:offsets[i + 1]]`` for each i."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + lengths[i] - 1``, in order."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()), dtype=np.int64)


class RecentCache:
    """Two generations of a dict: entries not used during a whole
    generation go. It only saves time; results never depend on it."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.new, self.old = limit, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and key in self.old:
            found = self.old[key]
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = value
