"""Groups of any size as blocks of bounded size.

A group is dealt into blocks by a hash of the member, each gathered as one
row. A kernel then sees one block, or two blocks of the same group: a group
of k blocks becomes k (k + 1) / 2 tasks of bounded size, so no group meets
in one task and pairs are formed only inside a kernel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(members: DataFrame, payload: list[str],
              kernel: Callable[[pa.StructArray, pa.StructArray | None], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``members`` has ``grp``, ``n_blocks`` (of its group), ``member`` and
    the payload columns. ``kernel(left, right)`` gets the members of a block
    and either None (links inside the block) or another block's members
    (links between the two)."""
    blocks = (members
              .withColumn("blk", F.pmod(F.xxhash64("member"), F.col("n_blocks")).cast("int"))
              .groupBy("grp", "n_blocks", "blk")
              .agg(F.collect_list(F.struct("member", *payload)).alias("rows")))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("rows")
            for i in range(len(rows)):
                yield from kernel(rows[i].values, None)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("both")
            for i in range(len(rows)):
                pair = rows[i].values
                if len(pair) == 2:  # a block can be empty and so missing
                    yield from kernel(pair.field("rows")[0].values, pair.field("rows")[1].values)

    alone = blocks.select("rows").mapInArrow(inside, schema)
    # block k meets every other block of its group once (the outer explode
    # keeps both branches on one shuffle: no filter moves below it)
    meets = (blocks
             .withColumn("other", F.explode_outer(F.sequence(F.lit(0), F.col("n_blocks").cast("int") - 1)))
             .where("other <> blk")
             .select("grp", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"),
                     "blk", "rows")
             .groupBy("grp", "lo", "hi")
             .agg(F.collect_list(F.struct("blk", "rows")).alias("both")))
    return alone.union(meets.select("both").mapInArrow(between, schema))
