"""Token counts from an exact length histogram.

Documents are aggregated by encoded length; sums over the lengths above a
limit (suffix sums) then answer totals, quantiles and truncated totals for
every context limit from the histogram alone.

Defined results: null and empty texts have length 0; repeated rows count
each time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respondo.llm.common import slices, stage, text_array
from respondo.llm.word_bpe import token_counts


def lengths(docs: DataFrame, vocabulary: Broadcast, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs) counted inside each task; one row per distinct
    length and slice."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                n, c = np.unique(token_counts(text_array(rows.column("text")), vocabulary.value),
                                 return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)),
                                                  pa.array(c.astype(np.int64))],
                                                 ["n_tokens", "n_docs"])

    return (docs.select(F.col(text_col).alias("text"))
            .mapInArrow(kernel, "n_tokens long, n_docs long"))


def histogram(docs: DataFrame, vocabulary: Broadcast, text_col: str = "text") -> DataFrame:
    """One row per distinct length: ``n_tokens``, ``n_docs``."""
    return (lengths(docs, vocabulary, text_col)
            .groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))


def suffix_sums(hist: DataFrame, block: int = 4096) -> DataFrame:
    """Add to every length L: ``docs_to`` (documents of at most L tokens),
    ``docs_over`` and ``tokens_over`` (documents longer than L, their
    tokens), ``tokens_truncated`` (all tokens if every document is cut at
    L) and ``total_tokens``. Sums run inside blocks of lengths; only one
    row per block meets in one task."""
    tokens = F.col("n_tokens") * F.col("n_docs")
    h = stage(hist, "lengths").withColumn("block", F.floor(F.col("n_tokens") / block))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"),
                                    F.sum(tokens).alias("block_tokens"))
    later = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding,
                                                Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(whole).alias("all_docs"),
        F.sum("block_tokens").over(whole).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(
        1, Window.unboundedFollowing)
    out = (h.withColumn("d", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
           .withColumn("t", F.coalesce(F.sum(tokens).over(inside), F.lit(0)))
           .join(blocks, "block"))
    over_docs, over_tokens = F.col("d") + F.col("later_docs"), F.col("t") + F.col("later_tokens")
    return out.select(
        "n_tokens", "n_docs",
        (F.col("all_docs") - over_docs).alias("docs_to"),
        over_docs.alias("docs_over"), over_tokens.alias("tokens_over"),
        (F.col("total_tokens") - over_tokens + F.col("n_tokens") * over_docs)
        .alias("tokens_truncated"),
        "total_tokens")


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens kept at each context limit, from the suffix sums: the totals
    up to the limit plus the limit for every longer document."""
    short = F.col("n_tokens") <= F.col("context")
    return (sums.select("n_tokens", "n_docs",
                        F.explode(F.array(*map(F.lit, limits))).alias("context"))
            .groupBy("context")
            .agg(F.sum(F.least("n_tokens", "context") * F.col("n_docs")).alias("tokens"),
                 F.sum(F.when(~short, F.col("n_docs")).otherwise(0)).alias("docs_cut")))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    picks = [F.min(F.when(F.col("docs_to") >= F.lit(q) * (F.col("docs_to") + F.col("docs_over")),
                          F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)]
    row = sums.agg(*picks)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(q).alias("share"), F.col(f"q{i}").alias("n_tokens"))
        for i, q in enumerate(shares)])).alias("r")).select("r.*")
