"""A corpus pipeline over ``documents``: stages that each call one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All but
the last return the columns of ``docs``. Null and empty texts, repeated
rows and empty tables behave as each operator says; columns beyond those of
``documents`` pass through to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respondo.llm import minhash, packing, quality, secrets
from respondo.llm.common import broadcast_file, stage, table, without_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns beyond those of ``documents`` under names
    that no operator uses, and which name stands for which column."""
    names = {f"__extra_{i}" if c not in COLUMNS else c: c for i, c in enumerate(docs.columns)}
    return docs.toDF(*names), names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule policy rejects go."""
    own, names = aside(docs)
    return quality.ledger(own).where(quality.passes("v1")).select(*[F.col(n).alias(c) for n, c in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles,
    similarity 0.8 or more."""
    groups = minhash.near_duplicates(docs, percent=80, words=5)
    return without_rows(docs, stage(groups.where(~F.col("first")).select("row"), "gone"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    own, names = aside(docs)
    found = secrets.find(own)
    clean = secrets.redacted("text", "found")
    changed = F.size("found") > 0
    return found.select(*[
        clean.alias("text") if c == "text"
        else F.when(changed, F.length(clean).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
        if c == "n_chars" else F.col(n).alias(c) for n, c in names.items()])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their ids, packed into sequences of 2048."""
    vocabulary = broadcast_file(spark, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(docs, vocabulary, capacity=2048, separator=0, with_ids=True)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates),
          ("secret scan", secret_scan), ("best-fit packing", best_fit_packing)]

#: SQL cannot express the later stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
