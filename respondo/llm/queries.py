"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respondo.llm import (additive, byte_bpe, embedding_dedup, lm_scores, merkle, minhash, oracles, packing,
                          quality, secrets, sharding, spelling, token_counts, warc)
from respondo.llm.common import broadcast_file, stage, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {"op2_pruned_flat_graph": oracles.OP2, "op4_min_max_hashing": oracles.OP4,
                          "op8_rule_ledger": oracles.OP8, "op11_trie_frontier": oracles.OP11,
                          "op12_time_forward_manifest": oracles.OP12}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_min_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = broadcast_file(spark, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary, capacity=2048, separator=0)


@query
def op2_pruned_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9).select(
        "vec_id", "n_links", "component_id", "kept")


@query
def op3_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = broadcast_file(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents")
    encoded = byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN)
    both = byte_bpe.decode(encoded, vocabulary, public_tokenizers.PATTERN)
    return both.select("doc_id", byte_bpe.n_tokens(F.col("ids")).alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op4_min_max_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85, words=5).select(
        "doc_id", "n_shingles", "component_id", "kept")


@query
def op5_log_frequency_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return lm_scores.score(table(spark, sf_dir, "documents"), F.crc32(name) % 7 == 2)


@query
def op6_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id", *[secrets.count("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.listed("base"), 256).alias("base_sha256"),
        secrets.listed("found").alias("spans"))


@query
def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = broadcast_file(spark, public_tokenizers.path("word_bpe_49k.json"))
    return token_counts.suffix_sums(
        token_counts.histogram(table(spark, sf_dir, "documents"), vocabulary))


@query
def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes("base")).alias("base_failed"),
        (quality.passes("base") & quality.passes("v1")).alias("kept"), "failed")


@query
def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return sharding.shard(docs, shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number")


@query
def op10_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


@query
def op11_trie_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = stage(spelling.word_counts(table(spark, sf_dir, "documents"), every=199, least_len=6, least_n=5),
                  "words")
    return spelling.variants(words, times=5)


@query
def op12_time_forward_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"),
                           F.when(tampered, merkle.ascii_lower(F.col("text"))))


@query
def op13_additive_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return additive.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                             F.crc32(name) % 4 == 2, at_least=0.7)
