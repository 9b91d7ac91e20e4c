"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cellsieve.llm import (
    byte_bpe, chat_format, decontaminate, factor_machine, hash_tree, merkle, minhash_dedup, mixing, periodic_runs, pii_bootstrap, quality_trees,
    sql, suffix_dedup, token_codes)
from cellsieve.llm.base import read
from suite.registry import Query

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


TREE = hash_tree.ShardTree.regular(regions=4, racks=2, shards=2)
GROWN = TREE.with_shard(16)
CONTROL = r"\### Assistant: </turn> ok"


@query
def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.personal_data(read(spark, sf_dir, "documents"))


@query
def op2_factor_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return factor_machine.score_documents(docs, factor_machine.train(docs, read(spark, sf_dir, "labels")))


@query
def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.stored_codes(
        read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    placed = hash_tree.place(docs, TREE).withColumn("law", F.lit("key")).withColumn(
        "grown_shard", hash_tree.shard_of(F.col("doc_id"), GROWN))
    return hash_tree.with_slots(placed).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(read(spark, sf_dir, "documents"), with_text=False)


@query
def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, percent=80)


@query
def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_trees.quality_report(docs, quality_trees.train(docs, read(spark, sf_dir, "labels")))


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.createDataFrame(
        [(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat_format.stored_chats(turns.unionByName(more))


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_report(read(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(read(spark, sf_dir, "documents"))


@query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(
        read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.collapsed_report(read(spark, sf_dir, "documents"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


SQL |= {
    "op4_hash_tree": sql.op4(TREE, GROWN),
    "op5_decontaminate": sql.OP5,
    "op7_minhash_dedup": sql.op7(size=4, percent=80),
    "op9_chat_format": sql.op9(CONTROL),
    "op10_mix_sources": sql.op10(),
    "op11_merkle_manifest": sql.op11(),
}
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
