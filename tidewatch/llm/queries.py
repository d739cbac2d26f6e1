"""Registered queries over the driver's tables, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import bpe, chat_format, decontam, hmm_lm, langid, merkle, minhash_dedup, packing, pii_lstm, secret_forest, shallot, spotsigs, toxicity
from tidewatch.llm.common import read_table
from tidewatch.llm.oracles import ORACLES

#: The query's tokenizer: where its ranks lie on every machine, and the pattern that cuts texts.
BPE_RANKS, BPE_PATTERN = "byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN

#: The packing query's vocabulary, as ranks and as the tokenizer's own file.
PACKING_RANKS, PACKING_TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def op1_minhash_dedup(spark: SparkSession, directory: str) -> DataFrame:
    p = minhash_dedup.MinHash(shingle=3, percent=85, bands=24, rows=5, agree=98)
    return minhash_dedup.near_dedup(read_table(spark, directory, "documents"), p)


def op2_spotsigs(spark: SparkSession, directory: str) -> DataFrame:
    return spotsigs.edited_pairs(read_table(spark, directory, "documents"))


def op3_hmm_scores(spark: SparkSession, directory: str) -> DataFrame:
    return hmm_lm.lm_scores(read_table(spark, directory, "documents"))


def op4_chat_formatting(spark: SparkSession, directory: str) -> DataFrame:
    told = read_table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    # The contract's own conversation: control strings as text.
    own = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    return chat_format.conversation_digests(told.unionByName(own))


def op6_pii(spark: SparkSession, directory: str) -> DataFrame:
    return pii_lstm.span_digests(read_table(spark, directory, "documents"))


def op7_language_id(spark: SparkSession, directory: str) -> DataFrame:
    docs = read_table(spark, directory, "documents")
    return langid.predictions(docs, langid.train(docs))


def op5_secret_scans(spark: SparkSession, directory: str) -> DataFrame:
    return secret_forest.secret_scan(read_table(spark, directory, "documents"))


def op8_byte_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return bpe.token_digests(read_table(spark, directory, "documents"), public_tokenizers.path(BPE_RANKS), BPE_PATTERN)


def op9_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, directory, "documents"), read_table(spark, directory, "labels"))


def op10_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    return decontam.contamination(read_table(spark, directory, "documents"), read_table(spark, directory, "benchmark")).drop("doc")


def op11_merkle_manifest(spark: SparkSession, directory: str) -> DataFrame:
    return merkle.manifest(read_table(spark, directory, "documents"))


def op12_shallot_clusters(spark: SparkSession, directory: str) -> DataFrame:
    return shallot.clusters(read_table(spark, directory, "embeddings"))


def op13_best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    tokens = packing.Tokens(public_tokenizers.path(PACKING_RANKS), public_tokenizers.path(PACKING_TOKENIZER), public_tokenizers.PATTERN)
    return packing.packed_documents(read_table(spark, directory, "documents"), tokens)


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_spotsigs, op3_hmm_scores, op4_chat_formatting, op5_secret_scans, op6_pii, op7_language_id, op8_byte_bpe, op9_toxicity, op10_decontamination, op11_merkle_manifest, op12_shallot_clusters, op13_best_fit_packing)}
ORACLE_SQL = {name: sql for name, sql in ORACLES.items() if name in QUERIES}
