"""The corpus pipeline: toxicity, near-duplicates, benchmark contamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns rows that the caller writes as Parquet and reads again
as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, decontam, minhash_dedup, secret_forest, toxicity
from tidewatch.llm.common import free_names, read_table
from tidewatch.llm.queries import BPE_PATTERN, BPE_RANKS
from tidewatch.session import durable

#: Documents that score at least this are rejected.
TOXIC = 0.3


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is below the threshold. Labels belong to the ids of the corpus that the run reads."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.filter_toxic(docs, model, TOXIC)


def _from_files(docs: DataFrame) -> DataFrame:
    """Rows that know their file and their place in it."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return durable(docs)
    return docs


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per group of near-duplicates (five words, 0.8): one with the smallest doc_id.

    Decided per row, not per doc_id: of rows that share an id, each is judged by its own text, and of equal rows one stays.
    A row is named by its file and its place there (by 64 bits, so two of 10^9 rows share a name with a probability of about 0.03).
    """
    row, least = free_names(docs, "row", "least")
    named = _from_files(docs).withColumn(row, F.expr("xxhash64(_metadata.file_path, _metadata.row_index)"))
    groups = minhash_dedup.near_dedup(named.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), F.col("component_id").alias("group"))
    ids = named.select(row, F.col("doc_id").alias("id"))
    kept = groups.join(ids, row).groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", F.col(row).alias("r"))).alias(least))
    return named.join(kept.select(F.col(f"{least}.r").alias(row)), row, "left_semi").select(*_columns(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.uncontaminated(docs, read_table(spark, sf_dir, "benchmark")).select(*_columns(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets in texts are masked, and n_chars counts the masked text."""
    (secrets,) = free_names(docs, "n_secrets")
    (candidates,) = free_names(docs, "n_candidates")
    masked = secret_forest.redacted(docs, durable(secret_forest.findings(docs)), (candidates, secrets))
    chars = F.when(F.col(secrets) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.select(*(chars.alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes decoded from them."""
    import public_tokenizers

    return bpe.token_digests(docs, public_tokenizers.path(BPE_RANKS), BPE_PATTERN)


STAGES = [
    ("toxicity", reject_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated),
    ("secret_scans", mask_secrets), ("byte_bpe", tokenize),
]

#: Trained models and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
