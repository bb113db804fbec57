"""The corpus pipeline: toxic documents go, one near-duplicate of each group stays, benchmark text goes, secrets are
masked, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept. Stages that filter leave the rows
they keep untouched; the secret stage changes ``text`` and ``n_chars`` of documents with secrets only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm import bpe, decontaminate, secrets, simhash, toxicity
from spanwise.llm.queries import digests, table, vocabulary_path
from spanwise.session import materialize

#: Documents at or above this score are rejected.
TOXIC = 0.5
#: SQL has no hashed-feature classifier, XXH64 fingerprint or tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct("*").alias("row"), "text")
    training = docs.select("doc_id", "text")
    kept = toxicity.scored(rows, training, table(spark, sf_dir, "labels")).where(F.col("score") < TOXIC)
    return kept.select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(bpe.tokenized(docs.select("doc_id", "text"), vocabulary_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs
