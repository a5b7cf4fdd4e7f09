"""Corpus pipeline: documents in, their token ids out.

Each stage takes all that the one before it kept; between stages the documents are written as
Parquet to the shared folder and read again, so a stage reads from files that don't change.

All stages take a null text for an empty one, keep null ids, treat repeated rows as rows of their
own, give an empty table for an empty one, read texts of any length whole, and hand on further
columns as they are, whatever their names. `docs` must come from files or a checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from crosslight.llm import bpe, minhash, mixing, substrings, toxicity
from crosslight.llm.common import shared_folder, table
from crosslight.llm.labelled import training_rows

#: Shares of tokens that the mixing stage asks for, and the tokens it gives, of those it gets; as no rate is below 1, no document is lost to it.
TARGETS, GROWTH = {"high": 0.92, "low": 0.08}, 1.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that toxicity scoring, fitted on the labels of this input, doesn't reject; a score of 0.5 does."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.learn(training_rows(docs, labels, "toxic"))
    return docs.where(toxicity.score_column(spark, model, "text") < 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the smallest id, the first of those with equal ids."""
    return minhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier row holds; n_chars follows the text."""
    from pyspark.sql import functions as F

    kept = substrings.remove_repeats(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, and more often where its domains are short of their targets."""
    model = mixing.learn(mixing.domain_rows(docs, table(spark, sf_dir, "labels")))
    return mixing.take(docs, model, TARGETS, least=1.0, growth=GROWTH)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, ids, decoded."""
    import public_tokenizers

    return bpe.encode(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix_domains),
    ("bpe", encode_documents),
]

#: The stages fit models and follow hashes that SQL has no words for; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
