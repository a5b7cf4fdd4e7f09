"""Bounded samples of labelled rows, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: The most labelled rows that a classifier is fitted on.
MAX_ROWS = 20_000


def remainder(id_col: str, divisor: int) -> F.Column:
    """crc32 of the id as text, modulo the divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: F.Column | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """Whole texts and labels (0 or 1) of at most `max_rows` labelled documents: text, label.

    Labels that are null are left out, as are rows that `held_out` (over doc_id) selects; where an id
    is labelled more than once the larger label holds, and where several documents have one id the
    first text in order stands for it. Which rows are taken follows a hash of the id, so the sample is
    the same at every run. It has `max_rows` rows at most and is broadcast to the documents.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    if held_out is not None:
        known = known.where(~held_out)
    sample = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")


def labelled_tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
