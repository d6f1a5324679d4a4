"""The stages of the corpus pipeline; all but the last return the columns of documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, pii, quality_rules, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rated, name = quality_rules.with_quality(docs)
    return rated.filter(F.col(name)["kept"]).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near-duplicates.

    A row repeated with the same doc_id and text stays once; rows that share a doc_id but not the text each stand
    for themselves. Rows without a doc_id can't be named by a group and stay.
    """
    near = simhash.near_duplicates(docs.select("doc_id", "text"))
    stay = near.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    searched, name = decontaminate.with_leaks(docs, items)
    return searched.filter(F.size(name) == 0).select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars is counted anew."""
    masked = pii.with_masked(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return masked.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    tokens, name = bpe.with_tokens(docs.select("doc_id", "text"), bpe.default_vocabulary())
    return tokens.select("doc_id", *bpe.digests(name))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("pii", private),
    ("bpe", encoded),
]
