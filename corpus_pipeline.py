"""Corpus preparation in stages: each takes (spark, docs, sf_dir), and its result is written and read again."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelrisk.llm.common import written
from panelrisk.llm.stages import STAGES

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: Suffix arrays, Hamming links and byte-pair merges are beyond SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
