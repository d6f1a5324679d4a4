"""Parquet and CSV sinks, the key contract on read, and parameterised SQL."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from panelrisk.session import shuffle_width


def append_by_name(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Append the named columns, in this order, to a Parquet table."""
    df.select(*columns).write.mode("append").option("compression", "zstd").parquet(path)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Full refresh."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    writer = writer.option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_contract(spark: SparkSession, path: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Read some columns of a table that must carry its keys; only those columns are scanned."""
    df = spark.read.parquet(path)
    missing = [c for c in (*keys, *columns) if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}: a table without keys cannot be joined")
    return df.select(*keys, *columns)


def write_report(df: DataFrame, path: str) -> None:
    """Small report as CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def save_aggregate(df: DataFrame, name: str) -> None:
    """Keep an exploratory aggregate as a managed table."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def save_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int | None = None) -> None:
    """Keep a frame as a managed table whose rows lie in sorted buckets of their keys, so joins and groupings on these keys
    need no shuffle. Buckets are as many as the session's shuffle partitions: tables of one session fit each other."""
    n = buckets or shuffle_width(df)
    # One task writes a bucket, so it is one file.
    rows = df.repartition(n, *keys)
    rows.write.mode("overwrite").format("parquet").option("compression", "zstd").bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)


def run_template(spark: SparkSession, query: str, **args) -> DataFrame:
    """A query with ``:name`` markers bound as typed literals, never by text replacement."""
    return spark.sql(query, args=args)
