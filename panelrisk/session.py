"""Session settings the library expects; a cluster keeps its own values for anything already set."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the benchmark. On a cluster use the session you are given."""
    scratch = tempfile.mkdtemp(prefix="panelrisk-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.checkpoint.dir", f"{scratch}/checkpoints")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .appName("panelrisk")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; beside the warehouse where it names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame that is read several times to the checkpoint folder, on every kind of cluster alike."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shuffle_width(df: DataFrame) -> int:
    """The number of shuffle partitions the session is set to: how many tasks work side by side."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over every shuffle partition before a row is expanded into many.

    Adaptive execution sizes partitions by their present bytes, and a table about to grow a thousandfold
    still looks tiny, so the partition count is fixed here. A later grouping that contains ``keys``
    reuses this partitioning.
    """
    return df.repartition(shuffle_width(df), *keys)


def dealt(df: DataFrame, n: int, most: int) -> DataFrame:
    """``n`` rows dealt evenly to so many partitions that none has more than about ``most``; if one is enough, as they are."""
    parts = -(-n // most)
    return df.repartition(parts) if parts > 1 else df
