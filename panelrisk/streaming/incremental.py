"""Incremental batch loads. The source system is batch only, so no streaming query is needed here."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.session import shuffle_width


def rebuild_years(df: DataFrame, path: str, year: str = "year") -> None:
    """Rewrite only the year partitions present in ``df``; running it twice gives the same table."""
    # One hash partition per (year, slice): a year is written by several tasks, not by one.
    sliced = df.repartition(F.col(year), F.pmod(F.hash("entity"), F.lit(shuffle_width(df))))
    (
        sliced.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(year)
        .parquet(path)
    )


def years_present(spark: SparkSession, path: str, year: str = "year") -> list[int]:
    """Years of the table's partition folders; none if the path does not exist. No file is opened."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place) if status.isDirectory()]
    return sorted(int(name.removeprefix(f"{year}=")) for name in names if name.startswith(f"{year}="))


def missing_years(spark: SparkSession, df: DataFrame, path: str, year: str = "year") -> DataFrame:
    """Rows whose year is not in the table yet."""
    done = years_present(spark, path, year)
    return df.filter(~F.coalesce(F.col(year).isin(done), F.lit(False))) if done else df


def backfill(spark: SparkSession, df: DataFrame, path: str, year: str = "year") -> None:
    """Append the missing years; a second run appends nothing."""
    missing_years(spark, df, path, year).write.mode("append").option("compression", "zstd").partitionBy(year).parquet(path)
