"""Unpivot, densify, key-set comparison and long pair tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_positive(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide categories to long rows, keeping strictly positive values."""
    long = df.unpivot(list(ids), list(columns), name, value)
    return long.filter(F.col(value) > 0)


def densify(df: DataFrame, domain: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every row of ``domain`` with 0 where ``df`` has none."""
    out = domain.join(df, list(on), "left")
    return out.withColumns({v: F.coalesce(v, F.lit(0)) for v in values})


def integers(spark, low: int, high: int, name: str) -> DataFrame:
    return spark.range(low, high + 1).select(F.col("id").cast("int").alias(name))


def key_differences(left: DataFrame, right: DataFrame, key: str, cause: Column) -> DataFrame:
    """Keys on both sides, and keys missing on either side counted by cause."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, key, "full")
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    why = F.when(side == "both", F.lit("-")).otherwise(cause)
    return both.groupBy(side.alias("side"), why.alias("cause")).agg(F.count("*").alias("keys"))


def replicate(df: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """One copy of the rows per value, e.g. the observed past for each scenario."""
    return df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def cross_table(df: DataFrame, rows: str, columns: str, values: Sequence, agg: Column) -> DataFrame:
    """Pivot over a declared list of values, so no extra pass discovers them."""
    return df.groupBy(rows).pivot(columns, list(values)).agg(agg)
