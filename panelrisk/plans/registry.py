"""Named queries: a Spark plan, the inventory rows it covers, and the equivalent DuckDB SQL when there is one.

The output columns are declared once, as ``name:kind``. Both sides are shaped from that list:
i = bigint, f = double rounded to 6 digits, fN = rounded to N, d = ISO date text, s = text, b = boolean.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.plans.roles import Roles, with_roles


@dataclass(frozen=True)
class Query:
    name: str
    rows: tuple[str, ...]
    columns: tuple[tuple[str, str], ...]
    plan: Callable[[Roles], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.plan(Roles(spark, folder))
        return df.select(*[_spark_column(n, k) for n, k in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        shaped = ", ".join(_sql_column(n, k) for n, k in self.columns)
        body = self.sql.strip()
        return with_roles(f"WITH result_rows AS ({body})\nSELECT {shaped} FROM result_rows")


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "i":
        c = c.cast("bigint")
    elif kind[0] == "f":
        c = F.round(c.cast("double"), int(kind[1:] or 6)) + F.lit(0.0)
    elif kind == "d":
        c = c.cast("date").cast("string")
    elif kind == "s":
        c = c.cast("string")
    elif kind == "b":
        c = c.cast("boolean")
    return c.alias(name)


def _sql_column(name: str, kind: str) -> str:
    c = f'"{name}"'
    if kind == "i":
        c = f"CAST({c} AS BIGINT)"
    elif kind[0] == "f":
        c = f"round(CAST({c} AS DOUBLE), {kind[1:] or 6}) + CAST(0 AS DOUBLE)"
    elif kind == "d":
        c = f"CAST(CAST({c} AS DATE) AS VARCHAR)"
    elif kind == "s":
        c = f"CAST({c} AS VARCHAR)"
    elif kind == "b":
        c = f"CAST({c} AS BOOLEAN)"
    return f'{c} AS "{name}"'


REGISTRY: dict[str, Query] = {}


def query(rows: str, columns: str, sql: str | None = None):
    """Register the decorated plan under its own name."""
    parsed = tuple((n, k) for n, k in (c.split(":") for c in columns.split()))

    def add(plan: Callable[[Roles], DataFrame]):
        name = plan.__name__
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(rows.split()), parsed, plan, sql)
        return plan

    return add
