"""Monotone correction of probabilities: Platt on log-odds, or isotonic."""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrisk.functions.scalars import count_below, logit, sigmoid
from panelrisk.operators.ranks import running_totals
from panelrisk.session import cut_lineage


@dataclass(frozen=True)
class Platt:
    slope: float
    intercept: float

    def apply(self, df: DataFrame, p: str, into: str = "calibrated") -> DataFrame:
        return df.withColumn(into, sigmoid(logit(p) * F.lit(self.slope) + F.lit(self.intercept)))


@dataclass(frozen=True)
class Isotonic:
    """One row with the arrays ``boundaries`` and ``values``: the first and the last score of each step, in order."""

    steps: DataFrame

    def apply(self, df: DataFrame, p: str, into: str = "calibrated") -> DataFrame:
        """Piecewise linear between the fitted steps, clipped outside them; found by bisection of the boundaries."""
        given = F.col(p).cast("double")
        x, v = F.col("_fit.boundaries"), F.col("_fit.values")
        at = F.col("_at")
        x0, x1, v0, v1 = F.get(x, at - 1), F.get(x, at), F.get(v, at - 1), F.get(v, at)
        between = F.when(given == x1, v1).otherwise(v0 + (v1 - v0) * (given - x0) / (x1 - x0))
        value = F.when(at == 0, v1).when(at == F.size(x), v0).otherwise(between)
        placed = df.withColumn("_fit", self.steps.select(F.struct("boundaries", "values")).scalar()).withColumn("_at", count_below(x, given))
        return placed.withColumn(into, F.when(given.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))).drop("_fit", "_at")


def lower_hull(points: Iterable[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """Vertices (weight, sum, score) of the greatest convex line below points that come by weight."""
    hull: list[tuple[float, float, float]] = []
    for point in points:
        while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (point[0] - hull[-1][0]) >= (point[1] - hull[-1][1]) * (hull[-1][0] - hull[-2][0]):
            hull.pop()
        hull.append(point)
    return hull


def _hull_of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hull: list[tuple[float, float, float]] = []
    for batch in batches:
        hull = lower_hull(sorted([*hull, *batch[["cum_n", "cum_pos", "score"]].itertuples(index=False, name=None)]))
    yield pd.DataFrame(hull, columns=["cum_n", "cum_pos", "score"])


def _steps_of_hull(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for hull in _hull_of_task(batches):
        corners = lower_hull([(0, 0, float("nan")), *hull.itertuples(index=False, name=None)])
        rows = [(a[0], b[2], (b[1] - a[1]) / (b[0] - a[0])) for a, b in zip(corners, corners[1:])]
        yield pd.DataFrame(rows, columns=["before", "last", "value"])


def isotonic_steps(df: DataFrame, p: str, y: str) -> DataFrame:
    """The monotone fit of ``y`` on ``p``: one row with the arrays ``boundaries`` and ``values``.

    The fit's values are the slopes of the greatest convex line below the points (rows, positives) added up by score.
    The hull of all points is the hull of the hulls of any parts, so each task reduces its points to the vertices of
    their hull, and one task joins those: with whole counts they are few, about the cube root of rows x positives
    for a task, however many scores there are.
    """
    groups = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("score")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce(F.col(y).cast("int"), F.lit(0))).alias("pos")
    )
    cum = cut_lineage(running_totals(groups, "score", ["n", "pos"], descending=False))
    hulls = cum.select("cum_n", "cum_pos", "score").mapInPandas(_hull_of_task, "cum_n long, cum_pos long, score double")
    steps = hulls.repartition(1).mapInPandas(_steps_of_hull, "before long, last double, value double")
    first = cum.select((F.col("cum_n") - F.col("n")).alias("before"), F.col("score").alias("first"))
    ends = steps.join(first, "before").select(F.explode(F.array(F.struct(F.col("first").alias("x"), "value"), F.struct(F.col("last").alias("x"), "value"))).alias("e"))
    packed = ends.agg(F.sort_array(F.collect_list("e")).alias("e"))
    return cut_lineage(packed.select(F.col("e.x").alias("boundaries"), F.col("e.value").alias("values")))


def _grouped(df: DataFrame, p: str, y: str) -> DataFrame:
    """Weighted (p, y) pairs: one row per distinct score and label, so the fit does not see raw rows."""
    return df.groupBy(F.col(p).cast("double").alias("p"), F.col(y).cast("double").alias("y")).agg(
        F.count("*").cast("double").alias("w")
    )


def fit_calibrator(df: DataFrame, p: str, y: str, method: str = "isotonic") -> Platt | Isotonic:
    if method == "platt":
        rows = _grouped(df, p, y)
        z = VectorAssembler(inputCols=["z"], outputCol="x").transform(rows.withColumn("z", logit("p")))
        model = LogisticRegression(
            featuresCol="x", labelCol="y", weightCol="w", regParam=0.0, maxIter=100, tol=1e-9, standardization=False
        ).fit(z)
        return Platt(float(model.coefficients[0]), float(model.intercept))
    if method != "isotonic":
        raise ValueError(f"unknown calibration method {method!r}")
    return Isotonic(isotonic_steps(df, p, y))


def judge(df: DataFrame, p: str, y: str, fit: Column, test: Column, method: str) -> DataFrame:
    """Fit on one period, return the other period with ``calibrated``."""
    model = fit_calibrator(df.filter(fit), p, y, method)
    return model.apply(df.filter(test), p)


def refitted(df: DataFrame, p: str, y: str, method: str = "isotonic") -> DataFrame:
    """All rows with ``calibrated`` by the calibrator that is kept in the end: the one fitted on the whole period."""
    return fit_calibrator(df, p, y, method).apply(df, p)
