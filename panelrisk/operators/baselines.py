"""Four reference predictors learnt on train and scored on validation, all from grouped counts."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.functions.scalars import clip, threshold_class
from panelrisk.operators.metrics import report
from panelrisk.operators.panel import day_arrays, dense_panel, exposure
from panelrisk.operators.smoothing import K_SINGLE, single_level
from panelrisk.session import cut_lineage


def entity_history(panel: DataFrame) -> DataFrame:
    """(entity, train_n, train_pos, n, pos): train and validation counts in one pass."""
    y = F.col("y").cast("int")
    train, val = F.col("split") == "train", F.col("split") == "val"
    return panel.groupBy("entity").agg(
        F.count_if(train).alias("train_n"),
        F.coalesce(F.sum(F.when(train, y)), F.lit(0)).alias("train_pos"),
        F.count_if(val).alias("n"),
        F.coalesce(F.sum(F.when(val, y)), F.lit(0)).alias("pos"),
    )


def class_history(classed: DataFrame) -> DataFrame:
    """The same four counts per danger class, plus the rate learnt on train."""
    y = F.col("y")
    train, val = F.col("split") == "train", F.col("split") == "val"
    out = classed.groupBy("danger_class").agg(
        F.count_if(train).alias("train_n"),
        F.count_if(train & y).alias("train_pos"),
        F.count_if(val).alias("n"),
        F.count_if(val & y).alias("pos"),
    )
    return out.withColumn("class_rate", F.col("train_pos") / F.nullif(F.col("train_n"), F.lit(0)))


def sparse_history(days: DataFrame, entities: DataFrame, train: tuple[str, str], val: tuple[str, str]) -> DataFrame:
    """The counts of :func:`entity_history` from event-days and period lengths, without the dense panel."""

    def side(period: tuple[str, str], n: str, pos: str) -> DataFrame:
        counts = exposure(days, entities, *period)
        return counts.groupBy("entity").agg(F.sum("days").alias(n), F.sum("events").alias(pos))

    return side(train, "train_n", "train_pos").join(side(val, "n", "pos"), "entity")


def classed_panel(
    entities: DataFrame, days: DataFrame, measures: DataFrame, start: str, end: str, keep: Sequence[str] = ()
) -> DataFrame:
    """The dense panel with the danger class of the entity's cell; days without a measure are dropped."""
    arrays = day_arrays(measures, {"danger_class": threshold_class("fwi").cast("tinyint")}, start, end)
    return dense_panel(entities, days, start, end, keep, arrays).filter(F.col("danger_class").isNotNull())


def baselines(history: DataFrame, classed: DataFrame, k: float = K_SINGLE) -> DataFrame:
    """Constant, entity history, danger class, and their product clipped to [0, 1].

    ``history`` is (entity, train_n, train_pos, n, pos), ``classed`` the classed panel with its split.
    The dense rows are read once, collapsed to (entity, class, split).
    """
    base = history.agg((F.sum("train_pos") / F.sum("train_n")).alias("b"))
    constant = history.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).withColumn("score", base.scalar())
    spatial = history.filter((F.col("train_n") > 0) & (F.col("n") > 0)).withColumn(
        "score", single_level("train_pos", "train_n", base.scalar(), k)
    )
    y = F.col("y").cast("int")
    counted = classed.filter(F.col("split") != "test").groupBy("entity", "danger_class", "split")
    # Written once where the cluster names a checkpoint folder: several branches below read it.
    cells = cut_lineage(counted.agg(F.count("*").alias("n"), F.sum(y).alias("pos")))
    train, val = F.col("split") == "train", F.col("split") == "val"
    per_class = cells.groupBy("danger_class").agg(
        (F.sum(F.when(train, F.col("pos"))) / F.sum(F.when(train, F.col("n")))).alias("class_rate"),
        F.sum(F.when(val, F.col("n"))).alias("n"),
        F.sum(F.when(val, F.col("pos"))).alias("pos"),
    )
    weather = per_class.withColumn("score", F.col("class_rate"))

    crossed = cells.filter(val).join(history.select("entity", "train_n", "train_pos"), "entity")
    crossed = crossed.groupBy("train_pos", "train_n", "danger_class").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    crossed = crossed.join(per_class.select("danger_class", "class_rate"), "danger_class")
    product = single_level("train_pos", "train_n", base.scalar(), k) * F.col("class_rate") / base.scalar()
    product = crossed.withColumn("score", product).withColumn("score", clip("score", 0.0, 1.0))

    named = (("0 constant", constant), ("1 history", spatial), ("2 class", weather), ("3 product", product))
    parts = [d.select(F.lit(name).alias("predictor"), "score", "n", "pos") for name, d in named]
    groups = reduce(DataFrame.unionByName, parts).filter(F.col("n") > 0)
    merged = groups.groupBy("predictor", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    # One rate for all: the share of positives of the whole validation period.
    rate = history.agg((F.sum("pos") / F.sum("n")).alias("r"))
    scored = report(merged, by=["predictor"]).drop("base_rate", "lift")
    return scored.withColumn("lift", F.col("average_precision") / rate.scalar())
