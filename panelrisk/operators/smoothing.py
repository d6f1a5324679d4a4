"""Hierarchical smoothing of event rates, with the row's own year left out at constant exposure."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.functions.scalars import checked
from panelrisk.operators.ranks import column_quantiles

# Pseudo-days pulling a cluster to the overall rate and an entity to its cluster.
K0_CLUSTER = 20000
K1_ENTITY = 2000
# Pseudo-days of the single-level smoothing used by the baselines.
K_SINGLE = 500
FALLBACK_CLUSTER = -1


def with_fallback_cluster(counts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Entities with exposure but without a profile form the explicit group -1."""
    known = clusters.select("entity", "cluster")
    missing = counts.select("entity").distinct().join(known, "entity", "left_anti")
    return known.unionByName(missing.select("entity", F.lit(FALLBACK_CLUSTER).alias("cluster")))


def smooth_rates(
    counts: DataFrame, clusters: DataFrame, k0: float = K0_CLUSTER, k1: float = K1_ENTITY, leave_out: bool = True
) -> DataFrame:
    """Rates per (entity, excluded year); excluded year 0 uses every year.

    ``counts`` is (entity, year, days, events). Leaving a year out rescales the remaining counts to
    the full exposure, so the denominators are the same for every excluded year.
    """
    rows = counts.join(clusters.select("entity", "cluster"), "entity")
    base = rows.agg((F.sum("events") / F.sum("days")).alias("r"))
    years = rows.agg(F.sort_array(F.collect_set("year")).alias("y"))

    def totals(keys: list[str]) -> DataFrame:
        whole = rows.groupBy(*keys).agg(F.sum("days").alias("days"), F.sum("events").alias("events"))
        if not leave_out:
            return whole.withColumn("excluded_year", F.lit(0)).withColumn("kept", F.col("events").cast("double"))
        yearly = rows.groupBy(*keys, F.col("year").alias("excluded_year")).agg(
            F.sum("days").alias("year_days"), F.sum("events").alias("year_events")
        )
        each = whole.withColumn("_years", F.array_union(F.array(F.lit(0)), years.scalar()))
        each = each.select(*keys, "days", "events", F.explode("_years").alias("excluded_year"))
        each = each.join(yearly, [*keys, "excluded_year"], "left").na.fill(0, ["year_days", "year_events"])
        scale = F.col("days") / F.nullif(F.col("days") - F.col("year_days"), F.lit(0))
        return each.withColumn("kept", (F.col("events") - F.col("year_events")) * scale)

    by_cluster = totals(["cluster"]).select(
        "cluster",
        "excluded_year",
        ((F.col("kept") + F.lit(k0) * base.scalar()) / (F.col("days") + F.lit(k0))).alias("cluster_rate"),
    )
    by_entity = totals(["cluster", "entity"])
    entity_rate = (F.col("kept") + F.lit(k1) * F.col("cluster_rate")) / (F.col("days") + F.lit(k1))
    return (
        by_entity.join(by_cluster, ["cluster", "excluded_year"])
        .select("entity", "excluded_year", "cluster", "cluster_rate", entity_rate.alias("entity_rate"))
        .withColumn("rate_ratio", F.col("entity_rate") / F.col("cluster_rate"))
    )


def apply_rates(matrix: DataFrame, rates: DataFrame, exclude_own_year: bool = True) -> DataFrame:
    """Train rows read the rates without their own year, every other row the full ones.

    A row without a rate stops the job: imputing it would hide a missing entity. The rates of an entity are one row,
    which the rows of the matrix meet by hash, so that a matrix dealt by entity is neither moved nor sorted. Where no own
    year is excluded it is the full rate alone.
    """
    values = [c for c in rates.columns if c not in ("entity", "excluded_year")]
    if exclude_own_year:
        packed = rates.groupBy("entity").agg(F.collect_list(F.struct("excluded_year", *values)).alias("_rates"))
        own = F.when(F.col("split") == "train", F.col("year")).otherwise(F.lit(0))
        mine = F.filter("_rates", lambda r: r["excluded_year"] == F.col("_own"))
        joined = matrix.withColumn("_own", own).join(packed.hint("shuffle_hash"), "entity", "left").withColumn("_rate", F.explode_outer(mine))
        found = [F.col(f"_rate.{c}").alias(c) for c in values]
    else:
        full = rates.filter(F.col("excluded_year") == 0).select("entity", *values)
        joined, found = matrix.join(full.hint("shuffle_hash"), "entity", "left"), values
    joined = joined.select("entity", *[c for c in matrix.columns if c != "entity"], *found)
    orphan = F.concat(F.lit("no smoothed rate for entity "), F.col("entity").cast("string"))
    return checked(joined, F.col("entity_rate").isNull(), orphan)


def smooth_rates_without(
    counts: DataFrame, clusters: DataFrame, excluded: DataFrame, k0: float = K0_CLUSTER, k1: float = K1_ENTITY
) -> DataFrame:
    """Smoothing blind to the ``excluded`` entities, which then inherit the rate of their cluster."""
    kept = counts.join(excluded.select("entity"), "entity", "left_anti")
    rates = smooth_rates(kept, clusters, k0, k1, leave_out=False)
    rows = kept.join(clusters.select("entity", "cluster"), "entity")
    base = rows.agg((F.sum("events") / F.sum("days")).alias("r"))
    cluster_rate = rows.groupBy("cluster").agg(
        ((F.sum("events") + F.lit(k0) * base.scalar()) / (F.sum("days") + F.lit(k0))).alias("cluster_rate")
    )
    out = clusters.join(excluded.select("entity"), "entity", "left_semi").join(cluster_rate, "cluster", "left")
    prior = out.select(
        "entity",
        F.lit(0).alias("excluded_year"),
        "cluster",
        "cluster_rate",
        F.col("cluster_rate").alias("entity_rate"),
        (F.col("cluster_rate") / F.col("cluster_rate")).alias("rate_ratio"),
    )
    return rates.unionByName(prior)


def single_level(events, days, base, k: float = K_SINGLE):
    """Column expression pulling a raw rate to ``base`` with ``k`` borrowed days."""
    return (F.col(events) + F.lit(float(k)) * base) / (F.col(days) + F.lit(float(k)))


def silent_report(counts: DataFrame, rates: DataFrame) -> DataFrame:
    """Entities that never had an event: their share and the spread of their smoothed rate."""
    totals = counts.groupBy("entity").agg(F.sum("events").alias("events"))
    full = rates.filter(F.col("excluded_year") == 0).select("entity", "entity_rate")
    quiet = F.when(F.col("events") == 0, F.col("entity_rate"))
    rated = totals.join(full, "entity", "left").withColumn("_quiet", quiet)
    median = column_quantiles(rated, ["_quiet"], 0.5).select("_quiet")
    return rated.agg(
        F.avg((F.col("events") == 0).cast("double")).alias("silent_share"),
        F.min("_quiet").alias("min_rate"),
        F.max("_quiet").alias("max_rate"),
    ).withColumn("median_rate", median.scalar())
