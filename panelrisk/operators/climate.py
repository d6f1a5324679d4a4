"""Climatology, period statistics, level factors, scenario ratios and shifted profiles."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.functions.scalars import HIGH_DANGER, VERY_HIGH_DANGER, checked, clip, interpolate, period_label
from panelrisk.operators.geo import nearest_site


def climatology(measures: DataFrame, columns: Sequence[str], window: int = 15, lagged: Sequence[str] = ("fwi", "ffmc")) -> DataFrame:
    """Mean per (cell, day of year), smoothed over a centred circular window, with the circular day before.

    December precedes January: the series of a cell (at most 366 rows) is repeated before and after itself.
    """
    mean = measures.groupBy("cell", F.dayofyear("day").alias("doy")).agg(*[F.avg(c).alias(c) for c in columns])
    half = window // 2
    three = mean.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_turn"))
    around = Window.partitionBy("cell").orderBy("_turn", "doy").rowsBetween(-half, half)
    smooth = three.withColumns({c: F.avg(c).over(around) for c in columns}).filter("_turn = 0").drop("_turn")
    order = Window.partitionBy("cell").orderBy("doy")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = {f"{c}_d1": F.coalesce(F.lag(c).over(order), F.last(c).over(whole)) for c in lagged if c in columns}
    return smooth.withColumns(before)


def cell_climate(measures: DataFrame, start: str, end: str, x: str = "fwi") -> DataFrame:
    """Mean, exact 90th percentile and yearly days over the danger bound, per cell over a period."""
    years = int(end[:4]) - int(start[:4]) + 1
    rows = measures.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.groupBy("cell").agg(
        F.avg(x).alias("fwi_mean"),
        F.percentile(x, 0.9).alias("fwi_p90"),
        (F.count_if(F.col(x) > HIGH_DANGER) / F.lit(float(years))).alias("days_high"),
    )


def period_stats(measures: DataFrame, periods: Sequence[tuple[int, int]], x: str = "fwi") -> DataFrame:
    """Mean, p90 and days per year over two bounds, per cell and named period."""
    named = measures.withColumn("period", period_label(F.year("day"), periods)).filter("period IS NOT NULL")
    years = F.count_distinct(F.year("day"))
    return named.groupBy("cell", "period").agg(
        F.avg(x).alias("mean"),
        F.percentile(x, 0.9).alias("p90"),
        (F.count_if(F.col(x) > HIGH_DANGER) / years).alias("days_high"),
        (F.count_if(F.col(x) > VERY_HIGH_DANGER) / years).alias("days_very_high"),
    )


def annual_series(measures: DataFrame, days: DataFrame, x: str = "fwi") -> DataFrame:
    """Four yearly series stacked: mean, June-September mean, days over the bound per cell, event-days."""
    year = F.year("day").alias("x")
    per = measures.groupBy(year).agg(
        F.avg(x).alias("mean of the year"),
        F.avg(F.when(F.month("day").between(6, 9), F.col(x))).alias("mean June-September"),
        (F.count_if(F.col(x) > HIGH_DANGER) / F.count_distinct("cell")).alias("days over the bound"),
    )
    long = per.unpivot(["x"], per.columns[1:], "series", "y").filter("y IS NOT NULL")
    events = days.groupBy(F.year("day").alias("x")).agg(F.count("*").cast("double").alias("y"))
    return long.unionByName(events.withColumn("series", F.lit("event days")))


def observed_factors(measures: DataFrame, start: str, end: str, x: str = "fwi") -> DataFrame:
    """Level of each year relative to the reference period, per cell (1 when the reference is not positive)."""
    yearly = measures.groupBy("cell", F.year("day").alias("year")).agg(F.avg(x).alias("m"))
    ref = measures.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    ref = ref.groupBy("cell").agg(F.avg(x).alias("r"))
    k = F.when(F.col("r") > 0, F.col("m") / F.col("r")).otherwise(F.lit(1.0))
    return yearly.join(ref, "cell").select("cell", "year", k.alias("k"))


def recent_level(factors: DataFrame, first: int, last: int) -> DataFrame:
    """Mean factor of the recent years and its p10/p90 spread relative to the mean, clipped."""
    near = factors.filter(F.col("year").between(first, last)).groupBy("cell").agg(
        F.avg("k").alias("k_now"), F.percentile("k", 0.1).alias("p10"), F.percentile("k", 0.9).alias("p90")
    )
    return near.select(
        "cell",
        "k_now",
        clip(F.col("p10") / F.col("k_now"), 0.3, 1.0).alias("r_low"),
        clip(F.col("p90") / F.col("k_now"), 1.0, 3.0).alias("r_high"),
    )


def mean_maps(yearly: DataFrame) -> DataFrame:
    """Mean over the years of each (scenario, horizon, site); NaN values are ignored."""
    return (
        yearly.filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("scenario", "horizon", "site")
        .agg(F.avg("value").alias("value"))
    )


def delta_ratios(cells: DataFrame, maps: DataFrame, sites: DataFrame, historical: str = "historical") -> DataFrame:
    """Future over historical value per (cell, scenario, horizon) at the nearest site with a positive history.

    A ratio that is not finite stops the job.
    """
    past = maps.filter((F.col("scenario") == historical) & (F.col("value") > 0))
    past = past.select("site", F.col("value").alias("past"))
    valid = sites.join(past, "site")
    near = nearest_site(cells, valid.select("site", "site_lat", "site_lon")).join(past, "site")
    future = maps.filter(F.col("scenario") != historical).select("site", "scenario", "horizon", "value")
    k = F.col("value") / F.col("past")
    bad = k.isNull() | F.isnan(k) | (F.abs(k) == float("inf"))
    ratios = checked(near.join(future, "site"), bad, "a climate ratio is not finite")
    return ratios.select("cell", "scenario", "horizon", k.alias("k"), "dist_deg")


def days_over(measures: DataFrame, ratios: DataFrame, years: float, threshold: float = HIGH_DANGER, x: str = "fwi") -> DataFrame:
    """Days per year over the threshold once every value is multiplied by k, i.e. over threshold / k."""
    rows = measures.select("cell", x).join(ratios, "cell")
    shifted = F.lit(threshold) / F.greatest(F.col("k"), F.lit(1e-6))
    return rows.groupBy("cell", "scenario", "horizon").agg(
        (F.count_if(F.col(x) > shifted) / F.lit(float(years))).alias("days_over")
    )


def mean_ratio_forms(profile: DataFrame, x: str, k: str) -> DataFrame:
    """Ratio of the means and mean of the ratios; small denominators make them differ."""
    return profile.agg(
        (F.avg(F.col(x) * F.col(k)) / F.avg(x)).alias("ratio_of_means"), F.avg(k).alias("mean_of_ratios")
    )


def level_factors(
    observed: DataFrame,
    ratios: DataFrame,
    anchors: Sequence[int],
    scenarios: Sequence[str],
    recent: tuple[int, int],
    first: int,
    last: int,
) -> DataFrame:
    """Yearly level factor per cell and scenario, measured in the past and projected afterwards.

    The past is repeated for every scenario. The future starts from the recent mean level and follows
    a piecewise-linear path through 1 at ``first - 1`` and the ratio of each anchor year; the band is
    the recent p10/p90 spread.
    """
    names = F.explode(F.array(*[F.lit(s) for s in scenarios])).alias("scenario")
    none = F.lit(None).cast("double")
    past = observed.select("cell", "year", names, "k", none.alias("k_low"), none.alias("k_high"))
    wide = ratios.groupBy("cell", "scenario").pivot("horizon", list(anchors)).agg(F.first("k"))
    now = recent_level(observed, *recent)
    base = wide.join(now, "cell", "left").na.fill(1.0, ["k_now", "r_low", "r_high"])
    years = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year")
    path = interpolate("year", [(first - 1, F.lit(1.0)), *[(a, F.col(f"`{a}`")) for a in anchors]])
    future = base.select("*", years).withColumn("k", F.col("k_now") * path)
    future = future.select(
        "cell", "year", "scenario", "k", (F.col("k") * F.col("r_low")).alias("k_low"), (F.col("k") * F.col("r_high")).alias("k_high")
    )
    return past.unionByName(future)


def risk_transfer(assigned: DataFrame, cluster_rates: DataFrame) -> DataFrame:
    """Risk of each entity's present and shifted cluster, and the gain between them."""
    now = cluster_rates.select(F.col("cluster"), F.col("cluster_rate").alias("risk_now"))
    then = cluster_rates.select(F.col("cluster").alias("cluster_future"), F.col("cluster_rate").alias("risk_future"))
    both = assigned.join(now, "cluster").join(then, "cluster_future")
    return both.withColumn("gain", F.col("risk_future") / F.col("risk_now"))


def transfer_summary(transfer: DataFrame) -> DataFrame:
    moved = F.col("cluster") != F.col("cluster_future")
    return transfer.groupBy("scenario").agg(
        F.count_if(moved).alias("moving"),
        F.avg(moved.cast("double")).alias("moving_share"),
        F.avg("risk_now").alias("mean_now"),
        F.avg("risk_future").alias("mean_future"),
        F.avg((F.col("risk_future") > F.col("risk_now")).cast("double")).alias("rising_share"),
    )


def largest_shifts(transfer: DataFrame, key: str, k: int) -> DataFrame:
    """The k entities that change their cluster with the largest gain in risk; equal gains by key."""
    moved = transfer.filter(F.col("cluster") != F.col("cluster_future"))
    # Rates are sums in any order: gains equal but for rounding are one gain.
    return moved.orderBy(F.round("gain", 9).desc(), F.col(key)).limit(k)
