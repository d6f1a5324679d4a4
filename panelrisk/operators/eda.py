"""Exploratory rollups over events, panel, measures and land cover."""
from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.functions.scalars import M2_PER_HA, safe_ratio
from panelrisk.operators.ranks import exact_quantiles, join_null_safe, running_totals


def rates_by(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exposure, events and area in ha of panel rows per key."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("exposure"),
        F.sum(F.col("y").cast("int")).alias("events"),
        (F.sum("size") / M2_PER_HA).alias("ha"),
    )


def exposure_by(entities: DataFrame, key: str) -> DataFrame:
    return entities.groupBy(key).agg(F.count("*").alias("entities"), F.sum("area_km2").alias("km2"))


def season_by(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key, F.dayofyear("day").alias("doy")).agg(
        F.count("*").alias("events"), (F.sum(F.coalesce("size", F.lit(0.0))) / M2_PER_HA).alias("ha")
    )


def event_totals(days: DataFrame) -> DataFrame:
    """Per entity: events, burnt ha, last event day."""
    return days.groupBy("entity").agg(
        F.sum("n").alias("events"), (F.sum("size") / M2_PER_HA).alias("ha"), F.max("day").alias("last_day")
    )


def entity_summary(entities: DataFrame, days: DataFrame) -> DataFrame:
    out = entities.join(event_totals(days), "entity", "left")
    return out.withColumn("events", F.coalesce("events", F.lit(0))).withColumn("ha", F.coalesce("ha", F.lit(0.0)))


def equal_width_bands(entities: DataFrame, days: DataFrame, x: str, low: float, high: float, n: int) -> DataFrame:
    """Entities, area and events per equal-width band; 0 below the range and n + 1 from its top on."""
    band = F.expr(f"width_bucket({x}, {float(low)}D, {float(high)}D, {int(n)})")
    rows = entities.filter(F.col(x).isNotNull()).withColumn("band", band)
    rows = rows.join(event_totals(days).select("entity", "events", "ha"), "entity", "left")
    return rows.groupBy("band").agg(
        F.count_distinct("entity").alias("entities"),
        F.sum("area_km2").alias("km2"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
        F.coalesce(F.sum("ha"), F.lit(0.0)).alias("ha"),
    ).withColumn("low", F.lit(float(low)) + (F.col("band") - 1) * F.lit((high - low) / n))


def signature(events: DataFrame, part: Column, name: str) -> DataFrame:
    """Counts per calendar part and their deviation in % from a flat distribution over the parts seen."""
    counts = events.filter(part.isNotNull()).groupBy(part.alias(name)).agg(F.count("*").alias("events"))
    mean = counts.agg(F.avg("events").alias("m")).scalar()
    return counts.withColumn("deviation_pct", F.lit(100.0) * (F.col("events") - mean) / mean)


def date_quality(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Largest weekday deviation, share exactly at midnight, and the first of the month against the other days."""
    week = signature(events, F.weekday(ts), "weekday").agg(F.max(F.abs("deviation_pct")).alias("v"))
    days = events.groupBy(F.dayofmonth(ts).alias("d")).agg(F.count("*").alias("n"))
    first = days.agg((F.max(F.when(F.col("d") == 1, F.col("n"))) / F.avg(F.when(F.col("d") > 1, F.col("n")))).alias("v"))
    midnight = ((F.hour(ts) == 0) & (F.minute(ts) == 0)).cast("double")
    out = events.agg(F.avg(midnight).alias("midnight_share"))
    out = out.withColumn("max_weekday_pct", week.scalar()).withColumn("first_day_ratio", first.scalar())
    fine = (F.col("max_weekday_pct") < 10) & (F.col("midnight_share") < 0.05) & (F.col("first_day_ratio") < 1.15)
    return out.withColumn("daily_grain_valid", fine)


def coverage(events: DataFrame, group: str, listed: Sequence) -> DataFrame:
    """Per year: groups seen, events, share of the listed groups, and the change in groups since the year before."""
    inside = F.col(group).isin(*listed).cast("double")
    per = events.groupBy(F.year("day").alias("year")).agg(
        F.count_distinct(group).alias("groups"), F.count("*").alias("events"), F.avg(inside).alias("listed_share")
    )
    # One row per year.
    w = Window.partitionBy(F.lit(1)).orderBy("year")
    return per.withColumn("groups_change", F.col("groups") - F.lag("groups").over(w))


def break_year(yearly: DataFrame, change: str = "groups_change") -> DataFrame:
    """The year of the largest rise; the earliest one when several tie."""
    return yearly.filter(F.col(change).isNotNull()).agg(
        F.max_by("year", F.struct(F.col(change), -F.col("year"))).alias("break_year")
    )


def duplicate_counts(df: DataFrame, keys: dict[str, Sequence[str]]) -> DataFrame:
    """Rows beyond the first of each key, for several candidate keys.

    Each key is counted by two partial aggregations, so a key repeated a million times is one row after the first.
    """
    parts = []
    for name, cols in keys.items():
        groups = df.groupBy(*cols).agg(F.count("*").alias("n"))
        parts.append(
            groups.agg(F.sum(F.col("n") - 1).alias("duplicates"), F.count_if(F.col("n") > 1).alias("groups")).select(
                F.lit(name).alias("key"), "duplicates", "groups"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def mark_duplicates(df: DataFrame, key: Sequence[str], name: str = "suspect") -> DataFrame:
    """Flag every member of a repeated key. The counts are aggregated first and joined back null-safely."""
    sizes = df.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1")
    sizes = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.lit(True).alias("_hit"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key])
    out = df.join(sizes, same, "left").withColumn(name, F.coalesce("_hit", F.lit(False)))
    return out.drop("_hit", *[f"_k_{k}" for k in key])


def overlap_audit(events: DataFrame, source: str, ts: str = "ts") -> DataFrame:
    """For each pair of consecutive exports: do their ranges touch, and how many keys lie in both at the border?"""
    files = events.groupBy(source).agg(F.min(F.to_date(ts)).alias("start"), F.max(F.to_date(ts)).alias("end"))
    # One row per file.
    w = Window.partitionBy(F.lit(1)).orderBy("start")
    borders = files.select(source, "end", F.lead("start").over(w).alias("next_start")).filter("next_start IS NOT NULL")
    at = events.select(F.to_date(ts).alias("end"), ts, F.col(source).alias("_s"))
    shared = at.groupBy("end", ts).agg(F.count_distinct("_s").alias("files"))
    found = shared.groupBy("end").agg(F.count_if(F.col("files") > 1).alias("shared"))
    out = borders.join(found, "end", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return out.select(source, "end", "next_start", (F.col("end") >= F.col("next_start")).alias("touching"), "shared")


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of NULL per column, all columns in one pass, as rows."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column", "missing")


def normalised_rates(summary: DataFrame, key: str, fuel_share: str) -> DataFrame:
    """Events per 1000 km2, per 1000 km2 of fuel, and the share of entities touched."""
    fuel = F.sum(F.col("area_km2") * F.coalesce(F.col(fuel_share), F.lit(0.0)))
    return summary.groupBy(key).agg(
        (F.sum("events") * 1000.0 / F.sum("area_km2")).alias("per_1000_km2"),
        (F.sum("events") * 1000.0 / F.nullif(fuel, F.lit(0.0))).alias("per_1000_km2_fuel"),
        F.avg((F.col("events") > 0).cast("double")).alias("touched_share"),
    )


def size_per_year(events: DataFrame) -> DataFrame:
    dated = events.select(F.year("day").alias("year"), "size")
    sizes = exact_quantiles(dated, "size", [0.5, 0.9], by=["year"])
    counted = join_null_safe(dated.groupBy("year").agg(F.count("*").alias("events")), sizes, ["year"], "left")
    return counted.select("year", F.get("quantiles", F.lit(0)).alias("median_size"), F.get("quantiles", F.lit(1)).alias("p90_size"), "events")


def log_histogram(df: DataFrame, x: str, per_decade: int = 4) -> DataFrame:
    """Counts in bins of equal width in log10; non-positive values are left out."""
    return (
        df.filter(F.col(x) > 0)
        .groupBy(F.floor(F.log10(x) * F.lit(per_decade)).cast("int").alias("bin"))
        .agg(F.count("*").alias("rows"))
    )


def hierarchy_change(areas: DataFrame, level: Column) -> DataFrame:
    """Area per top category in the first and last vintage of the table, and the change between them."""
    per = areas.groupBy(level.alias("top"), "vintage").agg(F.sum("area").alias("area"))
    return per.groupBy("top").agg(
        F.min_by("area", "vintage").alias("first_area"), F.max_by("area", "vintage").alias("last_area")
    ).withColumn("change", F.col("last_area") - F.col("first_area"))


def vintage_stability(areas: DataFrame, key: str) -> DataFrame:
    """Spread of the total area of a key across vintages: median and 99th percentile of max - min."""
    total = areas.groupBy(key, "vintage").agg(F.sum("area").alias("t"))
    span = total.groupBy(key).agg((F.max("t") - F.min("t")).alias("span"))
    found = exact_quantiles(span, "span", [0.5, 0.99])
    return found.select(F.col("quantiles")[0].alias("median_span"), F.col("quantiles")[1].alias("p99_span"))


def revision_diff(original: DataFrame, revised: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Share of keys whose value differs between the original and the revised table."""
    a = original.select(*keys, F.col(value).alias("_a"))
    b = revised.select(*keys, F.col(value).alias("_b"))
    both = a.join(b, list(keys))
    per = both.withColumn("_d", F.abs(F.col("_a") - F.col("_b")))
    return per.agg(
        F.avg((F.col("_d") > tolerance).cast("double")).alias("differing_share"), F.max("_d").alias("max_diff")
    )


def range_report(measures: DataFrame, columns: Sequence[str], documented: dict[str, tuple[float, float]]) -> DataFrame:
    """Min, max, mean per variable and year, and whether they stay inside the documented range."""
    year = F.year("day").alias("year")
    stats = measures.groupBy(year).agg(
        *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    )
    items = [
        F.struct(
            F.lit(c).alias("variable"),
            F.col(f"min_{c}").cast("double").alias("low"),
            F.col(f"max_{c}").cast("double").alias("high"),
            F.col(f"mean_{c}").alias("mean"),
            (
                (F.col(f"min_{c}") >= documented.get(c, (-math.inf, math.inf))[0])
                & (F.col(f"max_{c}") <= documented.get(c, (-math.inf, math.inf))[1])
            ).alias("in_range"),
        )
        for c in columns
    ]
    return stats.select("year", F.explode(F.array(*items)).alias("v")).select("year", "v.*")


def exceedance_days(measures: DataFrame, bounds: Sequence[float], x: str = "fwi") -> DataFrame:
    """Mean number of days per cell over each bound, per year."""
    per = measures.groupBy("cell", F.year("day").alias("year")).agg(
        *[F.count_if(F.col(x) > b).alias(f"d{i}") for i, b in enumerate(bounds)]
    )
    means = per.groupBy("year").agg(*[F.avg(f"d{i}").alias(f"d{i}") for i in range(len(bounds))])
    items = [F.struct(F.lit(float(b)).alias("bound"), F.col(f"d{i}").alias("days")) for i, b in enumerate(bounds)]
    return means.select("year", F.explode(F.array(*items)).alias("v")).select("year", "v.*")


def group_profile(df: DataFrame, group: str, columns: Sequence[str], sample_std: bool = True, top: int = 5) -> DataFrame:
    """Mean of each variable per group, its z-score across groups, and the ``top`` most distinctive ones.

    The z-scores are taken over the group means: one row per group and variable.
    """
    means = df.groupBy(group).agg(*[F.avg(c).alias(c) for c in columns])
    long = means.unpivot([group], list(columns), "variable", "mean")
    over = Window.partitionBy("variable")
    std = F.stddev_samp("mean").over(over) if sample_std else F.stddev_pop("mean").over(over)
    z = long.withColumn("z", (F.col("mean") - F.avg("mean").over(over)) / F.nullif(std, F.lit(0.0)))
    order = Window.partitionBy(group).orderBy(F.abs(F.coalesce("z", F.lit(0.0))).desc(), "variable")
    return z.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def importance_blocks(importances: DataFrame, blocks: DataFrame) -> DataFrame:
    """Importance per block of features and its share of the total."""
    named = importances.join(blocks, "feature", "left").withColumn("block", F.coalesce("block", F.lit("other")))
    per = named.groupBy("block").agg(F.sum("importance").alias("importance"))
    return per.withColumn("share", F.col("importance") / importances.agg(F.sum("importance").alias("t")).scalar())


def contribution_shift(contributions: DataFrame) -> DataFrame:
    """Mean |contribution| per feature on samples 'random' and 'top', and how many ranks a feature gains.

    ``contributions`` is long: (sample, feature, value). The ranking is over features, a short list.
    """
    per = contributions.groupBy("sample", "feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
    ranked = per.withColumn("place", F.rank().over(Window.partitionBy("sample").orderBy(F.desc("mean_abs"))))
    a = ranked.filter("sample = 'random'").select("feature", F.col("mean_abs").alias("random"), F.col("place").alias("_a"))
    b = ranked.filter("sample = 'top'").select("feature", F.col("mean_abs").alias("top"), F.col("place").alias("_b"))
    return a.join(b, "feature").select("feature", "random", "top", (F.col("_a") - F.col("_b")).alias("places_gained"))


def quantile_bin(df: DataFrame, x: str, bins: int, name: str) -> DataFrame:
    """Index of the quantile bin of ``x`` (exact edges, equal edges merged, last bin closed)."""
    edges = exact_quantiles(df, x, [i / bins for i in range(bins + 1)]).select(F.array_sort(F.array_distinct("quantiles")).alias("e"))
    last = F.size(F.filter("_e", lambda e: e <= F.col(x))) - 1
    index = F.least(F.greatest(last, F.lit(0)), F.greatest(F.size("_e") - 2, F.lit(0)))
    return df.withColumn("_e", edges.scalar()).withColumn(name, index).drop("_e")


def median_by_bin(df: DataFrame, x: str, value: str, bins: int = 24) -> DataFrame:
    binned = quantile_bin(df, x, bins, "bin")
    out = binned.groupBy("bin").agg(F.count("*").alias("rows"))
    for c, name in ((x, "x"), (value, "value")):
        middle = exact_quantiles(binned, c, [0.5], by=["bin"]).select("bin", F.col("quantiles")[0].alias(name))
        out = join_null_safe(out, middle, ["bin"], "left")
    return out.select("bin", "x", "value", "rows")


def median_grid(df: DataFrame, x: str, z: str, value: str, bins: int, least: int = 20) -> DataFrame:
    """Conditional medians on a 2-D quantile grid; cells under ``least`` rows are blank."""
    binned = quantile_bin(quantile_bin(df, x, bins, "bin_x"), z, bins, "bin_z")
    cell = ["bin_x", "bin_z"]
    middle = exact_quantiles(binned, value, [0.5], by=cell).select(*cell, F.col("quantiles")[0].alias("value"))
    out = join_null_safe(binned.groupBy(*cell).agg(F.count("*").alias("rows")), middle, cell, "left")
    return out.withColumn("value", F.when(F.col("rows") >= least, F.col("value")))


def seasonal_shares(season: DataFrame, key: str, windows: dict[str, tuple[int, int]], least: int) -> DataFrame:
    """Share of events in each day-of-year window, for groups with at least ``least`` events."""
    parts = [
        (F.sum(F.when(F.col("doy").between(a, b), F.col("events")).otherwise(0)) / F.sum("events")).alias(n)
        for n, (a, b) in windows.items()
    ]
    out = season.groupBy(key).agg(F.sum("events").alias("events"), *parts)
    return out.filter(F.col("events") >= least)


def top_k(df: DataFrame, measure: Column | str, key: str, k: int, largest: bool = True) -> DataFrame:
    m = F.col(measure) if isinstance(measure, str) else measure
    return df.orderBy(m.desc() if largest else m.asc(), F.col(key).asc()).limit(k)


def day_kpis(scored: DataFrame, score: str, key: str, danger: int = 5) -> DataFrame:
    """Mean, max, entities in the worst classes, size of the best decile, and the entity at the maximum."""
    best = F.max_by(key, F.struct(F.col(score), -F.col(key)))
    return scored.agg(
        F.avg(score).alias("mean_score"),
        F.max(score).alias("max_score"),
        F.count_if(F.col("danger_class") >= danger).alias("in_danger"),
        F.floor(F.count("*") / 10).alias("decile_size"),
        best.alias("top_entity"),
    )


def compare_days(a: DataFrame, b: DataFrame, key: str, score: str, measure: str, danger: int = 3) -> DataFrame:
    """The second of two days against the first, over the entities of both: means, entities in danger, entities whose
    measure rises, and the median ratio of the scores (ratios to a score of zero are left out)."""
    both = paired_days(a, b, key, score, measure)
    before, after = F.count_if(F.col("class_a") >= danger), F.count_if(F.col("class_b") >= danger)
    rise = F.col("change") > 0
    out = both.agg(
        F.avg("measure_b").alias("mean"),
        (F.avg("measure_b") - F.avg("measure_a")).alias("mean_change"),
        after.alias("in_danger"),
        (after - before).alias("in_danger_change"),
        F.count_if(rise).alias("rising"),
        F.avg(rise.cast("double")).alias("rising_share"),
    )
    ratio = exact_quantiles(both.withColumn("ratio", F.try_divide("score_b", "score_a")), "ratio", [0.5])
    return out.withColumn("median_ratio", ratio.select(F.get("quantiles", F.lit(0))).scalar())


def paired_days(a: DataFrame, b: DataFrame, key: str, score: str, measure: str) -> DataFrame:
    """(key, measure, score and danger class of both days, change of the measure) of the entities of both days."""
    sides = [
        d.select(key, F.col(measure).alias(f"measure_{n}"), F.col(score).alias(f"score_{n}"), F.col("danger_class").alias(f"class_{n}"))
        for n, d in (("a", a), ("b", b))
    ]
    return sides[0].join(sides[1], key).withColumn("change", F.col("measure_b") - F.col("measure_a"))


def decade_profile(measures: DataFrame, x: str = "fwi") -> DataFrame:
    decade = (F.floor(F.year("day") / 10) * 10).cast("int").alias("decade")
    return measures.groupBy(decade, F.dayofyear("day").alias("doy")).agg(F.avg(x).alias("mean"))


def fold_summary(results: DataFrame, group: str, value: str) -> DataFrame:
    return results.groupBy(group).agg(F.avg(value).alias("mean"), F.min(value).alias("worst"), F.count("*").alias("folds"))


def category_composition(areas: DataFrame, zone: str, categories: Sequence[str]) -> DataFrame:
    """Share of each category in a zone's area."""
    total = F.sum("area")
    parts = [
        safe_ratio(F.sum(F.when(F.col("category") == c, F.col("area"))), total).alias(f"share_{c.lower()}")
        for c in categories
    ]
    return areas.groupBy(zone).agg(total.alias("area_total"), *parts)


def category_fill(events: DataFrame, column: str) -> DataFrame:
    """Share of rows with a value and the number of distinct values, per year."""
    return events.groupBy(F.year("day").alias("year")).agg(
        F.avg(F.col(column).isNotNull().cast("double")).alias("filled"), F.count_distinct(column).alias("values")
    )


def category_counts(events: DataFrame, column: str) -> DataFrame:
    """Rows of each value and year, rows without a value included, and their share of the year."""
    counts = events.groupBy(F.year("day").alias("year"), F.col(column).alias("category")).agg(F.count("*").alias("events"))
    total = F.sum("events").over(Window.partitionBy("year"))
    return counts.withColumn("share", F.col("events") / total)


def summer_means(measures: DataFrame, months: tuple[int, int] = (6, 9), x: str = "fwi") -> DataFrame:
    """Summer mean per cell and decade: months first averaged within the year, then over years."""
    year = F.year("day")
    yearly = (
        measures.filter(F.month("day").between(*months))
        .groupBy("cell", year.alias("year"))
        .agg(F.avg(x).alias("m"))
    )
    decade = (F.floor(F.col("year") / 10) * 10).cast("int")
    whole = yearly.groupBy("cell").agg(F.avg("m").alias("summer_mean")).withColumn("decade", F.lit(0))
    parts = yearly.groupBy("cell", decade.alias("decade")).agg(F.avg("m").alias("summer_mean"))
    return parts.unionByName(whole)


def spatial_mean(measures: DataFrame, used: DataFrame, x: str = "fwi") -> DataFrame:
    """Daily mean over all cells and over the cells that hold an entity."""
    flagged = measures.join(used.select("cell").distinct().withColumn("_used", F.lit(True)), "cell", "left")
    return flagged.groupBy("day").agg(
        F.avg(x).alias("all_cells"), F.avg(F.when(F.col("_used"), F.col(x))).alias("used_cells")
    )


def distribution(df: DataFrame, x: str) -> DataFrame:
    out = df.agg(F.max(x).alias("max"), F.avg((F.col(x) == 0).cast("double")).alias("zero_share"))
    out = out.withColumn("q", exact_quantiles(df, x, (0.5, 0.9, 0.95, 0.99)).scalar())
    return out.select(
        *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))], "max", "zero_share"
    )


def worst_class_share(classes: DataFrame, worst: int = 5) -> DataFrame:
    """Share of exposure and of events in the worst classes, and the rate gradient from the first to the last class."""
    hit = F.col("danger_class") >= worst
    rate = F.col("events") / F.col("exposure")
    return classes.filter(F.col("danger_class").isNotNull()).agg(
        (F.sum(F.when(hit, F.col("exposure")).otherwise(0)) / F.sum("exposure")).alias("exposure_share"),
        (F.sum(F.when(hit, F.col("events")).otherwise(0)) / F.sum("events")).alias("event_share"),
        (F.max_by(rate, "danger_class") / F.min_by(rate, "danger_class")).alias("gradient"),
    )


def reverse_cumulative_share(classes: DataFrame, order: str, values: Sequence[str]) -> DataFrame:
    """Share of each total that lies at or above a class."""
    cum = running_totals(classes, order, list(values), ranges=2)
    whole = classes.agg(F.struct(*[F.sum(v).alias(v) for v in values]).alias("w"))
    out = cum.withColumn("_w", whole.scalar())
    return out.select(order, *[(F.col(f"cum_{v}") / F.col(f"_w.{v}")).alias(f"{v}_at_or_above") for v in values])


def running_in_year(daily: DataFrame, value: str) -> DataFrame:
    """Running total within the year along the day of year: at most 366 rows per partition."""
    w = Window.partitionBy("year").orderBy("doy").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("running", F.sum(value).over(w))


def centred_mean(dense: DataFrame, order: str, value: str, half: int, by: Sequence[str] = (), name: str = "smooth") -> DataFrame:
    """Centred rolling mean on a dense axis such as the day of year (a bounded partition)."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(order).rowsBetween(-half, half)
    return dense.withColumn(name, F.avg(value).over(w))


def local_excess(dense: DataFrame, order: str, value: str, half: int = 10) -> DataFrame:
    """Ratio of a day to the mean of its neighbourhood, the day itself left out."""
    w = Window.partitionBy(F.lit(1)).orderBy(order).rowsBetween(-half, half)
    around = (F.sum(value).over(w) - F.col(value)) / F.nullif(F.count(value).over(w) - 1, F.lit(0))
    return dense.withColumn("around", around).withColumn("excess", F.col(value) / F.nullif(F.col("around"), F.lit(0.0)))


def display_weights(scored: DataFrame) -> DataFrame:
    """Map weights: score over its maximum, score per km2 over its 99th percentile, index over 50."""
    per_area = F.col("score") / F.greatest(F.col("area_km2"), F.lit(0.5))
    high = exact_quantiles(scored.select(per_area.alias("d")), "d", [0.99]).select(F.col("quantiles")[0])
    top = F.struct(scored.agg(F.max("score")).scalar().alias("m"), high.scalar().alias("q"))
    out = scored.withColumn("_t", top)
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return out.withColumns(
        {
            "w_raw": F.col("score") / F.col("_t.m"),
            "w_area": unit(per_area / F.col("_t.q")),
            "w_index": unit(F.col("fwi") / 50),
        }
    ).drop("_t")
