"""Leak-safe features: event history, day-before and lagged measures, as-of vintages, sequences."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.functions.calendar import date_features
from panelrisk.functions.scalars import NO_EVENT_DAYS, SIZE_HORIZON, checked, count_below, log1p0, threshold_class
from panelrisk.operators.panel import history_names
from panelrisk.session import spread

# History horizons in days.
HORIZONS = (7, 30, 90, 365)


def _history_columns(lag: Column, horizons: Sequence[int]) -> list[Column]:
    counts = [F.coalesce(F.sum(F.when(lag <= h, F.col("n"))), F.lit(0)).alias(f"events_{h}d") for h in horizons]
    area = F.coalesce(F.sum(F.when(lag <= SIZE_HORIZON, F.col("size"))), F.lit(0.0)).alias(f"size_{SIZE_HORIZON}d")
    return [*counts, area, F.min(lag).alias("days_since_event")]


def event_lags(days: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Sparse history table: a row for each of the ``max(horizons)`` days after an event-day, which never sees its own.

    The event-days of an entity are packed into one row. Its history only changes on the day after an event-day and
    where one leaves a horizon, so it is found once for each stretch between two changes, and the stretch is filled up
    with days: the table is neither shuffled nor aggregated, and a hot entity has as many rows as the calendar has
    days. Event-days without a day count on each of the (unknown) days after them.
    """
    dated = days.filter(F.col("day").isNotNull()).groupBy("entity", "day").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    packed = dated.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("day", "n", "size"))).alias("_events"))
    steps = sorted({0, SIZE_HORIZON, *horizons})
    changes = F.flatten(F.transform("_events", lambda e: F.array(*[F.date_add(e["day"], s + 1) for s in steps])))
    rows = spread(packed, "entity").withColumn("_changes", F.array_sort(F.array_distinct(changes)))
    stretches = F.transform("_changes", lambda c, k: F.struct(c.alias("first"), F.date_sub(F.get("_changes", k + 1), 1).alias("last")))
    cut = rows.select("entity", F.col("_events").alias("_e"), F.col("_events.day").alias("_day"), F.explode(stretches).alias("_s"))
    first = F.col("_s.first")
    below = [count_below(F.col("_day"), first), *[count_below(F.col("_day"), F.date_sub(first, h)) for h in (*horizons, SIZE_HORIZON)]]
    names = ["_upto", *[f"_from{i}" for i in range(len(horizons))], "_from_size"]
    placed = cut.select("*", *[c.alias(n) for n, c in zip(names, below)])

    def total(start: str, value: str, zero: Column) -> Column:
        return F.aggregate(F.slice("_e", F.col(start) + 1, F.col("_upto") - F.col(start)), zero, lambda t, e: t + e[value])

    zero = F.lit(0).cast("bigint")
    values = [total(f"_from{i}", "n", zero).alias(f"events_{h}d") for i, h in enumerate(horizons)]
    values.append(total("_from_size", "size", F.lit(0.0)).alias(f"size_{SIZE_HORIZON}d"))
    past = placed.select("entity", "_s", F.get("_day", F.col("_upto") - 1).alias("_last"), *values)
    near = past.filter(F.datediff("_s.first", "_last") <= max(horizons))
    table = near.select("*", F.explode(F.sequence("_s.first", "_s.last")).alias("day")).select(
        "entity", "day", *[c for c in history_names(horizons)[:-1]], F.datediff("day", "_last").alias("days_since_event")
    )
    lags = F.explode(F.sequence(F.lit(1), F.lit(max(horizons)))).alias("lag")
    undated = days.filter(F.col("day").isNull()).select("entity", "day", "n", "size", lags)
    return table.unionByName(undated.groupBy("entity", "day").agg(*_history_columns(F.col("lag"), horizons)))


def history_by_range(days: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """The sliding form of :func:`event_lags`, on the event-days themselves; kept as a cross-check."""
    epoch = F.datediff("day", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("entity").orderBy("_t")
    out = days.withColumn("_t", epoch)
    return out.withColumns(
        {f"events_{h}d": F.coalesce(F.sum("n").over(w.rangeBetween(-h, -1)), F.lit(0)) for h in horizons}
    ).drop("_t")


def history_at(days: DataFrame, entities: DataFrame, day: str, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """History of every entity at one day, straight from the sparse event-days."""
    at = F.lit(day).cast("date")
    lag = F.datediff(at, F.col("day"))
    past = days.filter(F.col("day").between(F.date_sub(at, max(horizons)), F.date_sub(at, 1)))
    table = past.groupBy("entity").agg(*_history_columns(lag, horizons))
    return fill_history(entities.select("entity").join(table, "entity", "left"), horizons)


def fill_history(df: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Defaults for entities without history: 0 for counts and size, the sentinel for the delay."""
    zero = {f"events_{h}d": F.coalesce(f"events_{h}d", F.lit(0)) for h in horizons}
    return df.withColumns(
        {
            **zero,
            f"size_{SIZE_HORIZON}d": F.coalesce(f"size_{SIZE_HORIZON}d", F.lit(0.0)),
            "days_since_event": F.coalesce("days_since_event", F.lit(NO_EVENT_DAYS)),
        }
    )


def day_before(measures: DataFrame, cols: Sequence[str], key: str = "cell", day: str = "day") -> DataFrame:
    """Add ``<col>_d1``: the value exactly one calendar day earlier, NULL when that day is missing."""
    w = Window.partitionBy(key).orderBy(day)
    adjacent = F.lag(day).over(w) == F.date_sub(F.col(day), 1)
    return measures.withColumns({f"{c}_d1": F.when(adjacent, F.lag(c).over(w)) for c in cols})


def measure_lags(measures: DataFrame, x: str = "fwi", key: str = "cell", day: str = "day") -> DataFrame:
    """Row lags, strict-past rolling means and maxima, and a one-week slope of one measure.

    Frames count the series' own rows and end at -1. A cell has one row per calendar day, so a
    partition is bounded by the length of the calendar.
    """
    w = Window.partitionBy(key).orderBy(day)
    past = lambda n: w.rowsBetween(-n, -1)
    return measures.select(
        key,
        day,
        *[F.lag(x, d).over(w).alias(f"{x}_lag{d}") for d in (2, 3, 7, 14)],
        *[F.avg(x).over(past(n)).alias(f"{x}_mean{n}") for n in (7, 14, 30)],
        *[F.max(x).over(past(n)).alias(f"{x}_max{n}") for n in (7, 30)],
        (F.lag(x, 1).over(w) - F.lag(x, 8).over(w)).alias(f"{x}_slope7"),
    )


def past_sequences(measures: DataFrame, n: int = 30, x: str = "fwi", key: str = "cell", day: str = "day") -> DataFrame:
    """The ``n`` calendar days before each day as an array ordered by date (shorter where days are missing)."""
    epoch = F.datediff(day, F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(-n, -1)
    out = measures.withColumn("_t", epoch).withColumn(
        "_past", F.collect_list(F.struct(F.col("_t"), F.col(x))).over(w)
    )
    return out.select(key, day, F.transform(F.array_sort("_past"), lambda s: s[x]).alias("sequence"))


def asof_years(vintages: DataFrame, key: str, vintage: str, last_year: int) -> DataFrame:
    """Expand each vintage over the years it is the most recent one for: an as-of join becomes an equi-join.

    A key has a handful of vintages, so the expansion is (keys x years) rows.
    """
    w = Window.partitionBy(key).orderBy(vintage)
    until = F.least(F.coalesce(F.lead(vintage).over(w) - 1, F.lit(last_year)), F.lit(last_year))
    held = vintages.withColumn("_until", until).filter(F.col("_until") >= F.col(vintage))
    return held.select("*", F.explode(F.sequence(F.col(vintage), F.col("_until"))).alias("year")).drop("_until")


def asof_vintage(
    rows: DataFrame, vintages: DataFrame, key: str, vintage: str = "vintage", year: str = "year", last_year: int = 2100
) -> DataFrame:
    """Left join each row with the most recent vintage not after its year."""
    return rows.join(F.broadcast(asof_years(vintages, key, vintage, last_year).withColumnRenamed("year", year)), [key, year], "left")


def category_shares(areas: DataFrame, shares: dict[str, str], key: Sequence[str]) -> DataFrame:
    """Long (key, category, area) to one row with the total and one share per named SQL condition."""
    total = F.sum("area")
    parts = {
        name: F.coalesce(F.sum(F.when(F.expr(cond), F.col("area"))), F.lit(0.0)) / F.nullif(total, F.lit(0.0))
        for name, cond in shares.items()
    }
    return areas.groupBy(*key).agg(total.alias("area_total"), *[c.alias(n) for n, c in parts.items()])


def feature_matrix(
    panel: DataFrame,
    entities: DataFrame,
    measures: DataFrame,
    lags: DataFrame | None,
    shares: DataFrame,
    indices: Sequence[str],
    share_key: str = "dep",
    last_year: int = 2100,
) -> DataFrame:
    """The model matrix of the given panel rows.

    Pass a panel that is already bounded and sampled: the filters then run before every join.
    ``lags`` is the sparse history table, or None when the panel already carries its history.
    Measures stay at cell grain; the day before and the features of the date are attached there, not to each panel row.
    """
    static = entities.select(
        "entity",
        "cell",
        share_key,
        log1p0("population").alias("log_population"),
        log1p0("density").alias("log_density"),
        log1p0("area_km2").alias("log_area"),
        "alt_mean",
        (F.col("alt_max") - F.col("alt_min")).alias("alt_range"),
        "density_grid",
        "lat",
        "lon",
    )
    d1 = [c for c in indices if c in ("fwi", "ffmc")]
    weather = day_before(measures, d1).withColumn("danger_class", threshold_class("fwi"))
    flags = ("is_weekend", "is_holiday", "is_july_14", "is_august_15")
    dated = date_features(weather).drop("year", "holiday", "is_school_break").withColumns({c: F.col(c).cast("int") for c in flags})
    dates = [c for c in dated.columns if c not in weather.columns]
    own = [] if lags is not None else history_names(HORIZONS)
    rows = panel.select("entity", "day", "year", "split", F.col("y").cast("int").alias("y"), "n_events", "size", *own)
    # The panel's rows stay where they are: entities meet them by hash, cells x days and keys x years are sent to all.
    rows = rows.join(static.hint("shuffle_hash"), "entity").join(F.broadcast(dated), ["cell", "day"])
    if lags is not None:
        rows = fill_history(rows.join(lags, ["entity", "day"], "left"))
    rows = asof_vintage(rows, shares, share_key, last_year=last_year).withColumn("year", F.year("day"))
    return rows.select(*[c for c in rows.columns if c not in dates], *dates)


# Columns that carry the target or the row's identity, never features.
NOT_FEATURES = ("entity", "day", "y", "n_events", "size", "split", "dep", "year", "cell", "u", "size_30d", "vintage", "area_total")
# Columns a model without local event history, then without learnt rates, must not read.
HISTORY_COLUMNS = (
    "events_7d", "events_30d", "events_90d", "events_365d", "days_since_event", "entity_rate", "rate_ratio",
)
POSITION_COLUMNS = ("lat", "lon")
CLUSTER_COLUMNS = ("cluster_rate", "cluster")


def feature_columns(matrix: DataFrame, banned: Sequence[str] = NOT_FEATURES) -> list[str]:
    """Numeric columns that may feed a model, in the matrix's own order."""
    numeric = {"int", "bigint", "smallint", "double", "float"}
    return [name for name, kind in matrix.dtypes if kind in numeric and name not in banned]


def feature_sets(columns: Sequence[str]) -> dict[str, list[str]]:
    """A: everything. B: no local history nor position. C: additionally no learnt cluster column."""
    no_history = [c for c in columns if c not in HISTORY_COLUMNS + POSITION_COLUMNS]
    return {
        "A": list(columns),
        "B": no_history,
        "C": [c for c in no_history if c not in CLUSTER_COLUMNS],
    }


def drop_guard(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that cannot duplicate rows: a repeated key on the right stops the job."""
    w = Window.partitionBy(*keys)
    unique = right.withColumn("_copies", F.count("*").over(w))
    guarded = checked(unique, F.col("_copies") > 1, "duplicate keys on the right side")
    return left.join(guarded.drop("_copies"), list(keys), "left")
