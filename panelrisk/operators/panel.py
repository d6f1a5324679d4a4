"""Dense entity x day panel from sparse events, its split and its nested sample.

The panel never shuffles its dense side: the event-days of an entity (one per calendar day at
most) travel with the entity row, and the days are generated next to it.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.functions.scalars import NO_EVENT_DAYS, SIZE_HORIZON, checked, count_below, split_label
from panelrisk.functions.uniforms import drawn_days, uniform_days
from panelrisk.session import spread

# Fixed value: share of train negatives kept by the sample.
NEGATIVE_SHARE = 0.00189
#: An event-day with the events and sizes up to and with it.
INDEXED = "array<struct<day: date, n: bigint, size: double, cum_n: bigint, cum_size: double>>"


def event_days(events: DataFrame) -> DataFrame:
    """(entity, day, n, size): events and total size per entity and day; events without entity are ignored."""
    return (
        events.filter(F.col("entity").isNotNull())
        .groupBy("entity", "day")
        .agg(F.count("*").alias("n"), F.sum(F.coalesce("size", F.lit(0.0))).alias("size"))
    )


def day_arrays(measures: DataFrame, values: dict[str, Column], start: str, end: str, key: str = "cell") -> DataFrame:
    """One row per cell with, for each value, an array holding one entry per day of [start, end].

    A day without a measure is NULL. The arrays are as long as the calendar: a day that a cell has twice would shift
    all days after it, so it stops the job; aggregate such measures first.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    axis = measures.select(key).distinct().select(key, F.explode(F.sequence(lo, hi)).alias("day"))
    filled = axis.join(measures.select(key, "day", *[c.alias(n) for n, c in values.items()]), [key, "day"], "left")
    packed = filled.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("day", *values))).alias("_a"))
    packed = checked(packed, F.size("_a") != F.datediff(hi, lo) + 1, "a cell has several measures of one day")
    return packed.select(key, *[F.col(f"_a.{n}").alias(n) for n in values])


def day_index(days: DataFrame) -> DataFrame:
    """(entity, _events): the event-days of each entity in order, each with the running count and size.

    At most one entry per calendar day, so a hot entity stays a bounded row.
    """
    past = Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = days.select("entity", "day", "n", "size", F.sum("n").over(past).alias("cum_n"), F.sum("size").over(past).alias("cum_size"))
    entry = F.struct("day", "n", "size", "cum_n", "cum_size")
    return running.groupBy("entity").agg(F.sort_array(F.collect_list(entry)).cast(INDEXED).alias("_events"))


def dense_panel(
    entities: DataFrame, days: DataFrame, start: str, end: str, keep: Sequence[str] = (),
    arrays: DataFrame | None = None, key: str = "cell", horizons: Sequence[int] | None = None,
    share: float | None = None,
) -> DataFrame:
    """Every entity on every day of [start, end] with y, n_events, size and the deterministic uniform u.

    ``days`` is the output of :func:`event_days`; ``keep`` names entity columns to carry along;
    ``arrays`` is the output of :func:`day_arrays` over the same period, whose values are read by
    position, so that attaching a cell's measures does not shuffle the dense side either. With
    ``horizons`` each row also gets its strict-past event history, read from the packed event-days:
    a filter on the panel then runs before the history is computed.

    The calendar of an entity is cut at its event-days, and each stretch is filled up with days. So a day
    knows the last event-day up to it without a search, whatever the number of events. The uniforms of an entity are
    hashed as one vector over its calendar, where they are asked for.

    With ``share`` only the event-days and the days whose u is below it become rows, as a filter would leave them: the days
    are drawn from the vector, and a day finds its last event-day by bisection.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    packed = day_index(days.filter(F.col("day").between(F.date_sub(lo, max(horizons or [0])), hi)))
    rows = entities.select("entity", *dict.fromkeys([*keep, *([key] if arrays is not None else [])]))
    if arrays is not None:
        # Joined before spreading: a crowded cell is then dealt over all tasks with its arrays.
        rows = rows.join(arrays, key)
    rows = spread(rows, "entity").join(packed, "entity", "left").withColumn("_events", F.coalesce("_events", F.array().cast(INDEXED)))
    none = F.array(F.struct(F.lit(None), F.lit(0), F.lit(0.0), F.lit(0), F.lit(0.0))).cast(INDEXED)
    searched = [F.col(f"_events.{c}").alias(f"_{c}") for c in ("day", "cum_n", "cum_size")] if horizons else []
    along = [c for c in rows.columns if c not in ("_events", "entity", *keep, key)]
    if share is None:
        stretches = F.transform(
            F.concat(none, "_events"),
            lambda e, k: F.struct(
                F.greatest(lo, e["day"]).alias("first"), F.coalesce(F.date_sub(F.get("_events", k)["day"], 1), hi).alias("last"), e.alias("event"), k.alias("place")
            ),
        )
        found = F.explode(F.filter(stretches, lambda s: s["first"] <= s["last"])).alias("_s")
        rows = rows.withColumn("_u", uniform_days(F.col("entity"), start, end))
        cut = rows.select("entity", *keep, *along, "_u", *searched, found)
        dense = cut.select("*", F.explode(F.sequence("_s.first", "_s.last")).alias("day"))
        millionths = F.get("_u", F.datediff("day", lo))
    else:
        rows = rows.withColumn("_drawn", drawn_days(F.col("entity"), F.col("_events.day"), start, end, share))
        cut = rows.select("entity", *keep, *along, "_events", *searched, F.explode("_drawn").alias("_d"))
        dense = cut.withColumn("day", F.date_add(lo, F.col("_d.at")))
        dense = dense.withColumn("_place", count_below(F.col("_events.day"), F.date_add("day", 1)))
        event = F.get(F.concat(none, "_events"), F.col("_place"))
        dense = dense.withColumn("_s", F.struct(event.alias("event"), F.col("_place").alias("place")))
        millionths = F.col("_d.u")
    at = F.datediff("day", lo)
    values = [] if arrays is None else [F.get(c, at).alias(c) for c in arrays.columns if c != key]
    hit = F.coalesce(F.col("_s.event.day") == F.col("day"), F.lit(False))
    n = F.when(hit, F.col("_s.event.n")).otherwise(0)
    if horizons:
        dense = dense.withColumn("_past", indexed_history(F.col("day"), horizons))
        values += [F.col(f"_past.{c}").alias(c) for c in history_names(horizons)]
    return dense.select(
        "entity",
        *keep,
        "day",
        F.year("day").alias("year"),
        hit.alias("y"),
        n.alias("n_events"),
        F.when(hit, F.col("_s.event.size")).otherwise(0.0).alias("size"),
        (millionths / F.lit(1e6)).alias("u"),
        *values,
    )


def history_names(horizons: Sequence[int]) -> list[str]:
    return [*[f"events_{h}d" for h in horizons], f"size_{SIZE_HORIZON}d", "days_since_event"]


def indexed_history(day: Column, horizons: Sequence[int]) -> Column:
    """Struct of the history columns at ``day``: a horizon is the difference of two running totals.

    The one at ``day`` is that of the stretch; the one before the horizon is found by bisection, and only if the
    last event-day lies inside the horizon.
    """
    event, place = F.col("_s.event"), F.col("_s.place")
    today = F.coalesce(event["day"] == day, F.lit(False))
    last = F.when(today, F.get("_day", place - 2)).otherwise(event["day"])
    upto = {c: F.when(today, event[f"cum_{c}"] - event[c]).otherwise(event[f"cum_{c}"]) for c in ("n", "size")}

    def within(c: str, horizon: int, zero: Column) -> Column:
        first = count_below(F.col("_day"), F.date_sub(day, horizon))
        total = upto[c] - F.coalesce(F.get(f"_cum_{c}", first - 1), zero)
        return F.when(F.datediff(day, last) <= horizon, total).otherwise(zero)

    counts = [within("n", h, F.lit(0).cast("bigint")).alias(f"events_{h}d") for h in horizons]
    since = F.when(F.datediff(day, last) <= max(horizons), F.datediff(day, last)).otherwise(F.lit(NO_EVENT_DAYS))
    return F.struct(*counts, within("size", SIZE_HORIZON, F.lit(0.0)).alias(f"size_{SIZE_HORIZON}d"), since.alias("days_since_event"))


def with_split(panel: DataFrame, train_end: int, val_end: int) -> DataFrame:
    return panel.withColumn("split", split_label("year", train_end, val_end))


def downsample(panel: DataFrame, share: float = NEGATIVE_SHARE) -> DataFrame:
    """All positives, the train negatives with u below ``share``, validation and test whole.

    A smaller share keeps a subset of what a larger one keeps.
    """
    return panel.filter((F.col("split") != "train") | F.col("y") | (F.col("u") < share))


def yearly_volumes(panel: DataFrame) -> DataFrame:
    y = F.col("y").cast("int")
    return panel.groupBy("year").agg(
        F.count("*").alias("rows"),
        F.sum(y).alias("positives"),
        F.round(F.lit(100.0) * F.sum(y) / F.count("*"), 4).alias("rate_pct"),
    )


def exposure(days: DataFrame, entities: DataFrame, start: str, end: str) -> DataFrame:
    """(entity, year, days, events) over a period, from the sparse side only.

    The panel is rectangular, so the exposure of a year is its number of calendar days; the
    253-million-row scan of the dense form is not needed.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    hit = (
        days.filter(F.col("day").between(lo, hi))
        .groupBy("entity", F.year("day").alias("year"))
        .agg(F.count("*").alias("events"))
    )
    years = F.explode(F.sequence(F.year(lo), F.year(hi))).alias("year")
    first = F.greatest(lo, F.make_date("year", F.lit(1), F.lit(1)))
    last = F.least(hi, F.make_date("year", F.lit(12), F.lit(31)))
    return (
        entities.select("entity", years)
        .withColumn("days", F.datediff(last, first) + 1)
        .join(hit, ["entity", "year"], "left")
        .select("entity", "year", F.col("days").cast("bigint").alias("days"), F.coalesce("events", F.lit(0)).alias("events"))
    )
