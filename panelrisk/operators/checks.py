"""Integrity and leakage checks: each returns one row (check, status, value)."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _row(name: str, ok: Column, value: Column) -> list[Column]:
    return [
        F.lit(name).alias("check"),
        F.when(ok, F.lit("OK")).otherwise(F.lit("FAIL")).alias("status"),
        value.cast("bigint").alias("value"),
    ]


def count_of(df: DataFrame):
    """The row count as a scalar subquery."""
    return df.agg(F.count("*").alias("c")).scalar()


def none_found(name: str, offenders: DataFrame) -> DataFrame:
    """OK when the table of offenders is empty; the value is their number."""
    return offenders.agg(F.count("*").alias("c")).select(*_row(name, F.col("c") == 0, F.col("c")))


def equal_counts(name: str, left: DataFrame, right: Column) -> DataFrame:
    return left.agg(F.count("*").alias("c")).select(*_row(name, F.col("c") == right, F.col("c")))


# Days that share a row of the counts below, one bit each.
DAYS_PER_MASK = 64


def rectangular(panel: DataFrame, entities: DataFrame, days: DataFrame) -> DataFrame:
    """Every entity on every day exactly once: the size matches and no key is repeated.

    The days of an entity are the bits of a few masks, so that the state held is one row for 64 days: a key is
    repeated where there are more rows than bits. An unknown day is one key too.
    """
    size = count_of(entities) * count_of(days)
    at = F.unix_date("day")
    bit = F.expr("shiftleft(1L, pmod(unix_date(day), 64))")
    masks = panel.groupBy("entity", F.floor(at / DAYS_PER_MASK).alias("_days")).agg(F.count("*").alias("n"), F.bit_or(bit).alias("_mask"))
    distinct = F.when(F.col("_days").isNull(), F.lit(1)).otherwise(F.bit_count("_mask"))
    whole = masks.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > distinct).alias("repeated"))
    ok = (F.col("rows") == size) & (F.col("repeated") == 0)
    return whole.select(*_row("panel rectangular", ok, F.col("rows")))


def no_invalid_cell(entities: DataFrame, cells: DataFrame) -> DataFrame:
    bad = entities.join(cells.filter("is_sea").select("cell"), "cell", "left_semi")
    return none_found("no entity on an invalid cell", bad)


def measures_complete(entities: DataFrame, measures: DataFrame, start: str, end: str) -> DataFrame:
    """Every used cell has a measure on every day of the period; the value is the number of holes."""
    span = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    wanted = entities.select("cell").distinct().select("cell", F.explode(span).alias("day"))
    return none_found("measures complete", wanted.join(measures.select("cell", "day"), ["cell", "day"], "left_anti"))


def events_attached(events: DataFrame, entities: DataFrame) -> DataFrame:
    known = events.filter(F.col("entity").isNotNull())
    return none_found("attached events known", known.join(entities.select("entity"), "entity", "left_anti"))


def positives_coherent(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Positive panel rows equal the distinct (entity, day) pairs that hold an event."""
    pairs = events.filter(F.col("entity").isNotNull()).agg(F.count_distinct(F.struct("entity", "day")).alias("c"))
    return equal_counts("positives coherent", panel.filter("y"), pairs.scalar())


#: Pairs without mirror that are held until they are compared with the next ones of their tile.
HELD_PAIRS = 1 << 20


def _alone(pairs: pd.DataFrame) -> np.ndarray:
    """Which rows are of a pair that is there in one direction only."""
    back = (pairs["entity"] > pairs["neighbour"]).to_numpy()
    low, high = pairs["entity"].where(~back, pairs["neighbour"]), pairs["neighbour"].where(~back, pairs["entity"])
    share = pd.Series(back).groupby([low.to_numpy(), high.to_numpy()]).transform("mean").to_numpy()
    return (share == 0.0) | (share == 1.0)


def _unmirrored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows without mirror of a task whose tiles come one after the other; only those are held while a tile goes by."""
    found, tile, held, size, ended = 0, None, [], 0, set()

    def compared() -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        return rows[_alone(rows)] if len(rows) else rows

    for batch in batches:
        unknown = (batch["entity"].isna() | batch["neighbour"].isna()).to_numpy()
        found += int(unknown.sum())
        batch = batch[~unknown & (batch["entity"] != batch["neighbour"]).to_numpy()]
        tiles, a, b = (batch[c].to_numpy() for c in ("tile", "entity", "neighbour"))
        # A mirror that is the next row goes at once: the first of each two such rows, unless it was the second of two.
        next_is = np.r_[(tiles[1:] == tiles[:-1]) & (a[1:] == b[:-1]) & (b[1:] == a[:-1]), False][: len(a)].astype(bool)
        run = np.arange(len(a)) - np.maximum.accumulate(np.where(np.r_[True, ~next_is[:-1]][: len(a)], np.arange(len(a)), 0))
        first = next_is & (run % 2 == 0)
        rest = batch[~(first | np.r_[False, first[:-1]][: len(a)])]
        edges = np.flatnonzero(np.r_[True, tiles[1:] != tiles[:-1]][: len(tiles)])
        for own in tiles[edges]:
            if own != tile:
                if tile is not None:
                    found += len(compared()) if held else 0
                    ended.add(tile)
                if own in ended:
                    raise ValueError("the rows of a tile don't come one after the other")
                tile, held, size = own, [], 0
            part = rest[rest["tile"] == own][["entity", "neighbour"]]
            if len(part):
                held.append(part)
                size += len(part)
            if size > HELD_PAIRS:
                held = [compared()]
                size = len(held[0]) // 2  # it is compared again when as many have come
    yield pd.DataFrame({"c": [found + (len(compared()) if held else 0)]})


def pairs_symmetric(pairs: DataFrame) -> DataFrame:
    """Pairs without their mirror: both directions are counted under one key, so each pair is moved once and not sorted.

    Pairs that come with a ``tile`` are not moved: all rows of a pair that have the same tile, in both directions, are in one
    task, and its tiles come one after the other. Each task counts its own.
    """
    a, b = F.col("entity"), F.col("neighbour")
    if "tile" in pairs.columns:
        per_task = pairs.select("tile", "entity", "neighbour").mapInPandas(_unmirrored, "c long")
        found = per_task.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"))
        return found.select(*_row("pair table symmetric", F.col("c") == 0, F.col("c")))
    both = pairs.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(
        F.count_if(a < b).alias("forth"), F.count_if(a > b).alias("back"), F.count_if(a.isNull() | b.isNull()).alias("unknown")
    )
    alone = F.when(F.col("forth") == 0, F.col("back")).when(F.col("back") == 0, F.col("forth")).otherwise(0)
    found = both.agg(F.coalesce(F.sum(alone + F.col("unknown")), F.lit(0)).alias("c"))
    return found.select(*_row("pair table symmetric", F.col("c") == 0, F.col("c")))


def passage_sane(passage: DataFrame, live: DataFrame) -> DataFrame:
    moved = passage.join(live.select(F.col("code").alias("source")), "source", "left_semi")
    return none_found("no live code moved", moved)


def violations(df: DataFrame, bad: Column, order: Sequence[str], limit: int = 100) -> DataFrame:
    """The first offenders in key order, for a person to look at."""
    return df.filter(bad).orderBy(*order).limit(limit)


def split_bounds(panel: DataFrame) -> DataFrame:
    """First and last day and row count of each split, with the gap in days to the previous one."""
    per = panel.groupBy("split").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("rows"))
    # Three rows at most, ordered by first day.
    w = Window.partitionBy(F.lit(1)).orderBy("first")
    return per.withColumn("gap_days", F.datediff("first", F.lag("last").over(w)))


def split_contiguous(panel: DataFrame) -> DataFrame:
    bad = split_bounds(panel).filter(F.coalesce("gap_days", F.lit(1)) != 1)
    return none_found("splits contiguous", bad)


def evaluation_whole(sample: DataFrame, entities: DataFrame, days_by_split: DataFrame) -> DataFrame:
    """Validation and test hold entities x days rows each: they were not sampled."""
    got = sample.filter(F.col("split") != "train").groupBy("split").agg(F.count("*").alias("n"))
    want = days_by_split.filter(F.col("split") != "train").groupBy("split").agg(F.count("*").alias("d"))
    bad = want.join(got, "split", "left").filter(F.coalesce("n", F.lit(0)) != F.col("d") * count_of(entities))
    return none_found("evaluation splits whole", bad)


def no_day_zero(days: DataFrame, lags: DataFrame) -> DataFrame:
    """A delay below one day, or a 7-day count that is not explained by the strict past.

    The events of an entity are packed into one row, which its many rows of ``lags`` meet by hash: they are neither
    sorted nor, where they are dealt by entity, moved. A count on an unknown day is not explained.
    """
    known = days.filter(F.col("day").isNotNull()).groupBy("entity", "day").agg(F.sum("n").alias("n"))
    packed = known.groupBy("entity").agg(F.collect_list(F.struct("day", "n")).alias("_events"))
    both = lags.join(packed.hint("shuffle_hash"), "entity", "left")
    week = F.filter("_events", lambda e: e["day"].between(F.date_sub("day", 7), F.date_sub("day", 1)))
    past = F.aggregate(week, F.lit(0).cast("bigint"), lambda total, e: total + e["n"])
    late, unexplained = F.col("days_since_event") < 1, F.col("events_7d") != F.coalesce(past, F.lit(0))
    # A row may be wrong in both ways.
    wrong = both.agg((F.count_if(late) + F.count_if(unexplained)).alias("c"))
    return wrong.select(*_row("lags strictly past", F.col("c") == 0, F.col("c")))


def vintage_not_future(rows: DataFrame, vintage: str = "vintage", year: str = "year") -> DataFrame:
    return none_found("vintage never future", rows.filter(F.col(vintage) > F.col(year)))


def leak_equivalence(panel: DataFrame) -> DataFrame:
    """``n_events > 0``, ``size > 0`` and y say the same thing, which is why neither may be a feature."""
    y = F.col("y").cast("boolean")
    bad = ((F.col("n_events") > 0) != y) | ((F.col("size") > 0) & ~y)
    return none_found("count and size leak y", panel.filter(bad))


def time_axis(measures: DataFrame, start: str, end: str) -> DataFrame:
    """Missing and duplicated days of the axis, and cells that are neither always nor never measured."""
    span = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    axis = measures.sparkSession.range(1).select(span)
    missing = axis.join(measures.select("day").distinct(), "day", "left_anti")
    repeated = measures.groupBy("cell", "day").agg(F.count("*").alias("n")).filter("n > 1")
    per_cell = measures.groupBy("cell").agg(F.count_distinct("day").alias("n"))
    partial = per_cell.filter(F.col("n") != F.datediff(F.lit(end), F.lit(start)) + 1)
    parts = [("no missing day", missing), ("no repeated cell-day", repeated), ("no intermittent cell", partial)]
    return reduce(DataFrame.unionByName, [none_found(n, d) for n, d in parts])


def entity_quality(entities: DataFrame, name_length: int | None = None) -> DataFrame:
    """Key uniqueness, altitude order, and the largest relative gap of the recomputed density."""
    repeated = entities.groupBy("entity").agg(F.count("*").alias("n")).filter("n > 1")
    order = entities.filter(~((F.col("alt_min") <= F.col("alt_mean")) & (F.col("alt_mean") <= F.col("alt_max"))))
    again = F.col("population") / F.col("area_km2")
    gap = entities.filter(F.abs(again - F.col("density")) > 0.01 * F.abs(again))
    parts = [("entity key unique", repeated), ("altitudes ordered", order), ("density recomputed", gap)]
    if name_length is not None:
        parts.append(("name length", entities.filter(F.length("name") != name_length)))
    return reduce(DataFrame.unionByName, [none_found(n, d) for n, d in parts])


def coordinate_gap(entities: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Entities whose two coordinate pairs disagree by more than ``tolerance`` degrees."""
    far = (F.abs(F.col("lat") - F.col("lat_alt")) > tolerance) | (F.abs(F.col("lon") - F.col("lon_alt")) > tolerance)
    return none_found("two coordinates agree", entities.filter(far))


def volume_gap(panel_rows: DataFrame, expected: Column, limit: float = 0.05) -> DataFrame:
    """WARN-style check: the row count differs from the expectation by more than ``limit``."""
    out = panel_rows.agg(F.count("*").alias("c"))
    return out.select(*_row("volume as expected", F.abs(F.col("c") / expected - 1) <= limit, F.col("c")))


def same_yearly_volumes(predictions: DataFrame, panel: DataFrame) -> DataFrame:
    """Rows and positives per year of a prediction set equal the panel's."""

    def volumes(df: DataFrame, suffix: str) -> DataFrame:
        return df.groupBy("year").agg(
            F.count("*").alias(f"rows{suffix}"), F.sum(F.col("y").cast("int")).alias(f"pos{suffix}")
        )

    both = volumes(predictions, "_p").join(volumes(panel, "_g"), "year", "left")
    same = F.col("rows_p").eqNullSafe(F.col("rows_g")) & F.col("pos_p").eqNullSafe(F.col("pos_g"))
    return none_found("prediction volumes match panel", both.filter(~same))


def totals_match(parts: DataFrame, whole: DataFrame, key: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """Sum of category areas per key against the announced total."""
    got = parts.groupBy(*key).agg(F.sum("area").alias("got"))
    bad = whole.join(got, list(key), "left").filter(
        F.abs(F.coalesce("got", F.lit(0.0)) - F.col("area_total")) > tolerance * F.abs(F.col("area_total"))
    )
    return none_found("category totals match", bad)


def announced_counts(meta: DataFrame) -> DataFrame:
    """Files whose announced row count differs from what was read."""
    return none_found("announced rows read", meta.filter(~F.col("announced").eqNullSafe(F.col("rows"))))


# Columns produced by a fit or by a neighbour search: they never belong to the base matrix.
LEARNT_PREFIXES = ("cluster", "entity_rate", "rate_ratio", "neighbour", "events_10km", "events_20km", "events_50km")


def forbidden_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.startswith(LEARNT_PREFIXES)]


def same_features(model_features: Sequence[str], prepared: Sequence[str]) -> None:
    """A model must be served the columns it was fitted on, in the same order."""
    if list(model_features) != list(prepared):
        raise ValueError(f"the model expects {list(model_features)}, the preparation gives {list(prepared)}")
