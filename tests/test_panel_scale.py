"""The dense panel and what reads it: no hash, sort or exchange for each of its rows."""
import hashlib
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from panelrisk.functions.scalars import uniform
from panelrisk.functions.uniforms import day_millionths
from panelrisk.operators import checks, features, geo, panel


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_millionths_of_short_long_and_missing_keys():
    days = np.frombuffer(b"1995-01-011995-01-022000-02-29", np.uint8).reshape(-1, 10)
    keys = ["7", "123456", None, "", "é" * 20, "x" * 44, "x" * 45, "y" * 70]
    got = day_millionths(keys, days)
    for key, found in zip(keys, got):
        texts = [("" if key is None else key + "|") + bytes(d).decode() for d in days]
        assert found.tolist() == [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 1000000 for t in texts]


def test_uniforms_of_the_panel_are_hashed_by_entity(spark):
    """Before, each row of the panel had its own MD5 and conversion."""
    entities = spark.createDataFrame([(1,), (23,), (23,)], "entity long")
    days = spark.createDataFrame([(1, date(1995, 1, 3), 2, 5.0)], "entity long, day date, n long, size double")
    dense = panel.dense_panel(entities, days, "1995-01-01", "1995-03-01")
    assert dense.count() == 180
    assert dense.filter(F.col("u") != uniform(F.col("entity"), F.col("day"))).count() == 0
    assert "md5(" not in plan_of(dense)


def test_rectangular_holds_masks_not_days(spark):
    """Before, each (entity, day) was a group of its own."""
    entities = spark.createDataFrame([(1,), (2,)], "entity long")
    span = spark.range(1).select(F.explode(F.expr("sequence(date'1969-12-01', date'1970-03-10')")).alias("day"))
    whole = entities.crossJoin(span)
    hole = whole.filter("NOT (entity = 2 AND day = date'1970-01-01')")
    twice = hole.union(whole.filter("entity = 1 AND day = date'1969-12-31'"))
    unknown = hole.selectExpr("entity", "day").union(spark.createDataFrame([(1, None)], "entity long, day date"))
    found = [checks.rectangular(p, entities, span).collect()[0] for p in (whole, hole, twice, unknown)]
    assert [(r["status"], r["value"]) for r in found] == [("OK", 200), ("FAIL", 199), ("FAIL", 200), ("OK", 200)]
    dense = panel.dense_panel(entities, spark.createDataFrame([], "entity long, day date, n long, size double"), "1995-01-01", "1995-03-01")
    assert "bit_or" in plan_of(checks.rectangular(dense, entities, span))


def lags_by_expansion(days):
    """The table by its definition: each event-day on each of the 365 days after it."""
    lag = F.col("lag")
    rows = days.select("entity", "day", "n", "size", F.explode(F.sequence(F.lit(1), F.lit(365))).alias("lag"))
    counts = [F.coalesce(F.sum(F.when(lag <= h, F.col("n"))), F.lit(0)).alias(f"events_{h}d") for h in (7, 30, 90, 365)]
    size = F.coalesce(F.sum(F.when(lag <= 30, F.col("size"))), F.lit(0.0)).alias("size_30d")
    return rows.withColumn("day", F.date_add("day", lag)).groupBy("entity", "day").agg(*counts, size, F.min("lag").alias("days_since_event"))


def test_lags_are_filled_not_aggregated(spark, rows):
    """Before, 365 rows for each event-day were shuffled and grouped."""
    days = spark.createDataFrame(
        [(1, date(1995, 1, 1), 2, 4.0), (1, date(1995, 1, 2), 1, 1.5), (1, date(1995, 1, 31), 1, 0.0), (1, date(1996, 1, 31), 1, 2.0),
         (1, date(1998, 1, 1), 3, float("nan")), (1, date(1998, 2, 10), 1, 8.0), (2, date(1999, 5, 5), 1, 1.0), (3, None, 2, 3.0), (3, date(1997, 1, 1), 1, 7.0)],
        "entity long, day date, n long, size double",
    )
    got, want = features.event_lags(days), lags_by_expansion(days)
    columns = [*want.columns[:-2], F.expr("string(size_30d)"), "days_since_event"]
    assert rows(got, *columns) == rows(want, *columns) and got.count() == want.count()
    assert checks.no_day_zero(days, got).collect()[0]["value"] == 1  # the unknown day
    shifted = got.withColumn("events_7d", F.col("events_7d") + F.when(F.col("entity") == 2, 1).otherwise(0))
    assert checks.no_day_zero(days, shifted.withColumn("days_since_event", F.col("days_since_event") - F.when(F.col("entity") == 2, 1).otherwise(0))).collect()[0]["value"] == 367


def test_check_of_lags_does_not_sort_them(spark):
    days = spark.createDataFrame([(1, date(1995, 1, 1), 2, 4.0)], "entity long, day date, n long, size double")
    plan = plan_of(checks.no_day_zero(days, features.event_lags(days)))
    assert "ShuffledHashJoin" in plan or "BroadcastHashJoin" in plan


def test_pairs_are_not_shuffled(spark, rows):
    """Before, pairs of places were joined twice more; now only entities are moved."""
    data = [(i, 45.0 + (i % 20) * 0.05, 3.0 + (i // 20) * 0.1) for i in range(200)] + [(1000 + i, 45.2, 3.2) for i in range(30)]
    points = spark.createDataFrame(data, "entity long, lat double, lon double")
    before = geo.ROWS_PER_BLOCK
    geo.ROWS_PER_BLOCK = 8  # many blocks for the crowded place
    try:
        pairs = geo.pairs_within(points, 12.0)
        got, count = rows(pairs, "entity", "neighbour"), pairs.count()
    finally:
        geo.ROWS_PER_BLOCK = before
    b = points.select(F.col("entity").alias("neighbour"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    dist = geo.great_circle_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    want = rows(points.crossJoin(b).filter("entity <> neighbour").filter(dist <= 12000.0), "entity", "neighbour")
    assert got == want and count == len(want)
    above = plan_of(pairs).split("neighbour")[0]
    assert "Exchange" not in above


def test_pairs_without_mirror_are_counted(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (3, 1), (4, 4), (5, None)], "entity long, neighbour long")
    assert checks.pairs_symmetric(pairs).collect()[0]["value"] == 3
    assert checks.pairs_symmetric(pairs.limit(0)).collect()[0]["value"] == 0
    assert "Join" not in plan_of(checks.pairs_symmetric(pairs))


def test_sample_is_drawn_before_rows_are_made(spark):
    """Before, every day of every entity was a row that a filter dropped."""
    entities = spark.createDataFrame([(1,), (23,), (23,), (None,)], "entity long")
    events = [(1, date(1994, 12, 30), 1, 2.0), (1, date(1995, 1, 3), 2, 5.0), (1, date(1995, 1, 4), 1, 1.0), (23, date(1996, 12, 31), 1, 0.5), (None, date(1995, 2, 1), 1, 1.0)]
    days = spark.createDataFrame(events, "entity long, day date, n long, size double")
    for horizons in (None, (7, 30)):
        period = ("1995-01-01", "1996-12-31")
        whole = panel.dense_panel(entities, days, *period, horizons=horizons).filter("y OR u < 0.02")
        drawn = panel.dense_panel(entities, days, *period, horizons=horizons, share=0.02)
        assert drawn.dtypes == whole.dtypes
        assert sorted(map(repr, drawn.collect())) == sorted(map(repr, whole.collect()))
        assert "sequence(" not in plan_of(drawn.select("entity", "day"))


def test_features_of_a_date_are_found_per_cell_and_day(spark):
    """Before, Easter, the weekday and the cyclic encodings were computed for each row of the panel."""
    entities = spark.createDataFrame(
        [(k, 1, 2, 10 + k, 1.5, 2.0, 3.0, 1.0, 5.0, 1, 45.0, 2.0) for k in range(2)],
        "entity long, cell long, dep long, population long, density double, area_km2 double, alt_mean double, alt_min double, alt_max double, density_grid long, lat double, lon double",
    )
    measures = spark.createDataFrame([(1, date(1995, 7, d), float(d), 1.0, 1.0, 1.0) for d in (13, 14, 15)], "cell long, day date, fwi double, ffmc double, dmc double, dc double")
    shares = spark.createDataFrame([(2, 1995, 0.5)], "dep long, vintage int, share_s double")
    none = spark.createDataFrame([], "entity long, day date, n long, size double")
    rows = panel.with_split(panel.dense_panel(entities, none, "1995-07-13", "1995-07-15", horizons=features.HORIZONS), 1998, 1999)
    matrix = features.feature_matrix(rows, entities, measures, None, shares, ("fwi", "ffmc"))
    assert [(r.entity, r.day.day, r.is_july_14, r.is_weekend, r.year) for r in matrix.orderBy("entity", "day").collect()] == [
        (e, d, int(d == 14), int(d == 15), 1995) for e in range(2) for d in (13, 14, 15)
    ]
    plan = matrix._jdf.queryExecution().optimizedPlan().toString().split("\n")
    first = min(i for i, line in enumerate(plan) if "Join" in line)
    assert not any("weekday(" in line for line in plan[:first])
