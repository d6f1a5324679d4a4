import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrisk.functions.calendar import calendar, easter_sunday
from panelrisk.functions.scalars import interpolate, student_t_p, threshold_class
from panelrisk.operators import checks, features, panel

D0 = dt.date(2008, 6, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def days(spark):
    """Events 0, 1, 7, 8, 30, 31, 365 and 366 days before D0, two of them on one day."""
    back = (0, 1, 7, 8, 30, 31, 365, 366)
    rows = [("A", day(-b), 1.0) for b in back] + [("A", day(-7), 2.0), ("B", day(-3), 5.0), (None, day(-1), 9.0)]
    return panel.event_days(spark.createDataFrame(rows, "entity string, day date, size double"))


def test_history_bounds(days):
    r = features.event_lags(days).filter((F.col("entity") == "A") & (F.col("day") == D0)).first()
    # The day itself and the 366th day before it never count.
    assert (r.events_7d, r.events_30d, r.events_90d, r.events_365d) == (3, 5, 6, 7)
    assert (r.size_30d, r.days_since_event) == (6.0, 1)


def test_three_forms_of_history_agree(spark, days):
    lags = features.event_lags(days)
    entities = spark.createDataFrame([("A",), ("B",), ("C",)], "entity string")
    for n in (-200, 0, 5, 364):
        at = features.history_at(days, entities, str(day(n))).orderBy("entity").collect()
        joined = entities.join(lags.filter(F.col("day") == F.lit(day(n))).drop("day"), "entity", "left")
        want = features.fill_history(joined).orderBy("entity").collect()
        dense = panel.dense_panel(entities, days, str(day(n)), str(day(n)), horizons=features.HORIZONS)
        got = dense.select("entity", *panel.history_names(features.HORIZONS)).orderBy("entity").collect()
        assert [tuple(r) for r in at] == [tuple(r) for r in want] == [tuple(r) for r in got]
    sliding = {(r.entity, r.day): r.events_365d for r in features.history_by_range(days).collect()}
    table = {(r.entity, r.day): r.events_365d for r in lags.collect()}
    assert all(table.get(k, 0) == v for k, v in sliding.items())


def test_silent_entity_reads_the_sentinel(spark, days):
    r = features.history_at(days, spark.createDataFrame([("C",)], "entity string"), str(D0)).first()
    assert (r.events_365d, r.days_since_event) == (0, 9999)


def test_class_bounds(spark):
    values = [5.1, 5.2, 11.2, 21.3, 38.0, 50.0, 49.9, None]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(threshold_class("x").alias("c"))
    assert [r.c for r in df.collect()] == [1, 2, 3, 4, 5, 6, 5, None]


def test_vintages(spark):
    v = spark.createDataFrame([("a", 2006, 0.1), ("a", 2012, 0.2), ("a", 2018, 0.3)], "k string, vintage int, s double")
    rows = spark.createDataFrame([("a", y) for y in (2005, 2006, 2011, 2012, 2017, 2018, 2025)], "k string, year int")
    out = {r.year: r.vintage for r in features.asof_vintage(rows, v, "k", last_year=2030).collect()}
    assert out == {2005: None, 2006: 2006, 2011: 2006, 2012: 2012, 2017: 2012, 2018: 2018, 2025: 2018}


def test_day_before_needs_the_adjacent_day(spark):
    m = spark.createDataFrame([(1, day(0), 1.0), (1, day(1), 2.0), (1, day(3), 4.0)], "cell int, day date, fwi double")
    out = {r.day: r.fwi_d1 for r in features.day_before(m, ("fwi",)).collect()}
    assert out == {day(0): None, day(1): 1.0, day(3): None}


def test_frames_end_the_day_before(spark):
    m = spark.createDataFrame([(1, day(i), float(i)) for i in range(40)], "cell int, day date, fwi double")
    r = features.measure_lags(m).filter(F.col("day") == day(35)).first()
    assert (r.fwi_lag2, r.fwi_max7, r.fwi_mean7, r.fwi_slope7) == (33.0, 34.0, 31.0, 7.0)
    s = features.past_sequences(m).filter(F.col("day") == day(35)).first().sequence
    assert s == [float(i) for i in range(5, 35)]


def test_panel_is_dense_and_marks_events(spark, days):
    entities = spark.createDataFrame([("A",), ("B",), ("C",)], "entity string")
    p = panel.dense_panel(entities, days, str(day(-10)), str(day(0)))
    assert p.count() == 33 and p.filter("y").count() == 5
    assert p.filter("n_events = 2").count() == 1
    assert p.filter("u < 0 OR u >= 1").count() == 0


def test_attached_day_arrays_equal_a_join(spark, days):
    entities = spark.createDataFrame([("A", 1), ("B", 2), ("C", 1)], "entity string, cell int")
    m = spark.createDataFrame([(1, day(-2), 9.0), (1, day(0), 7.0), (2, day(-1), 3.0)], "cell int, day date, fwi double")
    arrays = panel.day_arrays(m, {"fwi": F.col("fwi")}, str(day(-2)), str(day(0)))
    got = panel.dense_panel(entities, days, str(day(-2)), str(day(0)), arrays=arrays).select("entity", "day", "fwi")
    want = panel.dense_panel(entities, days, str(day(-2)), str(day(0)), keep=["cell"]).join(m, ["cell", "day"], "left")
    assert set(map(tuple, got.collect())) == set(map(tuple, want.select("entity", "day", "fwi").collect()))


def test_samples_are_nested_and_keep_evaluation_whole(spark, days):
    entities = spark.createDataFrame([(str(i),) for i in range(30)] + [("A",)], "entity string")
    p = panel.with_split(panel.dense_panel(entities, days, "2008-01-01", "2010-12-31"), 2008, 2009)
    small, large = panel.downsample(p, 0.01), panel.downsample(p, 0.1)
    key = ["entity", "day"]
    assert small.join(large, key, "left_anti").count() == 0
    assert small.filter("split <> 'train'").count() == p.filter("split <> 'train'").count()
    assert small.filter("y").count() == p.filter("y").count()


def test_sparse_exposure_equals_the_dense_count(spark, days):
    entities = spark.createDataFrame([("A",), ("B",), ("C",)], "entity string")
    got = panel.exposure(days, entities, "2007-03-01", "2008-12-31")
    p = panel.dense_panel(entities, days, "2007-03-01", "2008-12-31")
    want = p.groupBy("entity", "year").agg(F.count("*").alias("days"), F.count_if("y").alias("events"))
    assert set(map(tuple, got.collect())) == set(map(tuple, want.collect()))


def test_guarded_join_refuses_duplicates(spark):
    left = spark.createDataFrame([(1,)], "k int")
    right = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="duplicate keys"):
        features.drop_guard(left, right, ["k"]).collect()


def test_feature_lists():
    cols = ["fwi", "lat", "events_7d", "cluster", "cluster_rate", "entity_rate"]
    sets = features.feature_sets(cols)
    assert sets == {"A": cols, "B": ["fwi", "cluster", "cluster_rate"], "C": ["fwi"]}
    assert checks.forbidden_columns(["fwi", "cluster_rate", "events_10km"]) == ["cluster_rate", "events_10km"]
    with pytest.raises(ValueError):
        checks.same_features(["a", "b"], ["b", "a"])


def test_leaking_columns_are_never_features(spark):
    df = spark.createDataFrame([(1, 2.0, 3, 4.0, "train")], "y int, size double, n_events int, fwi double, split string")
    assert features.feature_columns(df) == ["fwi"]


def test_holidays(spark):
    known = {1818: "03-22", 1943: "04-25", 1981: "04-19", 2000: "04-23", 2019: "04-21", 2024: "03-31", 2285: "03-22", 3000: "04-13"}
    years = spark.createDataFrame([(y,) for y in known], "y int")
    assert {r.y: str(r.e)[5:] for r in years.select("y", easter_sunday(F.col("y")).alias("e")).collect()} == known
    found = {str(r.day): r.holiday for r in calendar(spark, "2024-01-01", "2024-12-31").filter("is_holiday").collect()}
    assert len(found) == 11 and found["2024-04-01"] == "easter_monday" and found["2024-05-09"] == "ascension" and found["2024-05-20"] == "whit_monday"


def test_t_tail_and_interpolation(spark):
    # Two-sided critical values from the usual tables.
    table = [(12.706, 1), (4.303, 2), (3.182, 3), (2.571, 5), (2.228, 10), (2.012896, 47)]
    df = spark.createDataFrame(table, "t double, nu int").select(student_t_p("t", "nu").alias("p"))
    assert all(r.p == pytest.approx(0.05, abs=2e-4) for r in df.collect())
    x = spark.createDataFrame([(0.0,), (1.0,), (2.5,), (9.0,)], "x double").select(interpolate("x", [(1, 10.0), (2, 20.0), (3, 0.0)]).alias("v"))
    assert [r.v for r in x.collect()] == [10.0, 10.0, 10.0, 0.0]


def test_event_on_every_day_of_twenty_years(spark):
    """The running totals of a hot entity against plain sums, in a time that a scan of all its days would not meet."""
    import time

    from panelrisk.functions.scalars import NO_EVENT_DAYS

    start, size = dt.date(1990, 1, 1), 20 * 365
    rows = [(1, start + dt.timedelta(days=k), 1 + k % 3, float(k % 5)) for k in range(size)] + [(2, start + dt.timedelta(days=40), 2, 7.0)]
    days = spark.createDataFrame(rows, "entity long, day date, n long, size double")
    entities = spark.createDataFrame([(1,), (2,), (3,)], "entity long")
    began = time.perf_counter()
    dense = panel.dense_panel(entities, days, str(start), str(start + dt.timedelta(days=size - 1)), horizons=features.HORIZONS).toPandas()
    assert time.perf_counter() - began < 60
    assert len(dense) == 3 * size
    for entity in (1, 2, 3):
        own = dense[dense.entity == entity].sort_values("day").reset_index(drop=True)
        n, sizes = np.zeros(size, int), np.zeros(size)
        for e, d, k, s in rows:
            if e == entity:
                n[(d - start).days], sizes[(d - start).days] = k, s
        before = np.r_[0, np.cumsum(n)]
        assert own.n_events.tolist() == n.tolist() and own.y.tolist() == (n > 0).tolist()
        for h in features.HORIZONS:
            assert own[f"events_{h}d"].tolist() == [before[t] - before[max(0, t - h)] for t in range(size)]
        totals = np.r_[0, np.cumsum(sizes)]
        assert np.allclose(own.size_30d, [totals[t] - totals[max(0, t - 30)] for t in range(size)])
        last = [max((u for u in range(max(0, t - 365), t) if n[u]), default=None) for t in range(0, size, 97)]
        assert own.days_since_event.tolist()[::97] == [NO_EVENT_DAYS if u is None else t - u for t, u in zip(range(0, size, 97), last)]
