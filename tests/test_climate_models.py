import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelrisk.functions.scalars import checked
from panelrisk.operators import calibration, checks, climate, clustering, eda, metrics, series, serving


def test_circular_smoothing_and_lag(spark):
    start = dt.date(2001, 1, 1)
    rows = [(1, start + dt.timedelta(days=i), 15.0 if i == 0 else 0.0) for i in range(365)]
    clim = climate.climatology(spark.createDataFrame(rows, "cell int, day date, fwi double"), ["fwi"])
    got = {r.doy: r for r in clim.collect()}
    # A spike on January 1 reaches seven days on both sides of the new year.
    assert {d for d, r in got.items() if r.fwi > 0} == {*range(1, 9), *range(359, 366)}
    assert got[1].fwi == pytest.approx(1.0) and got[1].fwi_d1 == got[365].fwi


def test_factors_start_from_the_recent_level(spark):
    obs = spark.createDataFrame([(1, y, 1.2) for y in range(2011, 2026)], "cell int, year int, k double")
    ratios = spark.createDataFrame([(1, "s", 2038, 1.1), (1, "s", 2058, 1.3), (1, "s", 2092, 1.2)], "cell int, scenario string, horizon int, k double")
    out = {r.year: r for r in climate.level_factors(obs, ratios, (2038, 2058, 2092), ("s",), (2011, 2025), 2026, 2100).collect()}
    assert out[2038].k == pytest.approx(1.2 * 1.1) and out[2048].k == pytest.approx(1.2 * 1.2) and out[2100].k == pytest.approx(1.2 * 1.2)
    assert out[2020].k_low is None and out[2038].k_low == pytest.approx(out[2038].k)


def test_non_finite_ratio_fails(spark):
    cells = spark.createDataFrame([(1, 45.0, 2.0)], "cell int, lat double, lon double")
    sites = spark.createDataFrame([(7, 45.1, 2.0)], "site int, site_lat double, site_lon double")
    maps = spark.createDataFrame([("historical", 0, 7, 2.0), ("high", 2058, 7, float("inf"))], "scenario string, horizon int, site int, value double")
    with pytest.raises(Exception, match="not finite"):
        climate.delta_ratios(cells, maps, sites).collect()


def test_trend_and_regression_against_closed_form(spark):
    rng = random.Random(5)
    pts = [(float(x), 3.0 + 0.5 * x + rng.gauss(0, 1)) for x in range(30)]
    r = series.trend(spark.createDataFrame(pts, "x double, y double")).first()
    mx, my = sum(p[0] for p in pts) / 30, sum(p[1] for p in pts) / 30
    slope = sum((x - mx) * (y - my) for x, y in pts) / sum((x - mx) ** 2 for x, _ in pts)
    assert r.slope == pytest.approx(slope) and r.significant and r.p_value < 1e-6
    _, model = series.least_squares(spark.createDataFrame(pts, "x double, y double"), ["x"], "y")
    assert model.coefficients[0] == pytest.approx(slope)


def test_acf_pacf_of_an_autoregression(spark):
    rng, x, rows = random.Random(8), 0.0, []
    for i in range(3000):
        x = 0.6 * x + rng.gauss(0, 1)
        rows.append(("s", dt.date(2000, 1, 1) + dt.timedelta(days=i), x))
    df = spark.createDataFrame(rows, "series string, day date, x double")
    a = series.acf(df, "x", lags=5, by=["series"])
    rho = {r.lag: r.acf for r in a.collect()}
    assert rho[0] == pytest.approx(1) and rho[1] == pytest.approx(0.6, abs=0.06) and rho[2] == pytest.approx(0.36, abs=0.08)
    part = {r.lag: r.pacf for r in series.pacf(a).collect()}
    assert part[1] == pytest.approx(rho[1]) and part[2] == pytest.approx((rho[2] - rho[1] ** 2) / (1 - rho[1] ** 2), abs=1e-9)
    assert series.unit_root(df, "x")["statistic"] < series.UNIT_ROOT_5PCT
    assert series.decorrelation_time(a).first().tau in (2, 3)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    rows = []
    for i in range(4000):
        p = rng.random()
        rows.append((i, p, int(rng.random() < p**3), 2020 + i % 3))
    return spark.createDataFrame(rows, "key long, p double, y int, year int")


@pytest.mark.parametrize("method", ["platt", "isotonic"])
def test_calibration_is_monotone_and_recentres(scored, method):
    out = calibration.judge(scored, "p", "y", F.col("year") < 2022, F.col("year") == 2022, method)
    values = [r.calibrated for r in out.orderBy("p").select("calibrated").collect()]
    assert all(b >= a - 1e-12 for a, b in zip(values, values[1:]))
    raw = metrics.calibration_summary(metrics.score_groups(out, "p", "y")).first()
    cal = metrics.calibration_summary(metrics.score_groups(out, "calibrated", "y")).first()
    assert abs(cal.bias - 1) < 0.15 < abs(raw.bias - 1) and cal.brier < raw.brier
    if method == "platt":
        assert cal.average_precision == pytest.approx(raw.average_precision, abs=1e-9)


def test_medians_refuse_other_splits(spark):
    df = spark.createDataFrame([(1.0, "train"), (None, "train"), (3.0, "train"), (9.0, "val")], "x double, split string")
    with pytest.raises(Exception, match="fitted on train"):
        clustering.fit_medians(df, ["x"], "split").collect()
    train = df.filter("split = 'train'")
    m = clustering.fit_medians(train, ["x"], "split")
    assert m.first().x == 2.0 and clustering.impute(train, m, ["x"]).filter("x = 2.0").count() == 1


def test_guards_ignore_rows_the_join_drops(spark):
    left = spark.createDataFrame([(1, "train")], "k int, split string")
    right = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    bad = F.when(F.col("k") == 2, "val").otherwise("train") != "train"
    assert checked(left.join(right, "k"), bad, "stop").count() == 1


def test_position_weighs_a_quarter(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (3.0, 3.0, 5.0)], "lat double, alt double, flat double")
    rows = clustering.standardise(df, ["lat", "alt", "flat"]).orderBy("alt").collect()
    assert [r.alt for r in rows] == [-1.0, 1.0] and [r.lat for r in rows] == [-0.25, 0.25] and [r.flat for r in rows] == [0.0, 0.0]


def test_checks_catch_damage(spark):
    entities = spark.createDataFrame([("a",), ("b",)], "entity string")
    axis = spark.range(3).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    full = entities.crossJoin(axis)
    status = lambda df: checks.rectangular(df, entities, axis).first().status
    assert status(full) == "OK"
    hole = full.filter("NOT (entity = 'a' AND day = DATE '2020-01-02')")
    assert status(hole) == "FAIL" and status(hole.unionByName(hole.limit(1))) == "FAIL"
    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "entity string, neighbour string")
    assert checks.pairs_symmetric(pairs).first().status == "OK" and checks.pairs_symmetric(pairs.limit(1)).first().status == "FAIL"


def test_search_of_many_texts(spark):
    rows = [
        (1, "42218", "42000", "Saint-Étienne", 170), (2, "35288", "35400", "Saint-Malo", 46), (3, "2A004", "20000", "Ajaccio", 70), (4, "01001", "01400", "Mont Saint-Malo", 46),
        (5, "02002", None, "Malo", 46), (6, "03003", "", None, 9), (7, "20004", "20001", "Sainte-Anne", 5), (8, "20004", "20001", "Älmalo", 46),
    ]
    df = spark.createDataFrame(rows, "entity long, code string, postcode string, name string, population long")
    texts = {1: "st etienne", 2: "2a0", 3: "malo", 4: "354", 5: " ", 6: None, 7: "ste anne", 8: "ALM", 9: "zzz", 10: "2", 11: "a", 12: "st-malo", 13: "saint-malo x", 14: "o", 15: "20"}
    asked = spark.createDataFrame(list(texts.items()), "query_id long, text string")
    got = {}
    for r in serving.search_all(df, asked, limit=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.entity, r.kind))
    found = {q: [e for _, e, _ in own] for q, own in got.items()}
    assert found == {1: [1], 2: [3], 3: [5, 2, 4], 4: [2], 7: [7], 8: [8], 10: [3, 8, 7], 11: [1, 3, 8], 12: [2, 4], 14: [3, 2, 4], 15: [3, 8, 7]}
    assert all([n for n, _, _ in own] == list(range(1, len(own) + 1)) and len({k for _, _, k in own}) == 1 for own in got.values())
    assert got[4][0][2] == "code" and got[3][0][2] == "name" and 13 not in got
    assert serving.search_all(df, asked.limit(0)).count() == 0 and serving.search_all(df.limit(0), asked).count() == 0


def test_search(spark):
    rows = [("42218", "Saint-Étienne", 170000), ("76575", "Saint-Étienne-du-Rouvray", 28000), ("2A004", "Ajaccio", 70000), ("10387", "Troyes", 60000)]
    df = spark.createDataFrame(rows, "code string, name string, population int").withColumn("entity", F.col("code"))
    names = lambda q: [r.name for r in serving.search(df, q).collect()]
    assert names("st etienne") == ["Saint-Étienne", "Saint-Étienne-du-Rouvray"]
    assert names("2a0") == ["Ajaccio"] and names("ROUVRAY") == ["Saint-Étienne-du-Rouvray"] and names(" ") == []


def test_history_model_is_shown_on_test_only():
    assert serving.model_allowed(2024, (2006, 2019, 2022)) == "test"
    for year in (1999, 2010, 2021):
        with pytest.raises(ValueError):
            serving.model_allowed(year, (2006, 2019, 2022))


def test_wide_bands(spark):
    e = spark.createDataFrame([("a", -1.0, 1.0), ("b", 0.0, 1.0), ("c", 599.9, 1.0), ("d", 600.0, 1.0), ("e", None, 1.0)], "entity string, alt double, area_km2 double")
    days = spark.createDataFrame([("b", dt.date(2020, 1, 1), 2, 10000.0)], "entity string, day date, n long, size double")
    out = {r.band: (r.entities, r.events, r.ha) for r in eda.equal_width_bands(e, days, "alt", 0, 600, 12).collect()}
    assert out == {0: (1, 0, 0.0), 1: (1, 2, 1.0), 12: (1, 0, 0.0), 13: (1, 0, 0.0)}
    assert math.isclose(eda.distribution(days, "size").first().p50, 10000.0)


def test_a_whole_split_is_scored(spark):
    """A row for each entity and day of the validation year, with the positives that the events give."""
    import duckdb

    from panelrisk.plans.catalogue import REGISTRY
    from panelrisk.plans.roles import VAL_END

    folder = "/root/testdata/sf0.001"
    got = REGISTRY["boosted_scores"].run(spark, folder).toPandas()
    want = duckdb.sql(
        f"""SELECT c_custkey, d::DATE, count(o_orderkey) > 0 FROM '{folder}/customer.parquet', generate_series(DATE '{VAL_END}-01-01', DATE '{VAL_END}-12-31', INTERVAL 1 DAY) g(d)
        LEFT JOIN (FROM '{folder}/orders.parquet' WHERE o_orderpriority = '1-URGENT') ON o_custkey = c_custkey AND o_orderdate::DATE = d::DATE GROUP BY 1, 2"""
    ).fetchall()
    assert len(got) == len(want) and got.score.notna().all()
    assert {(r.entity, str(r.day)[:10]) for r in got.itertuples()} == {(e, str(d)) for e, d, _ in want}
    assert int(got.y.sum()) == sum(y for *_, y in want)


def test_isotonic_steps_are_monotone_means_of_their_blocks(spark):
    """Every block of the fit holds the mean of its rows, and the values are those of the max-min definition."""
    import random

    rng = random.Random(9)
    rows = [(k, rng.choice([round(rng.random(), 2), rng.random()]), int(rng.random() < 0.3)) for k in range(700)] + [(900, None, 1), (901, 0.5, None)]
    df = spark.createDataFrame(rows, "id long, p double, y int").repartition(6)
    steps = calibration.isotonic_steps(df, "p", "y").first()
    groups = {}
    for _, p, y in rows:
        if p is not None:
            n, s = groups.get(p, (0, 0))
            groups[p] = n + 1, s + (y or 0)
    scores = sorted(groups)
    cum = [(0, 0)]
    for p in scores:
        cum.append((cum[-1][0] + groups[p][0], cum[-1][1] + groups[p][1]))
    means = lambda i, j: (cum[j + 1][1] - cum[i][1]) / (cum[j + 1][0] - cum[i][0])
    least = [[0.0] * len(scores) for _ in scores]
    for i in range(len(scores)):
        low = math.inf
        for j in range(len(scores) - 1, i - 1, -1):
            low = min(low, means(i, j))
            least[i][j] = low
    want = {p: max(least[i][k] for i in range(k + 1)) for k, p in enumerate(scores)}
    out = calibration.refitted(df, "p", "y").collect()
    assert all(r.calibrated is None if r.p is None else abs(r.calibrated - want[r.p]) < 1e-12 for r in out)
    assert list(steps.boundaries) == sorted(steps.boundaries) and list(steps.values) == sorted(steps.values)
    blocks = list(zip(steps.boundaries[::2], steps.boundaries[1::2], steps.values[::2]))
    for low, high, value in blocks:
        own = [groups[p] for p in scores if low <= p <= high]
        assert abs(value - sum(s for _, s in own) / sum(n for n, _ in own)) < 1e-12
    model = calibration.Isotonic(calibration.isotonic_steps(df, "p", "y"))
    ask = [(-1.0,), (2.0,), ((blocks[1][1] + blocks[2][0]) / 2,)]
    got = [r.calibrated for r in model.apply(spark.createDataFrame(ask, "p double").coalesce(1), "p").collect()]
    assert got[0] == blocks[0][2] and got[1] == blocks[-1][2] and abs(got[2] - (blocks[1][2] + blocks[2][2]) / 2) < 1e-12


def test_isotonic_of_no_rows(spark):
    df = spark.createDataFrame([], "p double, y int")
    assert calibration.refitted(df, "p", "y").collect() == []


def test_residual_autocorrelation_equals_numpy(spark):
    """Harmonics by least squares, autocorrelation of the rest, and partial ones by solving the Yule-Walker equations."""
    import os

    import numpy as np
    import pytest as test

    from panelrisk.plans.catalogue import REGISTRY

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        test.skip("supplied tables are absent")
    left = {np.datetime64(r.day): r.residual for r in REGISTRY["deseasonalised"].run(spark, folder).collect()}
    mean = sum(left.values()) / len(left)
    # Days without a measure are holes of the series: a lag is one of the calendar.
    acf = np.array([sum((x - mean) * (left[d - k] - mean) for d, x in left.items() if d - k in left) for k in range(13)])
    acf /= acf[0]
    got = {r.lag: r for r in REGISTRY["residual_autocorrelation"].run(spark, folder).collect()}
    assert sorted(got) == list(range(1, 13))
    for k in range(1, 13):
        square = np.array([[acf[abs(i - j)] for j in range(k)] for i in range(k)])
        assert got[k].acf == test.approx(acf[k], abs=2e-6)
        assert got[k].pacf == test.approx(np.linalg.solve(square, acf[1 : k + 1])[-1], abs=2e-5)
        assert got[k].significant == (abs(got[k].pacf) > got[k].band)


def test_equal_names_and_texts_are_searched_once(spark):
    """Before, each search of a text met each entity of a name: as many rows as both together squared."""
    df = spark.range(400).select(F.col("id").alias("entity"), F.lit("Saint-Ouen").alias("name"), (F.col("id") % 50).alias("population"), F.lit("93400").alias("code"))
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.when(F.col("id") < 150, "t-Ouen").otherwise("934").alias("text"))
    found = serving.search_all(df, asked, limit=2, codes=("code",))
    assert {tuple(r) for r in found.filter("query_id IN (3, 200)").collect()} == {(q, r, e, k) for q, k in ((3, "name"), (200, "code")) for r, e in ((1, 49), (2, 99))}
    assert found.count() == 600
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Window [row_number()") >= 4, text  # entities of a name and of a prefix, of a text, of a query


def test_trajectories_of_a_crowded_cell_are_dealt(spark):
    """Before, all entities of a cell were one key, or one task where the join was a broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entities = spark.range(9000).select(F.col("id").alias("entity"), (F.col("id") % 1 + 1).alias("cell"))
        climate = spark.createDataFrame([(1, 227, 10.0)], "cell int, doy int, fwi double")
        factors = spark.createDataFrame([(1, y, "low", 1.0 + y / 10000, None, None) for y in (2001, 2002)], "cell int, year int, scenario string, k double, k_low double, k_high double")
        out = serving.trajectory(entities, climate, factors, 227, ("fwi",), 2001)
        per_task = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(per_task) == 36000 and max(per_task) < 30000
        assert out.filter("entity = 7").count() == 4 and out.filter("entity = 7 AND observed").first()["fwi"] == pytest.approx(12.001)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_vectors_are_filled_in_batches(spark):
    """Before, each column was its own case in one method; a value without a median still stops the job."""
    from panelrisk.operators import models

    rows = spark.createDataFrame([(1.0, None, 3), (None, 5.0, None), (float("inf"), -0.0, 7)], "a double, b double, c int")
    medians = spark.createDataFrame([(2.5, 4.5, 6.5)], "a double, b double, c double")
    prepared = models.Model(None, ["a", "b", "c"], medians).prepare(rows)
    assert [list(r.features) for r in prepared.collect()] == [[1.0, 4.5, 3.0], [2.5, 5.0, 6.5], [float("inf"), 0.0, 7.0]]
    assert "coalesce" not in prepared._jdf.queryExecution().optimizedPlan().toString()
    unknown = spark.createDataFrame([(2.5, None, 6.5)], "a double, b double, c double")
    with pytest.raises(Exception, match="neither a number nor has a median"):
        models.Model(None, ["a", "b", "c"], unknown).prepare(rows).collect()


@pytest.mark.parametrize("most, tasks", [(10, 5), (50_000, None)])
def test_profile_is_dealt_to_many_tasks(spark, monkeypatch, most, tasks):
    """Entities of one cell and department, in one partition: each task that reads the profile gets few of them."""
    from types import SimpleNamespace

    from panelrisk.plans import model_queries as mq

    monkeypatch.setattr(mq, "PROFILE_ROWS", most, raising=False)
    entities = spark.range(50).coalesce(1).selectExpr(
        "id AS entity", "1 AS dep", "2 AS cell", "id * 1D AS alt_mean", "0 AS alt_min", "id AS alt_max", "1D + id AS area_km2", "1D AS density",
        "1 AS density_grid", "40D + id AS lat", "2D AS lon",
    )
    shares = spark.sql("SELECT 1 AS dep, 1995 AS vintage, 0.1D AS share_standard, 0.2D AS share_economy, 0.3D AS share_promo")
    measures = spark.sql("SELECT 2 AS cell, DATE '1996-05-01' AS day, 30D AS fwi")
    found = mq.profile(SimpleNamespace(entities=entities, shares=shares, measures=measures))
    sizes = [n for n in found.rdd.glom().map(len).collect() if n]
    assert sum(sizes) == 50 and found.select("entity").distinct().count() == 50
    assert len(sizes) == (tasks or len(sizes)) and (tasks is None or max(sizes) <= 2 * most)
