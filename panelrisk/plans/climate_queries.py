"""Climatology, factors, trends, series and serving reads on the supplied tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from panelrisk.operators import climate, eda, series, serving, smoothing
from panelrisk.operators.features import history_at
from panelrisk.operators.reshape import replicate
from panelrisk.plans.metric_queries import rates
from panelrisk.plans.panel_queries import SITES_SQL, _sites
from panelrisk.plans.registry import query
from panelrisk.plans.roles import END, FIT_END, INDICES, JUDGE_YEAR, START, TRAIN_STOP
from panelrisk.session import cut_lineage

PERIODS = ((1995, 1996), (1997, 1999), (2000, 2001))
ANCHORS = (2038, 2058, 2092)
SCENARIOS = ("low", "high")


@query("A18 W6 W7", "cell:i doy:i fwi:f ffmc:f dmc:f dc:f fwi_d1:f ffmc_d1:f", "SELECT * FROM clim")
def climatology(t):
    return climate.climatology(t.measures, INDICES)


@query(
    "A4 L1",
    "cell:i fwi_mean:f fwi_p90:f days_high:f",
    """SELECT cell, avg(fwi) AS fwi_mean, quantile_cont(fwi, 0.9) AS fwi_p90, count(*) FILTER (fwi > 21.3) / 4.0::DOUBLE AS days_high
       FROM measures WHERE day BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' GROUP BY 1""",
)
def cell_climate(t):
    return climate.cell_climate(t.measures, START, TRAIN_STOP)


@query(
    "A19 V7",
    "cell:i period:s mean:f p90:f days_high:f days_very_high:f",
    """SELECT cell, CASE WHEN year(day) <= 1996 THEN '1995-1996' WHEN year(day) <= 1999 THEN '1997-1999' ELSE '2000-2001' END AS period, avg(fwi) AS mean, quantile_cont(fwi, 0.9) AS p90,
              count(*) FILTER (fwi > 21.3)::DOUBLE / count(DISTINCT year(day)) AS days_high, count(*) FILTER (fwi > 38)::DOUBLE / count(DISTINCT year(day)) AS days_very_high
       FROM measures GROUP BY 1, 2""",
)
def period_statistics(t):
    return climate.period_stats(t.measures, PERIODS)


ANNUAL_SQL = """a AS (SELECT year(day) AS x, 'mean of the year' AS series, avg(fwi) AS y FROM measures GROUP BY 1
    UNION ALL SELECT year(day), 'mean June-September', avg(fwi) FROM measures WHERE month(day) BETWEEN 6 AND 9 GROUP BY 1
    UNION ALL SELECT year(day), 'days over the bound', count(*) FILTER (fwi > 21.3)::DOUBLE / count(DISTINCT cell) FROM measures GROUP BY 1
    UNION ALL SELECT year(day), 'event days', count(*)::DOUBLE FROM days GROUP BY 1)"""


@query("A20", "x:i series:s y:f", f"WITH {ANNUAL_SQL} SELECT * FROM a")
def annual_series(t):
    return climate.annual_series(t.measures, t.days)


@query(
    "TS10 TS11",
    "series:s slope:f intercept:f3 r2:f first:i last:i start_value:f end_value:f change_pct:f",
    f"""WITH {ANNUAL_SQL}, r AS (SELECT series, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, min(x) AS first, max(x) AS last FROM a GROUP BY 1)
        SELECT *, intercept + slope * first AS start_value, intercept + slope * last AS end_value, 100 * slope * (last - first) / (intercept + slope * first) AS change_pct FROM r""",
)
def annual_trends(t):
    return series.trend(climate.annual_series(t.measures, t.days), by=["series"])


@query("TS10", "series:s p_value:f significant:b n:i")
def trend_significance(t):
    return series.trend(climate.annual_series(t.measures, t.days), by=["series"])


@query("A21 J27", "cell:i year:i k:f", "SELECT * FROM factors_obs")
def observed_factors(t):
    return climate.observed_factors(t.measures, START, TRAIN_STOP)


RECENT_SQL = """rec AS (SELECT cell, avg(k) AS k_now, least(greatest(quantile_cont(k, 0.1) / avg(k), 0.3), 1) AS r_low, least(greatest(quantile_cont(k, 0.9) / avg(k), 1), 3) AS r_high
    FROM factors_obs WHERE year BETWEEN 1997 AND 2001 GROUP BY 1)"""


@query("A22", "cell:i k_now:f r_low:f r_high:f", f"WITH {RECENT_SQL} SELECT * FROM rec")
def recent_levels(t):
    return climate.recent_level(climate.observed_factors(t.measures, START, TRAIN_STOP), 1997, 2001)


def _maps(t):
    """Yearly values per (scenario, horizon, site) read off the line items; one site in seven has gaps."""
    rows = t.table("lineitem").select(F.col("l_suppkey").alias("site"), F.year("l_shipdate").alias("y"), F.col("l_quantity").alias("q"))
    yearly = rows.groupBy("site", "y").agg(F.avg("q").alias("q")).withColumn(
        "value", F.when((F.col("site") % 7 == 0) & (F.col("y") == 1996), F.lit(float("nan"))).otherwise(F.col("q"))
    )
    scenario = F.when(F.col("y") <= 1997, "historical").when(F.col("y") <= 1999, "low").otherwise("high")
    return yearly.select("site", scenario.alias("scenario"), F.lit(2058).alias("horizon"), "value")


MAPS_SQL = """mp AS (SELECT site, CASE WHEN y <= 1997 THEN 'historical' WHEN y <= 1999 THEN 'low' ELSE 'high' END AS scenario, avg(q) AS value
    FROM (SELECT l_suppkey AS site, year(l_shipdate) AS y, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2) WHERE NOT (site % 7 = 0 AND y = 1996) GROUP BY 1, 2)"""


@query("CL1", "scenario:s horizon:i site:i value:f", f"WITH {MAPS_SQL} SELECT scenario, 2058 AS horizon, site, value FROM mp")
def mean_maps(t):
    return climate.mean_maps(_maps(t))


# Cells get the mean position of their entities.
CELLS_SQL = """ce AS (SELECT cell, round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon FROM entities GROUP BY 1)"""


def _cells(t):
    return t.entities.groupBy("cell").agg(F.round(F.avg("lat"), 4).alias("lat"), F.round(F.avg("lon"), 4).alias("lon"))


RATIO_SQL = f"""{SITES_SQL}, {MAPS_SQL}, {CELLS_SQL},
    nn AS (SELECT cell, arg_min(h.site, (d, h.site)) AS site, min(d) AS dist_deg FROM
           (SELECT ce.cell, s.site, sqrt(pow(ce.lat - site_lat, 2) + pow(ce.lon - site_lon, 2)) AS d FROM ce, sites s JOIN mp ON mp.site = s.site AND mp.scenario = 'historical' AND mp.value > 0) h GROUP BY 1),
    ra AS (SELECT nn.cell, f.scenario, f.value / p.value AS k, nn.dist_deg FROM nn JOIN mp p ON p.site = nn.site AND p.scenario = 'historical' JOIN mp f ON f.site = nn.site AND f.scenario <> 'historical')"""


def _ratios(t):
    # Read three times: written once, a row for each site and scenario.
    return climate.delta_ratios(_cells(t), cut_lineage(climate.mean_maps(_maps(t))), _sites(t))


@query("CL2 J18", "cell:i scenario:s k:f dist_deg:f", f"WITH {RATIO_SQL} SELECT * FROM ra")
def delta_ratios(t):
    return _ratios(t)


@query(
    "CL3",
    "cell:i scenario:s days_over:f",
    f"""WITH {RATIO_SQL} SELECT m.cell, scenario, count(*) FILTER (fwi > 21.3 / greatest(k, 1e-6)) / 4.0::DOUBLE AS days_over
        FROM measures m JOIN ra ON ra.cell = m.cell WHERE m.day <= DATE '1998-12-31' GROUP BY 1, 2""",
)
def shifted_days(t):
    past = t.measures.filter(F.col("day") <= F.lit(TRAIN_STOP).cast("date"))
    return climate.days_over(past, _ratios(t).drop("dist_deg"), 4)


@query(
    "CL4",
    "ratio_of_means:f mean_of_ratios:f",
    f"""WITH {RATIO_SQL}, c AS (SELECT cell, avg(fwi) AS m FROM measures GROUP BY 1)
        SELECT avg(m * k) / avg(m) AS ratio_of_means, avg(k) AS mean_of_ratios FROM entities JOIN c USING (cell) JOIN ra USING (cell) WHERE scenario = 'high'""",
)
def mean_ratio_forms(t):
    level = t.measures.groupBy("cell").agg(F.avg("fwi").alias("m"))
    high = _ratios(t).filter("scenario = 'high'").select("cell", "k")
    return climate.mean_ratio_forms(t.entities.join(level, "cell").join(high, "cell"), "m", "k")


def _factors(t):
    """Three anchor years per scenario, spread around the measured ratio."""
    ratios = _ratios(t).drop("horizon", "dist_deg")
    steps = F.array(*[F.struct(F.lit(a).alias("horizon"), F.lit(w).alias("w")) for a, w in zip(ANCHORS, (0.5, 1.0, 1.5))])
    spread = ratios.select("cell", "scenario", "k", F.explode(steps).alias("s"))
    spread = spread.select("cell", "scenario", F.col("s.horizon").alias("horizon"), (F.lit(1.0) + (F.col("k") - 1) * F.col("s.w")).alias("k"))
    observed = cut_lineage(climate.observed_factors(t.written_measures, START, TRAIN_STOP))
    return climate.level_factors(observed, spread, ANCHORS, SCENARIOS, (1997, 2001), 2002, 2100)


FACTORS_SQL = f"""{RATIO_SQL}, {RECENT_SQL},
    an AS (SELECT ra.cell, scenario, k_now, r_low, r_high, 1 + (k - 1) * 0.5 AS k1, k AS k2, 1 + (k - 1) * 1.5 AS k3 FROM ra JOIN rec USING (cell)),
    fu AS (SELECT cell, year, scenario, k_now * CASE WHEN year <= 2038 THEN 1 + (k1 - 1) * (year - 2001) / 37.0::DOUBLE WHEN year <= 2058 THEN k1 + (k2 - k1) * (year - 2038) / 20.0::DOUBLE
               WHEN year <= 2092 THEN k2 + (k3 - k2) * (year - 2058) / 34.0::DOUBLE ELSE k3 END AS k, r_low, r_high FROM an, (SELECT unnest(range(2002, 2101)) AS year)),
    fa AS (SELECT cell, year, s.scenario, k, NULL::DOUBLE AS k_low, NULL::DOUBLE AS k_high FROM factors_obs, (SELECT unnest(['low', 'high']) AS scenario) s
           UNION ALL SELECT cell, year, scenario, k, k * r_low, k * r_high FROM fu)"""


@query("CL8 F11", "cell:i year:i scenario:s k:f k_low:f k_high:f", f"WITH {FACTORS_SQL} SELECT * FROM fa")
def level_factors(t):
    return _factors(t)


# ---- daily series ------------------------------------------------------------------------------


def daily(t):
    return series.daily_series(t.days, t.measures, START, END)


@query("A17 TS1", "day:d events:i fwi:f danger_share:f", "SELECT day, events, fwi, danger_share FROM daily")
def daily_series(t):
    return daily(t)


@query(
    "TS2 F6",
    "day:d " + " ".join(f"sin{k}:f cos{k}:f" for k in (1, 2, 3, 4)),
    "SELECT day, " + ", ".join(f"sin(2 * pi() * {k} * doy / 365.25::DOUBLE) AS sin{k}, cos(2 * pi() * {k} * doy / 365.25::DOUBLE) AS cos{k}" for k in (1, 2, 3, 4)) + " FROM daily",
)
def fourier_terms(t):
    return series.fourier(daily(t))


@query(
    "W16",
    "day:d anomaly:f",
    "SELECT day, fwi - avg(fwi) OVER (PARTITION BY doy) AS anomaly FROM daily",
)
def daily_anomaly(t):
    return series.anomaly(daily(t).withColumn("doy", F.dayofyear("day")), "fwi")


@query(
    "W17",
    "day:d diff:f",
    "SELECT day, fwi - lag(fwi) OVER (ORDER BY day) AS diff FROM daily",
)
def daily_difference(t):
    return series.first_difference(daily(t), "fwi", "day")


ACF_SQL = """z AS (SELECT {cols} day, x - avg(x) OVER ({part}) AS z, count(*) OVER ({part}) AS n FROM {src}),
    p AS (SELECT {a} k AS lag, sum(a.z * b.z) AS c, max(a.n) AS n FROM z a, (SELECT unnest(range(0, {lags}))::INT AS k), z b WHERE b.day = a.day - k {same} GROUP BY ALL)"""


@query(
    "TS4",
    "lag:i acf:f band:f",
    "WITH s AS (SELECT day, events AS x FROM daily), "
    + ACF_SQL.format(cols="", part="", src="s", a="", lags=61, same="")
    + " SELECT lag, c / (SELECT c FROM p WHERE lag = 0) AS acf, 1.96 / sqrt(n) AS band FROM p",
)
def autocorrelation(t):
    return series.acf(daily(t), "events", lags=60)


def _index_series(t):
    """One anomaly series per index: the daily mean over cells minus its mean for the day of the year."""
    mean = t.measures.groupBy("day").agg(*[F.avg(c).alias(c) for c in INDICES])
    long = mean.unpivot(["day"], list(INDICES), "series", "x").withColumn("doy", F.dayofyear("day"))
    norm = long.groupBy("series", "doy").agg(F.avg("x").alias("m"))
    return long.join(norm, ["series", "doy"]).select("series", "day", (F.col("x") - F.col("m")).alias("x"))


@query(
    "TS5 TS4",
    "series:s tau:i",
    "WITH m AS (SELECT day, avg(fwi) AS fwi, avg(ffmc) AS ffmc, avg(dmc) AS dmc, avg(dc) AS dc FROM measures GROUP BY 1), "
    "l AS (UNPIVOT m ON fwi, ffmc, dmc, dc INTO NAME series VALUE v), "
    "s AS (SELECT series, day, v - avg(v) OVER (PARTITION BY series, dayofyear(day)) AS x FROM l), "
    + ACF_SQL.format(cols="series,", part="PARTITION BY series", src="s", a="a.series,", lags=31, same="AND b.series = a.series")
    + " SELECT p.series, min(p.lag) FILTER (p.c / o.c < exp(-1.0::DOUBLE)) AS tau FROM p JOIN p o ON o.series = p.series AND o.lag = 0 GROUP BY 1",
)
def decorrelation_times(t):
    return series.decorrelation_time(series.acf(_index_series(t), "x", lags=30, by=["series"]), by=["series"])


@query("TS6", "series:s lag:i pacf:f")
def partial_autocorrelation(t):
    return series.pacf(series.acf(_index_series(t), "x", lags=12, by=["series"]))


@query("TS3", "day:d events:f residual:f")
def deseasonalised(t):
    return series.deseasonalise(daily(t), "events")


@query("TS7", "series:s statistic:f critical_5pct:f lags:i")
def unit_root_statistics(t):
    """Level, first difference and yearly totals of the event series, and the level of the measure."""
    d = daily(t)
    yearly = series.resample(d, "events").select("year", "total")
    tests = {
        "events": series.unit_root(d, "events"),
        "fwi": series.unit_root(d, "fwi"),
        "events, differenced": series.unit_root(series.first_difference(d, "events", "day"), "diff"),
        "events per year": series.unit_root(yearly, "total", "year", lags=0),
    }
    rows = [(n, r["statistic"], r["critical_5pct"], int(r["lags"])) for n, r in tests.items()]
    return t.spark.createDataFrame(rows, "series string, statistic double, critical_5pct double, lags int")


@query("TS8", "model:s mae:f rmse:f r:f rows:i")
def autoregressive_forecasts(t):
    from panelrisk.operators.metrics import regression_errors

    return regression_errors(series.arx_forecasts(daily(t), "events", FIT_END, (1998, 1999)), "predicted", "actual", ["model"])


@query(
    "TS9",
    "day:d actual:f predicted:f",
    f"""SELECT d.day, d.events AS actual, m.p AS predicted FROM daily d JOIN (SELECT doy, avg(events) AS p FROM daily WHERE year <= {FIT_END} GROUP BY 1) m USING (doy) WHERE d.year = {JUDGE_YEAR}""",
)
def seasonal_forecast(t):
    return series.seasonal_forecast(daily(t), "events", FIT_END, (JUDGE_YEAR, JUDGE_YEAR))


@query(
    "TS12",
    "year:i mean:f total:f",
    "SELECT year, avg(fwi) AS mean, sum(fwi) AS total FROM daily WHERE month BETWEEN 6 AND 8 GROUP BY 1",
)
def summer_resample(t):
    return series.resample(daily(t), "fwi", months=(6, 8))


# ---- serving -----------------------------------------------------------------------------------

CLASS_SQL = "CASE WHEN {x} < 5.2 THEN 1 WHEN {x} < 11.2 THEN 2 WHEN {x} < 21.3 THEN 3 WHEN {x} < 38 THEN 4 WHEN {x} < 50 THEN 5 ELSE 6 END"
SCALED = ("fwi", "ffmc", "dmc", "dc", "fwi_d1", "ffmc_d1")


@query(
    "V1",
    "cell:i fwi:f ffmc:f dmc:f dc:f fwi_d1:f ffmc_d1:f danger_class:i",
    f"""WITH {FACTORS_SQL}, v AS (SELECT c.cell, {", ".join(f"c.{x} * coalesce(k, 1) AS {x}" for x in SCALED)}
            FROM clim c LEFT JOIN fa ON fa.cell = c.cell AND fa.year = 2050 AND fa.scenario = 'high' WHERE c.doy = 214)
        SELECT *, {CLASS_SQL.format(x="fwi")} AS danger_class FROM v""",
)
def projected_day(t):
    return serving.measures_on(climate.climatology(t.measures, INDICES), _factors(t), "2050-08-02", "high", SCALED)


@query(
    "V1",
    "cell:i day:d fwi:f ffmc:f fwi_d1:f ffmc_d1:f danger_class:i",
    f"""SELECT m.cell, m.day, m.fwi, m.ffmc, b.fwi AS fwi_d1, b.ffmc AS ffmc_d1, {CLASS_SQL.format(x="m.fwi")} AS danger_class
        FROM measures m LEFT JOIN measures b ON b.cell = m.cell AND b.day = m.day - 1 WHERE m.day = DATE '2000-08-02'""",
)
def observed_day(t):
    return serving.observed_on(t.measures, "2000-08-02", INDICES)


@query(
    "V2 P6",
    "entity:i events_7d:i events_30d:i events_90d:i events_365d:i days_since_event:i",
    """SELECT entity, coalesce(events_7d, 0) AS events_7d, coalesce(events_30d, 0) AS events_30d, coalesce(events_90d, 0) AS events_90d, coalesce(events_365d, 0) AS events_365d,
              coalesce(days_since_event, 9999) AS days_since_event FROM entities LEFT JOIN (SELECT * FROM lags WHERE day = DATE '1999-08-02') USING (entity)""",
)
def history_on_day(t):
    return history_at(t.days, t.entities, "1999-08-02")


@query(
    "V3",
    "entity:i score:f rank_pct:f",
    """WITH s AS (SELECT e.entity, m.fwi / 60 + coalesce(h.events_365d, 0) / 10.0::DOUBLE AS score FROM entities e JOIN measures m ON m.cell = e.cell AND m.day = DATE '2000-08-02'
                  LEFT JOIN lags h ON h.entity = e.entity AND h.day = DATE '2000-08-02')
       SELECT *, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) / count(*) OVER () AS rank_pct FROM s""",
)
def ranked_day(t):
    weather = serving.observed_on(t.measures, "2000-08-02", INDICES)
    features = serving.day_features(t.entities, weather, t.days, "2000-08-02")
    return serving.rank_day(features, F.col("fwi") / 60 + F.col("events_365d") / 10.0)


@query(
    "V4",
    "entity:i year:i scenario:s variant:s observed:b fwi:f danger_class:i",
    f"""WITH {FACTORS_SQL}, v AS (SELECT cell, year, scenario, unnest(['centre', 'low', 'high']) AS variant, unnest([k, coalesce(k_low, k), coalesce(k_high, k)]) AS k FROM fa),
        w AS (SELECT e.entity, v.year, v.scenario, v.variant, v.year <= 2001 AS observed, c.fwi * v.k AS fwi FROM v JOIN clim c ON c.cell = v.cell AND c.doy = 227 JOIN entities e ON e.cell = v.cell
              WHERE v.year > 2001 OR variant = 'centre')
        SELECT *, {CLASS_SQL.format(x="fwi")} AS danger_class FROM w""",
)
def entity_trajectories(t):
    """Trajectories of all entities on 15 August."""
    return serving.trajectory(t.entities, climate.climatology(t.written_measures, INDICES), _factors(t), 227, ("fwi",), 2001)


@query(
    "V7 A50",
    "period:s mean:f days_high:f",
    """SELECT period, avg(mean) AS mean, avg(days_high) AS days_high FROM (
           SELECT cell, CASE WHEN year(day) <= 1996 THEN '1995-1996' WHEN year(day) <= 1999 THEN '1997-1999' ELSE '2000-2001' END AS period, avg(fwi) AS mean,
                  count(*) FILTER (fwi > 21.3)::DOUBLE / count(DISTINCT year(day)) AS days_high FROM measures GROUP BY 1, 2) GROUP BY 1""",
)
def national_periods(t):
    return climate.period_stats(t.measures, PERIODS).groupBy("period").agg(F.avg("mean").alias("mean"), F.avg("days_high").alias("days_high"))


@query(
    "V9 P8",
    "cell:i day:d fwi:f4 ffmc:f4",
    "SELECT cell, day, fwi::FLOAT AS fwi, ffmc::FLOAT AS ffmc FROM measures WHERE day BETWEEN DATE '1999-12-31' AND DATE '2001-08-01'",
)
def weather_export(t):
    return serving.weather_export(t.measures, "2000-01-01", END, INDICES)


@query(
    "S22",
    "entity:i name:s share_economy:f cluster:i cluster_rate:f9 entity_rate:f9 events:i ha:f3",
    """SELECT e.entity, e.name, s.share_economy, r.cluster, r.cluster_rate, r.entity_rate, coalesce(t.n, 0) AS events, t.ha
       FROM entities e LEFT JOIN shares s ON s.dep = e.dep AND s.vintage = 1999 LEFT JOIN (SELECT * FROM rates WHERE excluded_year = 0) r USING (entity)
       LEFT JOIN (SELECT entity, sum(n) AS n, sum(size) / 10000 AS ha FROM days GROUP BY 1) t USING (entity)""",
)
def serving_table(t):
    shares = t.shares.filter("vintage = 1999").select("dep", "share_economy")
    shifted = t.entities.select("entity", F.col("cell").alias("future_cell"))
    return serving.serving_entities(t.entities, shares, rates(t), shifted, eda.event_totals(t.days))


@query(
    "CL7",
    "scenario:s moving:i moving_share:f mean_now:f9 mean_future:f9 rising_share:f",
    """WITH k AS (SELECT DISTINCT cluster, cluster_rate FROM rates WHERE excluded_year = 0), s AS (SELECT unnest(['low', 'high']) AS scenario),
       a AS (SELECT s.scenario, c.cluster, CASE WHEN s.scenario = 'high' AND e.lat < 44 THEN (SELECT max(cluster) FROM k) ELSE c.cluster END AS f FROM s, all_clusters c JOIN entities e USING (entity))
       SELECT scenario, count(*) FILTER (a.cluster <> a.f) AS moving, avg((a.cluster <> a.f)::INT) AS moving_share, avg(n.cluster_rate) AS mean_now, avg(t.cluster_rate) AS mean_future,
              avg((t.cluster_rate > n.cluster_rate)::INT) AS rising_share FROM a JOIN k n ON n.cluster = a.cluster JOIN k t ON t.cluster = a.f GROUP BY 1""",
)
def risk_transfer(t):
    return climate.transfer_summary(transferred(t))


def transferred(t):
    """Risk carried over when the southern entities of the high scenario take the last cluster."""
    clusters = smoothing.with_fallback_cluster(t.counts, t.clusters)
    k = rates(t).filter("excluded_year = 0").select("cluster", "cluster_rate").distinct()
    last = clusters.agg(F.max("cluster").alias("m")).scalar()
    rows = replicate(clusters.join(t.entities.select("entity", "lat"), "entity"), "scenario", SCENARIOS)
    moved = F.when((F.col("scenario") == "high") & (F.col("lat") < 44), last).otherwise(F.col("cluster"))
    return climate.risk_transfer(rows.withColumn("cluster_future", moved), k)


@query(
    "CL7",
    "entity:i cluster:i cluster_future:i risk_now:f9 risk_future:f9 gain:f",
    """WITH k AS (SELECT DISTINCT cluster, cluster_rate FROM rates WHERE excluded_year = 0),
       a AS (SELECT c.entity, c.cluster, (SELECT max(cluster) FROM k) AS cluster_future FROM all_clusters c JOIN entities e USING (entity) WHERE e.lat < 44)
       SELECT a.entity, a.cluster, a.cluster_future, n.cluster_rate AS risk_now, t.cluster_rate AS risk_future, t.cluster_rate / n.cluster_rate AS gain
       FROM a JOIN k n ON n.cluster = a.cluster JOIN k t ON t.cluster = a.cluster_future WHERE a.cluster <> a.cluster_future
       ORDER BY round(t.cluster_rate / n.cluster_rate, 9) DESC, a.entity LIMIT 8""",
)
def largest_shifts(t):
    return climate.largest_shifts(transferred(t).filter("scenario = 'high'"), "entity", 8)


@query("TS4 TS6", "lag:i acf:f band:f pacf:f significant:b")
def residual_autocorrelation(t):
    """Autocorrelation of what the harmonics leave of the event series, to lag 12."""
    left = cut_lineage(series.deseasonalise(daily(t), "events").select(F.lit("residual").alias("series"), "day", "residual"))
    own = series.acf(left, "residual", lags=12, by=["series"])
    partial = series.pacf(own).select("lag", "pacf")
    return own.join(partial, "lag").withColumn("significant", F.abs("pacf") > F.col("band"))
