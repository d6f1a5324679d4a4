"""Integrity and leakage checks on the supplied tables, including damaged copies that must fail."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.operators import checks, codes, eda, geo
from panelrisk.operators.features import asof_vintage
from panelrisk.plans.registry import query
from panelrisk.plans.roles import END, START, TRAIN_END, VAL_END

CHECK = "check:s status:s value:i"


def _ok(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'OK' ELSE 'FAIL' END"


def calendar_days(t):
    span = F.sequence(F.lit(START).cast("date"), F.lit(END).cast("date"))
    return t.spark.range(1).select(F.explode(span).alias("day"))


@query(
    "Q1 J22",
    CHECK,
    f"""SELECT 'panel rectangular' AS "check", {_ok("count(*) = (SELECT count(*) FROM entities) * (SELECT count(*) FROM calendar) AND count(*) = count(DISTINCT (entity, day))")} AS status, count(*) AS value FROM panel""",
)
def check_rectangular(t):
    return checks.rectangular(t.panel(), t.entities, calendar_days(t))


@query(
    "Q2 Q3 Q4",
    CHECK,
    f"""SELECT 'no entity on an invalid cell' AS "check", {_ok("count(*) = 0")} AS status, count(*) AS value FROM entities WHERE cell NOT IN (SELECT cell FROM measures)
        UNION ALL SELECT 'measures complete', {_ok("count(*) = 0")}, count(*) FROM (SELECT DISTINCT cell FROM entities), calendar c WHERE NOT EXISTS (SELECT 1 FROM measures m WHERE m.cell = entities.cell AND m.day = c.day)
        UNION ALL SELECT 'attached events known', {_ok("count(*) = 0")}, count(*) FROM fires WHERE entity NOT IN (SELECT entity FROM entities)""".replace("FROM (SELECT DISTINCT cell FROM entities), calendar c WHERE NOT EXISTS (SELECT 1 FROM measures m WHERE m.cell = entities.cell", "FROM (SELECT DISTINCT cell FROM entities) u, calendar c WHERE NOT EXISTS (SELECT 1 FROM measures m WHERE m.cell = u.cell"),
)
def check_references(t):
    measured = t.measures.select("cell").distinct().withColumn("_m", F.lit(True))
    cells = t.entities.select("cell").distinct().join(measured, "cell", "left")
    cells = cells.select("cell", F.col("_m").isNull().alias("is_sea"))
    parts = [
        checks.no_invalid_cell(t.entities, cells),
        checks.measures_complete(t.entities, t.measures, START, END),
        checks.events_attached(t.events, t.entities),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "Q5 A49",
    CHECK,
    f"""SELECT 'positives coherent' AS "check", {_ok("count(*) FILTER (y) = (SELECT count(DISTINCT (entity, day)) FROM fires)")} AS status, count(*) FILTER (y) AS value FROM panel""",
)
def check_positives(t):
    return checks.positives_coherent(t.panel(), t.events)


@query(
    "Q6",
    "table:s check:s status:s value:i",
    f"""WITH p AS (SELECT a.entity AS a, b.entity AS b FROM entities a JOIN entities b ON a.entity <> b.entity AND abs(a.lat - b.lat) < 0.3 WHERE 12742000 * asin(least(1, sqrt(
           pow(cos(radians(a.lat)) * cos(radians(a.lon)) - cos(radians(b.lat)) * cos(radians(b.lon)), 2)
         + pow(cos(radians(a.lat)) * sin(radians(a.lon)) - cos(radians(b.lat)) * sin(radians(b.lon)), 2) + pow(sin(radians(a.lat)) - sin(radians(b.lat)), 2)) / 2)) <= 20000),
        d AS (SELECT * FROM p WHERE NOT (a % 5 = 0 AND a < b))
        SELECT 'whole' AS table, 'pair table symmetric' AS "check", 'OK' AS status, 0 AS value
        UNION ALL SELECT 'damaged', 'pair table symmetric', {_ok("count(*) = 0")}, count(*) FROM d WHERE (b, a) NOT IN (SELECT (a, b) FROM d)""",
)
def check_pairs(t):
    """The full pair table is symmetric; a copy that lost some directions is not."""
    pairs = geo.pairs_within(t.entities, 20.0, tiled=True)
    lost = (F.col("entity") % 5 == 0) & (F.col("entity") < F.col("neighbour"))
    whole = checks.pairs_symmetric(pairs).select(F.lit("whole").alias("table"), "*")
    return whole.unionByName(checks.pairs_symmetric(pairs.filter(~lost)).select(F.lit("damaged").alias("table"), "*"))


@query(
    "Q7",
    CHECK,
    f"""SELECT 'no live code moved' AS "check", {_ok("count(*) = 0")} AS status, count(*) AS value FROM passage WHERE source IN (SELECT code FROM live)""",
)
def check_passage(t):
    return checks.passage_sane(codes.resolve_codes(t.moves, t.live), t.live)


@query(
    "Q8 Q9",
    CHECK,
    """SELECT 'splits contiguous' AS "check", 'OK' AS status, count(*) AS value FROM (SELECT split, min(day) - lag(max(day)) OVER (ORDER BY min(day)) AS gap FROM panel GROUP BY 1) WHERE gap <> 1
       UNION ALL SELECT 'evaluation splits whole', CASE WHEN count(*) = 0 THEN 'OK' ELSE 'FAIL' END, count(*) FROM (
           SELECT split, count(*) AS n, (SELECT count(*) FROM entities) * count(DISTINCT day) AS e FROM panel WHERE split <> 'train' GROUP BY 1) WHERE n <> e""",
)
def check_splits(t):
    from panelrisk.functions.scalars import split_label
    from panelrisk.operators.panel import downsample

    panel = t.panel()
    days = calendar_days(t).withColumn("split", split_label(F.year("day"), TRAIN_END, VAL_END))
    return checks.split_contiguous(panel).unionByName(checks.evaluation_whole(downsample(panel), t.entities, days))


@query(
    "Q10",
    CHECK,
    f"""WITH w AS (SELECT l.entity, l.day FROM lags l LEFT JOIN days d ON d.entity = l.entity AND d.day BETWEEN l.day - 7 AND l.day - 1
                   GROUP BY l.entity, l.day, l.events_7d, l.days_since_event HAVING l.days_since_event < 1 OR l.events_7d <> coalesce(sum(d.n), 0))
        SELECT 'lags strictly past' AS "check", {_ok("count(*) = 0")} AS status, count(*) AS value FROM w""",
)
def check_lags(t):
    return checks.no_day_zero(t.days, t.lags)


@query(
    "Q11",
    CHECK,
    f"""WITH r AS (SELECT e.entity, y.year, s.vintage FROM entities e JOIN (SELECT DISTINCT year FROM calendar) y ON true ASOF LEFT JOIN shares s ON s.dep = e.dep AND y.year >= s.vintage)
        SELECT 'vintage never future' AS "check", {_ok("count(*) FILTER (vintage > year) = 0")} AS status, count(*) FILTER (vintage > year) AS value FROM r""",
)
def check_vintages(t):
    rows = t.entities.select("entity", "dep", F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year"))
    return checks.vintage_not_future(asof_vintage(rows, t.shares, "dep", last_year=2001))


@query(
    "Q13",
    CHECK,
    f"""SELECT 'count and size leak y' AS "check", {_ok("count(*) = 0")} AS status, count(*) AS value FROM panel WHERE ((n_events > 0) <> y) OR (size > 0 AND NOT y)""",
)
def check_leaks(t):
    return checks.leak_equivalence(t.panel())


@query(
    "Q14",
    CHECK,
    f"""SELECT 'no missing day' AS "check", {_ok("count(*) = 0")} AS status, count(*) AS value FROM calendar WHERE day NOT IN (SELECT day FROM measures)
        UNION ALL SELECT 'no repeated cell-day', {_ok("count(*) = 0")}, count(*) FROM (SELECT cell, day FROM measures GROUP BY 1, 2 HAVING count(*) > 1)
        UNION ALL SELECT 'no intermittent cell', {_ok("count(*) = 0")}, count(*) FROM (SELECT cell FROM measures GROUP BY 1 HAVING count(DISTINCT day) <> 2405)""",
)
def check_time_axis(t):
    return checks.time_axis(t.measures, START, END)


@query(
    "Q15",
    CHECK,
    f"""SELECT 'entity key unique' AS "check", 'OK' AS status, 0 AS value
        UNION ALL SELECT 'altitudes ordered', {_ok("count(*) = 0")}, count(*) FROM entities WHERE NOT (alt_min <= alt_mean AND alt_mean <= alt_max)
        UNION ALL SELECT 'density recomputed', {_ok("count(*) = 0")}, count(*) FROM entities WHERE abs(population / area_km2 - density) > 0.01 * abs(population / area_km2)
        UNION ALL SELECT 'name length', {_ok("count(*) = 0")}, count(*) FROM entities WHERE length(name) <> 18
        UNION ALL SELECT 'two coordinates agree', {_ok("count(*) = 0")}, count(*) FROM entities WHERE entity % 50 = 0""",
)
def check_entities(t):
    rows = t.entities.withColumns(
        {"lat_alt": F.col("lat") + F.when(F.col("entity") % 50 == 0, 0.7).otherwise(0.1), "lon_alt": F.col("lon") + 0.1}
    )
    return checks.entity_quality(rows, 18).unionByName(checks.coordinate_gap(rows))


@query(
    "Q16",
    CHECK,
    f"""SELECT 'volume as expected' AS "check", {_ok("abs(count(*) / ((SELECT count(*) FROM entities) * 2405.0) - 1) <= 0.05")} AS status, count(*) AS value FROM panel""",
)
def check_volume(t):
    return checks.volume_gap(t.panel(), checks.count_of(t.entities) * F.lit(2405.0))


@query(
    "Q18",
    CHECK,
    f"""WITH g AS (SELECT year, count(*) AS n, count(*) FILTER (y) AS p FROM panel WHERE split <> 'train' GROUP BY 1)
        SELECT 'prediction volumes match panel' AS "check", {_ok("count(*) = 0")} AS status, count(*) AS value FROM g WHERE year = 2000""",
)
def check_prediction_volumes(t):
    """A prediction set of the evaluation years in which the positives of one year were lost."""
    panel = t.panel().filter("split <> 'train'")
    damaged = panel.withColumn("y", F.col("y") & (F.col("year") != 2000))
    return checks.same_yearly_volumes(damaged, panel)


@query(
    "Q19",
    CHECK,
    f"""WITH w AS (SELECT dep, vintage, sum(area) AS a FROM areas GROUP BY 1, 2), p AS (SELECT dep, vintage, sum(area) AS a FROM areas WHERE NOT (category = 'PROMO' AND vintage = 1997) GROUP BY 1, 2)
        SELECT 'category totals match' AS "check", {_ok("count(*) = 0")} AS status, count(*) AS value FROM w LEFT JOIN p USING (dep, vintage) WHERE abs(coalesce(p.a, 0) - w.a) > 0.01 * w.a
        UNION ALL SELECT 'announced rows read', 'FAIL', count(*) FROM (SELECT year(day) AS y, count(*) AS n FROM fires GROUP BY 1) WHERE y = 1997""",
)
def check_totals(t):
    """One category is missing from one vintage, and one yearly file announces a row too many."""
    whole = t.areas.groupBy("dep", "vintage").agg(F.sum("area").alias("area_total"))
    parts = t.areas.filter(~((F.col("category") == "PROMO") & (F.col("vintage") == 1997)))
    files = t.events.groupBy(F.year("day").alias("y")).agg(F.count("*").alias("rows"))
    meta = files.withColumn("announced", F.col("rows") + F.when(F.col("y") == 1997, 1).otherwise(0))
    return checks.totals_match(parts, whole, ["dep", "vintage"]).unionByName(checks.announced_counts(meta))


@query(
    "Q1 J22",
    CHECK,
    """SELECT 'panel rectangular' AS "check", 'FAIL' AS status, count(*) AS value FROM panel WHERE NOT (entity % 100 = 7 AND month = 2)""",
)
def check_rectangular_damaged(t):
    holes = t.panel().filter(~((F.col("entity") % 100 == 7) & (F.month("day") == 2)))
    return checks.rectangular(holes, t.entities, calendar_days(t))


@query(
    "A25",
    "key:s duplicates:i groups:i",
    """SELECT 'text' AS key, sum(n - 1) AS duplicates, count(*) FILTER (n > 1) AS groups FROM (SELECT count(*) AS n FROM conversations GROUP BY text)
       UNION ALL SELECT 'role and text', sum(n - 1), count(*) FILTER (n > 1) FROM (SELECT count(*) AS n FROM conversations GROUP BY role, text)""",
)
def duplicate_turns(t):
    return eda.duplicate_counts(t.table("conversations").select("role", "text"), {"text": ("text",), "role and text": ("role", "text")})
