"""Sources, projections, joins and features on the supplied tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from panelrisk.functions.calendar import date_features
from panelrisk.functions.scalars import (
    dominant_category,
    log1p0,
    null_inconsistent,
    period_label,
    prior_corrected,
    safe_ratio,
    threshold_class,
)
from panelrisk.operators import codes, compare, eda, features, geo, panel, ranks, reshape, serving
from panelrisk.plans.registry import query
from panelrisk.plans.roles import (
    END,
    FIT_END,
    INDICES,
    JUDGE_YEAR,
    RULES,
    SHARE_COLUMNS,
    START,
    TRAIN_END,
    TRAIN_STOP,
    VAL_END,
)
from panelrisk.sources.readers import cell_table, grid_to_long
from panelrisk.sources.tables import run_template

EASTER_SQL = """
    e AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter FROM (
        SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (
        SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM (
        SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM (
        SELECT DISTINCT year AS y, year % 19 AS a, year // 100 AS b, year % 100 AS c FROM calendar)))))"""


@query(
    "S21 F5 F6 F7 J12",
    "day:d year:i month:i doy:i weekday:i is_weekend:b is_holiday:b is_july_14:b is_august_15:b sin_doy:f cos_doy:f sin_month:f cos_month:f",
    f"""WITH {EASTER_SQL}
    SELECT c.*, weekday >= 5 AS is_weekend, (month = 7 AND day(c.day) = 14) AS is_july_14,
           (month = 8 AND day(c.day) = 15) AS is_august_15,
           strftime(c.day, '%m-%d') IN ('01-01','05-01','05-08','07-14','08-15','11-01','11-11','12-25')
             OR date_diff('day', e.easter, c.day) IN (1, 39, 50) AS is_holiday,
           sin(2 * pi() * doy / 365.25::DOUBLE) AS sin_doy, cos(2 * pi() * doy / 365.25::DOUBLE) AS cos_doy,
           sin(2 * pi() * month / 12::DOUBLE) AS sin_month, cos(2 * pi() * month / 12::DOUBLE) AS cos_month
    FROM calendar c JOIN e ON e.y = c.year""",
)
def calendar_features(t):
    d = F.to_date("o_orderdate")
    span = t.table("orders").agg(F.min(d).alias("a"), F.max(d).alias("b"))
    return date_features(span.select(F.explode(F.sequence("a", "b")).alias("day")))


@query("S3", "source:s rows:i", "SELECT 'orders.parquet' AS source, count(*) AS rows FROM orders")
def source_tag(t):
    tagged = t.table("orders").select(F.col("_metadata.file_name").alias("source"), "o_orderkey")
    return tagged.groupBy("source").agg(F.count("*").alias("rows"))


@query(
    "S1 P10 P12",
    "entity:i name:s alt_mean:f alt_min:f alt_max:f",
    """SELECT entity, name, CASE WHEN alt_max < alt_min THEN NULL ELSE alt_mean END AS alt_mean,
              CASE WHEN alt_max < alt_min THEN NULL ELSE alt_min END AS alt_min,
              CASE WHEN alt_max < alt_min THEN NULL ELSE alt_max END AS alt_max
       FROM entities WHERE substr(dep::VARCHAR, 1, 2) NOT IN ('21', '22') AND population IS NOT NULL""",
)
def entity_reference(t):
    kept = t.entities.filter(~F.substring(F.col("dep").cast("string"), 1, 2).isin("21", "22")).dropna(subset=["population"])
    return null_inconsistent(kept, "alt_min", "alt_max", ("alt_mean", "alt_min", "alt_max"))


def _arrays(t):
    """Daily arrays over six grid positions: the five measured cells and one that is always empty."""
    packed = t.measures.groupBy("day").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("cell").cast("int"), F.struct("fwi", "ffmc")))).alias("m")
    )
    nan = F.lit(float("nan"))
    at = F.sequence(F.lit(0), F.lit(5))
    return packed.select(
        "day",
        F.transform(at, lambda c: F.coalesce(F.col("m")[c]["fwi"], nan)).alias("fwi"),
        F.transform(at, lambda c: F.coalesce(F.col("m")[c]["ffmc"], nan)).alias("ffmc"),
    )


@query("S7", "cell:i day:d fwi:f ffmc:f", "SELECT cell, day, fwi, ffmc FROM measures WHERE cell IN (SELECT cell FROM entities)")
def grid_flattened(t):
    return grid_to_long(_arrays(t), ("fwi", "ffmc"), used=t.entities)


@query(
    "S8",
    "cell:i ilat:i ilon:i lat:f lon:f is_sea:b",
    """SELECT c AS cell, c // 3 AS ilat, c % 3 AS ilon, 45 - (c // 3) * 0.25 AS lat, 1 + (c % 3) * 0.25 AS lon,
              c NOT IN (SELECT cell FROM measures) AS is_sea FROM (SELECT unnest(range(0, 6)) AS c)""",
)
def grid_cells(t):
    return cell_table(_arrays(t), "fwi", [45.0, 44.75], [1.0, 1.25, 1.5])


@query(
    "S19",
    "year:i orders:i value:f2",
    """SELECT year(o_orderdate) AS year, count(*) AS orders, sum(o_totalprice) AS value FROM orders
       WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' GROUP BY 1""",
)
def bound_template(t):
    t.table("orders").createOrReplaceTempView("bound_template_orders")
    text = """SELECT year(o_orderdate) AS year, count(*) AS orders, sum(o_totalprice) AS value FROM bound_template_orders
              WHERE o_orderdate BETWEEN :low AND :high GROUP BY 1"""
    import datetime as dt

    return run_template(t.spark, text, low=dt.datetime(1996, 1, 1), high=dt.datetime(1999, 12, 31))


@query(
    "P1",
    "cell:i danger_class:i days:i",
    """SELECT cell, CASE WHEN fwi < 5.2 THEN 1 WHEN fwi < 11.2 THEN 2 WHEN fwi < 21.3 THEN 3 WHEN fwi < 38 THEN 4
                         WHEN fwi < 50 THEN 5 ELSE 6 END AS danger_class, count(*) AS days FROM measures GROUP BY 1, 2""",
)
def danger_classes(t):
    return t.measures.groupBy("cell", threshold_class("fwi").alias("danger_class")).agg(F.count("*").alias("days"))


@query("P2", "dep:i category:s", "SELECT dep, category FROM dominant")
def dominant_cover(t):
    return t.shares.filter("vintage = 1997").select("dep", dominant_category(RULES, "mixed").alias("category"))


def dominant(t):
    return dominant_cover(t)


@query(
    "P3 P4 P7 F8 F9",
    "entity:i log_population:f log_density:f back:f alt_range:i ha:f in_danger_zone:i",
    """SELECT entity, ln(coalesce(population, 0) + 1) AS log_population, ln(coalesce(density, 0) + 1) AS log_density,
              exp(ln(coalesce(population, 0) + 1)) - 1 AS back, alt_max - alt_min AS alt_range, area_km2 * 100 AS ha,
              (lat < 43)::INT AS in_danger_zone FROM entities""",
)
def entity_transforms(t):
    return t.entities.select(
        "entity",
        log1p0("population").alias("log_population"),
        log1p0("density").alias("log_density"),
        F.expm1(log1p0("population")).alias("back"),
        (F.col("alt_max") - F.col("alt_min")).alias("alt_range"),
        (F.col("area_km2") * 100).alias("ha"),
        (F.col("lat") < 43).cast("int").alias("in_danger_zone"),
    )


@query(
    "A3 P5 P11",
    "dep:i vintage:i area_total:f " + " ".join(f"{c}:f" for c in SHARE_COLUMNS),
    "SELECT * FROM shares",
)
def cover_shares(t):
    return t.shares


@query(
    "P9 P16 P17 T7",
    "entity:i day:d y:b n_events:i size:f2 u:f",
    "SELECT entity, day, y, n_events, size, u FROM train_sample",
)
def sampled_train(t):
    return t.sample


@query(
    "P17 Q9",
    "share:f split:s rows:i positives:i",
    """SELECT share, split, count(*) AS rows, count(*) FILTER (y) AS positives
       FROM panel_u, (SELECT unnest([0.0009, 0.00189, 0.01]) AS share) WHERE split <> 'train' OR y OR u < share GROUP BY 1, 2""",
)
def nested_samples(t):
    """Volumes of three nested samples of the whole panel, from one pass over it."""
    shares = (0.0009, 0.00189, 0.01)
    y = F.col("y").cast("int")
    kept = [(F.col("split") != "train") | F.col("y") | (F.col("u") < s) for s in shares]
    sums = [c for i, k in enumerate(kept) for c in (F.count_if(k).alias(f"n{i}"), F.sum(F.when(k, y)).alias(f"p{i}"))]
    per = t.panel().groupBy("split").agg(*sums)
    rows = [F.struct(F.lit(s).alias("share"), F.col(f"n{i}").alias("rows"), F.col(f"p{i}").alias("positives")) for i, s in enumerate(shares)]
    return per.select("split", F.explode(F.array(*rows)).alias("v")).select("split", "v.*")


@query(
    "P13",
    "suspect:b rows:i entities:i",
    """SELECT suspect, count(*) AS rows, count(DISTINCT o_custkey) AS entities
       FROM (SELECT o_custkey, count(*) OVER (PARTITION BY o_custkey, o_orderdate::DATE) > 1 AS suspect FROM orders) GROUP BY 1""",
)
def suspected_duplicates(t):
    rows = t.table("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    marked = eda.mark_duplicates(rows, ("o_custkey", "day"))
    return marked.groupBy("suspect").agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("entities"))


@query(
    "P14 J13 G7",
    "attached:i out_of_scope:i unresolved:i acceptable:b",
    """WITH m AS (SELECT f.cause AS c, coalesce(p.target, f.entity) AS code FROM fires f LEFT JOIN passage p ON p.source = f.entity),
       r AS (SELECT count(*) FILTER (code IN (SELECT code FROM live)) AS attached,
                    count(*) FILTER (code NOT IN (SELECT code FROM live) AND c = 'P') AS out_of_scope,
                    count(*) FILTER (code NOT IN (SELECT code FROM live) AND c <> 'P') AS unresolved FROM m)
       SELECT *, unresolved::DOUBLE / greatest(attached + unresolved, 1) < 0.01 AS acceptable FROM r""",
)
def attached_events(t):
    coded = codes.remap(t.events.withColumnRenamed("entity", "code"), "code", codes.resolve_codes(t.moves, t.live))
    return codes.attachment_report(codes.attach_known(coded, t.live, "code", F.col("cause") == "P"))


@query(
    "P15 A16 Q8",
    "split:s first:d last:d rows:i gap_days:i",
    """WITH s AS (SELECT split, min(day) AS first, max(day) AS last, count(*) AS rows FROM panel GROUP BY 1)
       SELECT *, coalesce(first - lag(last) OVER (ORDER BY first), -1) AS gap_days FROM s""",
)
def split_bounds(t):
    from panelrisk.operators.checks import split_bounds as bounds

    return bounds(t.panel()).withColumn("gap_days", F.coalesce("gap_days", F.lit(-1)))


@query(
    "P20",
    "period:s decade:i orders:i",
    """SELECT CASE WHEN y BETWEEN 1995 AND 1996 THEN '1995-1996' WHEN y BETWEEN 1997 AND 1999 THEN '1997-1999' ELSE 'none' END AS period,
              y // 10 * 10 AS decade, count(*) AS orders FROM (SELECT year(o_orderdate) AS y FROM orders) GROUP BY 1, 2""",
)
def period_labels(t):
    y = F.year("o_orderdate")
    named = F.coalesce(period_label(y, ((1995, 1996), (1997, 1999))), F.lit("none"))
    decade = (F.floor(y / 10) * 10).alias("decade")
    return t.table("orders").groupBy(named.alias("period"), decade).agg(F.count("*").alias("orders"))


@query(
    "P22",
    "fold:s rows:i positives:i",
    f"""SELECT CASE WHEN year <= {FIT_END} THEN 'fit' ELSE 'judge' END AS fold, count(*) AS rows, count(*) FILTER (y) AS positives
        FROM train_sample WHERE year <= {JUDGE_YEAR} GROUP BY 1""",
)
def internal_fold(t):
    fold = F.when(F.col("year") <= FIT_END, "fit").when(F.col("year") == JUDGE_YEAR, "judge")
    rows = t.sample.withColumn("fold", fold).filter("fold IS NOT NULL")
    return rows.groupBy("fold").agg(F.count("*").alias("rows"), F.sum(F.col("y").cast("int")).alias("positives"))


@query(
    "P23",
    "year:i rows:i positives:i",
    "SELECT year, count(*) AS rows, count(*) FILTER (y) AS positives FROM panel WHERE split = 'test' GROUP BY 1",
)
def allowed_periods(t):
    return panel.yearly_volumes(serving.allowed_rows(t.panel(), TRAIN_END, VAL_END))


@query(
    "P24",
    "event_id:i corrected:f",
    """SELECT event_id, score_a / (score_a + (1 - score_a) / 0.00189::DOUBLE) AS corrected FROM predictions""",
)
def prior_correction(t):
    return t.predictions.select("event_id", prior_corrected("score_a", 0.00189).alias("corrected"))


@query(
    "J6 J7 A1 A16",
    "year:i rows:i positives:i rate_pct:f4",
    """SELECT year, count(*) AS rows, count(*) FILTER (y) AS positives,
              100.0::DOUBLE * count(*) FILTER (y) / count(*) AS rate_pct FROM panel GROUP BY 1""",
)
def panel_volumes(t):
    return panel.yearly_volumes(t.panel())


@query(
    "J6 J7",
    "entity:i rows:i positives:i events:i size:f2 mean_u:f",
    """SELECT entity, count(*) AS rows, count(*) FILTER (y) AS positives, sum(n_events) AS events, sum(size) AS size, avg(u) AS mean_u
       FROM panel_u GROUP BY 1""",
)
def panel_by_entity(t):
    return t.panel().groupBy("entity").agg(
        F.count("*").alias("rows"),
        F.sum(F.col("y").cast("int")).alias("positives"),
        F.sum("n_events").alias("events"),
        F.sum("size").alias("size"),
        F.avg("u").alias("mean_u"),
    )


@query("A1 V10", "entity:i day:d n:i size:f2", "SELECT entity, day, n, size FROM days")
def event_day_table(t):
    return t.days


@query(
    "A2 J8",
    "entity:i day:d events_7d:i events_30d:i events_90d:i events_365d:i size_30d:f2 days_since_event:i",
    "SELECT * FROM lags",
)
def event_history(t):
    return t.lags


@query(
    "W20",
    "entity:i day:d events_7d:i events_30d:i events_90d:i events_365d:i",
    """SELECT entity, day, coalesce(sum(n) OVER (w RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS events_7d,
              coalesce(sum(n) OVER (w RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS events_30d,
              coalesce(sum(n) OVER (w RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS events_90d,
              coalesce(sum(n) OVER (w RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS events_365d
       FROM days WINDOW w AS (PARTITION BY entity ORDER BY day)""",
)
def event_history_range(t):
    return features.history_by_range(t.days)


MATRIX = (
    "entity:i day:d year:i split:s y:i n_events:i size:f2 cell:i dep:i fwi:f ffmc:f dmc:f dc:f danger_class:i fwi_d1:f ffmc_d1:f "
    "vintage:f " + " ".join(f"{c}:f" for c in SHARE_COLUMNS) + " log_population:f log_density:f log_area:f alt_mean:f alt_range:i "
    "density_grid:i lat:f lon:f doy:i month:i weekday:i is_weekend:i is_holiday:i is_july_14:i is_august_15:i "
    "sin_doy:f cos_doy:f sin_month:f cos_month:f events_7d:i events_30d:i events_90d:i events_365d:i days_since_event:i"
)


def matrix(t):
    return features.feature_matrix(t.sampled(features.HORIZONS), t.entities, t.measures, None, t.shares, INDICES, last_year=int(END[:4]))


@query(
    "J1 J2 J3 J4 P6 P8",
    MATRIX,
    f"""WITH {EASTER_SQL}
    SELECT g.entity, g.day, g.year, g.split, g.y, g.n_events, g.size, g.cell, g.dep, m.fwi, m.ffmc, m.dmc, m.dc,
      CASE WHEN m.fwi < 5.2 THEN 1 WHEN m.fwi < 11.2 THEN 2 WHEN m.fwi < 21.3 THEN 3 WHEN m.fwi < 38 THEN 4 WHEN m.fwi < 50 THEN 5 ELSE 6 END AS danger_class,
      b.fwi AS fwi_d1, b.ffmc AS ffmc_d1, s.vintage, {", ".join("s." + c for c in SHARE_COLUMNS)},
      ln(coalesce(x.population, 0) + 1) AS log_population, ln(coalesce(x.density, 0) + 1) AS log_density, ln(x.area_km2 + 1) AS log_area,
      x.alt_mean, x.alt_max - x.alt_min AS alt_range, x.density_grid, x.lat, x.lon, g.doy, g.month, isodow(g.day) - 1 AS weekday,
      (isodow(g.day) >= 6)::INT AS is_weekend,
      (strftime(g.day, '%m-%d') IN ('01-01','05-01','05-08','07-14','08-15','11-01','11-11','12-25')
        OR date_diff('day', e.easter, g.day) IN (1, 39, 50))::INT AS is_holiday,
      (strftime(g.day, '%m-%d') = '07-14')::INT AS is_july_14, (strftime(g.day, '%m-%d') = '08-15')::INT AS is_august_15,
      sin(2 * pi() * g.doy / 365.25::DOUBLE) AS sin_doy, cos(2 * pi() * g.doy / 365.25::DOUBLE) AS cos_doy,
      sin(2 * pi() * g.month / 12::DOUBLE) AS sin_month, cos(2 * pi() * g.month / 12::DOUBLE) AS cos_month,
      coalesce(h.events_7d, 0) AS events_7d, coalesce(h.events_30d, 0) AS events_30d, coalesce(h.events_90d, 0) AS events_90d,
      coalesce(h.events_365d, 0) AS events_365d, coalesce(h.days_since_event, 9999) AS days_since_event
    FROM train_sample g JOIN entities x ON x.entity = g.entity JOIN e ON e.y = g.year
    JOIN measures m ON m.cell = g.cell AND m.day = g.day
    LEFT JOIN measures b ON b.cell = g.cell AND b.day = g.day - 1
    LEFT JOIN lags h ON h.entity = g.entity AND h.day = g.day
    ASOF LEFT JOIN shares s ON s.dep = g.dep AND g.year >= s.vintage""",
)
def feature_matrix(t):
    return matrix(t)


@query(
    "J2",
    "cell:i day:d fwi_d1:f ffmc_d1:f",
    "SELECT m.cell, m.day, b.fwi AS fwi_d1, b.ffmc AS ffmc_d1 FROM measures m LEFT JOIN measures b ON b.cell = m.cell AND b.day = m.day - 1",
)
def measures_day_before(t):
    return features.day_before(t.measures, ("fwi", "ffmc"))


@query(
    "J4 Q11",
    "entity:i year:i vintage:f share_economy:f",
    """SELECT r.entity, r.year, s.vintage, s.share_economy
       FROM (SELECT entity, dep, unnest(range(1994, 2002))::INT AS year FROM entities) r
       ASOF LEFT JOIN shares s ON s.dep = r.dep AND r.year >= s.vintage""",
)
def asof_vintages(t):
    rows = t.entities.select("entity", "dep", F.explode(F.sequence(F.lit(1994), F.lit(2001))).alias("year"))
    return features.asof_vintage(rows, t.shares, "dep", last_year=2001)


@query(
    "J5 A12",
    "entity:i name:s area_km2:f share_economy:f events:i ha:f last_day:s",
    """SELECT e.entity, e.name, e.area_km2, s.share_economy, coalesce(t.events, 0) AS events, coalesce(t.ha, 0) AS ha,
              coalesce(t.last_day::VARCHAR, '-') AS last_day
       FROM entities e LEFT JOIN shares s ON s.dep = e.dep AND s.vintage = 1999
       LEFT JOIN (SELECT entity, sum(n) AS events, sum(size) / 10000 AS ha, max(day) AS last_day FROM days GROUP BY 1) t USING (entity)""",
)
def entity_summary(t):
    fixed = t.shares.filter("vintage = 1999").select("dep", "share_economy")
    out = eda.entity_summary(t.entities.join(fixed, "dep", "left"), t.days)
    return out.withColumn("last_day", F.coalesce(F.col("last_day").cast("string"), F.lit("-")))


@query(
    "J16 G2 G1",
    "entity:i neighbour:i dist_m:f3",
    """WITH d AS (SELECT a.entity, b.entity AS neighbour, 12742000 * asin(least(1, sqrt(
           pow(cos(radians(a.lat)) * cos(radians(a.lon)) - cos(radians(b.lat)) * cos(radians(b.lon)), 2)
         + pow(cos(radians(a.lat)) * sin(radians(a.lon)) - cos(radians(b.lat)) * sin(radians(b.lon)), 2)
         + pow(sin(radians(a.lat)) - sin(radians(b.lat)), 2)) / 2)) AS dist_m
       FROM entities a JOIN entities b ON a.entity <> b.entity AND abs(a.lat - b.lat) < 0.5)
       SELECT * FROM d WHERE dist_m <= 50000""",
)
def neighbour_pairs(t):
    return geo.pairs_within(t.entities, 50.0)


@query(
    "J9 G3",
    "entity:i day:d events_10km:i events_20km:i events_50km:i events_weighted:f",
    """WITH p AS (SELECT a.entity, b.entity AS other, 12742000 * asin(least(1, sqrt(
           pow(cos(radians(a.lat)) * cos(radians(a.lon)) - cos(radians(b.lat)) * cos(radians(b.lon)), 2)
         + pow(cos(radians(a.lat)) * sin(radians(a.lon)) - cos(radians(b.lat)) * sin(radians(b.lon)), 2)
         + pow(sin(radians(a.lat)) - sin(radians(b.lat)), 2)) / 2)) AS dist_m
       FROM entities a JOIN entities b ON a.entity <> b.entity AND abs(a.lat - b.lat) < 0.5),
       c AS (SELECT p.entity, f.day, count(*) FILTER (dist_m < 10000) AS n10, count(*) FILTER (dist_m < 20000) AS n20,
                    count(*) AS n50, sum(1 / (dist_m / 1000 + 1)) AS w50
             FROM p JOIN fires f ON f.entity = p.other WHERE dist_m <= 50000 GROUP BY 1, 2)
       SELECT entity, (day + k)::DATE AS day, sum(n10) AS events_10km, sum(n20) AS events_20km, sum(n50) AS events_50km, sum(w50) AS events_weighted
       FROM c, (SELECT unnest(range(1, 31))::INT AS k) GROUP BY 1, 2""",
)
def neighbour_history(t):
    return geo.neighbour_features(t.days, t.entities, 50.0)


@query(
    "J10 J20",
    "entity:i",
    "SELECT entity FROM entities e WHERE NOT EXISTS (SELECT 1 FROM days d WHERE d.entity = e.entity)",
)
def entities_without_event(t):
    return t.entities.select("entity").join(t.days, "entity", "left_anti")


@query("J11 U6", "entity:i", "SELECT DISTINCT entity FROM entities e WHERE EXISTS (SELECT 1 FROM days d WHERE d.entity = e.entity)")
def entities_with_event(t):
    return t.entities.select("entity").distinct().join(t.days, "entity", "left_semi")


@query(
    "J15",
    "source:s rows:i key_mismatches:i target_mismatches:i",
    """WITH b AS (SELECT event_id, CASE WHEN event_id % 997 = 0 THEN 1 - y ELSE y END AS y FROM predictions WHERE event_id % 991 <> 0)
       SELECT 'a' AS source, count(*) AS rows, 0 AS key_mismatches, 0 AS target_mismatches FROM predictions
       UNION ALL SELECT 'b', count(b.event_id), count(*) FILTER (b.event_id IS NULL), count(*) FILTER (b.y <> p.y)
       FROM predictions p LEFT JOIN b USING (event_id)""",
)
def alignment_audit(t):
    """A damaged copy of the predictions: some keys are lost and some targets flipped, and the audit counts them."""
    p = t.predictions
    flipped = F.when(F.col("event_id") % 997 == 0, 1 - F.col("y")).otherwise(F.col("y"))
    damaged = p.filter(F.col("event_id") % 991 != 0).withColumn("y", flipped)
    return compare.alignment_report({"a": p, "b": damaged}, ["event_id"])


@query("J15", "event_id:i y:i a:f b:f", "SELECT event_id, y, score_a AS a, score_b AS b FROM predictions")
def aligned_predictions(t):
    p = t.predictions
    return compare.align_predictions({"a": (p, "score_a"), "b": (p.orderBy("score_b"), "score_b")}, ["event_id"])


LATS = tuple(52.0 - 0.25 * i for i in range(48))
LONS = tuple(-6.0 + 0.25 * i for i in range(68))


@query(
    "J17 G1",
    "entity:i grid:i",
    """WITH la AS (SELECT i, 52.0::DOUBLE - 0.25 * i AS v FROM (SELECT unnest(range(0, 48)) AS i)),
       lo AS (SELECT i, -6.0::DOUBLE + 0.25 * i AS v FROM (SELECT unnest(range(0, 68)) AS i)),
       a AS (SELECT entity, arg_min(i, (abs(lat - v), i)) AS i FROM entities, la GROUP BY 1),
       b AS (SELECT entity, arg_min(i, (abs(lon - v), i)) AS i FROM entities, lo GROUP BY 1)
       SELECT entity, a.i * 68 + b.i AS grid FROM a JOIN b USING (entity)""",
)
def grid_attachment(t):
    return geo.attach_cells(t.entities.select("entity", "lat", "lon"), LATS, LONS).withColumnRenamed("cell", "grid")


def _sites(t):
    """Irregular sites: suppliers, at positions spread over the same area."""
    k = F.col("s_suppkey")
    return t.table("supplier").select(
        k.alias("site"),
        (F.lit(41.0) + (k * 6151 % 997) / 997.0 * 10).alias("site_lat"),
        (F.lit(-5.0) + (k * 3571 % 991) / 991.0 * 14).alias("site_lon"),
    )


SITES_SQL = """sites AS (SELECT s_suppkey AS site, 41::DOUBLE + (s_suppkey * 6151 % 997) / 997::DOUBLE * 10 AS site_lat,
    -5::DOUBLE + (s_suppkey * 3571 % 991) / 991::DOUBLE * 14 AS site_lon FROM supplier)"""


@query(
    "J18",
    "entity:i site:i dist_deg:f",
    f"""WITH {SITES_SQL}, d AS (SELECT entity, site, sqrt(pow(lat - site_lat, 2) + pow(lon - site_lon, 2)) AS dist_deg FROM entities, sites)
        SELECT entity, arg_min(site, (dist_deg, site)) AS site, min(dist_deg) AS dist_deg FROM d GROUP BY 1""",
)
def nearest_sites(t):
    return geo.nearest_site(t.entities, _sites(t), "entity")


@query(
    "G4",
    "entity:i distance_km:f3",
    f"""WITH {SITES_SQL}, seg AS (SELECT a.site, a.site_lat AS y1, a.site_lon AS x1, b.site_lat AS y2, b.site_lon AS x2
            FROM sites a JOIN sites b ON b.site = a.site + 1 WHERE a.site % 3 = 0),
        p AS (SELECT entity, (x1 - lon) * cos(radians(lat)) AS ax, y1 - lat AS ay, (x2 - lon) * cos(radians(lat)) AS bx, y2 - lat AS by_
              FROM entities, seg),
        q AS (SELECT *, least(1, greatest(0, -(ax * (bx - ax) + ay * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM p)
        SELECT entity, min(sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2))) * 111.19492664455873 AS distance_km
        FROM q GROUP BY 1""",
)
def line_distance(t):
    """Distance to a set of line segments, each joining two consecutive sites."""
    a = _sites(t).filter(F.col("site") % 3 == 0)
    b = _sites(t).select((F.col("site") - 1).alias("site"), F.col("site_lat").alias("lat2"), F.col("site_lon").alias("lon2"))
    segments = a.join(b, "site").select(F.col("site_lat").alias("lat1"), F.col("site_lon").alias("lon1"), "lat2", "lon2")
    return geo.distance_to_lines(t.entities, segments)


@query(
    "J19",
    "entity:i day:d n:i fwi_lag2:f",
    """SELECT d.entity, d.day, d.n, w.v AS fwi_lag2 FROM days d JOIN entities e USING (entity)
       LEFT JOIN (SELECT cell, day, lag(fwi, 2) OVER (PARTITION BY cell ORDER BY day) AS v FROM measures) w ON w.cell = e.cell AND w.day = d.day""",
)
def guarded_join(t):
    rows = t.days.join(t.entities.select("entity", "cell"), "entity")
    return features.drop_guard(rows, features.measure_lags(t.measures), ("cell", "day"))


@query(
    "J23 V8",
    "entity:i score_a:f score_b:f difference:f",
    """SELECT a.entity, a.s AS score_a, b.s AS score_b, b.s - a.s AS difference
       FROM (SELECT entity, max(score_a) AS s FROM predictions GROUP BY 1) a JOIN (SELECT entity, max(score_b) AS s FROM predictions GROUP BY 1) b USING (entity)
       ORDER BY difference DESC, entity LIMIT 8""",
)
def model_disagreement(t):
    best = t.predictions.groupBy("entity").agg(F.max("score_a").alias("a"), F.max("score_b").alias("b"))
    one = best.select("entity", F.col("a").alias("score"))
    two = best.select("entity", F.col("b").alias("score"))
    return eda.top_k(compare.difference(one, two, ["entity"], "score"), "difference", "entity", 8)


@query(
    "J25",
    "cell:i day:d length:i first:f last:f total:f",
    """SELECT cell, day, count(*) OVER w AS length, first_value(fwi) OVER w AS first, last_value(fwi) OVER w AS last, sum(fwi) OVER w AS total
       FROM measures WINDOW w AS (PARTITION BY cell ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""",
)
def past_month_sequences(t):
    s = features.past_sequences(t.measures)
    total = F.when(F.size("sequence") > 0, F.aggregate("sequence", F.lit(0.0), lambda a, v: a + v))
    return s.select(
        "cell", "day", F.size("sequence").alias("length"), F.get("sequence", F.lit(0)).alias("first"),
        F.try_element_at("sequence", F.lit(-1)).alias("last"), total.alias("total"),
    )


@query(
    "J26 A7",
    "event_id:i category:s fwi:f ha:f doy:i",
    """SELECT f.event_id, d.category, m.fwi, f.size / 10000 AS ha, dayofyear(f.day) AS doy
       FROM fires f JOIN entities e USING (entity) JOIN measures m ON m.cell = e.cell AND m.day = f.day LEFT JOIN dominant d ON d.dep = e.dep""",
)
def event_extract(t):
    rows = t.events.join(t.entities.select("entity", "cell", "dep"), "entity").join(t.measures, ["cell", "day"])
    rows = rows.join(dominant(t), "dep", "left")
    return rows.withColumns({"ha": F.col("size") / 10000, "doy": F.dayofyear("day")})


@query(
    "W2 W3 W4 W5",
    "cell:i day:d fwi_lag2:f fwi_lag3:f fwi_lag7:f fwi_lag14:f fwi_mean7:f fwi_mean14:f fwi_mean30:f fwi_max7:f fwi_max30:f fwi_slope7:f",
    """SELECT cell, day, lag(fwi, 2) OVER w AS fwi_lag2, lag(fwi, 3) OVER w AS fwi_lag3, lag(fwi, 7) OVER w AS fwi_lag7, lag(fwi, 14) OVER w AS fwi_lag14,
              avg(fwi) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS fwi_mean7, avg(fwi) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS fwi_mean14,
              avg(fwi) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS fwi_mean30, max(fwi) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS fwi_max7,
              max(fwi) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS fwi_max30, lag(fwi, 1) OVER w - lag(fwi, 8) OVER w AS fwi_slope7
       FROM measures WINDOW w AS (PARTITION BY cell ORDER BY day)""",
)
def measure_windows(t):
    return features.measure_lags(t.measures)


@query(
    "W1",
    "cell:i day:d previous:f",
    "SELECT cell, day, lag(fwi) OVER (PARTITION BY cell ORDER BY day) AS previous FROM measures",
)
def previous_row(t):
    from pyspark.sql import Window

    return t.measures.select("cell", "day", F.lag("fwi").over(Window.partitionBy("cell").orderBy("day")).alias("previous"))


@query("G5", "source:i target:i hops:i", "SELECT * FROM passage")
def code_passage(t):
    return codes.resolve_codes(t.moves, t.live)


@query("G6", "code:i", "SELECT DISTINCT source AS code FROM moves WHERE kind = '21'")
def ambiguous_codes(t):
    return codes.ambiguous_codes(t.moves)


@query(
    "G7 J13",
    "entity:i orders:i",
    "SELECT coalesce(p.target, o.o_custkey) AS entity, count(*) AS orders FROM orders o LEFT JOIN passage p ON p.source = o.o_custkey GROUP BY 1",
)
def remapped_orders(t):
    rows = t.table("orders").select(F.col("o_custkey").alias("entity"))
    return codes.remap(rows, "entity", codes.resolve_codes(t.moves, t.live)).groupBy("entity").agg(F.count("*").alias("orders"))


@query(
    "W15",
    "entity:i event_id:i day:d",
    """SELECT entity, event_id, day FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC, event_id) AS r FROM fires) WHERE r = 1""",
)
def latest_event(t):
    """The most recent event of each entity, by a partial aggregate rather than a window."""
    newest = F.max_by(F.struct("event_id", "day"), F.struct("day", -F.col("event_id"))).alias("e")
    return t.events.groupBy("entity").agg(newest).select("entity", "e.*")


@query(
    "P21",
    "event_id:i w_raw:f w_area:f w_index:f",
    """WITH s AS (SELECT p.event_id, p.score_a AS score, e.area_km2, p.score_b * 80 AS fwi, p.score_a / greatest(e.area_km2, 0.5) AS k
                  FROM predictions p JOIN entities e USING (entity)),
       t AS (SELECT max(score) AS m, quantile_cont(k, 0.99) AS q FROM s)
       SELECT event_id, score / m AS w_raw, greatest(least(k / q, 1), 0) AS w_area, greatest(least(fwi / 50, 1), 0) AS w_index FROM s, t""",
)
def display_weights(t):
    rows = t.predictions.join(t.entities.select("entity", "area_km2"), "entity")
    return eda.display_weights(rows.withColumns({"score": F.col("score_a"), "fwi": F.col("score_b") * 80}))


@query(
    "U3",
    "cell:i day:d index:s value:f",
    """SELECT cell, day, index, value FROM (UNPIVOT (SELECT cell, day, fwi, ffmc, dmc, dc FROM measures) ON fwi, ffmc, dmc, dc INTO NAME index VALUE value) WHERE value > 0""",
)
def unpivoted_measures(t):
    return reshape.unpivot_positive(t.measures, ["cell", "day"], INDICES, "index", "value")


@query(
    "U4",
    "doy:i events:i",
    """SELECT g.doy, coalesce(e.n, 0) AS events FROM (SELECT unnest(range(1, 367)) AS doy) g
       LEFT JOIN (SELECT dayofyear(day) AS doy, count(*) AS n FROM fires GROUP BY 1) e USING (doy)""",
)
def dense_season(t):
    season = t.events.groupBy(F.dayofyear("day").alias("doy")).agg(F.count("*").alias("events"))
    return reshape.densify(season, reshape.integers(t.spark, 1, 366, "doy"), ["doy"], ["events"])


@query(
    "U2",
    "side:s cause:s keys:i",
    """WITH a AS (SELECT DISTINCT entity FROM fires), b AS (SELECT entity FROM entities WHERE population > 5000),
       j AS (SELECT CASE WHEN b.entity IS NULL THEN 'left_only' WHEN a.entity IS NULL THEN 'right_only' ELSE 'both' END AS side,
                    coalesce(a.entity, b.entity) AS k FROM a FULL JOIN b ON a.entity = b.entity)
       SELECT side, CASE WHEN side = 'both' THEN '-' WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS cause, count(*) AS keys FROM j GROUP BY 1, 2""",
)
def key_set_difference(t):
    cause = F.when(F.col("entity") % 2 == 0, "even").otherwise("odd")
    return reshape.key_differences(t.events, t.entities.filter("population > 5000"), "entity", cause)


@query(
    "U2",
    "entity:i side:s",
    """(SELECT entity, 'both' AS side FROM days INTERSECT SELECT c_custkey, 'both' FROM customer WHERE c_acctbal > 0)
       UNION ALL (SELECT entity, 'lost' FROM days EXCEPT SELECT c_custkey, 'lost' FROM customer WHERE c_acctbal > 0)""",
)
def key_set_operators(t):
    a = t.days.select("entity")
    b = t.table("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("entity"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("lost")))


@query(
    "U1 U5",
    "scenario:s cell:i year:i k:f",
    "SELECT s.scenario, cell, year, k FROM factors_obs, (SELECT unnest(['low', 'mid', 'high']) AS scenario) s",
)
def replicated_past(t):
    from panelrisk.operators.climate import observed_factors

    return reshape.replicate(observed_factors(t.measures, START, TRAIN_STOP), "scenario", ("low", "mid", "high"))


@query(
    "T1 T2",
    "entity:i events:i",
    "SELECT entity, sum(n) AS events FROM days GROUP BY 1 ORDER BY events DESC, entity LIMIT 20",
)
def most_events(t):
    return eda.top_k(t.days.groupBy("entity").agg(F.sum("n").alias("events")), "events", "entity", 20)


@query(
    "T4",
    "entity:i largest_day:d largest:f2 smallest:f2",
    """SELECT entity, arg_max(day, (size, day)) AS largest_day, max(size) AS largest, min(size) AS smallest FROM fires GROUP BY 1""",
)
def extreme_rows(t):
    return t.events.groupBy("entity").agg(
        F.max_by("day", F.struct("size", "day")).alias("largest_day"), F.max("size").alias("largest"), F.min("size").alias("smallest")
    )


@query(
    "T5",
    "event_id:i gap:f",
    "SELECT event_id, score_a - score_b AS gap FROM predictions ORDER BY abs(score_a - score_b) DESC, event_id LIMIT 15",
)
def largest_gaps(t):
    gap = t.predictions.withColumn("gap", F.col("score_a") - F.col("score_b"))
    return gap.orderBy(F.abs("gap").desc(), "event_id").limit(15)


@query(
    "T6",
    "event_id:i entity:i",
    "SELECT event_id, entity FROM predictions WHERE score_a > 0.5 AND y = 0 ORDER BY event_id LIMIT 100",
)
def first_violations(t):
    from panelrisk.operators.checks import violations

    return violations(t.predictions, (F.col("score_a") > 0.5) & (F.col("y") == 0), ["event_id"])


@query(
    "T7",
    "event_id:i score_b:f",
    "SELECT event_id, score_b FROM predictions ORDER BY score_b DESC, event_id LIMIT 500",
)
def best_scores(t):
    from panelrisk.operators.models import random_and_top

    rows = t.predictions.withColumn("u", F.lit(0.0))
    return random_and_top(rows, "score_b", "event_id", 500, 0.1)[1]


@query(
    "T7 ML15",
    "event_id:i u:f",
    """SELECT event_id, u FROM (SELECT event_id, (('0x' || substr(md5(event_id || '|' || day), 1, 8))::BIGINT % 1000000)::DOUBLE / 1000000 AS u FROM predictions)
       WHERE u < 0.05""",
)
def reference_background(t):
    from panelrisk.functions.scalars import uniform
    from panelrisk.operators.models import reference_sample

    rows = t.predictions.withColumn("u", uniform(F.col("event_id"), F.col("day"))).withColumn("split", F.lit("train"))
    return reference_sample(rows, 0.05)


@query(
    "A49 A25",
    "key:s duplicates:i groups:i",
    """SELECT 'customer day' AS key, sum(n - 1) AS duplicates, count(*) FILTER (n > 1) AS groups FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate::DATE)
       UNION ALL SELECT 'document text', sum(n - 1), count(*) FILTER (n > 1) FROM (SELECT count(*) AS n FROM documents GROUP BY text)
       UNION ALL SELECT 'order key', sum(n - 1), count(*) FILTER (n > 1) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)""",
)
def duplicate_audit(t):
    o = t.table("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    orders = eda.duplicate_counts(o, {"customer day": ("o_custkey", "day"), "order key": ("o_orderkey",)})
    # Whole texts are compared; they are grouped by themselves, not by a hash that could collide.
    return orders.unionByName(eda.duplicate_counts(t.table("documents").select("text"), {"document text": ("text",)}))


@query(
    "V5 F1 F2",
    "entity:i name:s population:i",
    """SELECT entity, name, population FROM entities WHERE replace(lower(strip_accents(name)), ' ', '-') LIKE '%customer#0000001%' AND population IS NOT NULL
       ORDER BY population DESC, entity LIMIT 12""",
)
def entity_search(t):
    rows = t.entities.filter("population IS NOT NULL").withColumn("code", F.lpad(F.col("entity").cast("string"), 5, "0"))
    return serving.search(rows, "Customer#0000001")


@query(
    "V5 F1 F2",
    "query_id:i rank:i entity:i kind:s",
    """WITH e AS (SELECT entity, population, lpad(entity::VARCHAR, 5, '0') AS code, lpad((entity * 37 % 100000)::VARCHAR, 5, '0') AS postcode,
            replace(lower(strip_accents(name)), ' ', '-') AS plain FROM entities WHERE population IS NOT NULL),
       s AS (SELECT entity AS query_id, trim(CASE entity % 4 WHEN 0 THEN lpad(entity::VARCHAR, 4, '0') WHEN 1 THEN ' ' || substr(name, 1, length(name) - 1) || ' '
            WHEN 2 THEN substr(name, 5) ELSE substr(name, length(name) - 5) END) AS text FROM entities),
       c AS (SELECT query_id, entity, population, 'code' AS kind, false AS begins FROM s, e WHERE starts_with(code, upper(text)) OR starts_with(postcode, upper(text))),
       n AS (SELECT query_id, entity, population, 'name' AS kind, starts_with(plain, lower(text)) AS begins FROM s, e
            WHERE contains(plain, lower(text)) AND query_id NOT IN (SELECT query_id FROM c)),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY population DESC, begins DESC, entity) AS rank FROM (SELECT * FROM c UNION ALL SELECT * FROM n))
       SELECT query_id, rank, entity, kind FROM r WHERE rank <= 12""",
)
def entity_searches(t):
    """Each entity is searched for by a piece of its code or name."""
    key = F.col("entity").cast("string")
    postcode = F.lpad((F.col("entity") * 37 % 100000).cast("string"), 5, "0")
    rows = t.entities.filter("population IS NOT NULL").withColumns({"code": F.lpad(key, 5, "0"), "postcode": postcode})
    way = F.col("entity") % 4
    text = F.when(way == 0, F.lpad(key, 4, "0")).when(way == 1, F.expr("' ' || substr(name, 1, length(name) - 1) || ' '"))
    text = text.when(way == 2, F.expr("substr(name, 5)")).otherwise(F.expr("substr(name, length(name) - 5)"))
    return serving.search_all(rows, t.entities.select(F.col("entity").alias("query_id"), text.alias("text")))


@query(
    "A31",
    "top_share:f share_of_total:f",
    """WITH r AS (SELECT size, row_number() OVER (ORDER BY size DESC) AS r, count(*) OVER () AS n, sum(size) OVER () AS s FROM fires)
       SELECT p AS top_share, sum(size) FILTER (r <= greatest(floor(n * p), 1)) / max(s) AS share_of_total
       FROM r, (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE]) AS p) GROUP BY 1""",
)
def size_concentration(t):
    return ranks.concentration(t.events, "size", (0.01, 0.05, 0.1, 0.5))


@query(
    "P5",
    "dep:i ratio:f",
    "SELECT dep, coalesce(max(area) FILTER (vintage = 1999), 0) / nullif(max(area) FILTER (vintage = 1995), 0) AS ratio FROM areas GROUP BY 1",
)
def guarded_ratio(t):
    at = lambda v: F.max(F.when(F.col("vintage") == v, F.col("area")))
    return t.areas.groupBy("dep").agg(safe_ratio(at(1999), at(1995)).alias("ratio"))
