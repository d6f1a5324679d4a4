"""Exploratory rollups on the supplied tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from panelrisk.functions.scalars import band_right_closed, threshold_class
from panelrisk.operators import eda, reshape
from panelrisk.plans.panel_queries import dominant
from panelrisk.plans.registry import query
from panelrisk.plans.roles import CATEGORIES, INDICES


@query(
    "A6",
    "danger_class:i exposure:i events:i ha:f3",
    "SELECT danger_class, count(*) AS exposure, count(*) FILTER (y) AS events, sum(size) / 10000 AS ha FROM classed GROUP BY 1",
)
def rates_by_class(t):
    return eda.rates_by(t.classed(), ["danger_class"])


@query(
    "A8",
    "category:s entities:i km2:f",
    "SELECT coalesce(d.category, 'mixed') AS category, count(*) AS entities, sum(area_km2) AS km2 FROM entities e LEFT JOIN dominant d USING (dep) GROUP BY 1",
)
def exposure_by_category(t):
    rows = t.entities.join(dominant(t), "dep", "left").withColumn("category", F.coalesce("category", F.lit("mixed")))
    return eda.exposure_by(rows, "category")


@query(
    "A9",
    "category:s danger_class:i exposure:i events:i rate:f9",
    """SELECT coalesce(d.category, 'mixed') AS category, danger_class, count(*) AS exposure, count(*) FILTER (y) AS events, avg(y::INT) AS rate
       FROM classed c LEFT JOIN dominant d USING (dep) GROUP BY 1, 2""",
)
def rates_by_category_and_class(t):
    rows = t.classed(("dep",)).groupBy("dep", "danger_class").agg(
        F.count("*").alias("x"), F.sum(F.col("y").cast("int")).alias("e")
    )
    rows = rows.join(dominant(t), "dep", "left").withColumn("category", F.coalesce("category", F.lit("mixed")))
    out = rows.groupBy("category", "danger_class").agg(F.sum("x").alias("exposure"), F.sum("e").alias("events"))
    return out.withColumn("rate", F.col("events") / F.col("exposure"))


@query(
    "A9 A28",
    "category:s c1:f9 c2:f9 c3:f9 c4:f9 c5:f9 c6:f9",
    """WITH r AS (SELECT coalesce(d.category, 'mixed') AS category, danger_class AS k, y::INT AS y FROM classed c LEFT JOIN dominant d USING (dep))
       SELECT category, avg(y) FILTER (k = 1) AS c1, avg(y) FILTER (k = 2) AS c2, avg(y) FILTER (k = 3) AS c3, avg(y) FILTER (k = 4) AS c4,
              avg(y) FILTER (k = 5) AS c5, avg(y) FILTER (k = 6) AS c6 FROM r GROUP BY 1""",
)
def category_class_pivot(t):
    rates = rates_by_category_and_class(t)
    wide = reshape.cross_table(rates, "category", "danger_class", [1, 2, 3, 4, 5, 6], F.max("rate"))
    return wide.select("category", *[F.col(str(i)).alias(f"c{i}") for i in range(1, 7)])


@query(
    "A28",
    "doy:i y1995:f y1996:f y1997:f y1998:f y1999:f y2000:f y2001:f",
    """SELECT dayofyear(day) AS doy, avg(fwi) FILTER (year(day) = 1995) AS y1995, avg(fwi) FILTER (year(day) = 1996) AS y1996, avg(fwi) FILTER (year(day) = 1997) AS y1997,
              avg(fwi) FILTER (year(day) = 1998) AS y1998, avg(fwi) FILTER (year(day) = 1999) AS y1999, avg(fwi) FILTER (year(day) = 2000) AS y2000,
              avg(fwi) FILTER (year(day) = 2001) AS y2001 FROM measures GROUP BY 1""",
)
def year_by_doy(t):
    rows = t.measures.select(F.dayofyear("day").alias("doy"), F.year("day").alias("year"), "fwi")
    wide = reshape.cross_table(rows, "doy", "year", list(range(1995, 2002)), F.avg("fwi"))
    return wide.select("doy", *[F.col(str(y)).alias(f"y{y}") for y in range(1995, 2002)])


@query(
    "A10",
    "band:i low:f entities:i km2:f events:i ha:f3",
    """WITH b AS (SELECT entity, area_km2, CASE WHEN alt_mean < 0 THEN 0 WHEN alt_mean >= 600 THEN 13 ELSE floor(alt_mean / 50) + 1 END AS band FROM entities WHERE alt_mean IS NOT NULL),
       f AS (SELECT entity, count(*) AS n, sum(size) / 10000 AS ha FROM fires GROUP BY 1)
       SELECT band, (band - 1) * 50.0 AS low, count(DISTINCT entity) AS entities, sum(area_km2) AS km2, coalesce(sum(n), 0) AS events, coalesce(sum(ha), 0) AS ha
       FROM b LEFT JOIN f USING (entity) GROUP BY 1""",
)
def altitude_bands(t):
    return eda.equal_width_bands(t.entities, t.days, "alt_mean", 0, 600, 12)


@query(
    "A11",
    "category:s doy:i events:i ha:f3",
    """SELECT coalesce(d.category, 'mixed') AS category, dayofyear(f.day) AS doy, count(*) AS events, sum(size) / 10000 AS ha
       FROM fires f JOIN entities e USING (entity) LEFT JOIN dominant d USING (dep) GROUP BY 1, 2""",
)
def season_by_category(t):
    rows = t.events.join(t.entities.select("entity", "dep"), "entity").join(dominant(t), "dep", "left")
    return eda.season_by(rows.withColumn("category", F.coalesce("category", F.lit("mixed"))), "category")


@query(
    "V6",
    "dep:i doy:i events:i ha:f3",
    "SELECT dep, dayofyear(f.day) AS doy, count(*) AS events, sum(size) / 10000 AS ha FROM fires f JOIN entities USING (entity) GROUP BY 1, 2",
)
def season_by_department(t):
    return eda.season_by(t.events.join(t.entities.select("entity", "dep"), "entity"), "dep")


@query(
    "A45",
    "dep:i events:i winter:f summer:f",
    """SELECT dep, count(*) AS events, avg((dayofyear(f.day) BETWEEN 32 AND 105)::INT) AS winter, avg((dayofyear(f.day) BETWEEN 182 AND 258)::INT) AS summer
       FROM fires f JOIN entities USING (entity) GROUP BY 1 HAVING count(*) >= 30 ORDER BY winter DESC, dep LIMIT 3""",
)
def seasonal_leaders(t):
    shares = eda.seasonal_shares(season_by_department(t), "dep", {"winter": (32, 105), "summer": (182, 258)}, 30)
    return eda.top_k(shares, "winter", "dep", 3)


@query(
    "A23",
    "weekday:i events:i deviation_pct:f",
    """WITH c AS (SELECT isodow(ts) - 1 AS weekday, count(*) AS events FROM events GROUP BY 1)
       SELECT *, 100.0::DOUBLE * (events - (SELECT avg(events) FROM c)) / (SELECT avg(events) FROM c) AS deviation_pct FROM c""",
)
def weekday_signature(t):
    return eda.signature(t.table("events"), F.weekday("ts"), "weekday")


@query(
    "A23",
    "hour:i events:i deviation_pct:f",
    """WITH c AS (SELECT hour(ts) AS hour, count(*) AS events FROM events GROUP BY 1)
       SELECT *, 100.0::DOUBLE * (events - (SELECT avg(events) FROM c)) / (SELECT avg(events) FROM c) AS deviation_pct FROM c""",
)
def hour_signature(t):
    return eda.signature(t.table("events"), F.hour("ts"), "hour")


@query(
    "A23",
    "monthday:i events:i deviation_pct:f",
    """WITH c AS (SELECT dayofmonth(ts) AS monthday, count(*) AS events FROM events GROUP BY 1)
       SELECT *, 100.0::DOUBLE * (events - (SELECT avg(events) FROM c)) / (SELECT avg(events) FROM c) AS deviation_pct FROM c""",
)
def monthday_signature(t):
    return eda.signature(t.table("events"), F.dayofmonth("ts"), "monthday")


@query(
    "A23",
    "midnight_share:f max_weekday_pct:f first_day_ratio:f daily_grain_valid:b",
    """WITH c AS (SELECT isodow(ts) AS w, count(*) AS n FROM events GROUP BY 1), d AS (SELECT dayofmonth(ts) AS d, count(*) AS n FROM events GROUP BY 1),
       m AS (SELECT avg((hour(ts) = 0 AND minute(ts) = 0)::INT) AS midnight_share,
                    (SELECT max(abs(100.0::DOUBLE * (n - (SELECT avg(n) FROM c)) / (SELECT avg(n) FROM c))) FROM c) AS max_weekday_pct,
                    (SELECT max(n) FILTER (d = 1) / avg(n) FILTER (d > 1) FROM d) AS first_day_ratio FROM events)
       SELECT *, max_weekday_pct < 10 AND midnight_share < 0.05 AND first_day_ratio < 1.15 AS daily_grain_valid FROM m""",
)
def date_signature(t):
    return eda.date_quality(t.table("events"))


COVERAGE_SQL = """c AS (SELECT year(f.day) AS year, count(DISTINCT dep) AS groups, count(*) AS events, avg((dep IN (3, 5, 7, 11))::INT) AS listed_share
    FROM fires f JOIN entities USING (entity) GROUP BY 1), k AS (SELECT *, groups - lag(groups) OVER (ORDER BY year) AS groups_change FROM c)"""


@query("A24 W17", "year:i groups:i events:i listed_share:f groups_change:f", f"WITH {COVERAGE_SQL} SELECT * FROM k")
def yearly_coverage(t):
    return eda.coverage(t.events.join(t.entities.select("entity", "dep"), "entity"), "dep", (3, 5, 7, 11))


@query("A24", "break_year:i", f"WITH {COVERAGE_SQL} SELECT arg_max(year, (groups_change, -year)) AS break_year FROM k WHERE groups_change IS NOT NULL")
def coverage_break(t):
    return eda.break_year(yearly_coverage(t))


@query(
    "A26",
    "source:s end:d next_start:d touching:b shared:i",
    """WITH s AS (SELECT *, 'export-' || year(ts + INTERVAL 30 DAY) AS source FROM fires),
       f AS (SELECT source, min(day) AS start, max(day) AS "end" FROM s GROUP BY 1), b AS (SELECT source, "end", lead(start) OVER (ORDER BY start) AS next_start FROM f),
       x AS (SELECT day AS "end", count(*) FILTER (n > 1) AS shared FROM (SELECT day, ts, count(DISTINCT source) AS n FROM s GROUP BY 1, 2) GROUP BY 1)
       SELECT source, "end", next_start, "end" >= next_start AS touching, coalesce(shared, 0) AS shared FROM b LEFT JOIN x USING ("end") WHERE next_start IS NOT NULL""",
)
def export_overlap(t):
    """Consecutive yearly exports whose cut lies on 2 December."""
    shifted = F.year(F.date_add("day", 30))
    rows = t.events.withColumn("source", F.concat(F.lit("export-"), shifted.cast("string")))
    return eda.overlap_audit(rows, "source")


@query(
    "A27",
    "column:s missing:f",
    """SELECT 'population' AS column, avg((population IS NULL)::INT) AS missing FROM entities UNION ALL SELECT 'density', avg((density IS NULL)::INT) FROM entities
       UNION ALL SELECT 'alt_mean', avg((alt_mean IS NULL)::INT) FROM entities UNION ALL SELECT 'name', avg((name IS NULL)::INT) FROM entities""",
)
def missing_shares(t):
    return eda.missing_rates(t.entities, ("population", "density", "alt_mean", "name"))


@query(
    "A29",
    "reg:i per_1000_km2:f per_1000_km2_fuel:f touched_share:f",
    """WITH s AS (SELECT e.*, s.share_economy, coalesce(t.n, 0) AS events FROM entities e LEFT JOIN shares s ON s.dep = e.dep AND s.vintage = 1999
                  LEFT JOIN (SELECT entity, count(*) AS n FROM fires GROUP BY 1) t USING (entity))
       SELECT reg, sum(events) * 1000.0::DOUBLE / sum(area_km2) AS per_1000_km2, sum(events) * 1000.0::DOUBLE / nullif(sum(area_km2 * coalesce(share_economy, 0)), 0) AS per_1000_km2_fuel,
              avg((events > 0)::INT) AS touched_share FROM s GROUP BY 1""",
)
def region_rates(t):
    fixed = t.shares.filter("vintage = 1999").select("dep", "share_economy")
    return eda.normalised_rates(eda.entity_summary(t.entities.join(fixed, "dep", "left"), t.days), "reg", "share_economy")


@query(
    "A30",
    "year:i median_size:f3 p90_size:f3 events:i",
    "SELECT year(day) AS year, median(size) AS median_size, quantile_cont(size, 0.9) AS p90_size, count(*) AS events FROM fires GROUP BY 1",
)
def size_by_year(t):
    return eda.size_per_year(t.events)


@query(
    "A32",
    "bin:i rows:i",
    "SELECT floor(log10(size) * 4) AS bin, count(*) AS rows FROM fires WHERE size > 0 GROUP BY 1",
)
def size_histogram(t):
    return eda.log_histogram(t.events, "size")


@query(
    "A33",
    "top:s first_area:f last_area:f change:f",
    """WITH p AS (SELECT substr(category, 1, 1) AS top, vintage, sum(area) AS area FROM areas GROUP BY 1, 2)
       SELECT top, arg_min(area, vintage) AS first_area, arg_max(area, vintage) AS last_area, arg_max(area, vintage) - arg_min(area, vintage) AS change FROM p GROUP BY 1""",
)
def cover_change(t):
    return eda.hierarchy_change(t.areas, F.substring("category", 1, 1))


@query(
    "A34",
    "median_span:f p99_span:f",
    """WITH s AS (SELECT dep, max(a) - min(a) AS span FROM (SELECT dep, vintage, sum(area) AS a FROM areas GROUP BY 1, 2) GROUP BY 1)
       SELECT median(span) AS median_span, quantile_cont(span, 0.99) AS p99_span FROM s""",
)
def cover_stability(t):
    return eda.vintage_stability(t.areas, "dep")


@query(
    "A35",
    "differing_share:f max_diff:f",
    """WITH o AS (SELECT dep, year(l_shipdate) AS v, sum(l_quantity) AS a FROM lines GROUP BY 1, 2),
            r AS (SELECT dep, year(l_shipdate) AS v, sum(l_quantity) AS a FROM lines WHERE l_discount < 0.1 GROUP BY 1, 2)
       SELECT avg((abs(o.a - r.a) > 10)::INT) AS differing_share, max(abs(o.a - r.a)) AS max_diff FROM o JOIN r USING (dep, v)""",
)
def revision_difference(t):
    per = lambda df: df.groupBy("dep", F.year("l_shipdate").alias("v")).agg(F.sum("l_quantity").alias("a"))
    return eda.revision_diff(per(t.lines), per(t.lines.filter("l_discount < 0.1")), ["dep", "v"], "a", 10.0)


@query(
    "A36",
    "year:i variable:s low:f high:f mean:f in_range:b",
    """WITH l AS (SELECT year(day) AS year, variable, value FROM (UNPIVOT measures ON fwi, ffmc, dmc, dc INTO NAME variable VALUE value)),
       s AS (SELECT year, variable, min(value) AS low, max(value) AS high, avg(value) AS mean FROM l GROUP BY 1, 2)
       SELECT *, CASE variable WHEN 'fwi' THEN low >= 0 AND high <= 60 WHEN 'ffmc' THEN low >= 0 AND high <= 80 ELSE true END AS in_range FROM s""",
)
def documented_ranges(t):
    return eda.range_report(t.measures, INDICES, {"fwi": (0.0, 60.0), "ffmc": (0.0, 80.0)})


@query(
    "A37",
    "year:i bound:f days:f",
    """SELECT year, bound, avg(n) AS days FROM (SELECT cell, year(day) AS year, bound, count(*) FILTER (fwi > bound) AS n
       FROM measures, (SELECT unnest([11.2::DOUBLE, 21.3::DOUBLE, 38.0::DOUBLE]) AS bound) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def exceedance_days(t):
    return eda.exceedance_days(t.measures, (11.2, 21.3, 38.0))


@query(
    "A40",
    "segment:s variable:s mean:f z:f place:i",
    """WITH m AS (SELECT segment, variable, avg(value) AS mean FROM (UNPIVOT (SELECT segment, area_km2, alt_mean, density_grid::DOUBLE AS density_grid, lat FROM entities)
                  ON area_km2, alt_mean, density_grid, lat INTO NAME variable VALUE value) GROUP BY 1, 2),
       z AS (SELECT *, (mean - avg(mean) OVER (PARTITION BY variable)) / stddev_samp(mean) OVER (PARTITION BY variable) AS z FROM m)
       SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY abs(z) DESC, variable) AS place FROM z) WHERE place <= 3""",
)
def segment_profiles(t):
    rows = t.entities.withColumn("density_grid", F.col("density_grid").cast("double"))
    return eda.group_profile(rows, "segment", ("area_km2", "alt_mean", "density_grid", "lat"), top=3)


@query(
    "A41",
    "block:s importance:f share:f",
    """WITH i AS (SELECT 'fwi' AS feature, avg(fwi) AS importance FROM measures UNION ALL SELECT 'ffmc', avg(ffmc) FROM measures UNION ALL SELECT 'dmc', avg(dmc) FROM measures UNION ALL SELECT 'dc', avg(dc) FROM measures)
       SELECT CASE WHEN feature IN ('fwi', 'ffmc') THEN 'surface' WHEN feature = 'dmc' THEN 'deep' ELSE 'other' END AS block, sum(importance) AS importance,
              sum(importance) / (SELECT sum(importance) FROM i) AS share FROM i GROUP BY 1""",
)
def importance_by_block(t):
    """Feature weights (here the mean level of each index) summed by block of features."""
    weights = t.measures.agg(*[F.avg(c).alias(c) for c in INDICES]).unpivot([], list(INDICES), "feature", "importance")
    known = F.when(F.col("feature").isin("fwi", "ffmc"), "surface").when(F.col("feature") == "dmc", "deep")
    blocks = weights.select("feature", known.alias("block")).filter("block IS NOT NULL")
    return eda.importance_blocks(weights, blocks)


@query(
    "A42",
    "feature:s random:f top:f places_gained:i",
    """WITH c AS (UNPIVOT (SELECT event_id, score_a - 0.5 AS score_a, score_b - 0.5 AS score_b, score_c * 0.1 AS score_c FROM predictions) ON score_a, score_b, score_c INTO NAME feature VALUE value),
       s AS (SELECT 'random' AS sample, feature, value FROM c UNION ALL SELECT 'top', feature, value FROM c JOIN predictions p USING (event_id) WHERE p.score_b > 0.9),
       r AS (SELECT sample, feature, avg(abs(value)) AS m, rank() OVER (PARTITION BY sample ORDER BY avg(abs(value)) DESC) AS k FROM s GROUP BY 1, 2)
       SELECT a.feature, a.m AS random, b.m AS top, a.k - b.k AS places_gained FROM r a JOIN r b USING (feature) WHERE a.sample = 'random' AND b.sample = 'top'""",
)
def contribution_shift(t):
    p = t.predictions.withColumn("is_top", F.col("score_b") > 0.9)
    wide = p.select("is_top", (F.col("score_a") - 0.5).alias("score_a"), (F.col("score_b") - 0.5).alias("score_b"), (F.col("score_c") * 0.1).alias("score_c"))
    long = wide.unpivot(["is_top"], ["score_a", "score_b", "score_c"], "feature", "value")
    names = F.when(F.col("is_top"), F.array(F.lit("random"), F.lit("top"))).otherwise(F.array(F.lit("random")))
    return eda.contribution_shift(long.select(F.explode(names).alias("sample"), "feature", "value"))


@query(
    "A43",
    "bin:i x:f value:f rows:i",
    """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(score_a, [i / 24.0::DOUBLE for i in range(0, 25)]))) AS e FROM predictions),
       b AS (SELECT score_a, score_b, greatest(least(len(list_filter(e, lambda v: v <= score_a)) - 1, len(e) - 2), 0) AS bin FROM predictions, e)
       SELECT bin, median(score_a) AS x, median(score_b) AS value, count(*) AS rows FROM b GROUP BY 1""",
)
def conditional_median(t):
    return eda.median_by_bin(t.predictions, "score_a", "score_b", 24)


@query(
    "A43",
    "bin_x:i bin_z:i value:f rows:i",
    """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(score_a, [i / 8.0::DOUBLE for i in range(0, 9)]))) AS e,
                         list_sort(list_distinct(quantile_cont(score_b, [i / 8.0::DOUBLE for i in range(0, 9)]))) AS f FROM predictions),
       b AS (SELECT score_c, greatest(least(len(list_filter(e, lambda v: v <= score_a)) - 1, len(e) - 2), 0) AS bin_x,
                    greatest(least(len(list_filter(f, lambda v: v <= score_b)) - 1, len(f) - 2), 0) AS bin_z FROM predictions, e)
       SELECT bin_x, bin_z, CASE WHEN count(*) >= 20 THEN median(score_c) END AS value, count(*) AS rows FROM b GROUP BY 1, 2""",
)
def conditional_median_grid(t):
    return eda.median_grid(t.predictions, "score_a", "score_b", "score_c", 8)


@query(
    "A44",
    "band:i rows:i rate:f",
    """SELECT CASE WHEN score_a > -0.01 AND score_a <= 0.1 THEN 0 WHEN score_a > 0.1 AND score_a <= 0.3 THEN 1 WHEN score_a > 0.3 AND score_a <= 1 THEN 2 END AS band,
              count(*) AS rows, avg(y) AS rate FROM predictions GROUP BY 1""",
)
def fixed_bands(t):
    return t.predictions.groupBy(band_right_closed("score_a", (-0.01, 0.1, 0.3, 1.0)).alias("band")).agg(
        F.count("*").alias("rows"), F.avg("y").alias("rate")
    )


@query(
    "A47",
    "mean_score:f max_score:f in_danger:i decile_size:i top_entity:i",
    """WITH d AS (SELECT e.entity, m.fwi / 51 AS score, CASE WHEN m.fwi < 5.2 THEN 1 WHEN m.fwi < 11.2 THEN 2 WHEN m.fwi < 21.3 THEN 3 WHEN m.fwi < 38 THEN 4 WHEN m.fwi < 50 THEN 5 ELSE 6 END AS k
                  FROM entities e JOIN measures m ON m.cell = e.cell AND m.day = DATE '1999-08-02')
       SELECT avg(score) AS mean_score, max(score) AS max_score, count(*) FILTER (k >= 5) AS in_danger, count(*) // 10 AS decile_size, arg_max(entity, (score, -entity)) AS top_entity FROM d""",
)
def day_indicators(t):
    return eda.day_kpis(scored_day(t, "1999-08-02"), "score", "entity")


def scored_day(t, date):
    """Every entity with the measure of its cell on a day, as a score and as a danger class."""
    day = t.measures.filter(F.col("day") == F.lit(date).cast("date"))
    rows = t.entities.select("entity", "cell").join(day, "cell")
    return rows.withColumns({"score": F.col("fwi") / 51, "danger_class": threshold_class("fwi")})


def two_days(t):
    """A summer day and the same day two years later; entities differ in area, so their scores do too."""
    areas = t.entities.select("entity", "area_km2")
    for date in ("1997-08-02", "1999-08-02"):
        yield scored_day(t, date).join(areas, "entity").withColumn("score", F.col("fwi") * F.month(F.lit(date)) / (F.col("area_km2") + F.col("ffmc")))


TWO_DAYS_SQL = """d AS (SELECT e.entity, m.day, m.fwi, m.fwi * 8 / (e.area_km2 + m.ffmc) AS score,
        CASE WHEN m.fwi < 5.2 THEN 1 WHEN m.fwi < 11.2 THEN 2 WHEN m.fwi < 21.3 THEN 3 WHEN m.fwi < 38 THEN 4 WHEN m.fwi < 50 THEN 5 ELSE 6 END AS k
        FROM entities e JOIN measures m ON m.cell = e.cell AND m.day IN (DATE '1997-08-02', DATE '1999-08-02')),
    j AS (SELECT a.entity, a.fwi AS measure_a, b.fwi AS measure_b, b.fwi - a.fwi AS change, a.k AS ka, b.k AS kb, b.score / nullif(a.score, 0) AS ratio
          FROM d a JOIN d b USING (entity) WHERE a.day < b.day)"""


@query(
    "A47",
    "mean:f mean_change:f in_danger:i in_danger_change:i rising:i rising_share:f median_ratio:f",
    f"""WITH {TWO_DAYS_SQL} SELECT avg(measure_b) AS mean, avg(measure_b) - avg(measure_a) AS mean_change, count(*) FILTER (kb >= 3) AS in_danger,
        count(*) FILTER (kb >= 3) - count(*) FILTER (ka >= 3) AS in_danger_change, count(*) FILTER (change > 0) AS rising,
        avg((change > 0)::INT) AS rising_share, quantile_cont(ratio, 0.5) AS median_ratio FROM j""",
)
def day_deltas(t):
    return eda.compare_days(*two_days(t), "entity", "score", "fwi")


@query(
    "A47",
    "entity:i measure_a:f measure_b:f change:f",
    f"WITH {TWO_DAYS_SQL} SELECT entity, measure_a, measure_b, change FROM j ORDER BY change DESC, entity LIMIT 10",
)
def steepest_rises(t):
    return eda.top_k(eda.paired_days(*two_days(t), "entity", "score", "fwi"), "change", "entity", 10)


@query(
    "A50",
    "decade:i doy:i mean:f",
    "SELECT year(day) // 10 * 10 AS decade, dayofyear(day) AS doy, avg(fwi) AS mean FROM measures GROUP BY 1, 2",
)
def decade_profiles(t):
    return eda.decade_profile(t.measures)


@query(
    "A51",
    "feature_set:s mean:f worst:f folds:i",
    """WITH f AS (SELECT year(day) AS fold, unnest(['A', 'B']) AS feature_set, unnest([fwi, ffmc]) AS v FROM measures),
       r AS (SELECT fold, feature_set, avg(v) AS v FROM f GROUP BY 1, 2) SELECT feature_set, avg(v) AS mean, min(v) AS worst, count(*) AS folds FROM r GROUP BY 1""",
)
def fold_summaries(t):
    per = t.measures.groupBy(F.year("day").alias("fold")).agg(F.avg("fwi").alias("A"), F.avg("ffmc").alias("B"))
    return eda.fold_summary(per.unpivot(["fold"], ["A", "B"], "feature_set", "v"), "feature_set", "v")


@query(
    "A52",
    "dep:i area_total:f " + " ".join(f"share_{c.lower()}:f" for c in CATEGORIES),
    "SELECT dep, sum(area) AS area_total, "
    + ", ".join(f"coalesce(sum(area) FILTER (category = '{c}'), 0) / sum(area) AS share_{c.lower()}" for c in CATEGORIES)
    + " FROM areas GROUP BY 1 ORDER BY share_standard DESC, dep LIMIT 12",
)
def zone_composition(t):
    return eda.top_k(eda.category_composition(t.areas, "dep", CATEGORIES), "share_standard", "dep", 12)


@query(
    "A53",
    "year:i filled:f values:i",
    "SELECT year(day) AS year, avg((cause IS NOT NULL)::INT) AS filled, count(DISTINCT cause) AS values FROM (SELECT day, nullif(cause, 'P') AS cause FROM fires) GROUP BY 1",
)
def cause_fill(t):
    return eda.category_fill(t.events.withColumn("cause", F.nullif("cause", F.lit("P"))), "cause")


@query(
    "A53",
    "year:i category:s events:i share:f",
    """WITH c AS (SELECT year(day) AS year, nullif(cause, 'P') AS category, count(*) AS events FROM fires GROUP BY 1, 2)
       SELECT *, events / sum(events) OVER (PARTITION BY year) AS share FROM c""",
)
def cause_counts(t):
    return eda.category_counts(t.events.withColumn("cause", F.nullif("cause", F.lit("P"))), "cause")


@query(
    "A54",
    "cell:i decade:i summer_mean:f",
    """WITH y AS (SELECT cell, year(day) AS y, avg(fwi) AS m FROM measures WHERE month(day) BETWEEN 6 AND 9 GROUP BY 1, 2)
       SELECT cell, y // 10 * 10 AS decade, avg(m) AS summer_mean FROM y GROUP BY 1, 2 UNION ALL SELECT cell, 0, avg(m) FROM y GROUP BY 1""",
)
def summer_levels(t):
    return eda.summer_means(t.measures)


@query(
    "A55",
    "day:d all_cells:f used_cells:f",
    "SELECT day, avg(fwi) AS all_cells, avg(fwi) FILTER (cell IN (SELECT cell FROM entities WHERE reg < 3)) AS used_cells FROM measures GROUP BY 1",
)
def masked_mean(t):
    return eda.spatial_mean(t.measures, t.entities.filter("reg < 3"))


@query(
    "A56",
    "p50:f3 p90:f3 p95:f3 p99:f3 max:f3 zero_share:f",
    """SELECT quantile_cont(size, 0.5) AS p50, quantile_cont(size, 0.9) AS p90, quantile_cont(size, 0.95) AS p95, quantile_cont(size, 0.99) AS p99, max(size) AS max, avg((size = 0)::INT) AS zero_share FROM fires""",
)
def size_distribution(t):
    return eda.distribution(t.events, "size")


@query(
    "W10",
    "danger_class:i exposure_at_or_above:f events_at_or_above:f",
    """WITH c AS (SELECT danger_class, count(*) AS x, count(*) FILTER (y) AS e FROM classed GROUP BY 1)
       SELECT danger_class, sum(x) OVER w::DOUBLE / sum(x) OVER () AS exposure_at_or_above, sum(e) OVER w::DOUBLE / sum(e) OVER () AS events_at_or_above FROM c WINDOW w AS (ORDER BY danger_class DESC)""",
)
def reverse_cumulative(t):
    return eda.reverse_cumulative_share(eda.rates_by(t.classed(), ["danger_class"]), "danger_class", ("exposure", "events"))


@query(
    "W11",
    "year:i doy:i events:i running:i",
    """SELECT *, sum(events) OVER (PARTITION BY year ORDER BY doy) AS running FROM (SELECT year(day) AS year, dayofyear(day) AS doy, count(*) AS events FROM fires GROUP BY 1, 2)""",
)
def running_year_total(t):
    daily = t.events.groupBy(F.year("day").alias("year"), F.dayofyear("day").alias("doy")).agg(F.count("*").alias("events"))
    return eda.running_in_year(daily, "events")


SEASON_SQL = """s AS (SELECT g.doy, coalesce(e.n, 0) AS events FROM (SELECT unnest(range(1, 367)) AS doy) g LEFT JOIN (SELECT dayofyear(day) AS doy, count(*) AS n FROM fires GROUP BY 1) e USING (doy))"""


def dense_season(t):
    season = t.events.groupBy(F.dayofyear("day").alias("doy")).agg(F.count("*").alias("events"))
    return reshape.densify(season, reshape.integers(t.spark, 1, 366, "doy"), ["doy"], ["events"])


@query(
    "W8",
    "doy:i events:i smooth5:f smooth7:f smooth11:f smooth15:f",
    f"""WITH {SEASON_SQL} SELECT *, avg(events) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth5, avg(events) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS smooth7,
        avg(events) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS smooth11, avg(events) OVER (w ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS smooth15 FROM s WINDOW w AS (ORDER BY doy)""",
)
def smoothed_season(t):
    out = dense_season(t)
    for width in (5, 7, 11, 15):
        out = eda.centred_mean(out, "doy", "events", width // 2, name=f"smooth{width}")
    return out


@query(
    "W19",
    "doy:i events:i around:f excess:f",
    f"""WITH {SEASON_SQL}, a AS (SELECT *, (sum(events) OVER w - events)::DOUBLE / (count(*) OVER w - 1) AS around FROM s WINDOW w AS (ORDER BY doy ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))
        SELECT *, events / nullif(around, 0) AS excess FROM a""",
)
def season_excess(t):
    return eda.local_excess(dense_season(t), "doy", "events")


@query(
    "F1 F3 F4",
    "entity:i digits:s number:i wrong:b short:s",
    """SELECT c_custkey AS entity, regexp_extract(c_name, '#0*([0-9]+)$', 1) AS digits, TRY_CAST(split_part(c_name, '#', 2) AS BIGINT) AS number,
              TRY_CAST(c_mktsegment AS BIGINT) IS NULL AS wrong, upper(substr(lower(c_mktsegment), 1, 3)) AS short FROM customer""",
)
def parsed_names(t):
    """Pattern extraction and tolerant parsing of text keys."""
    c = t.table("customer")
    return c.select(
        F.col("c_custkey").alias("entity"),
        F.regexp_extract("c_name", r"#0*([0-9]+)$", 1).alias("digits"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).try_cast("bigint").alias("number"),
        F.col("c_mktsegment").try_cast("bigint").isNull().alias("wrong"),
        F.upper(F.substring(F.lower("c_mktsegment"), 1, 3)).alias("short"),
    )


@query(
    "F10",
    "vec_id:i length:i rounded_sum:f paired_sum:f",
    """SELECT vec_id, len(embedding) AS length, list_sum([round(v::DOUBLE, 2) for v in embedding]) AS rounded_sum,
              list_sum([(p[1]::DOUBLE) * (p[2]::DOUBLE) for p in list_zip(embedding, list_reverse(embedding))]) AS paired_sum FROM embeddings""",
)
def vertex_arrays(t):
    """Rounding, zipping and length of arrays."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    values = F.transform("embedding", lambda v: v.cast("double"))
    pairs = F.arrays_zip(values.alias("a"), F.reverse(values).alias("b"))
    return t.table("embeddings").select(
        "vec_id",
        F.size("embedding").alias("length"),
        total(F.transform(values, lambda v: F.round(v, 2))).alias("rounded_sum"),
        total(F.transform(pairs, lambda p: p["a"] * p["b"])).alias("paired_sum"),
    )
