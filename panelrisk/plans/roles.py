"""The supplied tables in the roles of the panel, as Spark plans and as the same CTEs in SQL.

entity     customer (department = nation, region = region); other attributes are exact integer
           functions of its key and balance
event      urgent orders: entity, day, size
measure    one row per (cell, day) from line items; cell = region of the supplier
land cover area per (department, vintage, category) from line items and parts
prediction the events table scored by two formulas, keyed by event_id
moves      code movements read off orders; live codes = customers with a positive balance
"""
from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.operators.baselines import classed_panel
from panelrisk.operators.features import asof_years, category_shares, event_lags
from panelrisk.operators.panel import NEGATIVE_SHARE, dense_panel, event_days, exposure, with_split
from panelrisk.session import cut_lineage

START, END = "1995-01-01", "2001-08-01"
TRAIN_END, VAL_END = 1998, 1999
TRAIN_STOP = "1998-12-31"
FIT_END, JUDGE_YEAR = 1997, 1998
VINTAGES = (1995, 1997, 1999)
CATEGORIES = ("STANDARD", "ECONOMY", "SMALL", "LARGE", "PROMO", "MEDIUM")
INDICES = ("fwi", "ffmc", "dmc", "dc")
SHARES = {
    "share_standard": "category = 'STANDARD'",
    "share_economy": "category = 'ECONOMY'",
    "share_small": "category = 'SMALL'",
    "share_large": "category = 'LARGE'",
    "share_promo": "category = 'PROMO'",
    "share_medium": "category = 'MEDIUM'",
    "share_bulk": "category IN ('LARGE', 'MEDIUM')",
    "share_s": "category LIKE 'S%'",
    "share_not_s": "category NOT LIKE 'S%'",
}
SHARE_COLUMNS = tuple(SHARES)
RULES = (("share_standard", 0.17, "standard"), ("share_economy", 0.168, "economy"), ("share_promo", 0.165, "promo"))


class Roles:
    """Lazy plans over one folder of the supplied tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def entities(self) -> DataFrame:
        c, n = self.table("customer"), self.table("nation")
        k = F.col("c_custkey")
        area = F.lit(1) + k % 97
        people = F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal")).cast("bigint"))
        low, high = (k * 31) % 500, (k * 17) % 900
        return c.join(n, c.c_nationkey == n.n_nationkey).select(
            k.alias("entity"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("dep"),
            F.col("n_regionkey").alias("reg"),
            F.col("n_regionkey").alias("cell"),
            (F.lit(41.35) + (k * 7919 % 1000003) / 1000003.0 * 9.95).alias("lat"),
            (F.lit(-5.1) + (k * 104729 % 1000003) / 1000003.0 * 14.5).alias("lon"),
            area.cast("double").alias("area_km2"),
            people.alias("population"),
            (people / area).alias("density"),
            low.alias("alt_min"),
            high.alias("alt_max"),
            ((low + high) / 2).alias("alt_mean"),
            (F.lit(1) + k % 7).alias("density_grid"),
        )

    @cached_property
    def events(self) -> DataFrame:
        o = self.table("orders").filter(F.col("o_orderpriority") == "1-URGENT")
        return o.select(
            F.col("o_orderkey").alias("event_id"),
            F.col("o_custkey").alias("entity"),
            F.to_date("o_orderdate").alias("day"),
            F.col("o_orderdate").alias("ts"),
            F.col("o_totalprice").alias("size"),
            F.col("o_orderstatus").alias("cause"),
        )

    @cached_property
    def days(self) -> DataFrame:
        return event_days(self.events)

    @cached_property
    def lines(self) -> DataFrame:
        """Line items with the department and cell of their supplier."""
        s, n = self.table("supplier"), self.table("nation")
        place = s.join(n, s.s_nationkey == n.n_nationkey).select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dep"), F.col("n_regionkey").alias("cell")
        )
        return self.table("lineitem").join(place, "l_suppkey")

    @cached_property
    def measures(self) -> DataFrame:
        q = F.col("l_quantity").cast("bigint")
        rows = self.lines.select("cell", F.to_date("l_shipdate").alias("day"), q.alias("q"), "l_partkey", "l_suppkey", "l_linenumber")
        return rows.groupBy("cell", "day").agg(
            (F.lit(1) + F.sum("q") % 50 + (F.sum("l_linenumber") % 10) / 10.0).alias("fwi"),
            ((F.sum("l_partkey") % 1000) / 10.0).alias("ffmc"),
            ((F.sum("l_suppkey") % 500) / 10.0).alias("dmc"),
            (F.sum(F.col("q") * F.col("l_linenumber")) % 800).cast("double").alias("dc"),
        )

    @cached_property
    def written_measures(self) -> DataFrame:
        """The measures for plans that read them several times: the line items are read once."""
        return cut_lineage(self.measures)

    @cached_property
    def areas(self) -> DataFrame:
        p = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"))
        # Each line belongs to the vintage in force when it was shipped; lines before the first vintage belong to that.
        in_force = F.coalesce(*[F.when(F.year("l_shipdate") >= v, F.lit(v)) for v in sorted(VINTAGES, reverse=True)], F.lit(min(VINTAGES)))
        rows = self.lines.withColumn("vintage", in_force)
        return rows.join(p, "l_partkey").groupBy("dep", "vintage", "category").agg(F.sum("l_quantity").alias("area"))

    @cached_property
    def shares(self) -> DataFrame:
        return category_shares(self.areas, SHARES, ["dep", "vintage"])

    @cached_property
    def share_years(self) -> DataFrame:
        return asof_years(self.shares, "dep", "vintage", int(END[:4]))

    @cached_property
    def lags(self) -> DataFrame:
        return event_lags(self.days)

    def panel(self, start: str = START, end: str = END, keep=(), horizons=None) -> DataFrame:
        rows = dense_panel(self.entities, self.days, start, end, keep, horizons=horizons)
        return with_split(rows, TRAIN_END, VAL_END)

    def classed(self, keep=()) -> DataFrame:
        """The whole panel with the danger class of each entity's cell and day."""
        rows = classed_panel(self.entities, self.days, self.measures, START, END, keep)
        return with_split(rows, TRAIN_END, VAL_END)

    @cached_property
    def sample(self) -> DataFrame:
        """Train rows of the sample: every positive and the drawn negatives."""
        return self.sampled()

    def sampled(self, horizons=None) -> DataFrame:
        """The sample of the train period, drawn before its rows are made."""
        rows = dense_panel(self.entities, self.days, START, TRAIN_STOP, horizons=horizons, share=NEGATIVE_SHARE)
        return with_split(rows, TRAIN_END, VAL_END)

    @cached_property
    def counts(self) -> DataFrame:
        return exposure(self.days, self.entities, START, TRAIN_STOP)

    @cached_property
    def clusters(self) -> DataFrame:
        """A fixed partition for the smoothing: market segment and department parity; one segment has no profile."""
        label = F.ascii("segment") % 7 * 10 + F.col("dep") % 3
        return self.entities.filter(F.col("segment") != "FURNITURE").select("entity", label.cast("int").alias("cluster"))

    @cached_property
    def predictions(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            "event_id",
            F.col("user_id").alias("entity"),
            F.to_date("ts").alias("day"),
            (F.col("event_type") == "purchase").cast("int").alias("y"),
            (F.col("value") / 500.0).alias("score_a"),
            ((F.col("event_id") * 7919 % 10007) / 10007.0).alias("score_b"),
            ((F.col("event_id") * 104729 % 1009) / 1009.0).alias("score_c"),
        )

    @cached_property
    def moves(self) -> DataFrame:
        o = self.table("orders")
        k = F.col("o_orderkey")
        kind = F.when(k % 11 == 0, "21").when(k % 13 == 0, "10").otherwise(F.concat(F.lit("3"), (F.lit(1) + k % 5).cast("string")))
        return o.select(
            kind.alias("kind"),
            F.to_date("o_orderdate").cast("string").alias("effective"),
            F.when(k % 4 == 0, "COMD").otherwise("COM").alias("target_type"),
            F.col("o_custkey").alias("source"),
            (F.col("o_custkey") + k % 40 - 20).alias("target"),
        )

    @cached_property
    def live(self) -> DataFrame:
        return self.table("customer").filter(F.col("c_acctbal") > 6000).select(F.col("c_custkey").alias("code"))


# The same roles in DuckDB SQL, in dependency order.
ROLE_SQL: dict[str, str] = {
    "entities": """
        SELECT c_custkey AS entity, c_name AS name, c_mktsegment AS segment, c_nationkey AS dep,
               n_regionkey AS reg, n_regionkey AS cell,
               41.35::DOUBLE + (c_custkey * 7919 % 1000003) / 1000003.0::DOUBLE * 9.95::DOUBLE AS lat,
               -5.1::DOUBLE + (c_custkey * 104729 % 1000003) / 1000003.0::DOUBLE * 14.5::DOUBLE AS lon,
               (1 + c_custkey % 97)::DOUBLE AS area_km2,
               CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal)::BIGINT END AS population,
               (CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal)::BIGINT END)::DOUBLE / (1 + c_custkey % 97) AS density,
               c_custkey * 31 % 500 AS alt_min, c_custkey * 17 % 900 AS alt_max,
               (c_custkey * 31 % 500 + c_custkey * 17 % 900)::DOUBLE / 2 AS alt_mean,
               1 + c_custkey % 7 AS density_grid
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "fires": """
        SELECT o_orderkey AS event_id, o_custkey AS entity, o_orderdate::DATE AS day, o_orderdate AS ts,
               o_totalprice AS size, o_orderstatus AS cause
        FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "days": """
        SELECT entity, day, count(*) AS n, sum(coalesce(size, 0)) AS size FROM fires GROUP BY 1, 2""",
    "calendar": f"""
        SELECT d::DATE AS day, year(d)::INT AS year, month(d)::INT AS month, dayofyear(d)::INT AS doy,
               (isodow(d) - 1)::INT AS weekday
        FROM (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 1 DAY)) AS d)""",
    "lines": """
        SELECT l.*, s_nationkey AS dep, n_regionkey AS cell
        FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "measures": """
        SELECT cell, l_shipdate::DATE AS day,
               (1 + sum(l_quantity::BIGINT) % 50 + (sum(l_linenumber) % 10)::DOUBLE / 10)::DOUBLE AS fwi,
               (sum(l_partkey) % 1000)::DOUBLE / 10 AS ffmc, (sum(l_suppkey) % 500)::DOUBLE / 10 AS dmc,
               (sum(l_quantity::BIGINT * l_linenumber) % 800)::DOUBLE AS dc
        FROM lines GROUP BY 1, 2""",
    "areas": """
        SELECT dep, greatest(1995, (SELECT max(v) FROM (SELECT unnest([1995, 1997, 1999]) AS v) WHERE v <= greatest(1995, year(l_shipdate))))::INT AS vintage,
               p_type AS category, sum(l_quantity) AS area
        FROM lines JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "shares": """
        SELECT dep, vintage, sum(area) AS area_total,
               coalesce(sum(area) FILTER (category = 'STANDARD'), 0) / nullif(sum(area), 0) AS share_standard,
               coalesce(sum(area) FILTER (category = 'ECONOMY'), 0) / nullif(sum(area), 0) AS share_economy,
               coalesce(sum(area) FILTER (category = 'SMALL'), 0) / nullif(sum(area), 0) AS share_small,
               coalesce(sum(area) FILTER (category = 'LARGE'), 0) / nullif(sum(area), 0) AS share_large,
               coalesce(sum(area) FILTER (category = 'PROMO'), 0) / nullif(sum(area), 0) AS share_promo,
               coalesce(sum(area) FILTER (category = 'MEDIUM'), 0) / nullif(sum(area), 0) AS share_medium,
               coalesce(sum(area) FILTER (category IN ('LARGE', 'MEDIUM')), 0) / nullif(sum(area), 0) AS share_bulk,
               coalesce(sum(area) FILTER (category LIKE 'S%'), 0) / nullif(sum(area), 0) AS share_s,
               coalesce(sum(area) FILTER (category NOT LIKE 'S%'), 0) / nullif(sum(area), 0) AS share_not_s
        FROM areas GROUP BY 1, 2""",
    "dominant": """
        SELECT dep, CASE WHEN share_standard > 0.17 THEN 'standard' WHEN share_economy > 0.168 THEN 'economy'
                         WHEN share_promo > 0.165 THEN 'promo' ELSE 'mixed' END AS category
        FROM shares WHERE vintage = 1997""",
    "lags": """
        SELECT entity, (day + lag)::DATE AS day,
               coalesce(sum(n) FILTER (lag <= 7), 0)::BIGINT AS events_7d,
               coalesce(sum(n) FILTER (lag <= 30), 0)::BIGINT AS events_30d,
               coalesce(sum(n) FILTER (lag <= 90), 0)::BIGINT AS events_90d, sum(n)::BIGINT AS events_365d,
               coalesce(sum(size) FILTER (lag <= 30), 0) AS size_30d, min(lag)::BIGINT AS days_since_event
        FROM days, (SELECT unnest(range(1, 366))::INT AS lag) GROUP BY 1, 2""",
    "panel": f"""
        SELECT e.entity, e.cell, e.dep, e.reg, c.day, c.year, c.month, c.doy, coalesce(d.n, 0) > 0 AS y,
               coalesce(d.n, 0) AS n_events, coalesce(d.size, 0) AS size,
               CASE WHEN c.year <= {TRAIN_END} THEN 'train' WHEN c.year <= {VAL_END} THEN 'val' ELSE 'test' END AS split
        FROM entities e CROSS JOIN calendar c LEFT JOIN days d ON d.entity = e.entity AND d.day = c.day""",
    "panel_u": """
        SELECT *, (('0x' || substr(md5(entity || '|' || day), 1, 8))::BIGINT % 1000000)::DOUBLE / 1000000 AS u FROM panel""",
    "train_sample": f"""
        SELECT * FROM panel_u WHERE day <= DATE '{TRAIN_STOP}' AND (y OR u < 0.00189)""",
    "classed": """
        SELECT p.*, m.fwi, CASE WHEN m.fwi < 5.2 THEN 1 WHEN m.fwi < 11.2 THEN 2 WHEN m.fwi < 21.3 THEN 3
                                WHEN m.fwi < 38 THEN 4 WHEN m.fwi < 50 THEN 5 ELSE 6 END AS danger_class
        FROM panel p JOIN measures m ON m.cell = p.cell AND m.day = p.day""",
    "counts": f"""
        SELECT entity, year, count(*) AS days, count(*) FILTER (y) AS events
        FROM panel WHERE day <= DATE '{TRAIN_STOP}' GROUP BY 1, 2""",
    "clusters": """
        SELECT entity, ((ascii(segment) % 7) * 10 + dep % 3)::INT AS cluster FROM entities WHERE segment <> 'FURNITURE'""",
    "all_clusters": """
        SELECT entity, cluster FROM clusters
        UNION ALL SELECT DISTINCT entity, -1 FROM counts WHERE entity NOT IN (SELECT entity FROM clusters)""",
    "rates": """
        WITH s AS (SELECT * FROM counts JOIN all_clusters USING (entity)),
        base AS (SELECT sum(events)::DOUBLE / sum(days) AS b FROM s),
        ys AS (SELECT 0 AS x UNION ALL SELECT DISTINCT year FROM s),
        ce AS (SELECT cluster, x, sum(days)::DOUBLE AS d, sum(events)::DOUBLE AS f,
                      coalesce(sum(days) FILTER (year = x), 0)::DOUBLE AS dx,
                      coalesce(sum(events) FILTER (year = x), 0)::DOUBLE AS fx FROM s, ys GROUP BY 1, 2),
        ee AS (SELECT entity, cluster, x, sum(days)::DOUBLE AS d, sum(events)::DOUBLE AS f,
                      coalesce(sum(days) FILTER (year = x), 0)::DOUBLE AS dx,
                      coalesce(sum(events) FILTER (year = x), 0)::DOUBLE AS fx FROM s, ys GROUP BY 1, 2, 3),
        cr AS (SELECT cluster, x, ((f - fx) * d / (d - dx) + 20000 * b) / (d + 20000) AS cluster_rate FROM ce, base)
        SELECT entity, x AS excluded_year, cluster, cluster_rate,
               ((f - fx) * d / (d - dx) + 2000 * cluster_rate) / (d + 2000) AS entity_rate
        FROM ee JOIN cr USING (cluster, x)""",
    "predictions": """
        SELECT event_id, user_id AS entity, ts::DATE AS day, (event_type = 'purchase')::INT AS y,
               value / 500::DOUBLE AS score_a, (event_id * 7919 % 10007)::DOUBLE / 10007 AS score_b,
               (event_id * 104729 % 1009)::DOUBLE / 1009 AS score_c FROM events""",
    "moves": """
        SELECT CASE WHEN o_orderkey % 11 = 0 THEN '21' WHEN o_orderkey % 13 = 0 THEN '10'
                    ELSE '3' || (1 + o_orderkey % 5) END AS kind,
               o_orderdate::DATE::VARCHAR AS effective, CASE WHEN o_orderkey % 4 = 0 THEN 'COMD' ELSE 'COM' END AS target_type,
               o_custkey AS source, o_custkey + o_orderkey % 40 - 20 AS target FROM orders""",
    "live": """SELECT c_custkey AS code FROM customer WHERE c_acctbal > 6000""",
    "hops": """
        SELECT source, arg_max(target, effective) AS target FROM (
            SELECT source, effective, min(target) AS target FROM moves
            WHERE kind IN ('31', '32', '33', '34', '35', '41', '50') AND target_type = 'COM' AND source <> target
            GROUP BY 1, 2) GROUP BY 1""",
    "passage": """
        WITH RECURSIVE walk(source, here, hops, seen) AS (
            SELECT source, target, 1, [source, target] FROM hops WHERE source NOT IN (SELECT code FROM live)
            UNION ALL
            SELECT w.source, h.target, w.hops + 1, list_append(w.seen, h.target) FROM walk w JOIN hops h ON h.source = w.here
            WHERE w.here NOT IN (SELECT code FROM live) AND NOT list_contains(w.seen, h.target))
        SELECT source, here AS target, hops FROM walk WHERE here IN (SELECT code FROM live)""",
    "daily": f"""
        SELECT c.day, c.doy, c.year, c.month, coalesce(e.events, 0)::DOUBLE AS events, w.fwi, w.danger_share
        FROM calendar c LEFT JOIN (SELECT day, count(*) AS events FROM days GROUP BY 1) e ON e.day = c.day
        JOIN (SELECT day, avg(fwi) AS fwi, count(*) FILTER (fwi > 21.3)::DOUBLE / count(*) AS danger_share
              FROM measures GROUP BY 1) w ON w.day = c.day""",
    "clim_raw": """
        SELECT cell, dayofyear(day)::INT AS doy, avg(fwi) AS fwi, avg(ffmc) AS ffmc, avg(dmc) AS dmc, avg(dc) AS dc
        FROM measures GROUP BY 1, 2""",
    "clim": """
        SELECT *, coalesce(lag(fwi) OVER w, last(fwi) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS fwi_d1,
               coalesce(lag(ffmc) OVER w, last(ffmc) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ffmc_d1
        FROM (SELECT cell, doy, turn, avg(fwi) OVER v AS fwi, avg(ffmc) OVER v AS ffmc, avg(dmc) OVER v AS dmc, avg(dc) OVER v AS dc
              FROM clim_raw, (SELECT unnest([-1, 0, 1]) AS turn)
              WINDOW v AS (PARTITION BY cell ORDER BY turn, doy ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))
        WHERE turn = 0 WINDOW w AS (PARTITION BY cell ORDER BY doy)""",
    "factors_obs": """
        SELECT y.cell, y.year, CASE WHEN r.m > 0 THEN y.m / r.m ELSE 1 END AS k
        FROM (SELECT cell, year(day)::INT AS year, avg(fwi) AS m FROM measures GROUP BY 1, 2) y
        JOIN (SELECT cell, avg(fwi) AS m FROM measures WHERE day <= DATE '1998-12-31' GROUP BY 1) r USING (cell)""",
}


def with_roles(body: str) -> str:
    """Prefix a query with the role CTEs it mentions, transitively."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in ROLE_SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(ROLE_SQL[name])

    visit(body)
    ctes = [f"{n} AS ({ROLE_SQL[n].strip()})" for n in ROLE_SQL if n in needed]
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[len("WITH "):]
    return "WITH " + ",\n".join(ctes) + "\n" + body
