"""Ranks, metrics, smoothing, baselines, calibration tables and model comparison on the supplied tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from panelrisk.functions.scalars import logit, sigmoid
from panelrisk.operators import baselines, compare, eda, metrics, ranks, smoothing
from panelrisk.plans.registry import query
from panelrisk.plans.roles import START, TRAIN_STOP

AP = """(SELECT {by} sum(pos * cp::DOUBLE / cn) / sum(pos) AS average_precision, sum(n) AS rows, sum(pos) AS positives FROM (
    SELECT *, sum(pos) OVER ({part} ORDER BY score DESC) AS cp, sum(n) OVER ({part} ORDER BY score DESC) AS cn FROM {groups}) {group})"""


def ap_sql(groups: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return AP.format(by=f"{by}," if by else "", part=part, groups=groups, group=f"GROUP BY {by}" if by else "")


GROUPS = "g AS (SELECT score_a AS score, count(*) AS n, sum(y) AS pos FROM predictions GROUP BY 1)"


@query("W9 M1", "average_precision:f rows:i positives:i", f"WITH {GROUPS} SELECT * FROM {ap_sql('g')}")
def average_precision(t):
    return metrics.average_precision(metrics.score_groups(t.predictions, "score_a", "y"))


@query(
    "W9",
    "score:f n:i pos:i cum_n:i cum_pos:i",
    f"WITH {GROUPS} SELECT *, sum(n) OVER (ORDER BY score DESC) AS cum_n, sum(pos) OVER (ORDER BY score DESC) AS cum_pos FROM g",
)
def cumulative_positives(t):
    return ranks.running_totals(metrics.score_groups(t.predictions, "score_a", "y"), "score", ["n", "pos"])


@query("M2", "brier:f9", f"WITH {GROUPS} SELECT sum(pos * pow(score - 1, 2) + (n - pos) * pow(score, 2)) / sum(n) AS brier FROM g")
def brier_score(t):
    return metrics.brier(metrics.score_groups(t.predictions, "score_a", "y"))


@query(
    "M3",
    "average_precision:f brier:f base_rate:f lift:f",
    f"""WITH {GROUPS}, a AS {ap_sql('g')}
        SELECT average_precision, (SELECT sum(pos * pow(score - 1, 2) + (n - pos) * pow(score, 2)) / sum(n) FROM g) AS brier,
               positives::DOUBLE / rows AS base_rate, average_precision / (positives::DOUBLE / rows) AS lift FROM a""",
)
def metric_report(t):
    return metrics.report(metrics.score_groups(t.predictions, "score_a", "y"))


@query(
    "M4 W18",
    "bin:i announced:f observed:f rows:i",
    f"""WITH {GROUPS}, b AS (SELECT *, least(floor(10 * sum(n) OVER (ORDER BY score) / (SELECT sum(n) FROM g)), 9)::INT AS bin FROM g)
        SELECT bin, sum(score * n) / sum(n) AS announced, sum(pos) / sum(n) AS observed, sum(n) AS rows FROM b GROUP BY 1""",
)
def calibration_curve(t):
    return metrics.calibration_curve(metrics.score_groups(t.predictions, "score_a", "y"))


@query(
    "M9",
    "average_precision:f rows:i positives:i",
    f"""WITH g AS (SELECT score_a AS score, sum(w) AS n, sum(w * y) AS pos FROM (SELECT *, 1 + entity % 3 AS w FROM predictions) GROUP BY 1)
        SELECT * FROM {ap_sql('g')}""",
)
def weighted_average_precision(t):
    rows = t.predictions.withColumn("w", F.lit(1) + F.col("entity") % 3)
    return metrics.average_precision(metrics.score_groups(rows, "score_a", "y", weight="w"))


BUDGET_SQL = """WITH r AS (SELECT y, row_number() OVER (ORDER BY score_a DESC, event_id) AS r, count(*) OVER () AS n, sum(y) OVER () AS p FROM predictions)"""


@query(
    "M10 T3",
    "budget:f rows:i captured:i precision:f recall:f",
    f"""{BUDGET_SQL}, b AS (SELECT unnest([0.001::DOUBLE, 0.005::DOUBLE, 0.01::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE]) AS budget),
        s AS (SELECT budget, max(floor(n * budget)) AS rows, sum(y) FILTER (r <= floor(n * budget)) AS captured, max(p) AS p FROM r, b GROUP BY 1)
        SELECT budget, rows, coalesce(captured, 0) AS captured, coalesce(captured, 0) / nullif(rows, 0) AS precision, coalesce(captured, 0)::DOUBLE / p AS recall FROM s""",
)
def budget_table(t):
    return metrics.budget_table(t.predictions, "score_a", "y", "event_id")


@query(
    "M11",
    "rows:i budget:f captured:i precision:f recall:f",
    f"""{BUDGET_SQL}, k AS (SELECT DISTINCT least(greatest(round_even(pow(10, log10(0.0002) - log10(0.0002) * i / 199) * n, 0)::BIGINT, 1), n) AS rows, n, p
                            FROM (SELECT unnest(range(0, 200)) AS i), (SELECT DISTINCT n, p FROM r))
        SELECT rows, rows::DOUBLE / n AS budget, (SELECT sum(y) FROM r WHERE r <= rows) AS captured,
               (SELECT sum(y) FROM r WHERE r <= rows)::DOUBLE / rows AS precision, (SELECT sum(y) FROM r WHERE r <= rows)::DOUBLE / p AS recall FROM k""",
)
def budget_curve(t):
    return metrics.budget_curve(t.predictions, "score_a", "y", "event_id")


@query(
    "M12",
    "level:f share:f precision:f recall:f ceiling:f",
    f"""WITH {GROUPS}, c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS cn, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER () AS tn, sum(pos) OVER () AS tp FROM g),
        l AS (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.2::DOUBLE]) AS level),
        k AS (SELECT level, arg_min({{'cn': cn, 'cp': cp, 'tn': tn, 'tp': tp}}, (abs(cn::DOUBLE / tn - level), cn)) AS b FROM c, l GROUP BY 1)
        SELECT level, b.cn::DOUBLE / b.tn AS share, b.cp::DOUBLE / b.cn AS precision, b.cp::DOUBLE / b.tp AS recall, least(1, b.tp::DOUBLE / b.tn / level) AS ceiling FROM k""",
)
def watch_levels(t):
    return metrics.watch_levels(metrics.score_groups(t.predictions, "score_a", "y"), (0.01, 0.05, 0.2))


@query(
    "M13",
    "group:i average_precision:f rows:i positives:i rate:f lift:f",
    f"""WITH g AS (SELECT dayofmonth(day) AS "group", score_a AS score, count(*) AS n, sum(y) AS pos FROM predictions GROUP BY 1, 2)
        SELECT *, positives::DOUBLE / rows AS rate, average_precision / nullif(positives::DOUBLE / rows, 0) AS lift FROM {ap_sql('g', '"group"')}""",
)
def average_precision_by_group(t):
    """Per period; the supplied events span one month, so the period is the day of the month."""
    rows = t.predictions.withColumn("group", F.dayofmonth("day"))
    found = metrics.average_precision(metrics.score_groups(rows, "score_a", "y", by=["group"]), by=["group"])
    return metrics.with_lift(found)


@query(
    "M16",
    "share:f3 taken:i large:i captured:i capture:f",
    """WITH e AS (SELECT event_id, score_b AS predicted, score_a AS size FROM predictions WHERE y = 1),
       r AS (SELECT *, row_number() OVER (ORDER BY predicted DESC, event_id) AS r, count(*) OVER () AS n FROM e),
       b AS (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.25::DOUBLE]) AS share)
       SELECT share, count(*) FILTER (r <= floor(n * share)) AS taken, count(*) FILTER (size > 0.5) AS large,
              count(*) FILTER (r <= floor(n * share) AND size > 0.5) AS captured,
              count(*) FILTER (r <= floor(n * share) AND size > 0.5) / nullif(count(*) FILTER (size > 0.5), 0)::DOUBLE AS capture
       FROM r, b GROUP BY share""",
)
def large_event_capture(t):
    """Among events: the share of the large ones that the best scores hold."""
    events = t.predictions.filter("y = 1").withColumn("large", (F.col("score_a") > 0.5).cast("int"))
    return metrics.capture(events, "score_b", "event_id", "large", (0.05, 0.1, 0.25))


@query(
    "M14",
    "mae:f rmse:f r2:f r:f rows:i",
    """SELECT avg(abs(score_a - score_b)) AS mae, sqrt(avg(pow(score_a - score_b, 2))) AS rmse,
              1 - sum(pow(score_a - score_b, 2)) / (var_pop(score_b) * count(*)) AS r2, corr(score_a, score_b) AS r, count(*) AS rows FROM predictions""",
)
def regression_errors(t):
    return metrics.regression_errors(t.predictions, "score_a", "score_b")


@query(
    "M15",
    "roc_auc:f",
    """WITH r AS (SELECT y, rank() OVER (ORDER BY score_a) + (count(*) OVER (PARTITION BY score_a) - 1) / 2.0::DOUBLE AS r FROM predictions)
       SELECT (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * sum(1 - y)) AS roc_auc FROM r""",
)
def roc_auc(t):
    return metrics.roc_auc(t.predictions, "score_a", "y")


@query(
    "M16 T3",
    "event_id:i score_b:f",
    """SELECT event_id, score_b FROM (SELECT *, row_number() OVER (ORDER BY score_b DESC, event_id) AS r, count(*) OVER () AS n FROM predictions)
       WHERE r <= floor(n * 0.05::DOUBLE)""",
)
def top_fraction(t):
    return ranks.top_fraction(t.predictions, "score_b", "event_id", 0.05)


#: Average precision of both models in 200 replicas, from the definition: every row once for each replica it is in.
REPLICAS_SQL = f"""u AS (SELECT DISTINCT entity FROM predictions),
        w AS (SELECT entity, replica, ('0x' || substr(md5('42|' || replica || '|' || entity), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
              FROM u, (SELECT unnest(range(1, 201)) AS replica)),
        m AS (SELECT entity, replica, (u >= 0.367879441171)::INT + (u >= 0.735758882343)::INT + (u >= 0.919698602929)::INT + (u >= 0.981011843124)::INT
                     + (u >= 0.996340153173)::INT + (u >= 0.999405815182)::INT + (u >= 0.999916758851)::INT + (u >= 0.999989750803)::INT + (u >= 0.999998874797)::INT AS w FROM w),
        l AS (SELECT entity, y, 'a' AS model, score_a AS score FROM predictions UNION ALL SELECT entity, y, 'b', score_b FROM predictions),
        g0 AS (SELECT replica, model, score, sum(w) AS n, sum(w * y) AS pos FROM l JOIN m USING (entity) WHERE w > 0 GROUP BY 1, 2, 3),
        g AS (SELECT {{'r': replica, 'm': model}} AS k, score, n, pos FROM g0),
        draws AS (SELECT k.r AS replica, k.m AS model, average_precision FROM {ap_sql('g', 'k')})"""


@query("M17 M9", "replica:i model:s average_precision:f", f"WITH {REPLICAS_SQL} SELECT * FROM draws")
def bootstrap_replicas(t):
    aligned = t.predictions.withColumns({"a": F.col("score_a"), "b": F.col("score_b")})
    return compare.bootstrap_scores(aligned, ["a", "b"], "entity")


@query(
    "M17",
    "reference:s model:s gap:f low:f high:f significant:b",
    f"""WITH {REPLICAS_SQL}, whole AS (SELECT model, score, count(*) AS n, sum(y) AS pos FROM l GROUP BY 1, 2),
        points AS (SELECT * FROM {ap_sql('whole', 'model')}),
        gaps AS (SELECT 100.0::DOUBLE * (max(average_precision) FILTER (model = 'b') / max(average_precision) FILTER (model = 'a') - 1) AS gap FROM draws GROUP BY replica),
        bounds AS (SELECT quantile_cont(gap, 0.025) AS low, quantile_cont(gap, 0.975) AS high FROM gaps)
        SELECT 'a' AS reference, 'b' AS model, 100.0::DOUBLE * (max(average_precision) FILTER (model = 'b') / max(average_precision) FILTER (model = 'a') - 1) AS gap,
               any_value(low) AS low, any_value(high) AS high, any_value(low) * any_value(high) > 0 AS significant FROM points, bounds""",
)
def paired_bootstrap(t):
    aligned = t.predictions.withColumns({"a": F.col("score_a"), "b": F.col("score_b")})
    return compare.paired_bootstrap(aligned, ["a", "b"], "entity").withColumnRenamed("gap_pct", "gap")


@query(
    "M18 M19",
    "average_precision:f suspicious:b inside_range:b",
    f"""WITH {GROUPS} SELECT average_precision, average_precision > 0.8 AS suspicious, average_precision BETWEEN 0.1 AND 0.3 AS inside_range FROM {ap_sql('g')}""",
)
def metric_verdict(t):
    ap = metrics.average_precision(metrics.score_groups(t.predictions, "score_a", "y"))
    return metrics.verdict(metrics.suspicion(ap), 0.1, 0.3)


@query(
    "W12 V3",
    "event_id:i rank_pct:f",
    """SELECT event_id, (rank() OVER (ORDER BY score_a) + (count(*) OVER (PARTITION BY score_a) - 1) / 2.0::DOUBLE) / count(*) OVER () AS rank_pct FROM predictions""",
)
def percentile_ranks(t):
    return ranks.percentile_rank(t.predictions, "score_a")


@query("W13", "event_id:i min_rank:i", "SELECT event_id, rank() OVER (ORDER BY score_a DESC) AS min_rank FROM predictions")
def descending_ranks(t):
    return ranks.with_ranks(t.predictions, "score_a")


@query(
    "W14",
    "event_id:i rank:f",
    "SELECT event_id, (row_number() OVER (ORDER BY score_a, event_id) - 1)::DOUBLE / count(*) OVER () AS rank FROM predictions",
)
def normalised_ranks(t):
    return ranks.normalised_rank(t.predictions, "score_a", "event_id", "rank")


@query(
    "A46",
    "median_rank:f share_in_top_1pct:f positives:i",
    """WITH r AS (SELECT y, rank() OVER (ORDER BY score_a DESC) AS r, count(*) OVER () AS n FROM predictions)
       SELECT median(r)::DOUBLE AS median_rank, avg((r <= n * 0.01)::INT) AS share_in_top_1pct, count(*) AS positives FROM r WHERE y = 1""",
)
def positives_ranks(t):
    return metrics.positives_rank_summary(t.predictions, "score_a", "y")


# ---- smoothing ---------------------------------------------------------------------------------


@query("A5", "entity:i year:i days:i events:i", "SELECT * FROM counts")
def exposure_counts(t):
    return t.counts


@query("J21", "entity:i cluster:i", "SELECT * FROM all_clusters")
def fallback_clusters(t):
    return smoothing.with_fallback_cluster(t.counts, t.clusters)


def rates(t):
    return smoothing.smooth_rates(t.counts, smoothing.with_fallback_cluster(t.counts, t.clusters))


@query(
    "L5 L6",
    "entity:i excluded_year:i cluster:i cluster_rate:f9 entity_rate:f9 rate_ratio:f",
    "SELECT *, entity_rate / cluster_rate AS rate_ratio FROM rates",
)
def smoothed_rates(t):
    return rates(t)


@query(
    "L7 J14",
    "entity:i day:d y:b cluster:i cluster_rate:f9 entity_rate:f9",
    """SELECT s.entity, s.day, s.y, r.cluster, r.cluster_rate, r.entity_rate FROM train_sample s
       LEFT JOIN rates r ON r.entity = s.entity AND r.excluded_year = CASE WHEN s.split = 'train' THEN s.year ELSE 0 END""",
)
def applied_rates(t):
    return smoothing.apply_rates(t.sample, rates(t))


@query(
    "L8",
    "entity:i cluster:i cluster_rate:f9 entity_rate:f9",
    """WITH x AS (SELECT entity FROM entities WHERE reg = 2), k AS (SELECT * FROM counts JOIN all_clusters USING (entity) WHERE entity NOT IN (SELECT entity FROM x)),
       b AS (SELECT sum(events)::DOUBLE / sum(days) AS b FROM k),
       cr AS (SELECT cluster, (sum(events) + 20000 * max(b)) / (sum(days) + 20000)::DOUBLE AS cluster_rate FROM k, b GROUP BY 1)
       SELECT entity, cluster, max(cluster_rate) AS cluster_rate, (sum(events) + 2000 * max(cluster_rate)) / (sum(days) + 2000)::DOUBLE AS entity_rate
       FROM k JOIN cr USING (cluster) GROUP BY 1, 2
       UNION ALL SELECT entity, cluster, cluster_rate, cluster_rate FROM all_clusters JOIN x USING (entity) LEFT JOIN cr USING (cluster)""",
)
def rates_without_region(t):
    clusters = smoothing.with_fallback_cluster(t.counts, t.clusters)
    return smoothing.smooth_rates_without(t.counts, clusters, t.entities.filter("reg = 2").select("entity"))


@query(
    "A48",
    "silent_share:f min_rate:f9 median_rate:f9 max_rate:f9",
    """WITH t AS (SELECT entity, sum(events) AS e FROM counts GROUP BY 1)
       SELECT avg((e = 0)::INT) AS silent_share, min(entity_rate) FILTER (e = 0) AS min_rate, median(entity_rate) FILTER (e = 0) AS median_rate,
              max(entity_rate) FILTER (e = 0) AS max_rate FROM t LEFT JOIN (SELECT * FROM rates WHERE excluded_year = 0) USING (entity)""",
)
def silent_entities(t):
    return smoothing.silent_report(t.counts, rates(t))


# ---- baselines ---------------------------------------------------------------------------------


@query("A13", "rate:f9", "SELECT avg(y::INT) AS rate FROM panel WHERE split = 'train'")
def base_rate(t):
    return t.panel(end=TRAIN_STOP).agg(F.avg(F.col("y").cast("int")).alias("rate"))


@query(
    "J24 L9",
    "entity:i train_n:i train_pos:i n:i pos:i smoothed:f9",
    """WITH h AS (SELECT entity, count(*) FILTER (split = 'train') AS train_n, count(*) FILTER (split = 'train' AND y) AS train_pos,
                         count(*) FILTER (split = 'val') AS n, count(*) FILTER (split = 'val' AND y) AS pos FROM panel GROUP BY 1)
       SELECT *, (train_pos + 500 * (SELECT sum(train_pos)::DOUBLE / sum(train_n) FROM h)) / (train_n + 500)::DOUBLE AS smoothed FROM h""",
)
def entity_history(t):
    h = baselines.entity_history(t.panel())
    base = h.agg((F.sum("train_pos") / F.sum("train_n")).alias("b")).scalar()
    return h.withColumn("smoothed", smoothing.single_level("train_pos", "train_n", base))


@query(
    "A14 A6",
    "danger_class:i train_n:i train_pos:i n:i pos:i class_rate:f9",
    """SELECT danger_class, count(*) FILTER (split = 'train') AS train_n, count(*) FILTER (split = 'train' AND y) AS train_pos, count(*) FILTER (split = 'val') AS n,
              count(*) FILTER (split = 'val' AND y) AS pos, count(*) FILTER (split = 'train' AND y)::DOUBLE / count(*) FILTER (split = 'train') AS class_rate
       FROM classed GROUP BY 1""",
)
def class_history(t):
    return baselines.class_history(t.classed())


@query(
    "A15 M5 M6 M7 M8",
    "predictor:s average_precision:f9 brier:f9 lift:f",
    f"""WITH h AS (SELECT entity, count(*) FILTER (split = 'train') AS tn, count(*) FILTER (split = 'train' AND y) AS tp, count(*) FILTER (split = 'val') AS n, count(*) FILTER (split = 'val' AND y) AS pos
               FROM panel GROUP BY 1),
        b AS (SELECT sum(tp)::DOUBLE / sum(tn) AS b, sum(pos)::DOUBLE / sum(n) AS r FROM h),
        c AS (SELECT danger_class AS k, count(*) FILTER (split = 'train' AND y)::DOUBLE / count(*) FILTER (split = 'train') AS cr, count(*) FILTER (split = 'val') AS n, count(*) FILTER (split = 'val' AND y) AS pos FROM classed GROUP BY 1),
        x AS (SELECT h.tp, h.tn, danger_class AS k, count(*) AS n, count(*) FILTER (y) AS pos FROM classed JOIN h USING (entity) WHERE split = 'val' GROUP BY 1, 2, 3),
        u AS (SELECT '0 constant' AS predictor, b AS score, sum(n) AS n, sum(pos) AS pos FROM h, b GROUP BY b
              UNION ALL SELECT '1 history', (tp + 500 * b) / (tn + 500)::DOUBLE, n, pos FROM h, b
              UNION ALL SELECT '2 class', cr, n, pos FROM c
              UNION ALL SELECT '3 product', least(1, greatest(0, (tp + 500 * b) / (tn + 500)::DOUBLE * cr / b)), x.n, x.pos FROM x JOIN c USING (k), b),
        g AS (SELECT predictor, score, sum(n) AS n, sum(pos) AS pos FROM u GROUP BY 1, 2),
        s AS (SELECT predictor, sum(pos * pow(score - 1, 2) + (n - pos) * pow(score, 2)) / sum(n) AS brier FROM g GROUP BY 1)
        SELECT predictor, average_precision, brier, average_precision / r AS lift FROM {ap_sql('g', 'predictor')} JOIN s USING (predictor), b""",
)
def baseline_report(t):
    history = baselines.sparse_history(t.days, t.entities, (START, TRAIN_STOP), ("1999-01-01", "1999-12-31"))
    return baselines.baselines(history, t.classed())


# ---- calibration and ensembles -----------------------------------------------------------------


@query(
    "K3",
    "bin:i announced:f observed:f rows:i gap:f",
    """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(score_a, [i / 12.0::DOUBLE for i in range(0, 13)]))) AS e FROM predictions),
       b AS (SELECT score_a AS p, y, greatest(least(len(list_filter(e, lambda v: v <= score_a)) - 1, len(e) - 2), 0) AS bin FROM predictions, e)
       SELECT bin, avg(p) AS announced, avg(y) AS observed, count(*) AS rows, avg(p) - avg(y) AS gap FROM b GROUP BY 1""",
)
def reliability_table(t):
    return metrics.reliability(t.predictions, "score_a", "y", 12)


@query(
    "K4 F12",
    "state:s average_precision:f brier:f mean_p:f real_rate:f distinct_values:i bias:f",
    f"""WITH l AS (SELECT 'before' AS state, score_a AS score, y FROM predictions
                   UNION ALL SELECT 'after', 1 / (1 + exp(-(0.5 * ln(q / (1 - q)) - 1))), y FROM (SELECT y, least(greatest(score_a, 1e-9::DOUBLE), (1 - 1e-9)::DOUBLE) AS q FROM predictions)),
        g AS (SELECT state, score, count(*) AS n, sum(y) AS pos FROM l GROUP BY 1, 2),
        s AS (SELECT state, sum(pos * pow(score - 1, 2) + (n - pos) * pow(score, 2)) / sum(n) AS brier, sum(score * n) / sum(n) AS mean_p, sum(pos)::DOUBLE / sum(n) AS real_rate, count(*) AS distinct_values FROM g GROUP BY 1)
        SELECT state, average_precision, brier, mean_p, real_rate, distinct_values, mean_p / real_rate AS bias FROM {ap_sql('g', 'state')} JOIN s USING (state)""",
)
def calibration_summary(t):
    """Raw scores against a sigmoid correction on log-odds; the ordering must not change."""
    p = t.predictions
    before = p.select(F.lit("before").alias("state"), "score_a", "y")
    after = p.select(F.lit("after").alias("state"), sigmoid(logit("score_a") * 0.5 - 1).alias("score_a"), "y")
    groups = metrics.score_groups(before.unionByName(after), "score_a", "y", by=["state"])
    return metrics.calibration_summary(groups, by=["state"])


@query(
    "K6",
    "group:i bias:f rows:i",
    """SELECT isodow(day) AS "group", avg(score_a) / avg(y) AS bias, count(*) AS rows FROM predictions GROUP BY 1""",
)
def residual_bias(t):
    return metrics.residual_bias(t.predictions, "score_a", "y", F.weekday("day") + 1)


R3 = """r AS (SELECT y, (row_number() OVER (ORDER BY score_a, event_id) - 1)::DOUBLE / count(*) OVER () AS a,
    (row_number() OVER (ORDER BY score_b, event_id) - 1)::DOUBLE / count(*) OVER () AS b,
    (row_number() OVER (ORDER BY score_c, event_id) - 1)::DOUBLE / count(*) OVER () AS c FROM predictions)"""


@query(
    "ML9",
    "model:s average_precision:f lift:f",
    f"""WITH {R3}, l AS (SELECT 'a + b' AS model, (a + b) / 2 AS score, y FROM r UNION ALL SELECT 'a + c', (a + c) / 2, y FROM r
            UNION ALL SELECT 'b + c', (b + c) / 2, y FROM r UNION ALL SELECT 'a + b + c', (a + b + c) / 3, y FROM r),
        g AS (SELECT model, score, count(*) AS n, sum(y) AS pos FROM l GROUP BY 1, 2)
        SELECT model, average_precision, average_precision / (positives::DOUBLE / rows) AS lift FROM {ap_sql('g', 'model')}""",
)
def rank_ensembles(t):
    aligned = t.predictions.withColumns({"a": F.col("score_a"), "b": F.col("score_b"), "c": F.col("score_c")})
    return compare.ensembles(aligned, ["a", "b", "c"], "event_id")


@query(
    "ML10",
    "a:s b:s rank_corr:f",
    f"WITH {R3} SELECT 'a' AS a, 'b' AS b, corr(a, b) AS rank_corr FROM r UNION ALL SELECT 'a', 'c', corr(a, c) FROM r UNION ALL SELECT 'b', 'c', corr(b, c) FROM r",
)
def rank_diversity(t):
    aligned = t.predictions.withColumns({"a": F.col("score_a"), "b": F.col("score_b"), "c": F.col("score_c")})
    return compare.rank_diversity(aligned, ["a", "b", "c"], "event_id")


@query(
    "A39 U7",
    "feature_a:s feature_b:s r:f",
    """WITH r AS (SELECT rank() OVER (ORDER BY score_a) + (count(*) OVER (PARTITION BY score_a) - 1) / 2.0::DOUBLE AS a,
                        rank() OVER (ORDER BY score_b) + (count(*) OVER (PARTITION BY score_b) - 1) / 2.0::DOUBLE AS b,
                        rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0::DOUBLE AS z
                 FROM (SELECT score_a, score_b, floor(score_a * 20) AS z FROM predictions)),
       p AS (SELECT 'score_a' AS feature_a, 'score_b' AS feature_b, corr(a, b) AS r FROM r UNION ALL SELECT 'score_a', 'z', corr(a, z) FROM r UNION ALL SELECT 'score_b', 'z', corr(b, z) FROM r)
       SELECT * FROM p WHERE abs(r) >= 0.9""",
)
def redundant_features(t):
    rows = t.predictions.withColumn("z", F.floor(F.col("score_a") * 20).cast("double"))
    return ranks.redundant_pairs(ranks.spearman(rows, ["score_a", "score_b", "z"], "event_id"))


@query(
    "A38",
    "feature_a:s feature_b:s r:f",
    """SELECT 'fwi' AS feature_a, 'ffmc' AS feature_b, corr(fwi, ffmc) AS r FROM measures UNION ALL SELECT 'fwi', 'dmc', corr(fwi, dmc) FROM measures
       UNION ALL SELECT 'fwi', 'dc', corr(fwi, dc) FROM measures UNION ALL SELECT 'ffmc', 'dmc', corr(ffmc, dmc) FROM measures
       UNION ALL SELECT 'ffmc', 'dc', corr(ffmc, dc) FROM measures UNION ALL SELECT 'dmc', 'dc', corr(dmc, dc) FROM measures""",
)
def measure_correlations(t):
    return ranks.correlations(t.measures, ["fwi", "ffmc", "dmc", "dc"])


@query(
    "A57 W10",
    "exposure_share:f event_share:f gradient:f",
    """WITH c AS (SELECT danger_class, count(*) AS x, count(*) FILTER (y) AS e FROM classed GROUP BY 1)
       SELECT sum(x) FILTER (danger_class >= 5)::DOUBLE / sum(x) AS exposure_share, sum(e) FILTER (danger_class >= 5)::DOUBLE / sum(e) AS event_share,
              arg_max(e::DOUBLE / x, danger_class) / arg_min(e::DOUBLE / x, danger_class) AS gradient FROM c""",
)
def worst_class_shares(t):
    return eda.worst_class_share(eda.rates_by(t.classed(), ["danger_class"]))
