"""Fitted models on the sampled train matrix. Fits have no SQL form, so these are checked by tests."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.operators import calibration, climate, clustering, eda, features, metrics, models, smoothing
from panelrisk.operators.features import day_before, feature_columns, measure_lags
from panelrisk.plans.climate_queries import _ratios
from panelrisk.plans.panel_queries import INDICES, matrix
from panelrisk.plans.registry import query
from panelrisk.plans.roles import END, FIT_END, JUDGE_YEAR, START, TRAIN_STOP, VAL_END
from panelrisk.session import cut_lineage, dealt

#: Clusters of entities, and the positives of the judged years below which a region is not judged at this size.
CLUSTERS, LEAST_POSITIVES = 30, 2
#: Rows of the profile that a task reads.
PROFILE_ROWS = 50_000
LIGHT = {"maxIter": 5, "maxDepth": 3}
#: The learning curve's model, as the curve needs it: all the trees of the original's, and its other settings.
CURVE = {"maxIter": 600, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
PROFILE_SHARES = ("share_standard", "share_economy", "share_promo")
PROFILE_COLUMNS = (
    *PROFILE_SHARES, "alt_mean", "alt_range", "log_area", "log_density", "density_grid", "lat", "lon", "fwi_mean", "fwi_p90", "days_high",
)


def fit_years():
    return F.col("year") <= FIT_END


def judge_years():
    return F.col("year") == JUDGE_YEAR


def profile(t):
    """One row per entity, written once: medians, scaler and every K-means pass read it.

    Neither the files of the entities nor the few cells and departments that they are joined by say how many tasks read
    it: more than ``PROFILE_ROWS`` rows are dealt evenly. Fewer stay as they come, for K-means starts from their order.
    """
    rows = clustering.static_profile(t.entities, t.shares, t.measures, PROFILE_SHARES, 1995, START, TRAIN_STOP)
    return cut_lineage(dealt(rows, t.entities.count(), PROFILE_ROWS))


def scaled_profile(t):
    raw = profile(t)
    medians = clustering.fit_medians(raw, PROFILE_COLUMNS)
    return clustering.standardise(clustering.impute(raw, medians, PROFILE_COLUMNS), PROFILE_COLUMNS)


def train_matrix(t):
    """The sampled matrix with the learnt rates of each row's own excluded year.

    It is written once: every fit reads it several times, and it holds the sample, not the panel.
    """
    rates = smoothing.smooth_rates(t.counts, smoothing.with_fallback_cluster(t.counts, t.clusters))
    return cut_lineage(smoothing.apply_rates(matrix(t), rates))


def split_matrix(t, year):
    """The matrix of every entity and day of a year after the train years, unsampled and lazy.

    Days on which a cell has no measures stay, with NULL indices. The rates are those of all train years.
    """
    start, stop = f"{year}-01-01", f"{year}-12-31"
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(stop).cast("date"))).alias("day")
    cells = t.entities.select("cell").distinct().select("cell", days)
    measures = cells.join(t.measures, ["cell", "day"], "left").unionByName(t.measures.filter(F.col("day") < F.lit(start).cast("date")))
    rows = features.feature_matrix(t.panel(start, stop, horizons=features.HORIZONS), t.entities, measures, None, t.shares, INDICES, last_year=int(END[:4]))
    rates = smoothing.smooth_rates(t.counts, smoothing.with_fallback_cluster(t.counts, t.clusters))
    return smoothing.apply_rates(rows, rates, exclude_own_year=False)


@query(
    "L1 L2",
    "entity:i share_standard:f alt_mean:f alt_range:f log_density:f fwi_mean:f fwi_p90:f days_high:f",
    """WITH c AS (SELECT cell, avg(fwi) AS fwi_mean, quantile_cont(fwi, 0.9) AS fwi_p90, count(*) FILTER (fwi > 21.3) / 4.0::DOUBLE AS days_high FROM measures WHERE day <= DATE '1998-12-31' GROUP BY 1),
       p AS (SELECT e.entity, s.share_standard, alt_mean, alt_max - alt_min AS alt_range, CASE WHEN population IS NULL THEN NULL ELSE density END AS d, fwi_mean, fwi_p90, days_high
             FROM entities e JOIN shares s ON s.dep = e.dep AND s.vintage = 1995 JOIN c USING (cell)),
       m AS (SELECT median(d) AS d FROM p)
       SELECT entity, share_standard, alt_mean, alt_range, ln(coalesce(p.d, m.d) + 1) AS log_density, fwi_mean, fwi_p90, days_high FROM p, m""",
)
def imputed_profile(t):
    """The static profile with unknown densities replaced by the median."""
    raw = profile(t).drop("log_density").join(t.entities.select("entity", "density"), "entity")
    medians = clustering.fit_medians(raw, ["density"])
    return clustering.impute(raw, medians, ["density"]).withColumn("log_density", F.log1p("density"))


@query(
    "L3",
    "entity:i alt_mean:f lat:f lon:f area_km2:f",
    """WITH s AS (SELECT avg(alt_mean) AS am, stddev_pop(alt_mean) AS asd, avg(lat) AS lm, stddev_pop(lat) AS ls, avg(lon) AS om, stddev_pop(lon) AS os, avg(area_km2) AS km, stddev_pop(area_km2) AS ks FROM entities)
       SELECT entity, (alt_mean - am) / asd AS alt_mean, (lat - lm) / ls * 0.25 AS lat, (lon - om) / os * 0.25 AS lon, (area_km2 - km) / ks AS area_km2 FROM entities, s""",
)
def standardised_profile(t):
    return clustering.standardise(t.entities, ("alt_mean", "lat", "lon", "area_km2"))


@query("L4", "cluster:i entities:i")
def entity_clusters(t):
    labelled, _ = clustering.cluster(scaled_profile(t), PROFILE_COLUMNS, k=CLUSTERS)
    return labelled.groupBy("cluster").agg(F.count("*").alias("entities"))


@query("L4", "cluster:i vectors:i")
def vector_clusters(t):
    """K-means on the supplied embedding vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = t.table("embeddings").select("vec_id", array_to_vector("embedding").alias("v"))
    model = KMeans(k=10, seed=42, featuresCol="v", predictionCol="cluster").fit(rows)
    return model.transform(rows).groupBy("cluster").agg(F.count("*").alias("vectors"))


@query("CL5 CL6", "scenario:s entities:i moving:i unreliable:i")
def shifted_clusters(t):
    """Profiles under a shifted climate, assigned with the present scaler and centres, and how far they fall."""
    raw = profile(t)
    medians = clustering.fit_medians(raw, PROFILE_COLUMNS)
    filled = clustering.impute(raw, medians, PROFILE_COLUMNS)
    scaler = clustering.fit_scaler(filled, PROFILE_COLUMNS)
    labelled, model = clustering.cluster(clustering.standardise(filled, PROFILE_COLUMNS, scaler), PROFILE_COLUMNS, k=CLUSTERS)
    present = clustering.centre_distance(labelled, PROFILE_COLUMNS, model, "cluster", "distance")
    past = t.measures.filter(F.col("day") <= F.lit(TRAIN_STOP).cast("date"))
    ratios = _ratios(t).drop("dist_deg")
    days = climate.days_over(past, ratios, 4).select("cell", "scenario", F.col("days_over").alias("_d"))
    shift = ratios.join(days, ["cell", "scenario"]).select("cell", "scenario", "k", "_d")
    rows = filled.join(t.entities.select("entity", "cell"), "entity").join(shift, "cell")
    rows = rows.withColumns({"fwi_mean": F.col("fwi_mean") * F.col("k"), "fwi_p90": F.col("fwi_p90") * F.col("k"), "days_high": F.col("_d")})
    future = clustering.reassign(clustering.standardise(rows, PROFILE_COLUMNS, scaler), PROFILE_COLUMNS, model)
    future = clustering.centre_distance(future, PROFILE_COLUMNS, model, "cluster_future", "distance")
    flagged = clustering.out_of_analogy(present, future, "distance").join(labelled.select("entity", "cluster"), "entity")
    return flagged.groupBy("scenario").agg(
        F.count("*").alias("entities"),
        F.count_if(F.col("cluster") != F.col("cluster_future")).alias("moving"),
        F.count_if(~F.col("reliable")).alias("unreliable"),
    )


def _fit_and_judge(t, kind, **params):
    rows = train_matrix(t)
    columns = feature_columns(rows)
    model = models.train(rows.filter(fit_years()), columns, kind, **params)
    return model, rows


@query("ML1", "average_precision:f rows:i positives:i")
def forest_model(t):
    model, rows = _fit_and_judge(t, "forest", numTrees=10, maxDepth=5)
    return models.evaluate(models.score(model, rows.filter(judge_years()), ["entity", "day", "y"]))


@query("ML2 ML3 S20", "entity:i day:d y:i score:f")
def boosted_scores(t):
    """The whole validation year, a row for each entity and day."""
    model, _ = _fit_and_judge(t, "boosted", **LIGHT)
    return models.score(model, split_matrix(t, VAL_END), ["entity", "day", "y"])


@query("ML4", "setting:s average_precision:f rows:i positives:i")
def parameter_choice(t):
    rows = train_matrix(t)
    grid = {"shallow": {"maxIter": 5, "maxDepth": 2}, "deep": {"maxIter": 5, "maxDepth": 4}}
    return models.temporal_grid(rows, feature_columns(rows), fit_years(), judge_years(), grid)


@query("ML5", "setting:s average_precision:f rows:i positives:i")
def cluster_configurations(t):
    def with_clusters(k):
        labels = cut_lineage(clustering.cluster(scaled, PROFILE_COLUMNS, k=k)[0].select("entity", "cluster"))
        full = smoothing.with_fallback_cluster(counts, labels)
        return cut_lineage(smoothing.apply_rates(base, smoothing.smooth_rates(counts, full)))

    # Written once: each configuration reads them several times.
    base, scaled, counts = cut_lineage(matrix(t)), cut_lineage(scaled_profile(t)), cut_lineage(t.counts)
    builds = {"none": lambda: base} | {f"k={k}": lambda k=k: with_clusters(k) for k in (10, 30, 60, 120)}
    return models.compare_configurations(builds, feature_columns, fit_years(), judge_years())


@query("ML6", "trees:i average_precision:f rows:i positives:i")
def learning_curve(t):
    model, rows = _fit_and_judge(t, "boosted", **CURVE)
    return models.learning_curve(model, rows.filter(judge_years()))


@query("ML7", "trees:i average_precision:f")
def early_stopping(t):
    """Stopped on the sampled judged year, evaluated on the whole validation year."""
    rows = models.with_validation(train_matrix(t), judge_years())
    columns = feature_columns(rows)
    model = models.train(rows, columns, "boosted", maxIter=10, maxDepth=3, validationIndicatorCol="is_validation", validationTol=0.01)
    ap = models.evaluate(models.score(model, split_matrix(t, VAL_END), ["y"]))
    return ap.select(F.lit(model.learner.getNumTrees).alias("trees"), "average_precision")


@query("ML8", "average_precision:f rows:i positives:i")
def neural_model(t):
    model, rows = _fit_and_judge(t, "neural", maxIter=20)
    return models.evaluate(models.score(model, rows.filter(judge_years()), ["y"]))


@query("ML11 A51", "feature_set:s mean:f worst:f folds:i")
def region_transfer(t):
    base = cut_lineage(matrix(t).join(t.entities.select("entity", "reg"), "entity"))
    clusters = smoothing.with_fallback_cluster(t.counts, t.clusters)
    regions = [r["reg"] for r in t.entities.select("reg").distinct().orderBy("reg").collect()]  # a handful
    results = models.leave_region_out(
        base, t.counts, clusters, t.entities.select("entity", "reg"),
        lambda df: [c for c in feature_columns(df) if c != "reg"], regions, fit_years(), judge_years(), least=LEAST_POSITIVES, **LIGHT,
    )
    return eda.fold_summary(results, "feature_set", "average_precision")


@query("ML12 W2 W3 W4 W5", "setting:s average_precision:f rows:i positives:i")
def lag_sufficiency(t):
    rows = train_matrix(t)
    lagged = rows.join(measure_lags(t.measures), ["cell", "day"], "left")
    parts = [
        models.temporal_grid(df, feature_columns(df), fit_years(), judge_years(), {name: LIGHT})
        for name, df in (("base", rows), ("with lags", lagged))
    ]
    return reduce(DataFrame.unionByName, parts)


@query("ML13", "r2_log:f mae_log:f mae_log_median:f average_precision_large:f roc_auc_large:f judged:i")
def size_stage(t):
    rows = train_matrix(t)
    return models.size_stage(rows, feature_columns(rows), fit_years(), judge_years(), large=25.0, **LIGHT)


@query("ML14 A41", "block:s importance:f share:f")
def importance_blocks(t):
    model, rows = _fit_and_judge(t, "boosted", **LIGHT)
    weights = models.importances(model)
    block = (
        F.when(F.col("feature").startswith("events_") | (F.col("feature") == "days_since_event"), "history")
        .when(F.col("feature").startswith("share_"), "cover")
        .when(F.col("feature").isin("fwi", "ffmc", "dmc", "dc", "fwi_d1", "ffmc_d1", "danger_class"), "weather")
        .when(F.col("feature").isin("cluster", "cluster_rate", "entity_rate", "rate_ratio"), "rates")
        .otherwise("other")
    )
    return eda.importance_blocks(weights, weights.select("feature", block.alias("block")))


def _half(t):
    """The first part of the event month is fitted, the rest judged."""
    return F.dayofmonth("day") <= 20, F.dayofmonth("day") > 20


@query("K1 K2 K5 K4", "method:s average_precision:f brier:f mean_p:f real_rate:f distinct_values:i bias:f")
def calibration_methods(t):
    fit, test = _half(t)
    p = t.predictions
    raw = p.filter(test).select(F.lit("raw").alias("method"), F.col("score_a").alias("calibrated"), "y")
    parts = [raw]
    for method in ("platt", "isotonic"):
        judged = calibration.judge(p, "score_a", "y", fit, test, method)
        parts.append(judged.select(F.lit(method).alias("method"), "calibrated", "y"))
    groups = metrics.score_groups(reduce(DataFrame.unionByName, parts), "calibrated", "y", by=["method"])
    return metrics.calibration_summary(groups, by=["method"])


#: The monotone fit by its definition: the largest of the least means over stretches that begin and end around a score.
ISOTONIC_SQL = """s AS (SELECT floor(score_a * 100) / 100 AS score, count(*) AS n, sum(y) AS pos FROM predictions GROUP BY 1),
        c AS (SELECT score, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, n, pos FROM s WINDOW w AS (ORDER BY score)),
        m AS (SELECT a.score AS lo, b.score AS hi, (b.cp - a.cp + a.pos)::DOUBLE / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.score <= b.score),
        l AS (SELECT lo, hi AS score, min(mean) OVER (PARTITION BY lo ORDER BY hi DESC) AS least FROM m),
        iso AS (SELECT score, max(least) AS value FROM l GROUP BY 1)"""


@query("K2 K5", "score:f rows:i calibrated:f", f"WITH {ISOTONIC_SQL} SELECT score, n AS rows, value AS calibrated FROM iso JOIN s USING (score)")
def isotonic_refit(t):
    """Each score with the value of the monotone fit on the whole period."""
    p = t.predictions.withColumn("score", F.floor(F.col("score_a") * 100) / 100)
    return calibration.refitted(p, "score", "y").groupBy("score").agg(F.count("*").alias("rows"), F.max("calibrated").alias("calibrated"))


@query(
    "L2 J2",
    "cell:i rows:i missing:i",
    """SELECT m.cell, count(*) AS rows, count(*) FILTER (b.fwi IS NULL) AS missing
       FROM measures m LEFT JOIN measures b ON b.cell = m.cell AND b.day = m.day - 1 GROUP BY 1""",
)
def missing_day_before(t):
    lagged = day_before(t.measures, ("fwi",))
    return lagged.groupBy("cell").agg(F.count("*").alias("rows"), F.count_if(F.col("fwi_d1").isNull()).alias("missing"))


