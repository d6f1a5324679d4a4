"""Static entity profile, imputation, standardisation and the partition of entities into clusters."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.functions.scalars import checked, log1p0
from panelrisk.operators.climate import cell_climate
from panelrisk.operators.ranks import column_quantiles, exact_quantiles

# Number of clusters, and the weight of position against the other variables.
CLUSTERS = 30
POSITION_WEIGHT = 0.25
POSITION = ("lat", "lon")


def static_profile(
    entities: DataFrame, shares: DataFrame, measures: DataFrame, share_columns: Sequence[str], vintage: int,
    start: str, end: str, share_key: str = "dep",
) -> DataFrame:
    """One row per entity: shares of one fixed vintage, relief, size, position and climate. Never the target."""
    fixed = shares.filter(F.col("vintage") == vintage).select(share_key, *share_columns)
    climate = cell_climate(measures, start, end)
    return (
        entities.join(fixed, share_key)
        .join(climate, "cell")
        .select(
            "entity",
            *share_columns,
            "alt_mean",
            (F.col("alt_max") - F.col("alt_min")).alias("alt_range"),
            log1p0("area_km2").alias("log_area"),
            log1p0("density").alias("log_density"),
            "density_grid",
            "lat",
            "lon",
            "fwi_mean",
            "fwi_p90",
            "days_high",
        )
    )


def fit_medians(train: DataFrame, columns: Sequence[str], split: str | None = None) -> DataFrame:
    """One row with the exact median of each column, learnt on train rows only.

    With ``split`` given, any row of another split stops the job.
    """
    rows = train
    if split is not None:
        rows = checked(train, F.col(split) != "train", "medians must be fitted on train")
    return column_quantiles(rows, columns, 0.5)


def impute(df: DataFrame, medians: DataFrame, columns: Sequence[str]) -> DataFrame:
    packed = medians.select(F.struct(*columns).alias("m"))
    filled = df.withColumn("_m", packed.scalar())
    return filled.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.col(f"_m.{c}")) for c in columns}
    ).drop("_m")


def fit_scaler(df: DataFrame, columns: Sequence[str], sample: bool = False) -> DataFrame:
    """One row with the mean and the standard deviation of each column (population unless ``sample``)."""
    std = F.stddev_samp if sample else F.stddev_pop
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", std))])


def standardise(
    df: DataFrame, columns: Sequence[str], scaler: DataFrame | None = None, weights: dict[str, float] | None = None
) -> DataFrame:
    """Centre and scale; position columns keep a quarter of the weight of the others."""
    scaler = fit_scaler(df, columns) if scaler is None else scaler
    weights = dict.fromkeys(POSITION, POSITION_WEIGHT) if weights is None else weights
    packed = scaler.select(F.struct(*scaler.columns).alias("s"))
    out = df.withColumn("_s", packed.scalar())

    def z(c: str):
        std = F.col(f"_s.std_{c}")
        # A constant column is centred only.
        return (F.col(c) - F.col(f"_s.mean_{c}")) / F.when(std > 0, std).otherwise(1.0) * F.lit(weights.get(c, 1.0))

    return out.withColumns({c: z(c) for c in columns}).drop("_s")


def cluster(scaled: DataFrame, columns: Sequence[str], k: int = CLUSTERS, seed: int = 42) -> tuple[DataFrame, KMeansModel]:
    """K-means on the scaled profile: the input with ``cluster``, and the model."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(scaled)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).drop("_v"), model


def reassign(
    shifted: DataFrame, columns: Sequence[str], model: KMeansModel, name: str = "cluster_future"
) -> DataFrame:
    """Assign shifted profiles with the PRESENT centres; the profile must use the present scaler."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(shifted)
    return model.transform(vectors).drop("_v").withColumnRenamed("cluster", name)


def centre_distance(scaled: DataFrame, columns: Sequence[str], model: KMeansModel, cluster_col: str, name: str) -> DataFrame:
    """Euclidean distance of each profile to the centre of its cluster (k small rows, as literals)."""
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    pairs = F.arrays_zip(F.array(*[F.col(c).cast("double") for c in columns]).alias("a"), centres[F.col(cluster_col)].alias("b"))
    square = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["a"] - p["b"]) * (p["a"] - p["b"]))
    return scaled.withColumn(name, F.sqrt(square))


def out_of_analogy(present: DataFrame, shifted: DataFrame, distance: str, quantile: float = 0.95) -> DataFrame:
    """Flag shifted profiles further from their centre than the present 95th percentile."""
    limit = exact_quantiles(present, distance, [quantile]).select(F.col("quantiles")[0])
    return shifted.withColumn("reliable", F.col(distance) <= limit.scalar())
