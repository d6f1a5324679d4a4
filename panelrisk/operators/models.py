"""Spark ML learners on the feature matrix, scoring with keys, temporal and spatial folds."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrisk.functions.scalars import M2_PER_HA
from panelrisk.operators.checks import same_features
from panelrisk.operators.clustering import fit_medians, fit_scaler, impute, standardise
from panelrisk.operators.features import feature_sets
from panelrisk.operators.metrics import average_precision, regression_errors, roc_auc, score_groups
from panelrisk.operators.ranks import exact_quantiles
from panelrisk.operators.smoothing import apply_rates, smooth_rates_without
from panelrisk.session import cut_lineage

# Fixed value: events larger than this (in ha) are "large".
LARGE_HA = 5.0


def _complete(batch: pa.Array, known: np.ndarray) -> np.ndarray:
    """Arrays of the same length, one for each row, in a row, with NULL replaced. A value that stays unknown stops the job."""
    flat = batch.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    if flat.null_count:
        values = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.tile(known, len(batch)), values)
    if np.isnan(values).any():
        raise ValueError("a feature is neither a number nor has a median")
    return values


def _as_array(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def _known(medians: Sequence[float | None]) -> np.ndarray:
    return np.array([np.nan if m is None else m for m in medians], float)


def filled(columns: Sequence[str], medians: Sequence[float | None]) -> Column:
    """The columns as one array with NULL replaced by the medians, a batch of rows at a time: dozens of columns, each with
    its own case, are a method that the virtual machine never compiles. A value that stays unknown stops the job."""
    known = _known(medians)

    @F.arrow_udf("array<double>")
    def fill(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(known))
            yield pa.ListArray.from_arrays(ends, pa.array(_complete(batch, known)))

    return fill(_as_array(columns))


_LINE = re.compile(r"\s*(?:(Tree) \d+ \(weight (\S+)\):|(If|Else) \(feature (\d+) (?:<=|>) (\S+)\)|(Predict): (\S+))$")


class Trees:
    """The trees of a boosted classifier as arrays of nodes, by which batches of rows are scored inside a task."""

    def __init__(self, learner: GBTClassificationModel):
        self.weights: list[float] = []
        self.roots: list[int] = []
        feature, edge, left, right, value, open_ifs = [], [], [], [], [], []
        deepest = 0
        for line in learner.toDebugString.splitlines()[1:]:
            if not line.strip():
                continue
            found = _LINE.match(line)
            if found is None:
                raise ValueError(f"not a node of a tree of numbers: {line!r}")
            tree, weight, branch, of, at, leaf, predicted = found.groups()
            node = len(value)
            if tree:
                self.weights.append(float(weight))
                self.roots.append(node)
            elif branch == "Else":  # the next node is what the last open condition leads to
                right[open_ifs[-1]] = node
                open_ifs[-1] = -1 - open_ifs[-1]
            else:  # a leaf leads to itself
                feature.append(int(of or 0)), edge.append(float(at or 0)), value.append(float(predicted or 0))
                left.append(node if leaf else node + 1), right.append(node)
                deepest = max(deepest, len(open_ifs))
                if branch:
                    open_ifs.append(node)
                while leaf and open_ifs and open_ifs[-1] < 0:
                    open_ifs.pop()
        self.depth = deepest
        self.left, self.right = np.array(left, np.int32), np.array(right, np.int32)
        self.edge, self.value = np.array(edge, float), np.array(value, float)
        # The features that some tree asks for; the others need not be brought to the trees.
        inner = self.left != np.arange(len(self.left))
        asked = np.unique(np.array(feature)[inner])
        self.asked = asked.tolist() or [0]
        self.feature = np.where(inner, np.searchsorted(asked, feature), 0).astype(np.int32)

    def predictions(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree its weighted prediction of each row."""
        begin = np.arange(len(rows)) * rows.shape[1]
        flat = rows.ravel()
        for root, weight in zip(self.roots, self.weights):
            node = np.full(len(rows), root, np.int32)
            for _ in range(self.depth):
                node = np.where(flat[begin + self.feature[node]] <= self.edge[node], self.left[node], self.right[node])
            yield self.value[node] * weight


def boosted(model: Model, steps: Sequence[int] | None = None) -> Column:
    """The probability of each row, or with ``steps`` the margins after so many trees as an array: the columns that the
    trees ask for go to a task's batches once and one number comes back, not a vector for the learner to walk."""
    trees = Trees(model.learner)
    columns, known = [model.features[k] for k in trees.asked], _known(model.medians.first())[trees.asked]

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            margin = np.zeros(len(batch))
            for one in trees.predictions(_complete(batch, known).reshape(-1, len(known))):
                margin += one
            with np.errstate(over="ignore"):
                yield pa.array(1.0 - 1.0 / (1.0 + np.exp(2.0 * margin)))

    @F.arrow_udf("array<double>")
    def margins(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            running, kept = np.zeros(len(batch)), np.empty((len(batch), len(steps)))
            for n, one in enumerate(trees.predictions(_complete(batch, known).reshape(-1, len(known))), 1):
                running += one
                if n in place:
                    kept[:, place[n]] = running
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(steps))
            yield pa.ListArray.from_arrays(ends, pa.array(kept.ravel()))

    if steps is None:
        return probability(_as_array(columns))
    place = {n: k for k, n in enumerate(steps)}
    return margins(_as_array(columns))


class Model:
    """A fitted learner with its own column list, medians and scaler, so it can only be served its own inputs."""

    def __init__(self, learner, features: Sequence[str], medians: DataFrame, scaler: DataFrame | None = None):
        self.learner, self.features, self.medians, self.scaler = learner, list(features), medians, scaler

    def prepare(self, df: DataFrame) -> DataFrame:
        if self.scaler is None:
            return df.withColumn("features", array_to_vector(filled(self.features, self.medians.first())))
        out = standardise(impute(df, self.medians, self.features), self.features, self.scaler, weights={})
        return VectorAssembler(inputCols=self.features, outputCol="features").transform(out)


def _learner(kind: str, width: int, params: dict):
    base = {"featuresCol": "features", "labelCol": "label", "seed": 42}
    if kind == "forest":
        return RandomForestClassifier(**{**base, "numTrees": 20, "maxDepth": 8, **params})
    if kind == "boosted":
        return GBTClassifier(**{**base, "maxIter": 20, "maxDepth": 4, "stepSize": 0.1, **params})
    if kind == "neural":
        return MultilayerPerceptronClassifier(**{**base, "layers": [width, 16, 2], "maxIter": 50, **params})
    if kind == "size":
        return GBTRegressor(**{**base, "maxIter": 20, "maxDepth": 4, **params})
    raise ValueError(f"unknown learner {kind!r}")


def train(
    df: DataFrame, features: Sequence[str], kind: str = "boosted", label: str = "y", **params
) -> Model:
    """Fit on train rows: medians first (they refuse other splits), then the learner."""
    medians = fit_medians(df, features, "split" if "split" in df.columns else None)
    # One row, found once: every score of the model reads it.
    medians = df.sparkSession.createDataFrame([tuple(medians.first())], medians.schema)
    scaler = None
    if kind == "neural":
        scaler = fit_scaler(impute(df, medians, features), features)
    model = Model(None, features, medians, scaler)
    rows = model.prepare(df).select("features", F.col(label).cast("double").alias("label"), *(
        [params["validationIndicatorCol"]] if "validationIndicatorCol" in params else []
    ))
    rows = rows.persist()
    try:
        model.learner = _learner(kind, len(features), params).fit(rows)
    finally:
        rows.unpersist()
    return model


def score(model: Model, df: DataFrame, keys: Sequence[str], name: str = "score") -> DataFrame:
    """Lazy scoring that keeps the keys; nothing but keys and score is written downstream."""
    same_features(model.features, [c for c in df.columns if c in set(model.features)])
    if isinstance(model.learner, GBTClassificationModel) and model.scaler is None:
        return df.select(*keys, boosted(model).alias(name))
    out = model.learner.transform(model.prepare(df))
    if "probability" in out.columns:
        return out.select(*keys, vector_to_array("probability")[1].alias(name))
    return out.select(*keys, F.col("prediction").alias(name))


def evaluate(scored: DataFrame, y: str = "y", name: str = "score") -> DataFrame:
    # Written once: the groups are read for the edges of the value ranges and for the totals, the rows are scored once.
    return average_precision(cut_lineage(score_groups(scored, name, y)))


def importances(model: Model) -> DataFrame:
    """(feature, importance) of a tree model; one row per feature."""
    spark = model.medians.sparkSession
    pairs = list(zip(model.features, (float(v) for v in model.learner.featureImportances.toArray())))
    return spark.createDataFrame(pairs, "feature string, importance double")


def with_validation(df: DataFrame, held: Column, name: str = "is_validation") -> DataFrame:
    """Mark the rows a boosted learner watches for early stopping."""
    return df.withColumn(name, held)


def learning_curve(model: Model, df: DataFrame, y: str = "y", steps: Sequence[int] | None = None) -> DataFrame:
    """Average precision after the first n trees of a boosted model.

    Rows are scored once: the margins after each number of trees are an array that gives all the curve's points.
    """
    trees = model.learner.getNumTrees
    steps = sorted({n for n in steps or range(1, trees + 1) if 1 <= n <= trees})
    # Each row becomes a row for each point.
    long = df.select(F.col(y).alias("y"), F.posexplode(boosted(model, steps)).alias("_at", "score"))
    long = long.select("y", F.element_at(F.array(*[F.lit(n) for n in steps]), F.col("_at") + 1).alias("trees"), "score")
    return average_precision(cut_lineage(score_groups(long, "score", "y", by=["trees"])), by=["trees"])


def temporal_grid(
    df: DataFrame, features: Sequence[str], fit: Column, judge: Column, grid: dict[str, dict], kind: str = "boosted"
) -> DataFrame:
    """Fit each parameter set on the earlier years and judge it on the later ones."""
    parts = []
    for name, params in grid.items():
        model = train(df.filter(fit), features, kind, **params)
        ap = evaluate(score(model, df.filter(judge), ["y"]))
        parts.append(ap.select(F.lit(name).alias("setting"), "average_precision", "rows", "positives"))
    return reduce(DataFrame.unionByName, parts)


def compare_configurations(
    builds: dict[str, Callable[[], DataFrame]], features: Callable[[DataFrame], list[str]], fit: Column, judge: Column
) -> DataFrame:
    """The same fold over several matrices, e.g. no clusters and different numbers of them."""
    parts = []
    for name, build in builds.items():
        matrix = build()
        ap = temporal_grid(matrix, features(matrix), fit, judge, {name: {"maxIter": 5}})
        parts.append(ap)
    return reduce(DataFrame.unionByName, parts)


def leave_region_out(
    base: DataFrame, counts: DataFrame, clusters: DataFrame, regions: DataFrame, features: Callable[[DataFrame], list[str]],
    names: Sequence, fit: Column, judge: Column, least: int = 30, **params,
) -> DataFrame:
    """Each region in turn is unknown: rates ignore it, the fit skips it, the later years of it are judged.

    ``base`` is the train matrix with its region in ``reg``. Regions with fewer positives than
    ``least`` in the judged years are skipped; one grouped count decides that for all of them.
    """
    positives = {r["reg"]: r["p"] for r in base.filter(judge).groupBy("reg").agg(F.sum("y").alias("p")).collect()}
    parts = []
    for region in names:
        if (positives.get(region) or 0) < least:
            continue
        out = regions.filter(F.col("reg") == region)
        rates = smooth_rates_without(counts, clusters, out)
        # Read by three fits and three evaluations.
        matrix = cut_lineage(apply_rates(base, rates, exclude_own_year=False))
        inside = F.col("reg") == region
        for name, columns in feature_sets(features(matrix)).items():
            model = train(matrix.filter(fit & ~inside), columns, "boosted", **params)
            ap = evaluate(score(model, matrix.filter(judge & inside), ["y"]))
            parts.append(ap.select(F.lit(region).alias("region"), F.lit(name).alias("feature_set"), "average_precision", "positives"))
    if not parts:
        raise ValueError("no region has enough positives to be judged")
    return reduce(DataFrame.unionByName, parts)


def size_stage(df: DataFrame, features: Sequence[str], fit: Column, judge: Column, large: float = LARGE_HA, **params) -> DataFrame:
    """Second stage on events only: the logarithm of the size, and whether the event is large."""
    ha = F.col("size") / M2_PER_HA
    events = df.filter((F.col("y") == 1) & (F.col("size") > 0))
    events = events.withColumn("log_size", F.log1p(ha)).withColumn("large", (ha > large).cast("int"))
    a, b = events.filter(fit), events.filter(judge)
    reg = train(a, features, "size", label="log_size", **params)
    errors = regression_errors(score(reg, b, ["log_size"], "predicted"), "predicted", "log_size")
    median = exact_quantiles(a, "log_size", [0.5]).select(F.col("quantiles")[0])
    naive = regression_errors(b.withColumn("predicted", median.scalar()), "predicted", "log_size")
    clf = train(a, features, "boosted", label="large", **params)
    scored = score(clf, b, ["large"], "score")
    ap = evaluate(scored, "large")
    return errors.select(
        F.col("r2").alias("r2_log"),
        F.col("mae").alias("mae_log"),
        naive.select("mae").scalar().alias("mae_log_median"),
        ap.select("average_precision").scalar().alias("average_precision_large"),
        roc_auc(scored, "score", "large").scalar().alias("roc_auc_large"),
        F.col("rows").alias("judged"),
    )


def reference_sample(train_rows: DataFrame, share: float) -> DataFrame:
    """Background sample taken from train rows only, by the deterministic uniform."""
    return train_rows.filter((F.col("split") == "train") & (F.col("u") < share))


def random_and_top(scored: DataFrame, score_col: str, key: str, n: int, share: float) -> tuple[DataFrame, DataFrame]:
    """A deterministic uniform sample, and exactly the n best scores."""
    return scored.filter(F.col("u") < share), scored.orderBy(F.desc(score_col), F.asc(key)).limit(n)
