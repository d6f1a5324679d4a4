"""Keyed alignment of prediction sets, model comparison, ensembles and the entity bootstrap."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrisk.functions.scalars import checked
from panelrisk.operators.metrics import average_precision
from panelrisk.operators.ranks import correlations, ordinal_rank, range_index
from panelrisk.session import cut_lineage, spread

REPLICAS = 200


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {missing}: sets without keys cannot be compared")
    return df


def alignment_report(sets: dict[str, DataFrame], keys: Sequence[str], y: str = "y") -> DataFrame:
    """Rows, key mismatches and target mismatches of every set against the first one."""
    names = list(sets)
    ref = sets[names[0]].select(*keys, F.col(y).alias("_ref"))
    parts = []
    for name in names:
        own = require_columns(sets[name], [*keys, y], name).select(*keys, F.col(y).alias("_own"))
        both = ref.join(own, list(keys), "full")
        missing = F.col("_ref").isNull() | F.col("_own").isNull()
        parts.append(
            both.agg(
                F.count_if(F.col("_own").isNotNull()).alias("rows"),
                F.count_if(missing).alias("key_mismatches"),
                F.count_if(F.col("_ref") != F.col("_own")).alias("target_mismatches"),
            ).select(F.lit(name).alias("source"), "*")
        )
    return reduce(DataFrame.unionByName, parts)


def align_predictions(
    sets: dict[str, tuple[DataFrame, str]], keys: Sequence[str], y: str = "y", extra: Sequence[str] = ()
) -> DataFrame:
    """One row per key with ``y`` and one score column per set.

    A key missing on either side, or a different target, stops the job. Nothing is matched by position.
    """
    items = list(sets.items())
    name, (first, score) = items[0]
    out = require_columns(first, [*keys, y, score], name).select(*keys, *extra, y, F.col(score).alias(name))
    for name, (df, score) in items[1:]:
        other = require_columns(df, [*keys, y, score], name)
        other = other.select(*keys, F.col(y).alias("_y"), F.col(score).alias(name), F.lit(True).alias("_right"))
        both = out.withColumn("_left", F.lit(True)).join(other, list(keys), "full")
        wrong = (
            F.when(F.col("_left").isNull() | F.col("_right").isNull(), F.lit(f"{name}: keys differ from the reference"))
            .when(~F.col(y).eqNullSafe(F.col("_y")), F.lit(f"{name}: targets differ from the reference"))
        )
        out = checked(both, wrong.isNotNull(), wrong).drop("_y", "_left", "_right")
    return out


def long_scores(aligned: DataFrame, models: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., model, score): all score columns stacked."""
    items = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"`{m}`").cast("double").alias("score")) for m in models])
    return aligned.select(*keep, F.explode(items).alias("_s")).select(*keep, "_s.model", "_s.score")


def model_scores(aligned: DataFrame, models: Sequence[str], y: str = "y") -> DataFrame:
    """Average precision of each model."""
    stacked = long_scores(aligned, models, [y])
    groups = stacked.groupBy("model", "score").agg(F.count("*").alias("n"), F.sum(F.col(y).cast("int")).alias("pos"))
    return average_precision(groups, by=["model"])


def poisson_weight(u: Column) -> Column:
    """Multiplicity of a unit in a Poisson(1) bootstrap, by inverting the distribution function."""
    # Distribution function of Poisson(1) at 0..8.
    cdf = (0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173,
           0.999405815182, 0.999916758851, 0.999989750803, 0.999998874797)
    return reduce(lambda a, c: a + F.when(u >= c, 1).otherwise(0), cdf, F.lit(0))


def bootstrap_uniform(unit: Column, replica: Column, seed: int) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), replica.cast("string"), unit.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _slices(batch: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of rows with the same keys, in order."""
    new = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
    starts = np.flatnonzero(new)
    for a, z in zip(starts, [*starts[1:], len(batch)]):
        yield tuple(batch[keys].iloc[a]), batch.iloc[a:z]


#: Rows of one score in a batch from which their weights are added up before they are dealt.
TIED = 16
_DEALT = "model string, _range int, score double, n long, pos long, _w binary, _n array<long>, _pos array<long>"


def _weighted(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positives of each row in each replica, as whole numbers; added-up rows bring theirs along.

    The weights of a row are one byte for each replica: a batch of them is read as one array, not row by row.
    """
    added = part["_w"].map(len).to_numpy() == 0
    if added.all():
        return tuple(np.stack(part[c].to_numpy()).astype(np.int64) for c in ("_n", "_pos"))
    rows = part["_w"].to_numpy()[~added]
    weights = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1).astype(np.int64)
    out = []
    for own, sums in (("n", "_n"), ("pos", "_pos")):
        values = np.empty((len(part), weights.shape[1]), np.int64)
        values[~added] = weights * part[own].to_numpy(np.int64)[~added, None]
        if added.any():
            values[added] = np.stack(part[sums].to_numpy()[added])
        out.append(values)
    return tuple(out)


def _tied_added_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a batch that share model and score become one with an array of sums, where there are many of them.

    So a score that very many rows share, a constant model's, is a few rows for each task when it is dealt.
    """
    for batch in batches:
        place = batch.groupby(["model", "score"], sort=False).ngroup().to_numpy()
        many = np.bincount(place, minlength=1)[place] >= TIED if len(batch) else np.zeros(0, bool)
        none = [np.zeros(0, np.int64)] * len(batch)
        single = batch[~many].assign(_n=none[: int((~many).sum())], _pos=none[: int((~many).sum())])
        yield single
        rows = batch[many].sort_values(["model", "score"], kind="stable")
        if not len(rows):
            continue
        starts = np.flatnonzero((rows[["model", "score"]] != rows[["model", "score"]].shift()).any(axis=1).to_numpy())
        n, pos = (np.add.reduceat(x, starts, axis=0) for x in _weighted(rows.assign(_n=None, _pos=None)))
        first = rows.iloc[starts][["model", "_range", "score"]]
        yield first.assign(n=0, pos=0, _w=[b""] * len(first), _n=list(n), _pos=list(pos))


def _range_totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per (model, range): rows and positives in each replica."""
    totals: dict[tuple, list[np.ndarray]] = {}
    for batch in batches:
        for key, part in _slices(batch, ["model", "_range"]):
            sums = [x.sum(axis=0) for x in _weighted(part)]
            totals[key] = [a + b for a, b in zip(totals[key], sums)] if key in totals else sums
    yield pd.DataFrame([(*key, n, pos) for key, (n, pos) in totals.items()], columns=["model", "_range", "n", "pos"])


def _before(totals: pd.DataFrame) -> tuple[dict[tuple, tuple[np.ndarray, np.ndarray]], dict[str, np.ndarray]]:
    """For each range of a model what the ranges of higher scores have in each replica; and each model's positives."""
    before, positives = {}, {}
    for row in totals.sort_values(["model", "_range"], ascending=False).itertuples(index=False):
        model, place, n, pos = row
        n_sum, pos_sum = positives.get(model, (np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)))
        before[model, place] = n_sum, pos_sum
        positives[model] = n_sum + np.asarray(n), pos_sum + np.asarray(pos)
    return before, {model: sums[1] for model, sums in positives.items()}


def _range_parts(before: dict[tuple, tuple[np.ndarray, np.ndarray]]):
    """Sum of positives times precision over the score groups of each (model, range), in each replica.

    Rows come by key, the scores from high to low. A score group may go on in the next batch, so the last one waits.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        for batch in batches:
            for this, part in _slices(batch, ["model", "_range"]):
                if this != key:
                    if key is not None:
                        yield _part_rows(key, part_sum + _contribution(n_sum, pos_sum, *waiting)[0])
                    key = this
                    n_sum, pos_sum = before[this]
                    part_sum, waiting, score = np.zeros(len(n_sum)), (np.zeros((0, len(n_sum)), np.int64),) * 2, None
                scores = part["score"].to_numpy()
                starts = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
                n, pos = (np.add.reduceat(x, starts, axis=0) for x in _weighted(part))
                if len(waiting[0]) and scores[0] == score:
                    n[0] += waiting[0][0]
                    pos[0] += waiting[1][0]
                elif len(waiting[0]):
                    n, pos = np.vstack([waiting[0], n]), np.vstack([waiting[1], pos])
                added, n_sum, pos_sum = _contribution(n_sum, pos_sum, n[:-1], pos[:-1])
                part_sum, waiting, score = part_sum + added, (n[-1:], pos[-1:]), scores[-1]
        if key is not None:
            yield _part_rows(key, part_sum + _contribution(n_sum, pos_sum, *waiting)[0])

    return run


def _contribution(n_sum: np.ndarray, pos_sum: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positives times precision at the end of each score group, summed; and the sums after the last group."""
    n_after, pos_after = n_sum + np.cumsum(n, axis=0), pos_sum + np.cumsum(pos, axis=0)
    added = (pos * pos_after / np.maximum(n_after, 1)).sum(axis=0)
    return (added, n_after[-1], pos_after[-1]) if len(n) else (added, n_sum, pos_sum)


def _part_rows(key: tuple, parts: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"model": key[0], "replica": np.arange(1, len(parts) + 1), "part": parts})


def bootstrap_scores(
    aligned: DataFrame, models: Sequence[str], unit: str, replicas: int = REPLICAS, seed: int = 42, y: str = "y"
) -> DataFrame:
    """(replica, model, average_precision) when whole units are resampled.

    The multiplicity of a unit comes from a hash of (seed, replica, unit): every model sees the same
    weights, a retried task draws the same ones, and no draw has to be stored. Rows are collapsed to
    (unit, model, score) and dealt once by score range, each with the array of its unit's weights; all
    replicas are summed side by side in those arrays, so the rows do not multiply with the replicas.
    A range's totals are models x ranges x replicas numbers whatever the data; what stands before each
    range follows from them and goes to the tasks, so the rows stay where they were dealt.
    """
    spark = aligned.sparkSession
    stacked = long_scores(aligned, models, [unit, y]).filter(F.col("score").isNotNull())
    groups = stacked.groupBy(unit, "model", "score").agg(
        F.count("*").alias("n"), F.sum(F.col(y).cast("int")).alias("pos")
    )
    # The uniforms are bound first, so each is hashed once and not at every step of its inversion.
    uniforms = F.transform(F.sequence(F.lit(1), F.lit(replicas)), lambda r: bootstrap_uniform(F.col("_unit"), r, seed))
    draw = F.unhex(F.array_join(F.transform(uniforms, lambda u: F.concat(F.lit("0"), poisson_weight(u).cast("string"))), ""))
    weights = spread(aligned.select(F.col(unit).alias("_unit")).distinct(), "_unit").withColumn("_w", draw)
    ranged = range_index(groups, "score").join(weights, F.col(unit) == F.col("_unit"))
    ranged = ranged.select("model", F.col("_range").cast("int").alias("_range"), "score", "n", F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), "_w")
    added = ranged.mapInPandas(_tied_added_up, _DEALT)
    rows = cut_lineage(added.repartition("model", "_range").sortWithinPartitions("model", "_range", F.desc("score")))

    totals = rows.mapInPandas(_range_totals, "model string, _range int, n array<long>, pos array<long>").toPandas()
    before, positives = _before(totals)
    parts = rows.mapInPandas(_range_parts(before), "model string, replica int, part double").groupBy("replica", "model").agg(F.sum("part").alias("part"))
    given = [(model, replica, int(n)) for model, sums in positives.items() for replica, n in enumerate(sums, 1)]
    total = spark.createDataFrame(given, "model string, replica int, pos long")
    return parts.join(total, ["replica", "model"]).select("replica", "model", (F.col("part") / F.nullif(F.col("pos"), F.lit(0))).alias("average_precision"))


def paired_bootstrap(
    aligned: DataFrame, models: Sequence[str], unit: str, replicas: int = REPLICAS, seed: int = 42, y: str = "y"
) -> DataFrame:
    """Relative gap of every pair of models, its 95 % interval and whether the interval excludes 0."""
    draws = bootstrap_scores(aligned, models, unit, replicas, seed, y)
    point = model_scores(aligned, models, y).select("model", F.col("average_precision").alias("ap"))
    pairs = [F.struct(F.lit(a).alias("reference"), F.lit(b).alias("model")) for a, b in combinations(models, 2)]

    def per_pair(df: DataFrame, keys: list[str], value: str) -> DataFrame:
        wide = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("model", value))).alias("m"))
        each = wide.select(*keys, "m", F.explode(F.array(*pairs)).alias("p"))
        gap = F.lit(100.0) * (F.col("m")[F.col("p.model")] / F.col("m")[F.col("p.reference")] - 1)
        return each.select(*keys, "p.reference", "p.model", gap.alias("gap"))

    bounds = per_pair(draws, ["replica"], "average_precision").groupBy("reference", "model").agg(
        F.percentile("gap", 0.025).alias("low"), F.percentile("gap", 0.975).alias("high")
    )
    exact = per_pair(point, [], "ap").withColumnRenamed("gap", "gap_pct")
    return exact.join(bounds, ["reference", "model"]).withColumn("significant", F.col("low") * F.col("high") > 0)


def rank_table(aligned: DataFrame, models: Sequence[str], key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Normalised ordinal rank of every model per key, one column per model.

    The scores are stacked and ranked within their model in one pass, then brought back side by side,
    so the plan does not grow with each model.
    """
    stacked = long_scores(aligned, models, [key, *keep])
    rows = aligned.agg(F.count("*").alias("c"))
    ranked = ordinal_rank(stacked, "score", key, by=["model"], descending=False)
    ranked = ranked.withColumn("rank", (F.col("ordinal") - 1) / rows.scalar())
    sides = [F.max(F.when(F.col("model") == m, F.col("rank"))).alias(m) for m in models]
    return ranked.groupBy(key, *keep).agg(*sides)


def ensembles(aligned: DataFrame, models: Sequence[str], key: str, y: str = "y", sizes: Sequence[int] = (2, 3)) -> DataFrame:
    """Average precision of the mean normalised rank of every subset of models."""
    ranked = rank_table(aligned, models, key, [y])
    combos = [c for k in sizes for c in combinations(models, k)]
    named = {" + ".join(c): reduce(lambda a, b: a + b, [F.col(m) for m in c]) / len(c) for c in combos}
    wide = ranked.select(y, *[e.alias(n) for n, e in named.items()])
    stacked = long_scores(wide, list(named), [y])
    groups = stacked.groupBy("model", "score").agg(F.count("*").alias("n"), F.sum(F.col(y).cast("int")).alias("pos"))
    out = average_precision(groups, by=["model"])
    return out.withColumn("lift", F.col("average_precision") / (F.col("positives") / F.col("rows")))


def rank_diversity(aligned: DataFrame, models: Sequence[str], key: str) -> DataFrame:
    """Correlation of the normalised ranks of each pair of models."""
    pairs = correlations(rank_table(aligned, models, key), models)
    return pairs.select(F.col("feature_a").alias("a"), F.col("feature_b").alias("b"), F.col("r").alias("rank_corr"))


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str], column: str, suffixes=("_a", "_b")) -> DataFrame:
    """Two scored days or models side by side with the difference ``column_b - column_a``."""
    left = a.select(*keys, F.col(column).alias(column + suffixes[0]))
    right = b.select(*keys, F.col(column).alias(column + suffixes[1]))
    return left.join(right, list(keys)).withColumn("difference", F.col(column + suffixes[1]) - F.col(column + suffixes[0]))
