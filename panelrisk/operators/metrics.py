"""Exact rare-event metrics computed from grouped scores ``(score, n, pos)``."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrisk.operators.ranks import exact_quantiles, ordinal_rank, running_totals, tie_ranks

# Watched shares of the ranking.
BUDGETS = (0.001, 0.005, 0.01, 0.05, 0.10)
# An average precision above this on an event this rare means a leak, not a success.
SUSPICIOUS_AP = 0.80


def score_groups(df: DataFrame, score: str, y: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row per distinct score: number of rows and of positives (weighted when asked)."""
    w: Column = F.lit(1) if weight is None else F.col(weight)
    return (
        df.groupBy(*by, F.col(score).alias("score"))
        .agg(F.sum(w).alias("n"), F.sum(w * F.col(y).cast("int")).alias("pos"))
        .filter(F.col("n") > 0)
    )


def average_precision(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum over distinct thresholds of recall step x precision; equal scores are one threshold.

    Also returns ``rows`` and ``positives``. Without positives the value is NULL.
    """
    cum = running_totals(groups, "score", ["n", "pos"], by=by)
    # recall step x precision = pos/P x cum_pos/cum_n; the common factor 1/P is applied once.
    step = F.col("pos") * F.col("cum_pos") / F.col("cum_n")
    return cum.groupBy(*by).agg(
        (F.sum(step) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"),
        F.sum("n").alias("rows"),
        F.sum("pos").alias("positives"),
    )


def with_lift(found: DataFrame) -> DataFrame:
    """Add the base rate and how many times the average precision is above it."""
    rate = F.col("positives") / F.col("rows")
    return found.withColumn("rate", rate).withColumn("lift", F.col("average_precision") / F.nullif(F.col("rate"), F.lit(0.0)))


def brier(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    s, n, p = F.col("score"), F.col("n"), F.col("pos")
    sse = p * (s - 1) * (s - 1) + (n - p) * s * s
    return groups.groupBy(*by).agg((F.sum(sse) / F.sum("n")).alias("brier"))


def report(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision, Brier score, base rate and lift over it, in one pass over the groups."""
    s, n, p = F.col("score"), F.col("n"), F.col("pos")
    cum = running_totals(groups, "score", ["n", "pos"], by=by)
    sse = p * (s - 1) * (s - 1) + (n - p) * s * s
    out = cum.groupBy(*by).agg(
        (F.sum(p * F.col("cum_pos") / F.col("cum_n")) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"),
        (F.sum(sse) / F.sum("n")).alias("brier"),
        (F.sum("pos") / F.sum("n")).alias("base_rate"),
    )
    return out.withColumn("lift", F.col("average_precision") / F.col("base_rate"))


def calibration_curve(groups: DataFrame, bins: int = 10) -> DataFrame:
    """Announced against observed frequency in bins of equal mass along the ascending score."""
    cum = running_totals(groups, "score", ["n"], descending=False)
    mass = groups.agg(F.sum("n").alias("t"))
    index = F.least(F.floor(F.lit(bins) * F.col("cum_n") / mass.scalar()), F.lit(bins - 1)).cast("int")
    return (
        cum.withColumn("bin", index)
        .groupBy("bin")
        .agg(
            (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("announced"),
            (F.sum("pos") / F.sum("n")).alias("observed"),
            F.sum("n").alias("rows"),
        )
    )


def reliability(df: DataFrame, p: str, y: str, bins: int = 15) -> DataFrame:
    """Reliability by quantile bins; equal edges are merged and a value on an edge opens the next bin."""
    probs = [i / bins for i in range(bins + 1)]
    groups = df.groupBy(F.col(p).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("int")).alias("pos"))
    edges = exact_quantiles(groups, "score", probs, count="n").select(F.array_sort(F.array_distinct("quantiles")).alias("e"))
    placed = groups.withColumn("_e", edges.scalar())
    last = F.size(F.filter("_e", lambda e: e <= F.col("score"))) - 1
    index = F.least(F.greatest(last, F.lit(0)), F.size("_e") - 2)
    return (
        placed.withColumn("bin", index)
        .groupBy("bin")
        .agg(
            (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("announced"),
            (F.sum("pos") / F.sum("n")).alias("observed"),
            F.sum("n").alias("rows"),
        )
        .withColumn("gap", F.col("announced") - F.col("observed"))
    )


def calibration_summary(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Level and ordering of a probability: Brier, mean, bias, average precision, distinct values."""
    s, n, p = F.col("score"), F.col("n"), F.col("pos")
    cum = running_totals(groups, "score", ["n", "pos"], by=by)
    out = cum.groupBy(*by).agg(
        (F.sum(p * F.col("cum_pos") / F.col("cum_n")) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"),
        (F.sum(p * (s - 1) * (s - 1) + (n - p) * s * s) / F.sum("n")).alias("brier"),
        (F.sum(s * n) / F.sum("n")).alias("mean_p"),
        (F.sum("pos") / F.sum("n")).alias("real_rate"),
        F.count("*").alias("distinct_values"),
    )
    return out.withColumn("bias", F.col("mean_p") / F.col("real_rate"))


def residual_bias(df: DataFrame, p: str, y: str, group: Column) -> DataFrame:
    return df.groupBy(group.alias("group")).agg(
        (F.avg(p) / F.avg(F.col(y).cast("double"))).alias("bias"), F.count("*").alias("rows")
    )


def budget_table(df: DataFrame, score: str, y: str, key: str, budgets: Sequence[float] = BUDGETS) -> DataFrame:
    """Watch the best ``floor(n * b)`` rows: rows, captured positives, precision, recall."""
    positives = ordinal_rank(df, score, key).filter(F.col(y).cast("int") == 1).select("ordinal")
    whole = df.agg(F.struct(F.count("*").alias("n"), F.sum(F.col(y).cast("int")).alias("pos")).alias("w"))
    takes = F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget")
    spread = positives.withColumn("_w", whole.scalar()).select("*", takes)
    rows = F.floor(F.col("_w.n") * F.col("budget"))
    out = spread.groupBy("budget").agg(
        F.first(rows).alias("rows"),
        F.sum((F.col("ordinal") <= rows).cast("int")).alias("captured"),
        F.first("_w.pos").alias("_pos"),
    )
    return out.select(
        "budget",
        "rows",
        "captured",
        (F.col("captured") / F.nullif(F.col("rows"), F.lit(0))).alias("precision"),
        (F.col("captured") / F.col("_pos")).alias("recall"),
    )


def budget_curve(df: DataFrame, score: str, y: str, key: str, points: int = 200, smallest: float = 2e-4) -> DataFrame:
    """Positives captured at each budget of a logarithmic grid; the grid is built from the row count."""
    lo = math.log10(smallest)
    whole = df.agg(F.struct(F.count("*").alias("n"), F.sum(F.col(y).cast("int")).alias("pos")).alias("w"))
    shares = F.array(*[F.lit(10 ** (lo - lo * i / (points - 1))) for i in range(points)])
    positives = ordinal_rank(df, score, key).filter(F.col(y).cast("int") == 1).select("ordinal")
    grid = positives.withColumn("_w", whole.scalar())
    at = F.array_sort(
        F.array_distinct(
            F.transform(
                shares,
                lambda s: F.least(F.greatest(F.rint(s * F.col("_w.n")).cast("bigint"), F.lit(1)), F.col("_w.n")),
            )
        )
    )
    # Each positive is counted once, at the first budget that reaches it (at most `points` values) ...
    first = F.element_at(F.filter(at, lambda b: b >= F.col("ordinal")), 1)
    caught = grid.groupBy(first.alias("rows")).agg(F.count("*").alias("c"))
    steps = whole.select("w", F.col("w").alias("_w")).select("w", F.explode(at).alias("rows"))
    # ... and the running sum goes over those few rows only.
    filled = steps.join(caught, "rows", "left").select("w", "rows", F.coalesce("c", F.lit(0)).alias("c"))
    cum = running_totals(filled, "rows", ["c"], descending=False, ranges=2)
    return cum.select(
        "rows",
        (F.col("rows") / F.col("w.n")).alias("budget"),
        F.col("cum_c").alias("captured"),
        (F.col("cum_c") / F.col("rows")).alias("precision"),
        (F.col("cum_c") / F.col("w.pos")).alias("recall"),
    )


def watch_levels(groups: DataFrame, levels: Sequence[float]) -> DataFrame:
    """At each watched share, the nearest reachable threshold, its precision, recall and the recall ceiling.

    The best possible precision when watching a share s with base rate b is ``min(1, b / s)``.
    """
    cum = running_totals(groups, "score", ["n", "pos"])
    whole = groups.agg(F.struct(F.sum("n").alias("n"), F.sum("pos").alias("pos")).alias("w"))
    spread = cum.withColumn("_w", whole.scalar()).select("*", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    share = F.col("cum_n") / F.col("_w.n")
    nearest = F.struct(F.abs(share - F.col("level")).alias("d"), F.col("cum_n"))
    picked = spread.groupBy("level").agg(
        F.min_by(F.struct("cum_n", "cum_pos", "_w"), nearest).alias("k"),
    )
    return picked.select(
        "level",
        (F.col("k.cum_n") / F.col("k._w.n")).alias("share"),
        (F.col("k.cum_pos") / F.col("k.cum_n")).alias("precision"),
        (F.col("k.cum_pos") / F.col("k._w.pos")).alias("recall"),
        F.least(F.lit(1.0), F.col("k._w.pos") / F.col("k._w.n") / F.col("level")).alias("ceiling"),
    )


def roc_auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Mann-Whitney form with average ranks, from grouped scores."""
    groups = score_groups(df, score, y)
    cum = running_totals(groups, "score", ["n"], descending=False)
    avg_rank = F.col("cum_n") - (F.col("n") - 1) / 2
    out = cum.agg(
        F.sum(avg_rank * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n")
    )
    p, n = F.col("p"), F.col("n")
    return out.select(((F.col("r") - p * (p + 1) / 2) / (p * (n - p))).alias("roc_auc"))


def regression_errors(df: DataFrame, predicted: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2 against the mean of the actual values, and Pearson correlation."""
    e = F.col(predicted) - F.col(actual)
    return df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.sum(e * e) / (F.var_pop(actual) * F.count(actual))).alias("r2"),
        F.corr(predicted, actual).alias("r"),
        F.count("*").alias("rows"),
    )


def positives_rank_summary(df: DataFrame, score: str, y: str) -> DataFrame:
    """Median rank of the positives and the share of them inside the best 1 %; one without a score has no rank."""
    rows = df.agg(F.count("*").alias("c"))
    positive = df.filter(F.col(y).cast("int") == 1)
    # Positives are counted by score before they meet the ranks, so a score that very many share is one row.
    counted = positive.groupBy(score).agg(F.count("*").alias("_n"))
    ranked = counted.join(tie_ranks(df, score).select(score, "min_rank"), score, "left")
    top = F.when(F.col("min_rank") <= F.col("_c") * F.lit(0.01), F.col("_n")).otherwise(0)
    summed = ranked.withColumn("_c", rows.scalar()).agg(
        (F.sum(top) / F.nullif(F.sum("_n"), F.lit(0))).alias("share_in_top_1pct"), F.coalesce(F.sum("_n"), F.lit(0)).alias("positives")
    )
    median = exact_quantiles(ranked, "min_rank", [0.5], count="_n")
    return summed.withColumn("median_rank", median.select(F.get("quantiles", F.lit(0))).scalar()).select("median_rank", "share_in_top_1pct", "positives")


def capture(df: DataFrame, score: str, key: str, large: str, shares: Sequence[float]) -> DataFrame:
    """(share, taken, large, captured, capture): of the rows marked ``large`` those among the best ``share`` of all rows."""
    ranked = ordinal_rank(df, score, key).withColumn("_n", df.agg(F.count("*").alias("c")).scalar())
    marked = F.col(large).cast("int")
    each = ranked.select("ordinal", "_n", marked.alias("_large"), F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    inside = F.col("ordinal") <= F.floor(F.col("_n") * F.col("share"))
    out = each.groupBy("share").agg(F.count_if(inside).alias("taken"), F.sum("_large").alias("large"), F.sum(F.when(inside, F.col("_large")).otherwise(0)).alias("captured"))
    return out.withColumn("capture", F.col("captured") / F.nullif(F.col("large"), F.lit(0)))


def suspicion(ap: DataFrame, limit: float = SUSPICIOUS_AP) -> DataFrame:
    return ap.withColumn("suspicious", F.col("average_precision") > limit)


def verdict(ap: DataFrame, low: float, high: float) -> DataFrame:
    """Compare a measured average precision with the range announced before the test."""
    return ap.withColumn("inside_range", F.col("average_precision").between(low, high))
