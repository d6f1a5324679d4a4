"""Distributed prefix sums and ranks.

A window ordered by score without a partition key would pull every row into one task. Here the
caller first aggregates by score, the groups are cut into value ranges, running sums are taken
inside a range, and the totals of the ranges before it (one row per range) are added back.
The result is exact whatever the range edges are; the edges only balance the work.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.session import shuffle_width


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which NULL keys meet; the keys come from the left side."""
    own = right.select(*[F.col(c).alias(f"_key_{i}") for i, c in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = [left[c].eqNullSafe(own[f"_key_{i}"]) for i, c in enumerate(keys)]
    return left.join(own, same, how).drop(*[f"_key_{i}" for i in range(len(keys))])


def range_index(df: DataFrame, value: str, ranges: int | None = None, name: str = "_range") -> DataFrame:
    """Number of balanced edges below ``value``: monotone in it, and 0 for NULL.

    There are as many ranges as the session has shuffle partitions, two at least.
    """
    ranges = ranges or max(2, shuffle_width(df))
    probs = [i / ranges for i in range(1, ranges)]
    # Two short searches instead of one long one: every `step`-th edge first, then the edges of that stretch.
    step = math.isqrt(ranges) + 1
    edges = df.agg(F.percentile_approx(F.col(value).cast("double"), probs, max(1000, 10 * ranges)).alias("e"))
    stops = F.filter("e", lambda _, i: (i + 1) % step == 0)
    found = edges.select(F.struct(F.col("e"), stops.alias("stops")).alias("s"))
    less = lambda e: e < F.col(value)
    coarse = F.coalesce(F.size(F.filter("_edges.stops", less)), F.lit(0))
    fine = F.size(F.filter(F.slice("_edges.e", F.col("_coarse") * step + 1, F.lit(step)), less))
    placed = df.withColumn("_edges", found.scalar()).withColumn("_coarse", coarse)
    index = F.coalesce(F.col("_coarse") * step + fine, F.lit(0))
    return placed.withColumn(name, index).drop("_edges", "_coarse")


def running_totals(
    groups: DataFrame,
    order: str,
    values: Sequence[str],
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    descending: bool = True,
    ranges: int | None = None,
    prefix: str = "cum_",
) -> DataFrame:
    """Add inclusive running sums ``cum_<value>`` along ``order`` (then ``ties`` ascending) within ``by``.

    ``groups`` must already be one row per (by, order, ties).
    """
    cut = range_index(groups, order, ranges)
    keys = list(by)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(*keys, "_range").orderBy(direction(order), *[F.col(t).asc() for t in ties])
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = cut.withColumns({f"{prefix}{v}": F.sum(v).over(inside) for v in values})

    # One row per (by, range): at most `ranges` rows for each value of `by`.
    totals = cut.groupBy(*keys, "_range").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*keys).orderBy(direction("_range"))
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_range", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before_{v}") for v in values]
    )
    out = join_null_safe(within, offsets, [*keys, "_range"])
    out = out.withColumns({f"{prefix}{v}": F.col(f"{prefix}{v}") + F.col(f"_before_{v}") for v in values})
    return out.drop("_range", *[f"_before_{v}" for v in values])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """(by..., quantiles): the exact quantiles of ``value``, interpolated between neighbouring ranks, as an array.

    Rows are counted by value, and prefix sums of the counts place each value; no task holds all values of a
    group. ``count`` names a column with the rows each row stands for. NULL is left out; a group without values has
    no row, except that without ``by`` there is always one.
    """
    rows = F.count("*") if count is None else F.sum(count)
    groups = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(rows.alias("n")).filter("n > 0")
    cum = running_totals(groups, value, ["n"], by=by, descending=False)
    total = groups.groupBy(*by).agg(F.sum("n").alias("_rows"))
    placed = join_null_safe(cum, total, by) if by else cum.withColumn("_rows", total.scalar())
    found = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("_rows") - 1)
        for side, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            inside = (F.col("cum_n") - F.col("n") <= at) & (at < F.col("cum_n"))
            found.append(F.max(F.when(inside, F.col(value).cast("double"))).alias(f"_{side}{i}"))
    out = placed.groupBy(*by).agg(F.max("_rows").alias("_rows"), *found)
    values = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("_rows") - 1)
        low, high = F.floor(place), F.ceil(place)
        between = (high - place) * F.col(f"_low{i}") + (place - low) * F.col(f"_high{i}")
        values.append(F.when((low == high) | (F.col(f"_low{i}") == F.col(f"_high{i}")), F.col(f"_low{i}")).otherwise(between))
    return out.select(*by, F.array(*values).alias("quantiles"))


def column_quantiles(df: DataFrame, columns: Sequence[str], p: float, by: Sequence[str] = ()) -> DataFrame:
    """(by..., columns...): the exact quantile of each column, all of them in one pass over the stacked values.

    A row of ``df`` is read once; what is sorted are the distinct values of each column with their counts, in ranges.
    Without ``by`` there is always one row; a column without values is NULL.
    """
    items = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    stacked = df.select(*by, F.explode(items).alias("_s")).select(*by, "_s._c", "_s._v")
    found = exact_quantiles(stacked, "_v", [p], by=[*by, "_c"])
    value = F.get("quantiles", F.lit(0))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_c") == i, value)).alias(c) for i, c in enumerate(columns)])


def tie_ranks(df: DataFrame, score: str, by: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """One row per distinct score: ``n`` rows at it, ``min_rank`` and ``avg_rank`` of those rows. NULL has no rank."""
    groups = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("n"))
    cum = running_totals(groups, score, ["n"], by=by, descending=descending)
    return cum.select(
        *by,
        score,
        "n",
        (F.col("cum_n") - F.col("n") + 1).alias("min_rank"),
        (F.col("cum_n") - (F.col("n") - 1) / 2).alias("avg_rank"),
    )


def with_ranks(df: DataFrame, score: str, by: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """Attach ``n``, ``min_rank`` and ``avg_rank`` to every row by an equi-join on the score; NULL where it is NULL."""
    return join_null_safe(df, tie_ranks(df, score, by, descending), [*by, score], "left")


def percentile_rank(df: DataFrame, score: str, name: str = "rank_pct") -> DataFrame:
    """Average rank of equal scores divided by the number of rows that have one (ascending); NULL stays NULL."""
    rows = df.agg(F.count(score).alias("c"))
    ranked = with_ranks(df, score, descending=False)
    return ranked.withColumn(name, F.col("avg_rank") / rows.scalar()).drop("n", "min_rank", "avg_rank")


def ordinal_rank(
    df: DataFrame,
    score: str,
    key: str,
    by: Sequence[str] = (),
    descending: bool = True,
    name: str = "ordinal",
    ranges: int | None = None,
    tie_ranges: int | None = None,
) -> DataFrame:
    """Row number along (score, key). ``key`` is a unique number; equal scores go by ascending key. Rows whose
    score is NULL stay, with a NULL number.

    A score shared by many rows is split by key range, so no task holds a whole tie.
    """
    keyed = range_index(df, key, tie_ranges, "_key_range")
    cell = [*by, score, "_key_range"]
    groups = keyed.filter(F.col(score).isNotNull()).groupBy(*cell).agg(F.count("*").alias("n"))
    cum = running_totals(groups, score, ["n"], by=by, ties=["_key_range"], descending=descending, ranges=ranges)
    offsets = cum.select(*cell, (F.col("cum_n") - F.col("n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(key))
    numbered = join_null_safe(keyed.withColumn("_in", inside), offsets, cell, "left")
    return numbered.withColumn(name, F.col("_start") + F.col("_in")).drop("_start", "_in", "_key_range")


def normalised_rank(df: DataFrame, score: str, key: str, name: str) -> DataFrame:
    """Ordinal rank scaled to [0, 1): 0 for the smallest score; NULL stays NULL."""
    rows = df.agg(F.count(score).alias("c"))
    ranked = ordinal_rank(df, score, key, descending=False, name="_ordinal")
    return ranked.withColumn(name, (F.col("_ordinal") - 1) / rows.scalar()).drop("_ordinal")


def top_fraction(df: DataFrame, score: str, key: str, share: float) -> DataFrame:
    """The ``floor(rows * share)`` best rows; rows without a score are neither counted nor taken."""
    rows = df.agg(F.count(score).alias("c"))
    ranked = ordinal_rank(df, score, key)
    return ranked.filter(F.col("ordinal") <= F.floor(rows.scalar() * F.lit(share))).drop("ordinal")


def concentration(df: DataFrame, size: str, shares: Sequence[float]) -> DataFrame:
    """Share of the total carried by the largest ``floor(n * p)`` rows, for each p (at least one row)."""
    groups = df.groupBy(size).agg(F.count("*").alias("n"), F.sum(size).alias("s"))
    cum = running_totals(groups, size, ["n", "s"])
    whole = groups.agg(F.struct(F.sum("n").alias("n"), F.sum("s").alias("s")).alias("w"))
    points = F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("top_share")
    cut = cum.withColumn("_w", whole.scalar()).select("*", points)
    wanted = F.greatest(F.floor(F.col("_w.n") * F.col("top_share")), F.lit(1))
    # The group that crosses the cut contributes only the rows still wanted.
    taken = F.greatest(F.least(F.col("n"), wanted - (F.col("cum_n") - F.col("n"))), F.lit(0))
    return cut.groupBy("top_share").agg((F.sum(taken * F.col(size)) / F.first("_w.s")).alias("share_of_total"))


def average_rank_columns(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """Replace each column by its average rank, keyed by ``key``."""
    out = df.select(key, *cols)
    for c in cols:
        ranks = tie_ranks(df.select(c), c, descending=False).select(c, F.col("avg_rank").alias(f"_{c}"))
        out = out.join(ranks, c, "left").drop(c).withColumnRenamed(f"_{c}", c)
    return out.select(key, *cols)


def pair_names(cols: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson coefficient of every pair a < b as rows, from one aggregation pass."""
    pairs = pair_names(cols)
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    items: list[Column] = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"`{a}|{b}`").alias("r"))
        for a, b in pairs
    ]
    return row.select(F.explode(F.array(*items)).alias("p")).select("p.*")


def spearman(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    return correlations(average_rank_columns(df, cols, key), cols)


def redundant_pairs(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    return pairs.filter(F.abs("r") >= threshold).orderBy(F.abs("r").desc(), "feature_a", "feature_b")
