"""Column expressions: classes, shares, logs, periods, deterministic uniforms, log-odds, t tail."""
from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the danger classes 1..5; class 6 is everything above.
CLASS_BOUNDS = (5.2, 11.2, 21.3, 38.0, 50.0)
HIGH_DANGER = 21.3
VERY_HIGH_DANGER = 38.0
# Sentinel for "no event inside the history horizon".
NO_EVENT_DAYS = 9999
# Horizon in days over which the burnt size is summed.
SIZE_HORIZON = 30
M2_PER_HA = 10000.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def threshold_class(x: Column | str, bounds: Sequence[float] = CLASS_BOUNDS) -> Column:
    """1-based class of ``x``; a value on a bound belongs to the class above, NULL stays NULL."""
    x = col(x)
    out = F.when(x.isNull(), F.lit(None))
    for i, b in enumerate(bounds, start=1):
        out = out.when(x < F.lit(float(b)), F.lit(i))
    return out.otherwise(F.lit(len(bounds) + 1)).cast("int")


def dominant_category(rules: Sequence[tuple[str, float, str]], default: str) -> Column:
    """First category, in priority order, whose share exceeds its threshold."""
    head, *tail = rules
    out = F.when(F.col(head[0]) > head[1], F.lit(head[2]))
    for share, limit, label in tail:
        out = out.when(F.col(share) > limit, F.lit(label))
    return out.otherwise(F.lit(default))


def log1p0(x: Column | str) -> Column:
    return F.log1p(F.coalesce(col(x).cast("double"), F.lit(0.0)))


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """NULL numerator counts as 0; a zero denominator gives NULL."""
    return F.coalesce(col(num).cast("double"), F.lit(0.0)) / F.nullif(col(den).cast("double"), F.lit(0.0))


def uniform(key: Column, *more: Column) -> Column:
    """Deterministic uniform in [0, 1) with six digits, from a hash of the key parts joined by '|'."""
    text = F.concat_ws("|", key.cast("string"), *[m.cast("string") for m in more])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 1000000) / F.lit(1e6)


def split_label(year: Column | str, train_end: int, val_end: int) -> Column:
    y = col(year)
    return F.when(y <= train_end, F.lit("train")).when(y <= val_end, F.lit("val")).otherwise(F.lit("test"))


def period_label(year: Column | str, periods: Sequence[tuple[int, int]]) -> Column:
    """``'a-b'`` for the named period that holds the year, NULL outside all of them."""
    y = col(year)
    return F.coalesce(*[F.when(y.between(a, b), F.lit(f"{a}-{b}")) for a, b in periods])


def decade(year: Column | str) -> Column:
    return (F.floor(col(year) / 10) * 10).cast("int")


def clip(x: Column | str, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(lo)), F.lit(hi))


def prior_corrected(p: Column | str, ratio: float) -> Column:
    """Undo negative down-sampling: ``ratio`` is the share of negatives kept."""
    p = col(p)
    return p / (p + (F.lit(1.0) - p) / F.lit(float(ratio)))


def logit(p: Column | str, eps: float = 1e-9) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(z: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(z)))


def band_right_closed(x: Column | str, cuts: Sequence[float]) -> Column:
    """Index of the band ``(cuts[i], cuts[i+1]]`` that holds x, NULL outside."""
    x = col(x)
    pairs = list(zip(cuts[:-1], cuts[1:]))
    return F.coalesce(*[F.when((x > lo) & (x <= hi), F.lit(i)) for i, (lo, hi) in enumerate(pairs)])


def null_inconsistent(df, low: str, high: str, group: Sequence[str]):
    """Blank every column of ``group`` where ``high < low``."""
    bad = F.col(high) < F.col(low)
    return df.withColumns({c: F.when(F.coalesce(bad, F.lit(False)), F.lit(None)).otherwise(F.col(c)) for c in group})


def cyclic(x: Column | str, period: float, k: int = 1) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * F.lit(float(k)) * col(x) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def interpolate(x: Column | str, anchors: Sequence[tuple[float, Column | float]]) -> Column:
    """Piecewise-linear through ``(position, value)`` anchors, flat outside them."""
    x = col(x)
    values = [(p, v if isinstance(v, Column) else F.lit(float(v))) for p, v in anchors]
    out = F.when(x <= values[0][0], values[0][1])
    for (x0, v0), (x1, v1) in zip(values[:-1], values[1:]):
        out = out.when(x <= x1, v0 + (v1 - v0) * (x - F.lit(float(x0))) / F.lit(float(x1 - x0)))
    return out.otherwise(values[-1][1])


def count_below(values: Column, x: Column) -> Column:
    """How many of the sorted values of an array lie below ``x``, by bisection."""
    steps = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.ceil(F.log2(F.size(values) + 1)).cast("int"))).otherwise(F.array().cast("array<int>"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = F.coalesce(F.get(values, middle) < x, F.lit(False)) & (s["low"] < s["high"])
        return F.struct(F.when(right, middle + 1).otherwise(s["low"]).alias("low"), F.when(right, s["high"]).otherwise(middle).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(values).alias("high")), halve)["low"]


def student_t_p(t: Column | str, dof: Column | str) -> Column:
    """Two-sided p-value of Student's t for integer degrees of freedom, by the finite trigonometric sum."""
    t, nu = F.abs(col(t)), col(dof).cast("int")
    theta = F.atan(t / F.sqrt(nu.cast("double")))
    c2 = F.cos(theta) * F.cos(theta)
    half = F.when(nu % 2 == 0, nu / 2 - 1).otherwise((nu - 3) / 2).cast("int")
    steps = F.when(half >= 1, F.sequence(F.lit(1), half)).otherwise(F.array().cast("array<int>"))
    shift = F.when(nu % 2 == 0, F.lit(-1)).otherwise(F.lit(0))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, j):
        ratio = (2 * j + shift) / (2 * j + 1 + shift)
        term = acc["term"] * ratio * c2
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(steps, zero, step, lambda a: a["total"])
    odd = (theta + F.sin(theta) * F.cos(theta) * series) * 2 / F.pi()
    area = F.when(nu % 2 == 0, F.sin(theta) * series).when(nu == 1, theta * 2 / F.pi()).otherwise(odd)
    return F.greatest(F.lit(1.0) - area, F.lit(0.0))


def stop_if(bad: Column, message: Column | str) -> Column:
    """0, or a failure of the job where ``bad`` holds.

    The optimizer copies deterministic filters to the other side of an equi-join, where rows that the
    join would drop could trigger the failure. An (empty) random suffix keeps the check in its place.
    """
    text = F.lit(message) if isinstance(message, str) else message
    pinned = F.concat(text, F.substring(F.rand(0).cast("string"), 1, 0))
    return F.when(bad, F.raise_error(pinned).cast("int")).otherwise(F.lit(0))


def checked(df, bad: Column, message: Column | str):
    """The same rows, guarded by :func:`stop_if`."""
    return df.withColumn("_stop", stop_if(bad, message)).filter(F.col("_stop") == 0).drop("_stop")
