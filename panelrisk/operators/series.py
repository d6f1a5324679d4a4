"""Daily series: harmonics, autocorrelation, trends, regressions and reference forecasts."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.functions.scalars import HIGH_DANGER, cyclic, student_t_p

# Fixed value: 5 % critical value of the unit-root regression with a constant (large samples).
UNIT_ROOT_5PCT = -2.86


def daily_series(days: DataFrame, measures: DataFrame, start: str, end: str, x: str = "fwi") -> DataFrame:
    """Per day: entity-days with an event, mean measure, share of cells over the danger bound."""
    span = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    axis = days.sparkSession.range(1).select(span)
    events = days.groupBy("day").agg(F.count("*").alias("events"))
    weather = measures.groupBy("day").agg(
        F.avg(x).alias("fwi"), (F.count_if(F.col(x) > HIGH_DANGER) / F.count("*")).alias("danger_share")
    )
    out = axis.join(events, "day", "left").join(weather, "day")
    return out.withColumn("events", F.coalesce("events", F.lit(0)).cast("double"))


def fourier(df: DataFrame, day: str = "day", n: int = 4) -> DataFrame:
    terms = {}
    for k in range(1, n + 1):
        terms[f"sin{k}"], terms[f"cos{k}"] = cyclic(F.dayofyear(day), 365.25, k)
    return df.withColumns(terms)


def harmonic_names(n: int = 4) -> list[str]:
    return [f"{f}{k}" for k in range(1, n + 1) for f in ("sin", "cos")]


def anomaly(df: DataFrame, x: str, group: str = "doy", name: str = "anomaly") -> DataFrame:
    """Value minus the mean of its group; the means are aggregated first and joined back."""
    mean = df.groupBy(group).agg(F.avg(x).alias("_m"))
    return df.join(mean, group).withColumn(name, F.col(x) - F.col("_m")).drop("_m")


def first_difference(df: DataFrame, x: str, order: str, by: Sequence[str] = (), name: str = "diff") -> DataFrame:
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(order)
    return df.withColumn(name, F.col(x) - F.lag(x).over(w))


def acf(df: DataFrame, x: str, day: str = "day", lags: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """Autocorrelation at lags 0..n with the white-noise band, by an equi-join of the series with its shifts.

    Lagged products are summed in parallel; no task needs the whole series in order.
    """
    keys = list(by)
    means = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.count(x).alias("_n")) if keys else None
    if keys:
        z = df.join(means, keys)
    else:
        stats = df.agg(F.struct(F.avg(x).alias("m"), F.count(x).alias("n")).alias("s"))
        z = df.withColumn("_s", stats.scalar()).withColumn("_m", F.col("_s.m")).withColumn("_n", F.col("_s.n"))
    z = z.select(*keys, F.col(day).alias("_d"), (F.col(x) - F.col("_m")).alias("_z"), "_n")
    shifted = z.select(
        *keys, F.col("_d"), F.col("_z").alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag")
    ).withColumn("_d", F.date_add("_d", F.col("lag")))
    prod = z.join(shifted, [*keys, "_d"]).groupBy(*keys, "lag").agg(
        F.sum(F.col("_z") * F.col("_w")).alias("c"), F.max("_n").alias("n")
    )
    zero = prod.filter("lag = 0").select(*keys, F.col("c").alias("c0"))
    # One value per series: without keys it is a single number.
    joined = prod.join(zero, keys) if keys else prod.withColumn("c0", zero.select("c0").scalar())
    return joined.select(
        *keys, "lag", (F.col("c") / F.col("c0")).alias("acf"), (F.lit(1.96) / F.sqrt(F.col("n").cast("double"))).alias("band")
    )


def decorrelation_time(acf_table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First lag whose autocorrelation falls under 1/e."""
    low = F.when(F.col("acf") < F.exp(F.lit(-1.0)), F.col("lag"))
    return acf_table.groupBy(*by).agg(F.min(low).alias("tau"))


def pacf(acf_table: DataFrame, by: str = "series") -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion.

    One group holds the few autocorrelations of one series, not its observations.
    """

    def recurse(pdf: pd.DataFrame) -> pd.DataFrame:
        rho = pdf.sort_values("lag")["acf"].to_list()
        phi: list[float] = []
        out = []
        for k in range(1, len(rho)):
            num = rho[k] - sum(p * rho[k - 1 - j] for j, p in enumerate(phi))
            den = 1.0 - sum(p * rho[j + 1] for j, p in enumerate(phi))
            last = num / den
            phi = [p - last * phi[k - 2 - j] for j, p in enumerate(phi)] + [last]
            out.append((pdf[by].iloc[0], k, last))
        return pd.DataFrame(out, columns=[by, "lag", "pacf"])

    return acf_table.select(by, "lag", "acf").groupBy(by).applyInPandas(recurse, f"{by} string, lag int, pacf double")


def trend(df: DataFrame, x: str = "x", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope with its p-value, the fitted value at both ends and the relative change."""
    fit = df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.count(y).alias("n"),
        F.min(x).alias("first"),
        F.max(x).alias("last"),
    )
    t = F.sqrt(F.col("r2") * (F.col("n") - 2) / F.nullif(F.lit(1.0) - F.col("r2"), F.lit(0.0)))
    start = F.col("intercept") + F.col("slope") * F.col("first")
    out = fit.withColumn("p_value", F.when(F.col("n") > 2, student_t_p(t, F.col("n") - 2)))
    return out.withColumns(
        {
            "start_value": start,
            "end_value": start + F.col("slope") * (F.col("last") - F.col("first")),
            "change_pct": F.lit(100.0) * F.col("slope") * (F.col("last") - F.col("first")) / F.nullif(start, F.lit(0.0)),
            "significant": F.col("p_value") < 0.05,
        }
    )


def resample(df: DataFrame, x: str, day: str = "day", months: tuple[int, int] | None = None) -> DataFrame:
    """Yearly mean and total, over the whole year or a range of months."""
    rows = df if months is None else df.filter(F.month(day).between(*months))
    return rows.groupBy(F.year(day).alias("year")).agg(F.avg(x).alias("mean"), F.sum(x).alias("total"))


def least_squares(df: DataFrame, features: Sequence[str], label: str):
    """Exact least squares by the normal equations; Spark adds up one small matrix."""
    vector = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip")
    model = LinearRegression(featuresCol="_x", labelCol=label, solver="normal", regParam=0.0).fit(vector.transform(df))
    return vector, model


def deseasonalise(df: DataFrame, x: str, n: int = 4) -> DataFrame:
    """Residual of the regression on annual harmonics."""
    terms = fourier(df, n=n)
    vector, model = least_squares(terms, harmonic_names(n), x)
    scored = model.transform(vector.transform(terms))
    return scored.withColumn("residual", F.col(x) - F.col("prediction")).drop("_x", "prediction", *harmonic_names(n))


def unit_root(df: DataFrame, x: str, order: str = "day", lags: int = 7) -> dict[str, float]:
    """t statistic of the level in the lagged-difference regression, with the 5 % critical value."""
    # A national series has one row per calendar day (or year), so it fits one ordered partition.
    w = Window.partitionBy(F.lit(1)).orderBy(order)
    d = df.select(order, F.col(x).cast("double").alias("_value")).filter(F.col("_value").isNotNull())
    d = d.withColumn("_dx", F.col("_value") - F.lag("_value").over(w)).withColumn("level", F.lag("_value").over(w))
    d = d.withColumns({f"dx{i}": F.lag("_dx", i).over(w) for i in range(1, lags + 1)}).na.drop()
    features = ["level", *[f"dx{i}" for i in range(1, lags + 1)]]
    _, model = least_squares(d, features, "_dx")
    return {"statistic": model.summary.tValues[0], "critical_5pct": UNIT_ROOT_5PCT, "lags": lags}


def seasonal_forecast(df: DataFrame, x: str, fit_until: int, judge: tuple[int, int]) -> DataFrame:
    """Predict the mean of the day of year over the fitting years, for the judged years."""
    year = F.year("day")
    mean = df.filter(year <= fit_until).groupBy(F.dayofyear("day").alias("doy")).agg(F.avg(x).alias("predicted"))
    judged = df.filter(year.between(*judge)).withColumn("doy", F.dayofyear("day"))
    return judged.join(mean, "doy").select("day", F.col(x).alias("actual"), "predicted")


ARX_VARIANTS = {"ar + harmonics + weather": (True, True), "ar + harmonics": (True, False), "ar": (False, False)}


def arx_forecasts(df: DataFrame, x: str, fit_until: int, judge: tuple[int, int], order: int = 2) -> DataFrame:
    """One-step autoregressions with and without harmonics and weather: (model, day, actual, predicted).

    The lagged values come from equi-joins on the day, so the series is never ordered in one task.
    """
    base = fourier(df)
    for k in range(1, order + 1):
        shifted = df.select(F.date_add("day", k).alias("day"), F.col(x).alias(f"lag{k}"))
        base = base.join(shifted, "day")
    year = F.year("day")
    parts = []
    for name, (season, weather) in ARX_VARIANTS.items():
        features = [f"lag{k}" for k in range(1, order + 1)]
        features += harmonic_names() if season else []
        features += ["fwi", "danger_share"] if weather else []
        vector, model = least_squares(base.filter(year <= fit_until), features, x)
        judged = model.transform(vector.transform(base.filter(year.between(*judge))))
        positive = F.greatest(F.col("prediction"), F.lit(0.0)).alias("predicted")
        parts.append(judged.select(F.lit(name).alias("model"), "day", F.col(x).alias("actual"), positive))
    return reduce(DataFrame.unionByName, parts)
