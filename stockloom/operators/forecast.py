"""Trend forecasts from the last rows of each series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from stockloom import rules
from stockloom.functions.numeric import whole
from stockloom.operators.series import SERIES


def recent_trend(features: DataFrame, series: Sequence[str] = SERIES, rows: int = rules.WINDOW_ROWS) -> DataFrame:
    """Mean, least-squares slope and population deviation of the last ``rows`` rows per series.

    The sums are whole numbers, so the figures do not depend on the order of addition.
    """
    last = features.filter(F.col("frame_no") > F.col("frame_rows") - rows)
    y = F.col("quantity_sold").cast("long")
    x = F.col("frame_no") - F.greatest(F.col("frame_rows") - rows, F.lit(0).cast("long")) - 1
    sums = last.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"),
        F.max("date").alias("last_date"),
    )
    n, sx, sy, sxy, sxx, syy = (F.col(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy"))
    slope = F.when(n < 2, F.lit(0.0)).otherwise(
        (n * sxy - sx * sy).cast("double") / F.nullif(n * sxx - sx * sx, F.lit(0)).cast("double")
    )
    return sums.select(
        *series, "last_date",
        (sy.cast("double") / n.cast("double")).alias("mean"),
        slope.alias("slope"),
        (F.sqrt((n * syy - sy * sy).cast("double")) / n.cast("double")).alias("deviation"),
    )


def _grid(trend: DataFrame, horizon: int) -> DataFrame:
    return trend.withColumn("day_no", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "date", F.date_add("last_date", F.col("day_no"))
    )


def _units(value: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), whole(value))


def _line(day: Column) -> Column:
    return F.col("mean") + F.col("slope") * (day - 1)


def forecast_days(trend: DataFrame, horizon: int, series: Sequence[str] = SERIES) -> DataFrame:
    """One row per series and coming day: the mean plus the slope per day ahead, at least 1 unit."""
    return _grid(trend, horizon).select(*series, "day_no", "date", _units(_line(F.col("day_no"))).alias("quantity"))


def noise(horizon: int, seed: int = 42) -> list[float]:
    """Standard normal values of a fixed seed; every series gets the same ones."""
    return np.random.RandomState(seed).standard_normal(horizon).tolist()


def noisy_forecast_days(trend: DataFrame, horizon: int, series: Sequence[str] = SERIES, seed: int = 42) -> DataFrame:
    """The trend forecast with seeded noise of 0.3 deviations."""
    day = F.col("day_no")
    value = _units(_line(day) + _jitter(horizon, seed, day))
    return _grid(trend, horizon).select(*series, "day_no", "date", value.alias("quantity"))


def with_band(days: DataFrame, share: float = rules.BAND_SHARE) -> DataFrame:
    return days.withColumns({
        "upper": F.col("quantity") * F.lit(1.0 + share), "lower": F.col("quantity") * F.lit(1.0 - share),
    })


def _jitter(horizon: int, seed: int, day: Column) -> Column:
    draws = F.array(*[F.lit(z) for z in noise(horizon, seed)])
    return F.col("deviation") * F.lit(rules.NOISE_SHARE) * F.element_at(draws, day.cast("int"))


def with_total(trend: DataFrame, horizon: int) -> DataFrame:
    """Add ``predicted_demand``, the trend forecast summed over ``horizon`` days.

    The days are summed inside the row of the series: neither a join nor a shuffle is needed.
    """
    days = F.sequence(F.lit(1), F.lit(horizon))
    total = F.aggregate(days, F.lit(0).cast("long"), lambda sum_, day: sum_ + _units(_line(day)))
    return trend.withColumn("predicted_demand", total)


def with_horizon_totals(
    trend: DataFrame, horizons: Sequence[int] = rules.HORIZONS, noisy: bool = True, seed: int = 42
) -> DataFrame:
    """One row per series and horizon with the total and the mean of the (noisy) forecast."""
    longest = max(horizons)

    def value(day: Column) -> Column:
        line = _line(day)
        return _units(line + _jitter(longest, seed, day)) if noisy else _units(line)

    total = F.aggregate(F.sequence(F.lit(1), F.col("horizon")), F.lit(0).cast("long"), lambda sum_, day: sum_ + value(day))
    return (
        trend.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
        .withColumn("predicted_demand", total)
        .withColumn("avg_forecast", F.col("predicted_demand") / F.col("horizon"))
    )


def naive_forecast(features: DataFrame, series: Sequence[str] = SERIES, share: float = rules.TRAIN_SHARE) -> DataFrame:
    """The last training value, repeated over the test rows."""
    split = F.floor(F.col("frame_rows").cast("double") * F.lit(share))
    last = features.filter(F.col("frame_no") == split).select(*series, F.col("quantity_sold").cast("double").alias("y_pred"))
    return (
        features.filter(F.col("frame_no") > split)
        .join(last, list(series))
        .select(
            *series, "date",
            (F.col("frame_no") - split).alias("step"), (F.col("frame_rows") - split).alias("steps"),
            F.col("quantity_sold").cast("double").alias("y"), "y_pred",
        )
    )
