"""Autoregressive forecaster: one ridge regression per series, fitted on all series at once.

Inputs of a day are the 30 scaled quantities before it and the other scaled features of the day
before. Fitting needs only sums of products over the training rows: tasks sum up the rows they
hold, Spark adds the partial sums up, and one small linear system per series is left.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stockloom import rules
from stockloom.operators.features import is_train, unscaled, vector
from stockloom.operators.series import CHUNK_ROWS, SERIES, chunk_order, cut, uncut

RIDGE = 1.0


def regression_rows(
    scaled_rows: DataFrame,
    series: Sequence[str] = SERIES,
    lags: int = rules.WINDOW_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Inputs ``x`` (ending in a constant 1) and scaled target ``y`` of each predictable day."""
    target, others = rules.FEATURES[0], rules.FEATURES[1:]
    rows = scaled_rows.select(
        *series, "date",
        F.col("frame_no").alias("row_no"), F.col("frame_rows").alias("series_rows"),
        "target_min", "target_max",
        F.col(target).alias("y"), vector(scaled_rows, others).alias("_others"),
    )
    order = chunk_order(series)
    windows = cut(rows, lags, chunk_rows).withColumns({
        "_lags": F.collect_list("y").over(order.rowsBetween(-lags, -1)),
        "_before": F.lag("_others").over(order),
    })
    return (
        uncut(windows)
        .filter(F.col("row_no") > lags)
        .select(
            *series, "date", "target_min", "target_max", "y",
            F.concat("_lags", "_before", F.array(F.lit(1.0))).alias("x"),
            (F.col("row_no") - lags).alias("seq_no"), (F.col("series_rows") - lags).alias("seq_rows"),
        )
        .withColumn("is_train", is_train("seq_no", "seq_rows"))
    )


def product_sums(rows: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Sums over the rows of all products of two of (x, y), per series: ``pos`` and ``value``.

    ``pos`` numbers the upper triangle of the square matrix row by row. A task holds the sums of one
    series at a time, and adding up is left to a hash aggregate, so no series needs to fit anywhere.
    """
    keys = list(series)
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, total = None, None

        def row():
            upper = np.triu_indices(total.shape[0])
            return pd.DataFrame([[*current, total[upper]]], columns=[*keys, "sums"])

        for batch in batches:
            for key, group in batch.groupby(keys, sort=False):
                z = np.column_stack([np.stack(group["x"].to_numpy()), group["y"].to_numpy()])
                if key != current:
                    if current is not None:
                        yield row()
                    current, total = key, np.zeros((z.shape[1], z.shape[1]))
                total += z.T @ z
        if current is not None:
            yield row()

    partial = rows.select(*keys, "x", "y").mapInPandas(sum_up, schema)
    return (
        partial.select(*keys, F.posexplode("sums").alias("pos", "value"))
        .groupBy(*keys, "pos")
        .agg(F.sum("value").alias("value"))
    )


def fit(rows: DataFrame, series: Sequence[str] = SERIES, ridge: float = RIDGE) -> DataFrame:
    """Coefficients ``weights`` per series from the training rows; the constant is not shrunk."""

    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series) -> pd.Series:
        packed = np.stack(sums.to_numpy())
        size = int((np.sqrt(8 * packed.shape[1] + 1) - 1) / 2)
        square = np.zeros((len(packed), size, size))
        upper = np.triu_indices(size)
        square[:, upper[0], upper[1]] = packed
        square[:, upper[1], upper[0]] = packed
        shrink = np.full(size - 1, ridge)
        shrink[-1] = 1e-9
        left = square[:, :-1, :-1] + np.diag(shrink)
        return pd.Series(list(np.linalg.solve(left, square[:, :-1, -1:])[:, :, 0]))

    sums = product_sums(rows.filter("is_train"), series)
    # The list has one entry per pair of inputs, whatever the length of the series.
    packed = sums.groupBy(*series).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_sums"))
    return packed.select(*series, solve(F.col("_sums.value")).alias("weights"))


def predict(rows: DataFrame, weights: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Add ``y_pred``, still scaled."""
    products = F.zip_with("x", "weights", lambda a, b: a * b)
    return rows.join(weights, list(series)).withColumn(
        "y_pred", F.aggregate(products, F.lit(0.0), lambda total, v: total + v)
    ).drop("weights")


def test_predictions(rows: DataFrame, weights: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Actual and predicted units over the test rows."""
    train = F.floor(F.col("seq_rows").cast("double") * F.lit(rules.TRAIN_SHARE))
    return predict(rows.filter(~F.col("is_train")), weights, series).select(
        *series, "date",
        (F.col("seq_no") - train).alias("step"), (F.col("seq_rows") - train).alias("steps"),
        unscaled(F.col("y")).alias("y"), unscaled(F.col("y_pred")).alias("y_pred"),
    )


def roll_out(
    scaled_rows: DataFrame,
    weights: DataFrame,
    horizon: int = 30,
    series: Sequence[str] = SERIES,
    lags: int = rules.WINDOW_ROWS,
) -> DataFrame:
    """Forecast day by day, feeding each forecast back in; the other features stay as on the last day."""
    target, others = rules.FEATURES[0], rules.FEATURES[1:]
    ends = (
        scaled_rows.filter((F.col("frame_no") > F.col("frame_rows") - lags) & (F.col("frame_rows") >= lags))
        .groupBy(*series)
        .agg(
            F.array_sort(F.collect_list(F.struct("frame_no", F.col(target).alias("v")))).alias("_last"),
            F.max_by(vector(scaled_rows, others), "frame_no").alias("_others"),
            F.max("date").alias("last_date"),
            F.first("target_min").alias("target_min"),
            F.first("target_max").alias("target_max"),
        )
    )

    @F.pandas_udf("array<double>")
    def steps(last: pd.Series, other: pd.Series, weight: pd.Series) -> pd.Series:
        past, rest, w = (np.stack(c.to_numpy()) for c in (last, other, weight))
        fixed = (rest * w[:, lags:-1]).sum(axis=1) + w[:, -1]
        out = np.empty((len(past), horizon))
        for day in range(horizon):
            out[:, day] = (past * w[:, :lags]).sum(axis=1) + fixed
            past = np.column_stack([past[:, 1:], out[:, day]])
        return pd.Series(list(out))

    return (
        ends.join(weights, list(series))
        .withColumn("_steps", steps(F.col("_last.v"), "_others", "weights"))
        .select(*series, "last_date", "target_min", "target_max", F.posexplode("_steps").alias("_day", "_value"))
        .select(
            *series,
            (F.col("_day") + 1).alias("day_no"),
            F.date_add("last_date", F.col("_day") + 1).alias("date"),
            F.greatest(unscaled(F.col("_value")), F.lit(0.0)).cast("long").alias("quantity"),
        )
    )


def save_weights(weights: DataFrame, path: str) -> None:
    weights.write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    """Stored coefficients; Spark's path error if nothing was trained yet."""
    return spark.read.parquet(path)
