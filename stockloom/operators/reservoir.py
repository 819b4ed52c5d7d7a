"""Nonlinear sequence forecaster: a fixed recurrent reservoir over the past days, read out by a ridge regression per series.

A reservoir is a small recurrent net whose weights are drawn once from a seed and never trained. It runs over the 30 scaled days
before a day; its last state, the last day's features and a constant are the inputs of the regression, which is fitted for all series at
once from sums of products (``regression.fit``). So a model is one short row of coefficients per series, and the
recurrent part is the same numpy code for a batch of windows in any task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stockloom import rules
from stockloom.operators.features import is_train, sequences, unscaled, vector
from stockloom.operators.series import CHUNK_ROWS, SERIES

UNITS, SEED = 32, 7
#: Largest eigenvalue of the recurrent weights, range of the input weights, and how much of a state is replaced each day.
RADIUS, INPUT_RANGE, LEAK = 0.8, 0.5, 0.3


def drawn(units: int = UNITS, inputs: int = len(rules.FEATURES), seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weights between units, from inputs to units, and the units' offsets."""
    rng = np.random.default_rng(seed)
    between = rng.uniform(-1, 1, (units, units))
    between *= RADIUS / np.abs(np.linalg.eigvals(between)).max()
    return between, rng.uniform(-INPUT_RANGE, INPUT_RANGE, (inputs, units)), rng.uniform(-INPUT_RANGE, INPUT_RANGE, units)


def states(windows: np.ndarray, weights: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The state after each window (windows x days x inputs), from rest."""
    between, into, offset = weights
    state = np.zeros((len(windows), len(between)))
    for day in range(windows.shape[1]):
        state = (1 - LEAK) * state + LEAK * np.tanh(windows[:, day] @ into + state @ between + offset)
    return state


def reservoir_rows(
    scaled_rows: DataFrame, series: Sequence[str] = SERIES, length: int = rules.WINDOW_ROWS, units: int = UNITS, seed: int = SEED,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Inputs ``x`` and scaled target ``y`` of each predictable day, as ``regression.fit`` and ``test_predictions`` take them."""
    width, weights = len(rules.FEATURES), drawn(units, seed=seed)

    @F.pandas_udf("array<double>")
    def state(past: pd.Series) -> pd.Series:
        return pd.Series(list(states(np.stack(past.to_numpy()).reshape(-1, length, width), weights)) if len(past) else [])

    rows = sequences(scaled_rows, series, length, chunk_rows=chunk_rows)
    inputs = F.concat(state(F.flatten("x")), F.element_at("x", -1), F.array(F.lit(1.0)))
    return rows.withColumn("x", inputs).withColumn("is_train", is_train("seq_no", "seq_rows"))


def roll_out(
    scaled_rows: DataFrame, weights: DataFrame, horizon: int = 30, series: Sequence[str] = SERIES, length: int = rules.WINDOW_ROWS,
    units: int = UNITS, seed: int = SEED,
) -> DataFrame:
    """Forecast day by day, feeding each forecast back in; the other features stay as on the last day. Series shorter than a
    window have no forecast."""
    width, reservoir = len(rules.FEATURES), drawn(units, seed=seed)
    ends = (
        scaled_rows.filter((F.col("frame_no") > F.col("frame_rows") - length) & (F.col("frame_rows") >= length))
        .groupBy(*series)
        .agg(
            F.array_sort(F.collect_list(F.struct("frame_no", vector(scaled_rows).alias("v")))).alias("_last"),
            F.max("date").alias("last_date"),
            F.first("target_min").alias("target_min"),
            F.first("target_max").alias("target_max"),
        )
    )

    @F.pandas_udf("array<double>")
    def steps(last: pd.Series, weight: pd.Series) -> pd.Series:
        if not len(last):
            return pd.Series([])
        past, w = np.stack(last.to_numpy()).reshape(-1, length, width), np.stack(weight.to_numpy())
        out = np.empty((len(past), horizon))
        for day in range(horizon):
            inputs = np.column_stack([states(past, reservoir), past[:, -1], np.ones(len(past))])
            out[:, day] = (inputs * w).sum(axis=1)
            following = past[:, -1:].copy()
            following[:, 0, 0] = out[:, day]
            past = np.concatenate([past[:, 1:], following], axis=1)
        return pd.Series(list(out))

    return (
        ends.join(weights, list(series))
        .withColumn("_steps", steps(F.flatten("_last.v"), "weights"))
        .select(*series, "last_date", "target_min", "target_max", F.posexplode("_steps").alias("_day", "_value"))
        .select(
            *series,
            (F.col("_day") + 1).alias("day_no"),
            F.date_add("last_date", F.col("_day") + 1).alias("date"),
            F.greatest(unscaled(F.col("_value")), F.lit(0.0)).cast("long").alias("quantity"),
        )
    )
