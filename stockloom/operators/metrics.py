"""Forecast accuracy per series and model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stockloom.functions.numeric import half_even
from stockloom.operators.series import CHUNK_ROWS, SERIES, chunk_order, cut, uncut


def forecast_metrics(
    predictions: DataFrame, series: Sequence[str] = SERIES, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """MAE, RMSE, MAPE and directional accuracy of ``y_pred`` against ``y``.

    ``step`` counts the rows of a series from 1 to ``steps``. MAPE leaves out zero actuals; it is null
    if all are zero, as is the directional accuracy of a single row.
    """
    keys = [*series, "model"] if "model" in predictions.columns else list(series)
    rows = predictions.select(
        *keys, F.col("step").alias("row_no"), F.col("steps").alias("series_rows"), "y", "y_pred"
    )
    order = chunk_order(keys)
    y, p = F.col("y"), F.col("y_pred")
    moves = uncut(cut(rows, 1, chunk_rows).withColumns({
        "_y_move": F.signum(y - F.lag("y").over(order)),
        "_p_move": F.signum(p - F.lag("y_pred").over(order)),
    }))
    return moves.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("test_samples"),
        half_even(F.avg(F.abs(y - p)), 4).alias("mae"),
        half_even(F.sqrt(F.avg((y - p) * (y - p))), 4).alias("rmse"),
        half_even(F.avg(F.when(y != 0, F.abs((y - p) / F.nullif(y, F.lit(0.0))))) * 100, 2).alias("mape"),
        half_even(F.avg((F.col("_y_move") == F.col("_p_move")).cast("double")) * 100, 2).alias("directional_accuracy"),
    )
