"""Feature frame, scaling, train/test split and 30-row sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stockloom import rules
from stockloom.functions import calendar
from stockloom.operators.series import CHUNK_ROWS, SERIES, chunk_order, cut, number_and_cut, number_dense, uncut
from stockloom.sources.sales import YEAR, dated

LAGS = (1, 7, 30)
WARM_UP = max(LAGS)


def with_calendar(dated_rows: DataFrame) -> DataFrame:
    return dated_rows.withColumns({**calendar.calendar_columns("date"), **calendar.season_columns("date")})


def base_features(sales: DataFrame) -> DataFrame:
    """Calendar and season features; season and festival flag are recomputed from the date."""
    return with_calendar(dated(sales))


def series_features(
    sales: DataFrame,
    series: Sequence[str] = SERIES,
    order: Sequence[str] = ("date",),
    keep_warm_up: bool = False,
    shifted: bool = False,
    chunk_rows: int = CHUNK_ROWS,
    dense: bool = False,
) -> DataFrame:
    """The feature frame of all series.

    Lags and rolling figures count rows, not days, and see the full series; the first rows, which lack lags, are dropped
    afterwards. A null quantity gives null lags and stays out of the rolling figures; its row is kept and numbered. The rolling figures include the row itself unless ``shifted``. The peak
    season goes by the category of the first row of the series. ``frame_no`` and ``frame_rows`` number
    the rows that are kept. All that follows from the date is added after the shuffle. ``dense`` is for series whose months are
    too long for one task; it writes the sorted rows when called (``series.number_dense``).
    """
    first, halo = ("category",) if "category" in sales.columns else (), WARM_UP + int(shifted)
    if dense:
        rows, order = cut(number_dense(dated(sales), series, order, first), halo, chunk_rows), ("row_no",)
    else:
        rows = number_and_cut(dated(sales), halo, series, order, chunk_rows, first=first)
    by = chunk_order(series, order)
    end = -1 if shifted else 0
    quantity = F.col("quantity_sold")
    week, month = by.rowsBetween(end - 6, end), by.rowsBetween(end - 29, end)
    framed = uncut(rows.withColumns({
        **{f"lag_{n}": F.lag(quantity, n).over(by) for n in LAGS},
        "rolling_mean_7": F.avg(quantity).over(week),
        "rolling_mean_30": F.avg(quantity).over(month),
        "rolling_std_7": F.coalesce(F.stddev_samp(quantity).over(week), F.lit(0.0)),
    }))
    if not keep_warm_up:
        framed = framed.filter(F.col("row_no") > WARM_UP)
    return with_calendar(framed).withColumns({
        "is_peak_disease_season": calendar.peak_season_flag("season", "first_category" if first else "'unknown'"),
        "frame_no": F.col("row_no") - WARM_UP,
        "frame_rows": F.col("series_rows") - WARM_UP,
    }).drop("first_category")


def vector(df: DataFrame, columns: Sequence[str] = rules.FEATURES):
    """The columns as one array of doubles in the given order; a missing column counts as 0."""
    return F.array(*[F.col(c).cast("double") if c in df.columns else F.lit(0.0) for c in columns])


def feature_vectors(features: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    return features.select(*series, "date", vector(features).alias("features"))


def tabular(features: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """The 16 inputs (no target) and the target, for row-wise regressors."""
    return features.select(
        *series, "date", "frame_no", "frame_rows",
        vector(features, rules.TABULAR_FEATURES).alias("x"),
        F.col("quantity_sold").cast("double").alias("y"),
    )


def is_train(position: str = "frame_no", total: str = "frame_rows", share: float = rules.TRAIN_SHARE):
    """True for the first ``share`` of a series: no shuffling, the test rows come last."""
    return F.col(position) <= F.floor(F.col(total).cast("double") * F.lit(share))


def moving_averages(features: DataFrame, series: Sequence[str] = SERIES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """7- and 30-row moving averages of the feature rows, null until a full frame is there."""
    rows = features.select(
        *series, "date", "quantity_sold",
        F.col("frame_no").alias("row_no"), F.col("frame_rows").alias("series_rows"),
    )
    order = chunk_order(series)

    def full_mean(n: int):
        return F.when(F.col("row_no") >= n, F.avg("quantity_sold").over(order.rowsBetween(1 - n, 0)))

    return uncut(cut(rows, 29, chunk_rows).withColumns({"ma_7": full_mean(7), "ma_30": full_mean(30)})).drop(
        "row_no", "series_rows"
    )


def last_rows(
    sales: DataFrame, rows: int, series: Sequence[str] = SERIES, months: DataFrame | None = None
) -> DataFrame:
    """The last ``rows`` rows of each series' feature frame: date, quantity and numbers, without lags.

    Row counts per month tell which months hold these rows. Only those months are joined, shuffled and numbered, from the end. The
    counts are ``months`` (``sales.month_counts`` of the stored table) or else a scan of narrow columns, combined before the
    shuffle. If ``sales`` has the ``year`` it is stored under, the folders of years before the first such month aren't read.
    """
    stored = YEAR in sales.columns
    year = [YEAR] if stored else []
    bucketed = dated(sales).select(*series, "date", "quantity_sold", *year).withColumn("_month", F.trunc("date", "month"))
    if months is None:
        sizes = bucketed.groupBy(*series, "_month").agg(F.count(F.lit(1)).alias("_rows"))
    else:
        sizes = months.groupBy(*series, F.col("month").alias("_month")).agg(F.sum("rows").alias("_rows"))
    whole = Window.partitionBy(*series)
    later = whole.orderBy(F.desc("_month")).rowsBetween(Window.unboundedPreceding, -1)
    wanted = sizes.select(
        *series, "_month", F.sum("_rows").over(whole).alias("series_rows"),
        F.coalesce(F.sum("_rows").over(later), F.lit(0)).alias("_after"),
    ).filter(F.col("_after") < rows)
    if stored:
        bucketed = bucketed.filter(F.col(YEAR) >= wanted.agg(F.min(F.year("_month"))).scalar())
    local = Window.partitionBy(*series, "_month").orderBy(F.desc("date"))
    numbered = bucketed.join(wanted, [*series, "_month"]).withColumn("_from_end", F.col("_after") + F.row_number().over(local))
    return numbered.filter(F.col("_from_end") <= rows).select(
        *series, "date", "quantity_sold",
        (F.col("series_rows") + 1 - F.col("_from_end") - WARM_UP).alias("frame_no"),
        (F.col("series_rows") - WARM_UP).alias("frame_rows"),
    ).filter("frame_no > 0")


def history(features: DataFrame, rows: int, series: Sequence[str] = SERIES) -> DataFrame:
    """The last ``rows`` feature rows of each series."""
    return features.filter(F.col("frame_no") > F.col("frame_rows") - rows).select(*series, "date", "quantity_sold")


# --- scaling -------------------------------------------------------------------------------


def scaler_params(features: DataFrame, series: Sequence[str] = SERIES, columns: Sequence[str] = rules.FEATURES) -> DataFrame:
    """Lowest and highest value of each feature per series, one row per series."""
    return features.groupBy(*series).agg(
        *[F.min(F.col(c).cast("double")).alias(f"{c}__min") for c in columns],
        *[F.max(F.col(c).cast("double")).alias(f"{c}__max") for c in columns],
    )


def scaler_table(params: DataFrame, series: Sequence[str] = SERIES, columns: Sequence[str] = rules.FEATURES) -> DataFrame:
    """Scaler parameters in long form: one row per series and feature."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"))
        for c in columns
    ])
    return params.select(*series, F.inline(entries))


def scaler_from_table(table: DataFrame, series: Sequence[str] = SERIES, columns: Sequence[str] = rules.FEATURES) -> DataFrame:
    """The wide form of stored scaler parameters."""
    def pick(feature: str, bound: str):
        return F.max(F.when(F.col("feature") == feature, F.col(bound))).alias(f"{feature}__{bound}")

    return table.groupBy(*series).agg(*[pick(c, b) for b in ("min", "max") for c in columns])


def scaled_value(column: str):
    """(x - min) / (max - min); a constant feature becomes 0."""
    low, high = F.col(f"{column}__min"), F.col(f"{column}__max")
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return (F.col(column).cast("double") - low) / span


def scaled(
    features: DataFrame,
    params: DataFrame | None = None,
    series: Sequence[str] = SERIES,
    columns: Sequence[str] = rules.FEATURES,
) -> DataFrame:
    """Feature frame with the features scaled per series to 0..1.

    The parameters are those of the whole series unless given. Bounds of the target stay as
    ``target_min`` and ``target_max``, for scaling back.
    """
    params = scaler_params(features, series, columns) if params is None else params
    keep = [c for c in features.columns if c not in columns]
    target = columns[0]
    return features.join(params, list(series)).select(
        *keep,
        *[scaled_value(c).alias(c) for c in columns],
        F.col(f"{target}__min").alias("target_min"),
        F.col(f"{target}__max").alias("target_max"),
    )


def unscaled(value, low="target_min", high="target_max"):
    """A scaled target value in units again."""
    low, high = F.col(low), F.col(high)
    return value * F.when(high == low, F.lit(1.0)).otherwise(high - low) + low


# --- sequences -----------------------------------------------------------------------------


def sequences(
    scaled_rows: DataFrame,
    series: Sequence[str] = SERIES,
    length: int = rules.WINDOW_ROWS,
    columns: Sequence[str] = rules.FEATURES,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per predictable day: ``x`` holds the ``length`` scaled rows before it, ``y`` its target.

    ``seq_no`` and ``seq_rows`` number the sequences of a series.
    """
    rows = scaled_rows.select(
        *series, "date",
        F.col("frame_no").alias("row_no"), F.col("frame_rows").alias("series_rows"),
        "target_min", "target_max",
        vector(scaled_rows, columns).alias("_row"), F.col(columns[0]).alias("y"),
    )
    before = chunk_order(series).rowsBetween(-length, -1)
    windows = cut(rows, length, chunk_rows).withColumn("x", F.collect_list("_row").over(before))
    return (
        uncut(windows)
        .filter(F.col("row_no") > length)
        .select(
            *series, "date", "x", "y", "target_min", "target_max",
            (F.col("row_no") - length).alias("seq_no"), (F.col("series_rows") - length).alias("seq_rows"),
        )
    )


def training_set(features: DataFrame, series: Sequence[str] = SERIES, length: int = rules.WINDOW_ROWS) -> DataFrame:
    """Features to sequences: scaling, sequences, train flag. Reads ``features`` twice."""
    rows = sequences(scaled(features, series=series), series, length)
    return rows.withColumn("is_train", is_train("seq_no", "seq_rows"))
