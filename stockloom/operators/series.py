"""Row-ordered work on series that may be longer than one task can hold.

A plain window over ``partitionBy(product)`` sends a whole series to one task. Here a series is
cut into chunks of consecutive rows with the help of row counts per month, and the last rows before a
chunk are copied into it, so that lags and bounded frames see the same rows as in the uncut series.
A window group is thus bounded by the chunk length plus some months, however many rows one
product has. The rows are shuffled once where the months' counts are small enough for Spark to broadcast them, else also to meet these.
Where a month of one series may itself be too long for a task, ``number_dense`` numbers the rows by ranges instead, and ``cut``
cuts them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from stockloom.session import scratch_path

SERIES = ("product_id",)
CHUNK_ROWS = 8192


def _bucketed(df: DataFrame, order: Sequence[str], bucket: Column | None) -> DataFrame:
    return df.withColumn("_bucket", F.trunc(F.col(order[0]), "month") if bucket is None else bucket)


def _offsets(bucketed: DataFrame, series: Sequence[str], order: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """Per series and bucket: ``_rows``, the rows ``_before`` it, ``series_rows``, and the value of
    each ``first`` column in the first row of the series."""
    group = [*series, "_bucket"]
    # Grouping by the wanted columns as well keeps this a hash aggregate; little is left to be merged.
    sizes = bucketed.groupBy(*group, *first).agg(F.count(F.lit(1)).alias("_rows"), F.min(order[0]).alias("_start"))
    if first:
        sizes = sizes.groupBy(*group).agg(
            F.sum("_rows").alias("_rows"),
            *[F.min_by(c, F.struct("_start", c)).alias(f"first_{c}") for c in first],
        )
    whole = Window.partitionBy(*series)
    by_bucket = whole.orderBy("_bucket")
    return sizes.select(
        *group, "_rows",
        F.coalesce(F.sum("_rows").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("series_rows"),
        *[F.first(f"first_{c}").over(by_bucket).alias(f"first_{c}") for c in first],
    )


def number_rows(
    df: DataFrame, series: Sequence[str] = SERIES, order: Sequence[str] = ("date",), bucket: Column | None = None
) -> DataFrame:
    """Add ``row_no`` (1-based, by ``order``) and ``series_rows`` to each row of its series.

    ``bucket`` is any column that never falls as ``order`` grows (default: month of the first
    order column); the rows of one series and bucket are what one task sorts.
    Series and order columns must not be null.
    """
    bucketed = _bucketed(df, order, bucket)
    group = [*series, "_bucket"]
    local = Window.partitionBy(*group).orderBy(*order)
    return (
        bucketed.join(_offsets(bucketed, series, order).drop("_rows"), group)
        .withColumn("row_no", F.col("_before") + F.row_number().over(local))
        .drop("_bucket", "_before")
    )


def _check(halo: int, chunk_rows: int) -> None:
    if chunk_rows < halo:
        raise ValueError("a chunk must be at least as long as the halo")


def number_and_cut(
    df: DataFrame,
    halo: int,
    series: Sequence[str] = SERIES,
    order: Sequence[str] = ("date",),
    chunk_rows: int = CHUNK_ROWS,
    bucket: Column | None = None,
    first: Sequence[str] = (),
) -> DataFrame:
    """Number the rows of each series and cut it into chunks.

    Adds ``row_no``, ``series_rows``, ``chunk``, ``is_halo`` and ``first_<c>``, the value of each ``first``
    column in the first row of the series. A chunk is made of whole buckets (see ``number_rows``);
    buckets with any of the ``halo`` rows before a chunk also go to it, marked ``is_halo``.
    """
    _check(halo, chunk_rows)
    bucketed = _bucketed(df, order, bucket)
    group = [*series, "_bucket"]
    offsets = _offsets(bucketed, series, order, first).withColumn("_home", F.expr(f"_before div {int(chunk_rows)}"))

    # Where the next two chunks start: later ones are more than a chunk, and so the halo, away.
    following = Window.partitionBy(*series).orderBy("_home")
    starts = offsets.groupBy(*series, "_home").agg(F.min("_before").alias("_at")).select(
        *series, "_home",
        *[F.lead(F.struct("_home", "_at"), n).over(following).alias(f"_next_{n}") for n in (1, 2)],
    )
    end = F.col("_before") + F.col("_rows")
    nearby = [
        F.when(F.col(f"_next_{n}._at") - halo < end, F.col(f"_next_{n}._home")) for n in (1, 2)
    ]
    places = offsets.join(starts, [*series, "_home"]).select(
        *group, "_home", "_before", "series_rows", *[f"first_{c}" for c in first],
        F.array_compact(F.array("_home", *nearby)).alias("_chunks"),
    )
    placed = (
        bucketed.join(places, group)
        .withColumn("chunk", F.explode("_chunks"))
        .withColumn("is_halo", F.col("chunk") != F.col("_home"))
        .drop("_chunks", "_home", "_bucket")
    )
    local = Window.partitionBy(*series, "chunk").orderBy(*order)
    return placed.withColumn("row_no", F.first("_before").over(local) + F.row_number().over(local)).drop("_before")


def number_dense(
    df: DataFrame, series: Sequence[str] = SERIES, order: Sequence[str] = ("date",), first: Sequence[str] = ()
) -> DataFrame:
    """Number the rows of each series, however many of them share a month, a day or any other bucket.

    Gives the columns of ``number_rows`` and ``first_<c>``, as in ``number_and_cut``. The rows are dealt into ranges of (series, order),
    sorted there and written to the shared folder with their places; a hot series, or a hot month of one, is simply cut into more
    ranges. A second pass over the series columns and places counts each range's rows by series, a few rows per range, and running sums of
    these give each range its first number. Rows that agree in series and order can't be told apart by a range: name a second
    order column where many do. Written when called; series and order columns must not be null.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "dense")
    ranged = df.repartitionByRange(*series, *order).sortWithinPartitions(*series, *order)
    # the places of a partition's rows are consecutive, from its number times 2 ** 33 on
    placed = ranged.withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path).withColumn("_range", F.shiftright("_at", 33))
    runs = rows.groupBy(*series, "_range").agg(
        F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_rows"), *[F.min_by(c, "_at").alias(f"first_{c}") for c in first])
    whole = Window.partitionBy(*series)
    by_range = whole.orderBy("_range")
    offsets = runs.select(
        *series, "_range", "_from",
        F.coalesce(F.sum("_rows").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("series_rows"),
        *[F.first(f"first_{c}").over(by_range).alias(f"first_{c}") for c in first],
    )
    return rows.join(offsets, [*series, "_range"]).withColumn(
        "row_no", F.col("_before") + F.col("_at") - F.col("_from") + 1).drop("_before", "_at", "_from", "_range")


def cut(df: DataFrame, halo: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Cut numbered series into chunks of ``chunk_rows`` rows; adds ``chunk`` and ``is_halo``.

    The last ``halo`` rows of a chunk also appear in the next one, marked ``is_halo``.
    """
    _check(halo, chunk_rows)
    home = F.expr(f"(row_no - 1) div {int(chunk_rows)}")
    left = (home + 1) * chunk_rows - F.col("row_no")
    goes_on = (left < halo) & ((home + 1) * chunk_rows < F.col("series_rows"))
    places = F.sequence(home, home + goes_on.cast("int"))
    return df.withColumn("chunk", F.explode(places)).withColumn("is_halo", F.col("chunk") != home)


def chunk_order(series: Sequence[str] = SERIES, order: Sequence[str] = ("row_no",)) -> WindowSpec:
    """The one window all frames of a cut series share."""
    return Window.partitionBy(*series, "chunk").orderBy(*order)


def uncut(df: DataFrame) -> DataFrame:
    """Drop the copied rows again."""
    return df.filter(~F.col("is_halo")).drop("chunk", "is_halo")
