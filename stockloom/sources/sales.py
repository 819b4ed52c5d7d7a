"""The sales fact: one row per product and day."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stockloom.session import scratch_path
from stockloom.sources import files

SALES_SCHEMA = T.StructType([
    T.StructField("date", T.StringType(), False),
    T.StructField("store_id", T.StringType()),
    T.StructField("product_id", T.StringType(), False),
    T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("season", T.StringType()),
    T.StructField("quantity_sold", T.IntegerType(), False),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("revenue", T.DoubleType()),
    T.StructField("current_stock", T.IntegerType()),
    T.StructField("lead_time_days", T.IntegerType()),
    T.StructField("expiry_risk", T.IntegerType()),
    T.StructField("is_festival_month", T.IntegerType()),
])
SALES_COLUMNS = SALES_SCHEMA.fieldNames()
#: What a row is about, and the folder it is stored in.
KEY, YEAR = ("store_id", "product_id", "date"), "year"


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read sales from CSV files with a header; the schema is fixed, nothing is inferred."""
    return spark.read.schema(SALES_SCHEMA).csv(path, header=True, enforceSchema=False, mode="FAILFAST")


def by_year(spark: SparkSession, path: str) -> DataFrame:
    """The stored sales table with the ``year`` its files lie under: a filter on it skips the other years' folders."""
    return spark.read.schema(T.StructType([*SALES_SCHEMA, T.StructField(YEAR, T.IntegerType())])).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored sales table, or None if there is none."""
    try:
        return by_year(spark, path).select(*SALES_COLUMNS)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in (missing.getCondition() or ""):
            return None
        raise


def _required(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} is missing in a row of the sales"))).otherwise(F.col(name))


def _checked(rows: DataFrame) -> DataFrame:
    """The sales columns and the year; a row without date, product or quantity fails the job."""
    required = {f.name: _required(f.name) for f in SALES_SCHEMA if not f.nullable}
    return rows.select(*[required.get(c, F.col(c)).alias(c) for c in SALES_COLUMNS]).withColumn(
        YEAR, F.substring("date", 1, 4).cast("int"))


def _put(rows: DataFrame, path: str, **options) -> None:
    (
        rows.hint("rebalance", "product_id", YEAR)
        .sortWithinPartitions(YEAR, "product_id", "date")
        .write.mode("overwrite").options(**options).partitionBy(YEAR).parquet(path)
    )


def _months_path(path: str) -> str:
    return f"{path.rstrip('/')}.months"


def _put_months(rows: DataFrame, path: str, **options) -> None:
    counts = rows.groupBy(YEAR, "store_id", "product_id", F.trunc("date", "month").alias("month")).agg(F.count(F.lit(1)).alias("rows"))
    counts.write.mode("overwrite").options(**options).partitionBy(YEAR).parquet(_months_path(path))
    files.mark_complete(rows.sparkSession, _months_path(path))


def month_counts(spark: SparkSession, path: str) -> DataFrame:
    """``store_id, product_id, month, rows, year`` of a stored table, kept beside it."""
    return spark.read.schema("store_id string, product_id string, month date, rows long, year int").parquet(_months_path(path))


def load_table(spark: SparkSession, rows: DataFrame, path: str, force_reload: bool = False) -> DataFrame:
    """Store ``rows`` as the sales table unless a complete, non-empty one is there, and return the table.

    Rows lie in a folder per year, placed by product and sorted by product and date inside the files, so that filters on
    either skip folders or row groups; parts that grow too large, also of one product and year, are split. Row counts per store,
    product and month are kept beside it. A load that died half-way has left no success marker and is done again. A row without
    date, product or quantity fails the load.
    """
    complete = files.is_complete(spark, path) and files.is_complete(spark, _months_path(path))
    stored = None if force_reload or not complete else read_table(spark, path)
    if stored is None or stored.isEmpty():
        files.remove(spark, f"{_months_path(path)}/_SUCCESS")
        _put(_checked(rows), path, partitionOverwriteMode="static")
        _put_months(by_year(spark, path), path, partitionOverwriteMode="static")
    return read_table(spark, path)


def add_rows(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Add ``rows`` to the stored sales table and return the table.

    A row takes the place of what is stored for its store, product and date; rows of one call that agree in these are all kept, as
    in ``load_table``. Only the years that the rows touch are read and written again. What changes is written aside
    first: a row that lacks its date, product or quantity fails the call and leaves the table as it was. A call that dies while the
    folders are exchanged leaves the table without its success marker, and then it must be loaded again. One writer at a
    time; readers must start after it. No rows change nothing; a table that isn't there or is incomplete is an error.
    """
    if not (files.is_complete(spark, path) and files.is_complete(spark, _months_path(path))):
        raise ValueError(f"{path} holds no complete sales table: load it first")
    added = scratch_path(spark, "sales_added")
    _put(_checked(rows), added)
    new = by_year(spark, added)
    years = [r[YEAR] for r in new.select(YEAR).distinct().collect()]  # as many rows as years
    if not years:
        return read_table(spark, path)
    stored, fresh = by_year(spark, path).filter(F.col(YEAR).isin(years)), new.select(*KEY).distinct()
    same = [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in KEY]
    kept = stored.alias("old").join(fresh.alias("new"), same, "left_anti")
    merged = scratch_path(spark, "sales_merged")
    _put(kept.unionByName(new), merged)
    changed = by_year(spark, merged)
    files.remove(spark, f"{_months_path(path)}/_SUCCESS")
    files.remove(spark, f"{path}/_SUCCESS")
    _put(changed, path, partitionOverwriteMode="dynamic")
    _put_months(changed, path, partitionOverwriteMode="dynamic")
    files.mark_complete(spark, path)
    files.remove(spark, added)
    files.remove(spark, merged)
    return read_table(spark, path)


def dated(sales: DataFrame) -> DataFrame:
    """Sales with ``date`` as a real date."""
    return sales.withColumn("date", F.to_date("date"))


def with_revenue(sales: DataFrame) -> DataFrame:
    """Add revenue where the source has none; a missing price counts as 0."""
    if "revenue" in sales.columns:
        return sales
    price = F.col("unit_price") if "unit_price" in sales.columns else F.lit(0.0)
    return sales.withColumn("revenue", F.round(F.col("quantity_sold") * price, 2))


def profile(sales: DataFrame | None, spark: SparkSession | None = None) -> DataFrame:
    """One row: status, row count, first and last date, number of products."""
    if sales is None:
        return spark.range(1).select(
            F.lit("not_initialised").alias("status"),
            F.lit(None).cast("long").alias("rows"),
            F.lit(None).cast("string").alias("date_from"),
            F.lit(None).cast("string").alias("date_to"),
            F.lit(None).cast("long").alias("products"),
        )
    return sales.agg(
        F.lit("ok").alias("status"),
        F.count(F.lit(1)).alias("rows"),
        F.min("date").cast("string").alias("date_from"),
        F.max("date").cast("string").alias("date_to"),
        F.countDistinct("product_id").alias("products"),
    )
