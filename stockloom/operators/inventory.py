"""Inventory state: product_id, current_stock, last_updated (null = never counted)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stockloom import rules

INVENTORY_SCHEMA = T.StructType([
    T.StructField("product_id", T.StringType(), False),
    T.StructField("current_stock", T.IntegerType(), False),
    T.StructField("last_updated", T.TimestampNTZType()),
])


def default_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(rules.DEFAULT_CATALOG),
        "product_id string, product_name string, category string, base_demand int, unit_price double, lead_time_days int",
    )


def defaults(catalog: DataFrame) -> DataFrame:
    """Stock for 30 days of base demand, never counted."""
    return catalog.select(
        "product_id",
        (F.col("base_demand") * rules.DEFAULT_STOCK_DAYS).cast("int").alias("current_stock"),
        F.lit(None).cast("timestamp_ntz").alias("last_updated"),
    )


def back_fill(inventory: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add the default stock of catalog products the inventory does not know."""
    missing = catalog.join(inventory, "product_id", "left_anti")
    return inventory.unionByName(defaults(missing))


def latest_counts(updates: DataFrame) -> DataFrame:
    """The latest count per product; of counts of the same moment the largest one.

    The newest value is kept while combining before the shuffle, so a product with very many counts
    costs one row per task. Negative counts become 0, fractions are cut off.
    """
    quantity = F.greatest(F.lit(0), F.col("new_quantity").cast("int"))
    newest = F.max(F.struct(F.col("ts").cast("timestamp_ntz").alias("ts"), quantity.alias("quantity")))
    return updates.filter("ts is not null").groupBy("product_id").agg(newest.alias("_newest")).select(
        "product_id", F.col("_newest.quantity").alias("_quantity"), F.col("_newest.ts").alias("_ts"))


def upsert(inventory: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply counts: product_id, new_quantity, ts. Unknown products are added.

    A count that is older than the stored one, or of the same moment and smaller, is ignored. So the result doesn't depend
    on how counts fall into batches, and applying a batch again changes nothing.
    """
    counts = latest_counts(updates)
    def moment(time: str, quantity: str):
        return F.struct(F.col(time).alias("time"), F.col(quantity).alias("quantity"))

    stale = moment("_ts", "_quantity") < moment("last_updated", "current_stock")
    use_new = F.col("_ts").isNotNull() & (F.col("last_updated").isNull() | ~stale)
    return inventory.join(counts, "product_id", "full_outer").select(
        "product_id",
        F.when(use_new, F.col("_quantity")).otherwise(F.col("current_stock")).alias("current_stock"),
        F.when(use_new, F.col("_ts")).otherwise(F.col("last_updated")).alias("last_updated"),
    )


def stock_of(inventory: DataFrame, product_id: str) -> DataFrame:
    """One row with the stock of a product, 0 if it is unknown."""
    return inventory.filter(F.col("product_id") == product_id).agg(
        F.lit(product_id).alias("product_id"), F.coalesce(F.max("current_stock"), F.lit(0)).alias("current_stock")
    )
