"""Derive the product catalog and the sales fact from order lines.

A product is a brand, a sale is what the order lines of the brand ship on a day. Only the daily
totals are worked on afterwards; the order lines themselves are scanned once, three columns wide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockloom import rules
from stockloom.functions import calendar, stock_rules
from stockloom.functions.numeric import lookup, whole
from stockloom.operators.ledger import stock_ledger
from stockloom.operators.series import number_rows
from stockloom.session import scratch_path
from stockloom.sources.sales import SALES_SCHEMA, by_year, load_table, month_counts, read_table

CATEGORY_OF_BRAND = {
    0: "fever", 1: "hydration", 2: "respiratory", 3: "allergy",
    4: "antibiotic", 5: "supplement", 6: "painkiller", 7: "diabetes",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_number(brand: Column) -> Column:
    return F.substring_index(brand, "#", -1).cast("int")


def daily_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units sold and highest list price per brand and ship date.

    The join takes no hint: Spark broadcasts the parts only if their size is below its threshold,
    and otherwise splits a hot part number at run time (AQE skew join). The totals are
    combined before the shuffle, so a hot brand costs one row per map task and day.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_quantity", F.col("l_shipdate").cast("date").alias("date")
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("brand"), "date")
        .agg(F.sum("l_quantity").alias("units"), F.max("p_retailprice").alias("price"))
    )


def derive_catalog(daily: DataFrame) -> DataFrame:
    """One row per brand: its category, mean units per selling day, highest price and lead time."""
    number = F.col("_number")
    numbered = daily.withColumn("_number", brand_number(F.col("brand")))
    sold = whole(F.col("units")) * (F.lit(1) + number % 4)
    return numbered.groupBy("brand", "_number").agg(
        F.floor(F.sum(sold) / F.count(F.lit(1))).cast("int").alias("base_demand"),
        F.max("price").alias("unit_price"),
    ).select(
        F.concat(F.lit("P"), F.lpad(number.cast("string"), 3, "0")).alias("product_id"),
        F.col("brand").alias("product_name"),
        lookup("_number % 8", CATEGORY_OF_BRAND, None).alias("category"),
        "base_demand",
        "unit_price",
        (F.lit(3) + number % 5).alias("lead_time_days"),
    )


def catalogued(daily: DataFrame, catalog: DataFrame) -> DataFrame:
    """Daily sales with the catalog columns, the season and the festival flag."""
    units = whole(F.col("units")) * (F.lit(1) + brand_number(F.col("brand")) % 4)
    seasons = calendar.season_columns("date")
    return (
        daily.select(F.col("brand").alias("product_name"), "date", units.cast("int").alias("quantity_sold"))
        .join(catalog, "product_name")
        .withColumns({name: seasons[name] for name in ("season", "is_festival_month")})
    )


def derive_sales(numbered: DataFrame) -> DataFrame:
    """The 13 sales columns, with the stock of each day from the ledger."""
    lead = F.col("lead_time_days")
    stocked = stock_ledger(
        numbered.withColumn("_factor", stock_rules.seasonal_factor("season", "category")),
        base=F.col("base_demand"),
        factor=F.col("_factor"),
        lead=lead,
        delivery_factor=F.lit(0.6) + F.lit(0.1) * (lead - 3),
    )
    columns = stocked.withColumns({
        "store_id": F.lit(rules.STORE_ID),
        "revenue": F.round(F.col("quantity_sold") * F.col("unit_price"), 2),
        "expiry_risk": stock_rules.expiry_flag("current_stock", "base_demand", F.col("_factor")),
        "date": F.date_format("date", "yyyy-MM-dd"),
    })
    return columns.select(*[F.col(f.name).cast(f.dataType) for f in SALES_SCHEMA])


class Store:
    """The stored sales table and catalog of one test-data folder, written once per session."""

    _stores: dict[tuple[str, str], "Store"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        # Each step reads its input more than once: it is written first, not computed again.
        daily = self._written("daily", daily_units(spark, sf_dir))
        self.catalog = self._written("catalog", derive_catalog(daily))
        numbered = self._written("numbered", number_rows(catalogued(daily, self.catalog)))
        self._tables: dict[str, DataFrame] = {}
        self._paths: dict[str, str] = {}
        self.sales_path = scratch_path(spark, "sales")
        load_table(spark, derive_sales(numbered), self.sales_path)

    def _written(self, name: str, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def written_once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table derived from this store, written at its first use."""
        if name not in self._tables:
            self._tables[name] = self._written(name, build())
        return self._tables[name]

    def path_once(self, name: str, fill: Callable[[str], object]) -> str:
        """A folder of this store, filled at its first use."""
        if name not in self._paths:
            path = scratch_path(self.spark, name)
            fill(path)
            self._paths[name] = path
        return self._paths[name]

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Store":
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._stores:
            cls._stores[key] = cls(spark, sf_dir)
        return cls._stores[key]

    @property
    def sales(self) -> DataFrame:
        return read_table(self.spark, self.sales_path)

    @property
    def sales_by_year(self) -> DataFrame:
        return by_year(self.spark, self.sales_path)

    @property
    def months(self) -> DataFrame:
        return month_counts(self.spark, self.sales_path)
