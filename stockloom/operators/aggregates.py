"""Grouped sales figures. All are hash aggregates that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockloom import rules

from stockloom.functions.numeric import half_even


def units(name: str) -> Column:
    return F.sum("quantity_sold").alias(name)


def mean_units(name: str = "avg_daily") -> Column:
    return F.round(F.avg("quantity_sold"), 1).alias(name)


def revenue(name: str = "total_revenue") -> Column:
    return F.round(F.sum("revenue"), 2).alias(name)


def month_of() -> Column:
    return F.substring("date", 1, 7)


def year_of() -> Column:
    return F.substring("date", 1, 4)


def top_selling(sales: DataFrame, n: int = 10) -> DataFrame:
    return (
        sales.groupBy("product_name", "category")
        .agg(units("total_sold"), mean_units(), revenue())
        .orderBy(F.desc("total_sold"), "product_name")
        .limit(n)
    )


def monthly_trend(sales: DataFrame) -> DataFrame:
    return (
        sales.groupBy(month_of().alias("month"))
        .agg(units("total_units"), revenue(), F.countDistinct("product_id").alias("products_sold"))
        .orderBy("month")
    )


def tail(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The last ``n`` rows by ``keys``, in that order."""
    return df.orderBy(*[F.desc(k) for k in keys]).limit(n).orderBy(*keys)


def seasonal_demand(sales: DataFrame) -> DataFrame:
    return (
        sales.groupBy("season", "product_name", "category")
        .agg(units("total_demand"), mean_units())
        .orderBy("season", F.desc("avg_daily"), "product_name")
    )


def slow_movers(sales: DataFrame, threshold: float | None = rules.SLOW_MOVER_LIMIT) -> DataFrame:
    """Products whose rounded mean demand is below ``threshold``, without one: below the mean over all sales rows."""
    if threshold is None:
        overall = sales.agg(F.avg("quantity_sold").alias("_limit"))
        means = sales.groupBy("product_name", "category").agg(mean_units("avg_daily_demand"), units("total_sold"))
        below = means.crossJoin(F.broadcast(overall)).filter("avg_daily_demand < _limit")  # one row
        return below.drop("_limit").orderBy("avg_daily_demand", "product_name")
    return (
        sales.groupBy("product_name", "category")
        .agg(mean_units("avg_daily_demand"), units("total_sold"))
        .filter(F.col("avg_daily_demand") < threshold)
        .orderBy("avg_daily_demand", "product_name")
    )


def product_sales(sales: DataFrame, product_id: str) -> DataFrame:
    """The series of one product; the filter reaches the scan."""
    return (
        sales.filter(F.col("product_id") == product_id)
        .select("date", "quantity_sold", "revenue", "current_stock", "season", "is_festival_month")
        .orderBy("date")
    )


def category_revenue(sales: DataFrame) -> DataFrame:
    return (
        sales.groupBy("category")
        .agg(revenue(), units("total_units"), mean_units())
        .orderBy(F.desc("total_revenue"), "category")
    )


def yearly_totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy(year_of().alias("year")).agg(units("total_units"), revenue()).orderBy("year")


def low_stock_days(sales: DataFrame, days: int = 7) -> DataFrame:
    """Days on which a product's stock was below ``days`` times its mean demand."""
    needed = sales.groupBy("product_id").agg((F.avg("quantity_sold") * days).alias("_needed"))
    return (
        sales.join(needed, "product_id")
        .filter(F.col("current_stock") < F.col("_needed"))
        .groupBy("product_name")
        .agg(F.count(F.lit(1)).alias("low_stock_days"))
        .orderBy(F.desc("low_stock_days"), "product_name")
    )


# --- frames behind the charts ----------------------------------------------------------------


def monthly_totals(sales: DataFrame) -> DataFrame:
    return (
        sales.groupBy(F.date_format(F.to_date("date"), "yyyy-MM").alias("month"))
        .agg(units("total_units"), F.sum("revenue").alias("total_revenue"))
        .orderBy("month")
    )


def top_products(sales: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` best-selling products, the best one last."""
    best = sales.groupBy("product_name").agg(units("total_units")).orderBy(F.desc("total_units"), "product_name").limit(n)
    return best.orderBy("total_units", F.desc("product_name"))


def category_share(sales: DataFrame) -> DataFrame:
    totals = sales.groupBy("category").agg(F.sum("revenue").alias("revenue"))
    grand = totals.agg(F.sum("revenue").alias("_all"))
    return (
        totals.crossJoin(F.broadcast(grand))  # one row
        .select("category", "revenue", (F.col("revenue") * 100 / F.col("_all")).alias("share_pct"))
        .orderBy(F.desc("revenue"), "category")
    )


def season_category_means(sales: DataFrame) -> DataFrame:
    return sales.groupBy("season", "category").agg(F.avg("quantity_sold").alias("avg_daily_demand"))


def product_means(sales: DataFrame) -> DataFrame:
    """Mean demand per product, fastest first."""
    return (
        sales.groupBy("product_name", "category")
        .agg(F.avg("quantity_sold").alias("avg_daily_demand"))
        .orderBy(F.desc("avg_daily_demand"), "product_name")
    )


def demand_histogram(sales: DataFrame, bins: int = 60) -> DataFrame:
    """Row counts over ``bins`` equally wide ranges of the daily quantity; empty ranges are left out."""
    bounds = sales.agg(
        F.min("quantity_sold").cast("double").alias("_low"), F.max("quantity_sold").cast("double").alias("_high")
    ).withColumn("_width", (F.col("_high") - F.col("_low")) / bins)
    # Counting the distinct quantities first leaves few rows to be placed.
    counts = sales.groupBy("quantity_sold").agg(F.count(F.lit(1)).alias("_rows"))
    place = F.when(F.col("_width") == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("quantity_sold") - F.col("_low")) / F.nullif(F.col("_width"), F.lit(0.0))), F.lit(bins - 1))
    )
    return (
        counts.crossJoin(F.broadcast(bounds))  # one row
        .groupBy(place.cast("int").alias("bin"))
        .agg(
            F.min(F.col("_low") + place * F.col("_width")).alias("bin_start"),
            F.sum("_rows").alias("days"),
        )
        .orderBy("bin")
    )


MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
DAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def year_month_grid(features: DataFrame) -> DataFrame:
    """Mean demand per product, year and month (one column each), rounded; no sales count as 0."""
    month = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month("date"))
    grid = (
        features.withColumn("_month", month)
        .groupBy("product_id", F.year("date").alias("year"))
        .pivot("_month", list(MONTH_NAMES))
        .agg(F.avg("quantity_sold"))
    )
    return grid.select(
        "product_id", "year",
        *[F.coalesce(half_even(F.col(m), 0), F.lit(0.0)).cast("int").alias(m.lower()) for m in MONTH_NAMES],
    )


def day_of_week_means(features: DataFrame) -> DataFrame:
    day = F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), F.col("day_of_week") + 1)
    return features.groupBy("product_id", "day_of_week").agg(
        F.first(day).alias("day"), F.avg("quantity_sold").alias("avg_quantity")
    )


def yearly_product_units(sales: DataFrame) -> DataFrame:
    return sales.groupBy(F.year(F.to_date("date")).alias("year"), "product_name").agg(units("total_units"))


def product_summary(features: DataFrame, catalog: DataFrame) -> DataFrame:
    """Totals and spread of each product's feature rows, with its catalog facts."""
    facts = catalog.select("product_id", "unit_price", "lead_time_days", F.initcap("category").alias("category"))
    return (
        features.groupBy("product_id")
        .agg(
            units("total_sold"),
            half_even(F.avg("quantity_sold"), 1).alias("avg_daily"),
            F.max("quantity_sold").alias("max_daily"),
            F.min("quantity_sold").alias("min_daily"),
            half_even(F.stddev_samp("quantity_sold"), 1).alias("std_daily"),
        )
        .join(facts, "product_id", "left")
    )


def demand_stats(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product_name").agg(
        half_even(F.avg("quantity_sold"), 1).alias("mean"),
        half_even(F.stddev_samp("quantity_sold"), 1).alias("std"),
        F.min("quantity_sold").alias("min"),
        F.max("quantity_sold").alias("max"),
    )


def catalog_movers(catalog: DataFrame, fast: float, slow: float) -> DataFrame:
    """Fast and slow movers by the catalog's base demand."""
    return catalog.select(
        "product_id", "product_name",
        F.when(F.col("base_demand") >= fast, "fast").when(F.col("base_demand") <= slow, "slow").alias("mover"),
    ).filter(F.col("mover").isNotNull())
