"""Stock recommendations and alerts for all products at once."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from stockloom import rules
from stockloom.functions import alerts as alert_rules, calendar, stock_rules
from stockloom.operators import forecast


def with_season(df: DataFrame, sales: DataFrame, as_of: date | str | None = None) -> DataFrame:
    """Add the season of the day ``as_of``, by default of the last day with sales."""
    if as_of is not None:
        return df.withColumn("season", calendar.season_of_date(f"date'{as_of}'"))
    last = sales.agg(F.max("date").alias("_last")).select(calendar.season_of_date("_last").alias("season"))
    return df.crossJoin(F.broadcast(last))  # one row


def recommend(forecasts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Recommendation record per row of ``forecasts``: product_id, season, predicted_demand, mean.

    Products missing from the catalog keep their id as name and get the default lead time.
    """
    known = forecasts.join(
        catalog.select("product_id", "product_name", "category", "unit_price", F.col("lead_time_days").alias("_lead")),
        "product_id", "left",
    )
    record = stock_rules.recommendation("predicted_demand", "season", "category", "mean", "_lead")
    keep = [c for c in forecasts.columns if c not in (*record, "product_id")]
    return known.select(
        "product_id",
        F.coalesce("product_name", "product_id").alias("product_name"),
        "category", "unit_price", *keep,
        *[c.alias(name) for name, c in record.items()],
    )


def trend_recommendations(
    features: DataFrame, sales: DataFrame, catalog: DataFrame, as_of: date | str | None = None, horizon: int = 30
) -> DataFrame:
    """Recommendations from the trend forecast over ``horizon`` days, for the season of ``as_of``."""
    total = forecast.with_total(forecast.recent_trend(features), horizon).drop("slope", "deviation")
    return recommend(with_season(total, sales, as_of), catalog)


def model_first(totals: DataFrame, rolled_out: DataFrame) -> DataFrame:
    """Demand from the stored model's roll-out where there is one, else from the trend; ``model_type`` names which."""
    rolled = rolled_out.groupBy("product_id").agg(F.sum("quantity").alias("_rolled"))
    return totals.join(rolled, "product_id", "left").withColumns({
        "model_type": F.when(F.col("_rolled").isNull(), "trend").otherwise("AR"),
        "predicted_demand": F.coalesce("_rolled", "predicted_demand"),
    }).drop("_rolled")


def with_stock(recommendations: DataFrame, inventory: DataFrame) -> DataFrame:
    """Add ``current_stock``; a product without a count has 0."""
    counted = inventory.select("product_id", F.col("current_stock").cast("long").alias("_counted"))
    return (
        recommendations.join(counted, "product_id", "left")
        .withColumn("current_stock", F.coalesce("_counted", F.lit(0).cast("long")))
        .drop("_counted")
    )


def with_alert(stocked: DataFrame) -> DataFrame:
    """Add the alert columns; they are null for healthy products."""
    values = [F.col(c) for c in ("current_stock", "recommended_stock", "reorder_point", "seasonal_factor")]
    typed = stocked.withColumn("alert_type", alert_rules.alert_type(*values))
    return typed.withColumns(alert_rules.alert_details("alert_type", *values))


ALERT_COLUMNS = (
    "product_id", "product_name", "alert_type", "severity", "label", "icon", "current_stock",
    "recommended_stock", "reorder_point", "deficit", "excess", "message",
)


def unsorted_alerts(recommendations: DataFrame, inventory: DataFrame) -> DataFrame:
    return (
        with_alert(with_stock(recommendations, inventory))
        .filter(F.col("alert_type").isNotNull())
        .select(*ALERT_COLUMNS)
    )


def alerts(recommendations: DataFrame, inventory: DataFrame) -> DataFrame:
    """All alerts, the most severe first."""
    return unsorted_alerts(recommendations, inventory).orderBy(alert_rules.severity_rank("severity"), "product_id")


def shelf_statuses(recommendations: DataFrame, inventory: DataFrame) -> DataFrame:
    """Traffic light and turnover class per product, as in the stock editor."""
    return with_stock(recommendations, inventory).select(
        "product_id", "product_name", "current_stock", "recommended_stock", "safety_stock", "reorder_point",
        stock_rules.turnover_class("avg_daily_demand").alias("turnover"),
        stock_rules.shelf_status("current_stock", "recommended_stock").alias("status"),
    )


def stock_vs_recommended(recommendations: DataFrame, inventory: DataFrame) -> DataFrame:
    return with_stock(recommendations, inventory).select(
        "product_name", "current_stock", "recommended_stock", "reorder_point"
    )


def horizon_recommendations(
    features: DataFrame,
    sales: DataFrame,
    catalog: DataFrame,
    as_of: date | str | None = None,
    horizons=rules.HORIZONS,
    noisy: bool = True,
) -> DataFrame:
    """Forecast figures and recommendation per product for several horizons."""
    total = forecast.with_horizon_totals(forecast.recent_trend(features), horizons, noisy)
    return recommend(with_season(total, sales, as_of), catalog)
