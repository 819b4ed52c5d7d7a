from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stockloom import rules
from stockloom.functions import stock_rules
from stockloom.operators import stock
from stockloom.operators.features import series_features
from stockloom.plans import overview


def alert_for(spark, current, recommended=1000, reorder=0, factor=1.0):
    df = spark.createDataFrame(
        [(current, recommended, reorder, factor)],
        "current_stock long, recommended_stock long, reorder_point long, seasonal_factor double",
    )
    return stock.with_alert(df).first()


@pytest.mark.parametrize("current, recommended, reorder, factor, kind", [
    (4999, 10000, 0, 1.0, "CRITICAL"),
    (5000, 10000, 0, 1.0, "LOW_STOCK"),
    (5000, 10000, 5000, 1.0, "RESTOCK_SOON"),
    (7900, 10000, 0, 1.0, "LOW_STOCK"),
    (8000, 10000, 0, 1.0, None),
    (13000, 10000, 0, 1.0, None),
    (13100, 10000, 0, 1.0, "OVERSTOCK"),
    (850, 1000, 0, 1.5, None),
    (850, 1000, 0, 1.6, "SEASONAL_RISK"),
    (900, 1000, 0, 1.6, None),
    (499, 1000, 600, 1.8, "CRITICAL"),
    (1200, 1000, 1300, 1.0, "RESTOCK_SOON"),
    (0, 0, 0, 1.0, None),
])
def test_alert_type(spark, current, recommended, reorder, factor, kind):
    assert alert_for(spark, current, recommended, reorder, factor).alert_type == kind


def test_alert_record(spark):
    critical = alert_for(spark, 1250, 10000)
    assert (critical.severity, critical.deficit, critical.excess) == ("critical", 8750, None)
    # 12.5 % is shown with the even neighbour
    assert critical.message == "Stock critically low — only 12% of recommended. Order 8,750 units urgently."
    assert critical.label == "🔴 Critical" and critical.icon == "🔴"
    over = alert_for(spark, 3000, 1000)
    assert (over.severity, over.deficit, over.excess) == ("info", None, 2000)
    assert over.message == "Overstocked by 2,000 units. Risk of expiry — delay next order."
    risk = alert_for(spark, 850, 1000, 0, 1.9)
    assert risk.message == "High-season item at 85% stock (demand ×1.9). Consider early restocking."
    restock = alert_for(spark, 1200, 1000, 1300)
    assert restock.deficit == -200 and "(1,300)" in restock.message and "-200 units" in restock.message
    healthy = alert_for(spark, 1000)
    assert healthy.message is None and healthy.severity is None and healthy.label is None


def test_buffer_needs_more_than_the_peak_factor(spark):
    rows = [("Monsoon", "allergy"), ("Winter", "fever"), ("Monsoon", "fever"), ("Summer", "nothing"), ("Nowhere", "fever")]
    df = spark.createDataFrame(rows, "season string, category string")
    factor = stock_rules.seasonal_factor("season", "category")
    got = [tuple(r) for r in df.select(factor, F.round(stock_rules.season_buffer("season", factor), 4)).collect()]
    assert got == [(1.3, 0.25), (1.4, 0.25), (1.8, 0.3), (1.0, 0.18), (1.0, 0.15)]


def test_recommendation_record(spark):
    df = spark.createDataFrame([(500.0, "Winter", "other", None, None)], "p double, season string, category string, d double, l int")
    row = df.select(*[c.alias(n) for n, c in stock_rules.recommendation("p", "season", "category").items()]).first()
    # mean 500 / 30, lead 5: safety int(41.67), reorder 83 + 41, buffer int(500 * 0.2)
    assert (row.safety_stock, row.reorder_point, row.buffer_units, row.recommended_stock) == (41, 124, 100, 600)
    assert (row.avg_daily_demand, row.buffer_pct, row.lead_time_days) == (16.7, 20.0, 5)
    binary = spark.createDataFrame([(500.0, "Summer", "hydration", 1.0, 3)], df.schema)
    row = binary.select(*[c.alias(n) for n, c in stock_rules.recommendation("p", "season", "category", "d", "l").items()]).first()
    assert row.buffer_units == int(500 * (0.18 + 0.05)) == 114


def test_safety_stock_is_at_least_one(spark):
    row = spark.createDataFrame([(0.1, 3)], "d double, l int").select(
        stock_rules.safety_stock("d", "l").alias("s"), stock_rules.reorder_point("d", "l").alias("r")).first()
    assert (row.s, row.r) == (1, 1)


def test_turnover_borders(spark):
    df = spark.createDataFrame([(45.0,), (45.1,), (89.9,), (90.0,)], "d double")
    assert [r[0] for r in df.select(stock_rules.turnover_class("d")).collect()] == [
        "Slow-Moving", "Normal", "Normal", "Fast-Moving"]


def test_shelf_status(spark):
    df = spark.createDataFrame([(49, 100), (50, 100), (80, 100), (130, 100), (131, 100), (5, 0)], "s int, r int")
    assert [r[0] for r in df.select(stock_rules.shelf_status("s", "r")).collect()] == [
        "Critical", "Low", "OK", "OK", "Overstock", "OK"]


@pytest.fixture(scope="module")
def shop(spark, make_sales):
    sales = make_sales({"P001": [100] * 60, "P002": [10] * 60, "NEW": [50] * 60})
    catalog = spark.createDataFrame(
        [("P001", "one", "fever", 100, 2.0, 3), ("P002", "two", "allergy", 10, 3.0, 4)],
        "product_id string, product_name string, category string, base_demand int, unit_price double, lead_time_days int")
    held = spark.createDataFrame([("P001", 10), ("P002", 366), ("GONE", 24)], "product_id string, current_stock int")
    return sales, catalog, held


def test_status_table_and_kpis(shop):
    sales, catalog, held = shop
    table = overview.stock_status_table(sales, catalog, held, as_of="2023-08-15")
    got = {r.product_id: r for r in table.collect()}
    assert got["P001"].predicted_demand == 3000 and got["P001"].seasonal_factor == 1.8
    assert got["P001"].recommended_stock == 3000 + 900 and got["P001"].status == "🔴 Critical"
    assert got["P002"].recommended_stock == 375 and got["P002"].status == rules.HEALTHY_LABEL
    assert got["NEW"].product_name == "NEW" and got["NEW"].current_stock == 0 and got["NEW"].turnover == "Normal"
    kpis = overview.overview_kpis(table).first()
    assert (kpis.products, kpis.total_forecast, kpis.low_stock_alerts, kpis.overstock_alerts) == (3, 4800, 2, 0)
    business = overview.business_kpis(table, held).first()
    assert (business.stockout_risk_pct, business.total_current, business.coverage_days) == (66.7, 400, 2.5)


def test_season_defaults_to_the_last_day(shop):
    sales, catalog, _ = shop
    seasons = stock.trend_recommendations(series_features(sales), sales, catalog)
    assert {r.season for r in seasons.collect()} == {"Summer"}  # the series end in March
