"""The registered queries: every operator of the library over the whole test tables.

Queries whose columns are computed in floating point round them, so that both engines print the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stockloom import rules
from stockloom.functions import stock_rules
from stockloom.functions.numeric import half_even
from stockloom.operators import (
    aggregates as agg, boosting, features as feats, forecast, inventory as inv, ledger, metrics, regression, reservoir, series, stock,
)
from stockloom.plans import comparison, overview, presets, reports
from stockloom.session import scratch_path
from stockloom.sources import exports, inventory_store, sales as sales_source
from stockloom.sources.lineitem_sales import Store, table
from stockloom.streaming.inventory_stream import apply_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PRODUCT = "P007"


def register(name: str, function: Query) -> None:
    """Register a query; date columns come out as text."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = function(spark, sf_dir)
        dates = [f.name for f in df.schema if isinstance(f.dataType, T.DateType)]
        return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df

    QUERIES[name] = run


def query(function: Query) -> Query:
    register(function.__name__, function)
    return function


def on_sales(name: str, function: Callable[[DataFrame], DataFrame]) -> None:
    register(name, lambda spark, sf_dir: function(Store.of(spark, sf_dir).sales))


def on_features(name: str, function: Callable[[DataFrame], DataFrame]) -> None:
    """A query that reads the feature frame once: the frame is part of its plan."""
    register(name, lambda spark, sf_dir: function(features_of(spark, sf_dir)))


def on_stored_features(name: str, function: Callable[[DataFrame], DataFrame]) -> None:
    """A query that reads the feature frame more than once, and so reads a written one."""
    register(name, lambda spark, sf_dir: function(stored_features(spark, sf_dir)))


def on_last_rows(name: str, function: Callable[[DataFrame], DataFrame]) -> None:
    """A query that reads the last rows of each series only."""
    register(name, lambda spark, sf_dir: function(last_rows_of(spark, sf_dir)))


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def features_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feats.series_features(Store.of(spark, sf_dir).sales)


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature frame as a table, written at its first use."""
    return Store.of(spark, sf_dir).written_once("features", lambda: features_of(spark, sf_dir))


def last_rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that trends and stock rules look back on."""
    store = Store.of(spark, sf_dir)
    return feats.last_rows(store.sales_by_year, rules.WINDOW_ROWS, months=store.months)


def counts_of(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stock counts taken from purchase events: their value is the number of days that the stock lasts at base demand."""
    number = F.lit(1) + F.col("user_id") % 25
    counted = events.filter("event_type = 'purchase'").withColumn(
        "product_id", F.concat(F.lit("P"), F.lpad(number.cast("string"), 3, "0")))
    return counted.join(catalog, "product_id").select(
        "product_id", "category", (F.col("value") * F.col("base_demand")).cast("int").alias("new_quantity"), "ts")


def inventory_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default inventory after all counts."""
    catalog = Store.of(spark, sf_dir).catalog
    return inv.upsert(inv.defaults(catalog), counts_of(table(spark, sf_dir, "events"), catalog))


def recommendations_of(spark: SparkSession, sf_dir: str, as_of: str | None = None, horizon: int = 30) -> DataFrame:
    store = Store.of(spark, sf_dir)
    return stock.trend_recommendations(last_rows_of(spark, sf_dir), store.sales, store.catalog, as_of, horizon)


# --- sources and sinks -----------------------------------------------------------------------


@query
def scan_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales written as CSV and scanned with the fixed schema."""
    path = scratch_path(spark, "sales_csv")
    exports.export_csv(Store.of(spark, sf_dir).sales, path)
    return sales_source.dated(sales_source.scan_csv(spark, path))


@query
def load_sales_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loading twice leaves one copy of the rows."""
    rows, path = Store.of(spark, sf_dir).sales, scratch_path(spark, "sales_table")
    sales_source.load_table(spark, rows, path)
    stored = sales_source.load_table(spark, rows, path)
    return stored.agg(F.count(F.lit(1)).alias("rows"), F.sum("quantity_sold").alias("units"))


@query
def append_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days up to mid-1997, then those from 1997 on with every Monday counted once more: the half-year that both hold is replaced."""
    rows, path = Store.of(spark, sf_dir).sales, scratch_path(spark, "sales_grown")
    sales_source.load_table(spark, rows.filter("date < '1997-07-01'"), path)
    later = rows.filter("date >= '1997-01-01'").withColumn(
        "quantity_sold", F.col("quantity_sold") + F.expr("case when weekday(to_date(date)) = 0 then 1 else 0 end"))
    stored = sales_source.add_rows(spark, later, path)
    return stored.groupBy("product_id", F.substring("date", 1, 4).alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantity_sold").alias("units"), F.max("date").alias("last_date"))


@query
def derived_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales fact from the order lines."""
    return Store.of(spark, sf_dir).sales


@query
def derived_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store.of(spark, sf_dir).catalog


on_sales("sales_profile", sales_source.profile)
on_sales("custom_sql", lambda sales: presets.run_sql(sales, presets.EXAMPLE_QUERY))
on_sales("parameter_sql", lambda sales: presets.run_sql(
    sales,
    "select product_name, count(*) as days, sum(quantity_sold) as total_sold from sales "
    "where category = :category and quantity_sold >= :least group by product_name",
    category="fever", least=50,
))


@query
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast report written as CSV and read back."""
    report, path = forecast_report(spark, sf_dir), scratch_path(spark, "forecast_csv")
    exports.export_csv(report, path)
    return exports.read_csv(spark, path, report)


@query
def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-sheet report; the result counts the lines of each sheet as read back."""
    store, held = Store.of(spark, sf_dir), inventory_of(spark, sf_dir)
    sheets = {
        "Forecasts": reports.forecast_report(store.sales, store.catalog, held),
        "Alerts": reports.alerts_report(store.sales, store.catalog, held),
        "Daily Sales": reports.daily_sales_report(stored_features(spark, sf_dir), store.catalog),
    }
    folders = exports.export_report(sheets, scratch_path(spark, "workbook"), "parquet")
    counts = [
        spark.read.parquet(folder).agg(F.lit(name).alias("sheet"), F.count(F.lit(1)).alias("lines"))
        for name, folder in folders.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- projections -----------------------------------------------------------------------------


on_sales("calendar_features", lambda sales: feats.base_features(sales).select(
    "product_id", "date", "month", "day_of_week", "day_of_month", "quarter", "is_weekend"))
on_sales("week_cyclical", lambda sales: rounded(
    feats.base_features(sales).select("product_id", "date", "week_sin", "week_cos"), ("week_sin", "week_cos"), 9))
on_sales("season_features", lambda sales: feats.base_features(sales).select(
    "product_id", "date", "season", "season_encoded", "is_festival_month"))
on_features("peak_season_flag", lambda features: features.select(
    "product_id", "date", "season", "category", "is_peak_disease_season"))
on_sales("product_sales", lambda sales: agg.product_sales(sales, PRODUCT))
on_features("lag_features", lambda features: features.select(
    "product_id", "date", "quantity_sold", "lag_1", "lag_7", "lag_30"))
on_features("rolling_stats", lambda features: rounded(features.select(
    "product_id", "date", "rolling_mean_7", "rolling_mean_30", "rolling_std_7"),
    ("rolling_mean_7", "rolling_mean_30", "rolling_std_7")))
on_sales("rolling_stats_shifted", lambda sales: rounded(feats.series_features(sales, shifted=True).select(
    "product_id", "date", "rolling_mean_7", "rolling_mean_30", "rolling_std_7"),
    ("rolling_mean_7", "rolling_mean_30", "rolling_std_7")))


def weighted_sum(vector: str, digits: int = 4):
    """Sum of the elements, each times its position: any swapped or wrong element changes it."""
    weighted = F.transform(vector, lambda v, i: v * (i + 1))
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda total, v: total + v), digits)


on_features("feature_vector", lambda features: feats.feature_vectors(features).select(
    "product_id", "date", F.size("features").alias("n_features"), weighted_sum("features").alias("checksum")))
on_features("tabular_features", lambda features: feats.tabular(features).select(
    "product_id", "date", F.size("x").alias("n_features"), weighted_sum("x").alias("checksum"), "y"))
on_sales("revenue_derived", lambda sales: sales_source.with_revenue(sales.drop("revenue")).select(
    "product_id", "date", "revenue"))


@query
def expiry_risk_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.of(spark, sf_dir)
    base = store.catalog.select("product_id", "base_demand")
    factor = stock_rules.seasonal_factor("season", "category")
    return store.sales.join(base, "product_id").select(
        "product_id", "date", stock_rules.expiry_flag("current_stock", "base_demand", factor).alias("expiry_risk"))


# --- aggregates ------------------------------------------------------------------------------


for preset in presets.PRESETS:
    on_sales(preset, presets.PRESETS[preset])

on_sales("top_selling", agg.top_selling)
on_sales("monthly_trend", agg.monthly_trend)
on_sales("monthly_trend_tail", lambda sales: agg.tail(agg.monthly_trend(sales), 6, "month"))
on_sales("seasonal_demand", agg.seasonal_demand)
on_sales("slow_movers", lambda sales: agg.slow_movers(sales, None))
on_sales("category_revenue", agg.category_revenue)
on_sales("eda_monthly", lambda sales: rounded(agg.monthly_totals(sales), ("total_revenue",), 2))
on_sales("eda_top_products", agg.top_products)
on_sales("eda_category_share", lambda sales: rounded(
    rounded(agg.category_share(sales), ("revenue",), 2), ("share_pct",), 6))
on_sales("eda_season_category", lambda sales: rounded(agg.season_category_means(sales), ("avg_daily_demand",)))
on_sales("eda_movers", lambda sales: rounded(agg.product_means(sales), ("avg_daily_demand",)))
on_sales("eda_histogram", lambda sales: rounded(agg.demand_histogram(sales), ("bin_start",)))
on_features("eda_heatmap", agg.year_month_grid)
on_features("eda_day_of_week", lambda features: rounded(agg.day_of_week_means(features), ("avg_quantity",)))
on_sales("eda_yoy_product", agg.yearly_product_units)
on_sales("demand_stats", agg.demand_stats)


@query
def product_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.product_summary(features_of(spark, sf_dir), Store.of(spark, sf_dir).catalog)


@query
def catalog_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.catalog_movers(Store.of(spark, sf_dir).catalog, rules.FAST_UNITS, rules.SLOW_UNITS)


# --- windows, scaling, sequences -------------------------------------------------------------


on_features("eda_moving_average", lambda features: rounded(
    feats.moving_averages(features), ("ma_7", "ma_30")))


@query
def order_line_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line against the lines of its part's brand before it: a dense series, summed up per brand and year."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("product_id"))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").cast("int").alias("quantity_sold"))
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")
    features = feats.series_features(rows, order=("date", "l_orderkey", "l_linenumber", "quantity_sold"), dense=True)
    return features.groupBy("product_id", F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("frame_no").alias("last_no"), F.sum("lag_1").alias("lag_1"), F.sum("lag_30").alias("lag_30"),
        F.round(F.sum(F.round(F.col("rolling_mean_7") * 420)), 0).cast("long").alias("mean_7"))


@query
def last_n_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.of(spark, sf_dir)
    return feats.last_rows(store.sales_by_year, 90, months=store.months).select("product_id", "date", "quantity_sold")


on_features("chrono_split", lambda features: features.groupBy("product_id").agg(
    F.count_if(feats.is_train()).alias("train_rows"), F.count_if(~feats.is_train()).alias("test_rows"),
    F.max(F.when(feats.is_train(), F.col("date"))).alias("last_train_date")))


@query
def scaler_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaler parameters stored and read back."""
    path = scratch_path(spark, "scaler")
    feats.scaler_table(feats.scaler_params(features_of(spark, sf_dir))).write.parquet(path)
    return rounded(spark.read.parquet(path), ("min", "max"))


on_stored_features("minmax_scaled", lambda features: rounded(
    feats.scaled(features).select("product_id", "date", *rules.FEATURES), rules.FEATURES))
on_stored_features("inverse_scaled", lambda features: feats.scaled(features).select(
    "product_id", "date", F.round(feats.unscaled(F.col("quantity_sold")), 6).alias("quantity")))


def sequence_figures(rows: DataFrame) -> DataFrame:
    flat = F.flatten("x")
    return rows.select(
        "product_id", "date", F.size("x").alias("n_rows"), F.size(flat).alias("n_values"),
        F.round(F.element_at(flat, 1), 6).alias("first_value"),
        F.round(F.element_at(F.element_at(F.col("x"), -1), 1), 6).alias("last_target"),
        F.round(F.aggregate(flat, F.lit(0.0), lambda total, v: total + v), 4).alias("checksum"),
        F.round("y", 6).alias("y"),
    )


on_stored_features("sequence_windows", lambda features: sequence_figures(feats.sequences(feats.scaled(features))))
on_stored_features("training_sets", lambda features: rounded(
    feats.training_set(features).groupBy("product_id", "is_train").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("date_from"), F.max("date").alias("date_to"),
        F.sum(F.size("x")).alias("window_rows"), F.sum("y").alias("y_total")),
    ("y_total",), 4))


@query
def stock_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger alone, with the default delivery factor."""
    store = Store.of(spark, sf_dir)
    base = store.catalog.select("product_id", "base_demand")
    rows = sales_source.dated(store.sales).drop("current_stock").join(base, "product_id")
    return ledger.stock_ledger(
        series.number_rows(rows), F.col("base_demand"), stock_rules.seasonal_factor("season", "category"), F.col("lead_time_days")
    ).select("product_id", "date", "current_stock")


# --- forecasts -------------------------------------------------------------------------------


on_last_rows("forecast_daily", lambda last: forecast.forecast_days(forecast.recent_trend(last), 30))
on_last_rows("forecast_total", lambda last: forecast.with_total(forecast.recent_trend(last), 30).select(
    "product_id", "predicted_demand"))
on_last_rows("forecast_noisy", lambda last: forecast.noisy_forecast_days(forecast.recent_trend(last), 60))
on_last_rows("forecast_band", lambda last: rounded(forecast.with_band(
    forecast.forecast_days(forecast.recent_trend(last), 30)), ("upper", "lower")))
on_stored_features("naive_forecast", forecast.naive_forecast)
on_stored_features("forecast_metrics", lambda features: metrics.forecast_metrics(
    forecast.naive_forecast(features).withColumn("model", F.lit(comparison.NAIVE))))


@query
def gbt_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of the stored comparison, applied again to the test rows."""
    trained(spark, sf_dir)
    store = Store.of(spark, sf_dir)
    folder = comparison.artefacts(spark, store.path_once("models", lambda path: None))
    booster = boosting.load_model(spark, f"{folder}/booster")
    return rounded(boosting.test_predictions(spark.read.parquet(f"{folder}/features"), booster), ("y_pred",))


def ar_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scaled = feats.scaled(stored_features(spark, sf_dir))
    return scaled, regression.regression_rows(scaled)


@query
def ar_product_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the regressions are fitted from: sums of products over the training rows, in millionths.

    Many sums are exact halves of the last digit; the 0.1 keeps rounding away from them.
    """
    _, rows = ar_rows(spark, sf_dir)
    return regression.product_sums(rows.filter("is_train")).select(
        "product_id", "pos", F.floor(F.col("value") * 1e6 + F.lit(0.1)).alias("millionths"))


@query
def ar_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = ar_rows(spark, sf_dir)
    return rounded(regression.test_predictions(rows, regression.fit(rows)), ("y", "y_pred"), 3)


@query
def ar_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled, rows = ar_rows(spark, sf_dir)
    return regression.roll_out(scaled, regression.fit(rows), 30)


@query
def actual_vs_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-span actuals and predictions with their dates, from stored coefficients."""
    _, rows = ar_rows(spark, sf_dir)
    path = scratch_path(spark, "weights")
    regression.save_weights(regression.fit(rows), path)
    tested = regression.test_predictions(rows, regression.load_weights(spark, path))
    return tested.select("product_id", "date", F.round("y", 2).alias("actual"), F.round("y_pred", 2).alias("predicted"))


def reservoir_tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reservoir.reservoir_rows(feats.scaled(stored_features(spark, sf_dir)))
    return regression.test_predictions(rows, regression.fit(rows))


@query
def reservoir_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product: the tested days, what was sold on them, and whether the reservoir's error stays below 1.5 times that of naming their mean."""
    tested = reservoir_tested(spark, sf_dir)
    means = tested.groupBy("product_id").agg(F.avg("y").alias("_mean"))
    return tested.join(means, "product_id").groupBy("product_id").agg(
        F.count(F.lit(1)).alias("days"), F.round(F.sum("y")).cast("long").alias("sold"),
        (F.avg(F.abs(F.col("y") - F.col("y_pred"))) < 1.5 * F.avg(F.abs(F.col("y") - F.col("_mean")))).alias("near"))


@query
def reservoir_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = feats.scaled(stored_features(spark, sf_dir))
    return reservoir.roll_out(scaled, regression.fit(reservoir.reservoir_rows(scaled)), 30)


def trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored model comparison, trained at its first use."""
    store = Store.of(spark, sf_dir)
    path = store.path_once("models", lambda path: comparison.train(store.sales, store.catalog, path))
    return comparison.load_comparison(spark, path)


@query
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All products, three models: trained, stored, scored, stored."""
    return trained(spark, sf_dir)


def foretold(scores: DataFrame) -> DataFrame:
    """The scores as far as they can be foretold: those of the exact models; for the trees of each product, whether they come within a
    quarter of its naive forecast, and beat the naive forecasts over all products by a tenth."""
    def mean_of(model: str):
        return F.avg(F.when(F.col("model") == model, F.col("mae")))

    beaten = scores.agg((mean_of(comparison.BOOSTED) < 0.9 * mean_of(comparison.NAIVE)).alias("_beaten"))
    naive = scores.filter(F.col("model") == comparison.NAIVE).select("product_id", F.col("mae").alias("_naive"))
    exact = F.col("model") != comparison.BOOSTED
    figures = ("mae", "rmse", "mape", "directional_accuracy")
    return scores.join(naive, "product_id").crossJoin(F.broadcast(beaten)).select(  # one row
        "product_id", "product_name", "model", "test_samples", "status",
        *[F.when(exact, F.round(F.col(c), 2)).alias(c) for c in figures],
        (exact | (F.col("_beaten") & (F.col("mae") <= 1.25 * F.col("_naive")))).alias("holds"))


@query
def comparison_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison of all products and models."""
    return foretold(trained(spark, sf_dir))


@query
def training_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training record merged with the comparison; the trees' errors are left out."""
    scores, store = trained(spark, sf_dir), Store.of(spark, sf_dir)
    record = spark.read.parquet(f"{comparison.artefacts(spark, store.path_once('models', lambda path: None))}/record")
    exact = F.col("model") != comparison.BOOSTED
    return comparison.recorded(scores, record).select(
        "product_id", "model", "status", "test_samples", "frame_rows", "train_rows", "test_rows",
        *[F.when(exact, F.round(F.col(c), 4)).alias(c) for c in ("scaled_mse", "scaled_mae")])


@query
def selected_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three models of the products of two categories only, trained, stored and scored on their test spans."""
    store = Store.of(spark, sf_dir)
    wanted = store.catalog.filter("category in ('fever', 'allergy')").select("product_id")
    path = store.path_once("selected", lambda path: comparison.train(store.sales, store.catalog, path, product_ids=wanted))
    return foretold(comparison.load_comparison(spark, path))


@query
def model_first_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand and stock from the stored models of all categories but one, which falls back to the trend."""
    store = Store.of(spark, sf_dir)
    scaled, rows = ar_rows(spark, sf_dir)
    modelled = store.catalog.filter("category <> 'diabetes'").select("product_id")
    path = scratch_path(spark, "weights")
    regression.save_weights(comparison.select_products(regression.fit(rows), modelled), path)
    rolled = regression.roll_out(scaled, regression.load_weights(spark, path), 30)
    total = forecast.with_total(forecast.recent_trend(last_rows_of(spark, sf_dir)), 30).drop("slope", "deviation", "last_date")
    demand = stock.with_season(stock.model_first(total, rolled), store.sales)
    return stock.recommend(demand, store.catalog).select(
        "product_id", "model_type", "season", "predicted_demand", "safety_stock", "reorder_point", "recommended_stock")


@query
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.ranked(trained(spark, sf_dir)).select(
        "product_id", "product_name", "model", "mae", "rmse", "mape", "directional_accuracy", "rank", "notes")


@query
def product_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested ids, taken from the customer keys; some of them are no products."""
    store = Store.of(spark, sf_dir)
    wanted = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("P"), F.lpad((F.col("c_custkey") % 40).cast("string"), 3, "0")).alias("product_id")
    ).distinct()
    known = comparison.select_products(store.catalog, wanted).select("product_id", F.lit("selected").alias("status"))
    return known.unionByName(
        comparison.unknown_products(wanted, store.catalog).select("product_id", F.lit("unknown").alias("status")))


# --- stock -----------------------------------------------------------------------------------


def with_daily_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.of(spark, sf_dir)
    means = forecast.recent_trend(last_rows_of(spark, sf_dir)).select("product_id", "mean")
    return means.join(store.catalog, "product_id")


@query
def safety_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_daily_mean(spark, sf_dir).select(
        "product_id", stock_rules.safety_stock("mean", "lead_time_days").alias("safety_stock"))


@query
def reorder_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_daily_mean(spark, sf_dir).select(
        "product_id", stock_rules.reorder_point("mean", "lead_time_days").alias("reorder_point"))


@query
def turnover_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_daily_mean(spark, sf_dir).select(
        "product_id", stock_rules.turnover_class(half_even("mean", 1)).alias("turnover"))


@query
def recommend_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommendations_of(spark, sf_dir).drop("mean", "last_date")


@query
def recommend_all_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendation and alert of every product in each of the four seasons."""
    total = forecast.with_total(forecast.recent_trend(last_rows_of(spark, sf_dir)), 30)
    seasons = F.explode(F.array(*[F.lit(s) for s in rules.SEASON_MONTHS]))
    store = Store.of(spark, sf_dir)
    recommended = stock.recommend(total.withColumn("season", seasons), store.catalog)
    return stock.with_alert(stock.with_stock(recommended, inventory_of(spark, sf_dir))).select(
        "product_id", "season", "buffer_pct", "buffer_units", "recommended_stock", "seasonal_factor",
        "current_stock", "alert_type", "severity", "label", "deficit", "excess", "message")


@query
def alert_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alert and turnover class: each product's week in each season, at three paces of selling and nine levels of stock."""
    total = forecast.with_total(forecast.recent_trend(last_rows_of(spark, sf_dir)), 7)
    seasons = F.explode(F.array(*[F.lit(s) for s in rules.SEASON_MONTHS]))
    paced = total.withColumn("season", seasons).withColumn(
        "mean", F.explode(F.array(*[F.col("mean") / F.lit(slower) for slower in (1.0, 4.0, 16.0)])))
    recommended = stock.recommend(paced, Store.of(spark, sf_dir).catalog)
    levels = F.explode(F.array(*[F.lit(percent) for percent in (0, 49, 50, 79, 80, 89, 100, 130, 131)]))
    stocked = recommended.withColumn("percent", levels).withColumn(
        "current_stock", F.expr("recommended_stock * percent div 100"))
    return stock.with_alert(stocked).select(
        "product_id", "season", "percent", stock_rules.turnover_class("avg_daily_demand").alias("turnover"), "recommended_stock",
        "reorder_point", "current_stock", "alert_type", "severity", "label", "icon", "deficit", "excess", "message")


@query
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock.alerts(recommendations_of(spark, sf_dir), inventory_of(spark, sf_dir))


@query
def stock_status_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.of(spark, sf_dir)
    return overview.stock_status_table(store.sales, store.catalog, inventory_of(spark, sf_dir)).drop(
        "alert_type", "severity")


@query
def overview_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.of(spark, sf_dir)
    return overview.overview_kpis(
        overview.stock_status_table(store.sales, store.catalog, inventory_of(spark, sf_dir)))


@query
def business_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, held = Store.of(spark, sf_dir), inventory_of(spark, sf_dir)
    return overview.business_kpis(overview.stock_status_table(store.sales, store.catalog, held), held)


@query
def inventory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock.shelf_statuses(recommendations_of(spark, sf_dir), inventory_of(spark, sf_dir))


@query
def stock_vs_recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock.stock_vs_recommended(recommendations_of(spark, sf_dir), inventory_of(spark, sf_dir))


@query
def forecast_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.of(spark, sf_dir)
    rows = stock.horizon_recommendations(last_rows_of(spark, sf_dir), store.sales, store.catalog)
    return rows.select(
        "product_id", "horizon", "predicted_demand", "recommended_stock", "safety_stock", "reorder_point",
        "buffer_pct", "seasonal_factor", F.col("avg_forecast").cast("long").alias("avg_forecast"))


# --- inventory -------------------------------------------------------------------------------


@query
def inventory_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.defaults(Store.of(spark, sf_dir).catalog)


@query
def inventory_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory_of(spark, sf_dir)


@query
def inventory_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all categories but one, which is filled from the catalog."""
    catalog = Store.of(spark, sf_dir).catalog
    counts = counts_of(table(spark, sf_dir, "events"), catalog).filter("category <> 'diabetes'")
    return inv.back_fill(inv.upsert(inv.defaults(catalog).limit(0), counts), catalog)


@query
def inventory_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels as read from the store after a bulk update."""
    catalog = Store.of(spark, sf_dir).catalog
    store = inventory_store.InventoryStore(spark, scratch_path(spark, "inventory"), catalog)
    store.bulk_update(counts_of(table(spark, sf_dir, "events"), catalog))
    return store.stock_levels()


@query
def inventory_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts as a stream, applied to the store in micro-batches."""
    path, catalog = scratch_path(spark, "inventory"), Store.of(spark, sf_dir).catalog
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def open_store(session: SparkSession) -> inventory_store.InventoryStore:
        return inventory_store.InventoryStore(session, path, catalog)

    apply_counts(counts_of(stream, catalog), open_store, scratch_path(spark, "stream")).awaitTermination()
    return open_store(spark).load()


# --- reports ---------------------------------------------------------------------------------


def forecast_report(spark: SparkSession, sf_dir: str, horizon: int = 30) -> DataFrame:
    store = Store.of(spark, sf_dir)
    return reports.forecast_report(store.sales, store.catalog, inventory_of(spark, sf_dir), horizon=horizon)


register("forecast_report", forecast_report)
for days in (7, 60):
    register(f"forecast_report_{days}", partial(forecast_report, horizon=days))


@query
def alerts_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.of(spark, sf_dir)
    return reports.alerts_report(store.sales, store.catalog, inventory_of(spark, sf_dir))


@query
def daily_sales_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_sales_report(features_of(spark, sf_dir), Store.of(spark, sf_dir).catalog)


@query
def daily_sales_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_sales_tail(daily_sales_report(spark, sf_dir))
