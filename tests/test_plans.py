from __future__ import annotations

import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom import rules
from stockloom.operators import aggregates as agg, features as feats
from stockloom.plans import comparison, presets, reports
from stockloom.sources import exports, sales as source


@pytest.fixture(scope="module")
def sales(make_sales):
    rng = np.random.default_rng(11)
    return make_sales({"A": rng.integers(1, 50, 120), "B": rng.integers(40, 90, 100), "C": rng.integers(1, 9, 25)}).persist()


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(
        [("A", "alpha", "fever", 95, 2.5, 3), ("B", "beta", "allergy", 40, 4.0, 4), ("C", "gamma", "fever", 60, 1.0, 5)],
        "product_id string, product_name string, category string, base_demand int, unit_price double, lead_time_days int")


def test_all_presets_run(sales):
    assert len(presets.PRESETS) == 10
    top = presets.run_preset(sales, "preset_top10_products").collect()
    assert [r.product_name for r in top][0] == "name B"
    slow = presets.run_preset(sales, "preset_slow_bottom5").collect()
    assert slow[0].product_name == "name C"
    for name in presets.PRESETS:
        presets.run_preset(sales, name).collect()


def test_free_sql_reads_only(spark, sales):
    spark.range(3).createOrReplaceTempView("sales")
    got = presets.run_sql(sales, presets.EXAMPLE_QUERY + ";").collect()
    assert [(r.products, r.units) for r in got] == [(3, sales.agg(F.sum("quantity_sold")).first()[0])]
    assert spark.table("sales").count() == 3 and [t.name for t in spark.catalog.listTables() if t.name.startswith("sales_")] == []
    with_cte = presets.run_sql(sales, "with t as (select * from sales where product_id = :p) select count(*) n from t -- x", p="A")
    assert with_cte.first().n == 120
    for text in ("drop view sales", "create table t as select 1", "insert into sales values (1)", "set a=b", "select 1) ; drop view sales --"):
        with pytest.raises(Exception):
            presets.run_sql(sales, text)


def test_low_stock_days_equal_pandas(sales):
    frame = sales.toPandas()
    need = frame.groupby("product_id").quantity_sold.transform("mean") * 7
    want = frame[frame.current_stock < need].groupby("product_name").size().to_dict()
    assert {r.product_name: r.low_stock_days for r in agg.low_stock_days(sales).collect()} == want


def test_histogram_counts_every_row(sales, make_sales):
    bins = agg.demand_histogram(sales).collect()
    values = np.array([r.quantity_sold for r in sales.select("quantity_sold").collect()])
    want, _ = np.histogram(values, bins=60)
    assert {r.bin: r.days for r in bins} == {i: n for i, n in enumerate(want) if n}
    assert [(r.bin, r.days) for r in agg.demand_histogram(make_sales({"A": [5, 5]})).collect()] == [(0, 2)]


def test_grid_has_all_months(sales):
    rows = agg.year_month_grid(feats.series_features(sales)).collect()
    assert {r.product_id for r in rows} == {"A", "B"}
    assert all(r.dec == 0 and isinstance(r.jan, int) for r in rows)


def test_catalog_movers_use_base_demand(catalog):
    got = {r.product_id: r.mover for r in agg.catalog_movers(catalog, rules.FAST_UNITS, rules.SLOW_UNITS).collect()}
    assert got == {"A": "fast", "B": "slow"}


def test_csv_round_trip_and_table(spark, sales, tmp_path):
    path = str(tmp_path / "csv")
    exports.export_csv(sales, path)
    assert sorted(source.scan_csv(spark, path).collect()) == sorted(sales.collect())
    table = str(tmp_path / "table")
    assert source.read_table(spark, table) is None
    assert source.profile(source.read_table(spark, table), spark).first().status == "not_initialised"
    source.load_table(spark, sales, table)
    assert source.load_table(spark, sales.limit(5), table).count() == 245
    assert source.load_table(spark, sales.filter("product_id = 'C'"), table, force_reload=True).count() == 25
    assert source.profile(source.read_table(spark, table)).first().asDict() == {
        "status": "ok", "rows": 25, "date_from": "2022-01-01", "date_to": "2022-01-25", "products": 1}


def test_filters_and_columns_reach_the_scan(spark, sales, tmp_path):
    table = source.load_table(spark, sales, str(tmp_path / "t"))
    plan = agg.product_sales(table, "A")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(product_id,A)" in plan and "lead_time_days" not in plan.split("ReadSchema")[1]


def test_revenue_fallback(sales):
    assert source.with_revenue(sales.drop("revenue")).filter("revenue <> round(quantity_sold * unit_price, 2)").isEmpty()
    assert {r.revenue for r in source.with_revenue(sales.drop("revenue", "unit_price")).collect()} == {0.0}


def test_reports(spark, sales, catalog, tmp_path):
    held = catalog.select("product_id", F.lit(1).alias("current_stock"))
    alerts = reports.alerts_report(sales, catalog, held).collect()
    assert len(alerts) == 2 and {r.alert_type for r in alerts} == {"CRITICAL"} and {r.status for r in alerts} == {None}
    forecast = reports.forecast_report(sales, catalog, held, horizon=7)
    exact = forecast.select("product_id", F.col("recommended_stock").alias("current_stock"))
    healthy = reports.alerts_report(sales, catalog, exact, horizon=7).collect()
    assert [(r.status, r.message, r.alert_type) for r in healthy] == [(*rules.NO_ALERTS, None)]
    daily = reports.daily_sales_report(feats.series_features(sales), catalog)
    assert daily.count() == 90 + 70 and {r.category for r in daily.collect()} == {"Fever", "Allergy"}
    tail = reports.daily_sales_tail(daily, 75).collect()
    assert [r.product_id for r in tail] == ["A"] * 5 + ["B"] * 70 and tail[-1].date == "2022-04-10"
    folders = exports.export_report({"Forecasts": forecast, "Daily Sales": daily}, str(tmp_path / "book"))
    assert exports.read_csv(spark, folders["Daily Sales"], daily).count() == 160


def test_training_and_comparison(spark, sales, catalog, tmp_path):
    path = str(tmp_path / "models")
    assert comparison.load_comparison(spark, path).isEmpty()
    got = comparison.train(sales, catalog, path, trees=2)
    rows = {(r.product_id, r.model): r for r in got.collect()}
    assert set(rows) == {(p, m) for p in "ABC" for m in ("Naive", "GBT", "AR")}
    assert {r.status for r in rows.values() if r.product_id == "C"} == {"too_short"} == {s for s in {r.status for r in rows.values()} if s != "evaluated"}
    assert rows["A", "Naive"].test_samples == 18 and rows["A", "AR"].test_samples == 12
    best = comparison.ranked(got).filter("rank = 1").collect()
    assert len(best) == 2 and all(r.notes == "Best" for r in best)
    stored = [json.loads(r.value) for r in spark.read.text(f"{comparison.artefacts(spark, path)}/json").collect()]
    assert {r["product_id"] for r in stored} == {"A", "B", "C"}
    assert set(next(r for r in stored if r["product_id"] == "A")["comparison"]) == {"Naive", "GBT", "AR"}


def test_models_learn_a_weekly_pattern(make_sales, catalog, tmp_path):
    weekly = make_sales({p: [20 + 30 * (day % 7 == 0) + shift for day in range(200)] for p, shift in (("A", 0), ("B", 40))})
    rows = {(r.product_id, r.model): r for r in comparison.train(weekly, catalog, str(tmp_path / "w"), trees=40).collect()}
    for product in "AB":
        naive = rows[product, "Naive"].mae
        assert rows[product, "GBT"].mae < 0.6 * naive and rows[product, "AR"].mae < 0.3 * naive


def test_a_series_may_be_too_short_for_the_sequence_model_only(make_sales, catalog, tmp_path):
    got = comparison.train(make_sales({"A": range(1, 100), "B": range(1, 62)}), catalog, str(tmp_path / "s"), trees=1).collect()
    assert {r.model: r.status for r in got if r.product_id == "B"} == {"Naive": "evaluated", "GBT": "evaluated", "AR": "too_short"}


def test_half_loaded_table_is_loaded_again(spark, sales, tmp_path):
    path = str(tmp_path / "table")
    source.load_table(spark, sales.limit(5), path)
    (tmp_path / "table" / "_SUCCESS").unlink()
    assert source.load_table(spark, sales, path).count() == 245
    with pytest.raises(Exception, match="quantity_sold is missing"):
        source.load_table(spark, sales.withColumn("quantity_sold", F.lit(None).cast("int")), str(tmp_path / "bad"))


def test_added_rows_replace_their_days(spark, make_sales, tmp_path):
    """Against a table kept as a dict: a row takes the place of its store, product and day; other years' files stay."""
    path = str(tmp_path / "table")
    with pytest.raises(ValueError, match="load it first"):
        source.add_rows(spark, make_sales({"A": [1]}), path)
    first = make_sales({"A": range(1, 800), "B": range(1, 500)}, start=date(2020, 1, 1))
    first = first.withColumn("store_id", F.when(F.col("product_id") == "A", F.col("store_id")))  # a null store is a store too
    source.load_table(spark, first, path)
    files_of = {y: {f.name for f in (tmp_path / "table" / f"year={y}").glob("*.parquet")} for y in (2020, 2021, 2022)}
    more = make_sales({"A": range(500, 600), "B": range(900, 1000), "N": [5, 5]}, start=date(2021, 4, 1))
    more = more.withColumn("store_id", F.when(F.col("product_id") != "B", F.col("store_id"))).withColumn("extra", F.lit(1))

    def rows(df):
        return {(r.store_id, r.product_id, r.date): r.quantity_sold for r in df.collect()}

    got = source.add_rows(spark, more, path)
    assert got.columns == first.columns and rows(got) == rows(first) | rows(more)
    assert got.count() == len(rows(first) | rows(more))
    for year, names in files_of.items():
        now = {f.name for f in (tmp_path / "table" / f"year={year}").glob("*.parquet")}
        assert (now == names) == (year != 2021)
    assert source.load_table(spark, more, path).count() == got.count()  # the table is complete
    counted = got.groupBy("product_id", F.trunc("date", "month").alias("month")).count()
    kept = source.month_counts(spark, path).select("product_id", "month", "rows")
    assert sorted(kept.collect()) == sorted(counted.collect())
    before = rows(got)
    with pytest.raises(Exception, match="quantity_sold is missing"):
        source.add_rows(spark, more.withColumn("quantity_sold", F.lit(None).cast("int")), path)
    assert rows(source.add_rows(spark, more.limit(0), path)) == before
    repeated = make_sales({"R": [7]}, start=date(2023, 1, 1))
    assert source.add_rows(spark, repeated.union(repeated), path).filter("product_id = 'R'").count() == 2


def test_an_empty_table_can_be_stored_and_grown(spark, make_sales, tmp_path):
    path, rows = str(tmp_path / "table"), make_sales({"A": [1, 2]})
    assert source.load_table(spark, rows.limit(0), path).count() == 0
    assert source.add_rows(spark, rows, path).count() == 2
    assert source.month_counts(spark, path).count() == 1


def test_a_name_of_two_categories_is_one_line_of_the_top_list(sales):
    both = sales.unionByName(sales.withColumn("category", F.lit("other")))
    assert len(presets.run_preset(both, "preset_top10_products").collect()) == 3


def test_training_of_selected_products(spark, sales, catalog, tmp_path):
    wanted = spark.createDataFrame([("B",), ("NONE",)], "product_id string")
    assert [r.product_id for r in comparison.unknown_products(wanted, catalog).collect()] == ["NONE"]
    got = comparison.train(sales, catalog, str(tmp_path / "m"), wanted, trees=1)
    assert {r.product_id for r in got.collect()} == {"B"}


def test_a_failed_training_leaves_the_one_before(spark, sales, catalog, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    before = sorted(comparison.train(sales, catalog, path, trees=1).collect())
    folder = comparison.artefacts(spark, path)

    def fails(*_, **__):
        raise RuntimeError("disk full")

    monkeypatch.setattr(comparison, "training_record", fails)
    with pytest.raises(RuntimeError, match="disk full"):
        comparison.train(sales, catalog, path, trees=2)
    assert comparison.artefacts(spark, path) == folder and sorted(comparison.load_comparison(spark, path).collect()) == before
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["training=0"]


def test_training_of_a_selection_keeps_the_other_products(spark, sales, catalog, tmp_path):
    path = str(tmp_path / "m")
    comparison.train(sales, catalog, path, trees=1)
    comparison.train(sales, catalog, path, spark.createDataFrame([("B",)], "product_id string"), trees=3)
    trees = {r.product_id: len(r.steps) for r in spark.read.parquet(f"{comparison.artefacts(spark, path)}/booster").collect()}
    assert set(trees) == {"A", "B"} and trees["B"] == 3 * trees["A"]  # C is too short for trees
    assert comparison.load_comparison(spark, path).count() == 9 == comparison.load_comparison(spark, path, 0).count()
    assert spark.read.text(f"{comparison.artefacts(spark, path)}/json").count() == 3
