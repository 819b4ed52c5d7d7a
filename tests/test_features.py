from __future__ import annotations

import shutil
from datetime import date

import pytest
from pyspark.sql import functions as F

from stockloom import rules
from stockloom.functions import calendar
from stockloom.operators import features as feats
from stockloom.sources import sales


def test_calendar_of_new_year(make_sales):
    row = feats.base_features(make_sales({"A": [1]})).first()
    assert (row.month, row.day_of_week, row.day_of_month, row.quarter, row.is_weekend) == (1, 5, 1, 1, 1)
    assert (row.season, row.season_encoded, row.is_festival_month) == ("Winter", 3, 1)
    assert abs(row.week_cos - 1) < 1e-12  # ISO week 52


def test_season_of_each_month(spark):
    months = spark.range(0, 14).select("id", calendar.season_of_month("id").alias("s")).collect()
    by_month = {r.id: r.s for r in months}
    assert by_month[0] == by_month[13] == "Unknown"
    assert [by_month[m] for m in (2, 3, 5, 6, 9, 10, 11, 12)] == [
        "Winter", "Summer", "Summer", "Monsoon", "Monsoon", "Post-Monsoon", "Post-Monsoon", "Winter"]
    codes = spark.createDataFrame([("Summer",), ("Winter",), ("Unknown",)], "s string").select(calendar.season_code("s"))
    assert [r[0] for r in codes.collect()] == [0, 3, 0]


def test_peak_season_uses_first_category(spark, make_sales):
    flags = spark.createDataFrame([("Monsoon", "fever"), ("Monsoon", "allergy"), ("Winter", None)], "s string, c string")
    assert [r[0] for r in flags.select(calendar.peak_season_flag("s", "c")).collect()] == [1, 0, 0]
    sales = make_sales({"A": [1] * 40}, category="fever").withColumn(
        "category", F.when(F.col("date") > "2022-01-15", "allergy").otherwise("fever"))
    assert {r.is_peak_disease_season for r in feats.series_features(sales).collect()} == {1}


def test_row_counts_at_the_borders(make_sales):
    features = feats.series_features(make_sales({"A": range(1, 2), "B": range(1, 32), "C": range(1, 62)}))
    rows = {r.product_id: r["count"] for r in features.groupBy("product_id").count().collect()}
    assert rows == {"B": 1, "C": 31}
    assert feats.sequences(feats.scaled(features)).count() == 1


def test_constant_feature_scales_to_zero_and_back(make_sales):
    features = feats.series_features(make_sales({"A": [7] * 40}))
    row = feats.scaled(features).select("quantity_sold", feats.unscaled(F.col("quantity_sold")).alias("back")).first()
    assert (row.quantity_sold, row.back) == (0.0, 7.0)


def test_scaler_table_round_trip(make_sales):
    features = feats.series_features(make_sales({"A": range(1, 70), "B": range(5, 50)}))
    wide = feats.scaler_params(features)
    again = feats.scaler_from_table(feats.scaler_table(wide)).select(*wide.columns)
    assert sorted(wide.collect()) == sorted(again.collect())


def test_vectors_have_fixed_order_and_zero_for_missing(make_sales):
    features = feats.series_features(make_sales({"A": range(1, 33)})).drop("week_sin")
    vector = feats.feature_vectors(features).orderBy("date").first().features
    assert len(vector) == len(rules.FEATURES) == 17
    assert vector[0] == 31 and vector[6] == 0 and vector[11] == 30
    assert len(feats.tabular(features).first().x) == 16


def test_split_keeps_order(make_sales):
    features = feats.series_features(make_sales({"A": [3] * 1096}))
    counts = features.groupBy(feats.is_train().alias("t")).count().collect()
    assert {r.t: r["count"] for r in counts} == {True: 852, False: 214}
    sets = feats.training_set(features).groupBy("is_train").count().collect()
    assert {r.is_train: r["count"] for r in sets} == {True: 828, False: 208}


def test_numbers_agree_with_kept_rows_when_a_quantity_is_null(make_sales):
    sales = make_sales({"A": range(1, 101)}).withColumn("quantity_sold", F.when(F.col("date") != "2022-02-20", F.col("quantity_sold")))
    rows = feats.series_features(sales).orderBy("frame_no").collect()
    assert [r.frame_no for r in rows] == list(range(1, 71)) and {r.frame_rows for r in rows} == {70}


def test_last_rows_equal_the_end_of_the_feature_frame(make_sales):
    sales = make_sales({"A": range(1, 201), "B": range(1, 51), "C": range(1, 20), "D": range(1, 32)})
    columns = ("product_id", "date", "quantity_sold", "frame_no", "frame_rows")
    features = feats.series_features(sales)
    for n in (1, 30, 90):
        wanted = features.filter(features.frame_no > features.frame_rows - n).select(*columns)
        assert sorted(feats.last_rows(sales, n).select(*columns).collect()) == sorted(wanted.collect())
    plan = feats.last_rows(sales, 30)._jdf.queryExecution().executedPlan().toString()
    assert "lag(" not in plan


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_last_rows_read_the_years_that_hold_them(spark, make_sales, tmp_path, broadcast):
    """Products that end in different years: years before the first month that is needed aren't opened."""
    long = make_sales({"A": range(1, 900), "B": range(1, 800)}, start=date(2019, 3, 1))
    path = str(tmp_path / "sales")
    sales.load_table(spark, long.union(make_sales({"C": range(1, 40)}, start=date(2021, 2, 1))), path)
    stored, months = sales.by_year(spark, path), sales.month_counts(spark, path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        for n in (1, 30, 90):
            wanted = sorted(feats.last_rows(stored.drop("year"), n).collect())
            assert sorted(feats.last_rows(stored, n, months=months).collect()) == wanted
            assert sorted(feats.last_rows(stored, n).collect()) == wanted
        got = feats.last_rows(stored, 30, months=months)
        plan = got._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line and "quantity_sold" in line]
        assert len(scans) == 1 and "year#" in scans[0].split("PartitionFilters")[1].split("PushedFilters")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # files listed before and gone now aren't missed
    for year in (2019, 2020):
        shutil.rmtree(tmp_path / "sales" / f"year={year}")
    assert feats.last_rows(stored, 30, months=months).count() == 30 + 30 + 9
