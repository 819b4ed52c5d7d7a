"""Chunked windows give what plain per-series pandas work gives, also for a very long series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stockloom import rules
from stockloom.operators import features as feats, ledger, series
from stockloom.sources.sales import dated


@pytest.fixture(scope="module")
def skewed(make_sales):
    """One product holds about two thirds of all rows."""
    rng = np.random.default_rng(5)
    sizes = {"HOT": 420, "A": 100, "B": 61, "C": 31, "D": 1}
    return {p: rng.integers(1, 90, n) for p, n in sizes.items()}


def brute_features(values):
    q = pd.Series(values, dtype=float)
    frame = pd.DataFrame({
        "quantity_sold": q, "lag_1": q.shift(1), "lag_7": q.shift(7), "lag_30": q.shift(30),
        "rolling_mean_7": q.rolling(7, min_periods=1).mean(),
        "rolling_mean_30": q.rolling(30, min_periods=1).mean(),
        "rolling_std_7": q.rolling(7, min_periods=1).std().fillna(0),
    })
    return frame.dropna(subset=["lag_30"]).reset_index(drop=True)


@pytest.mark.parametrize("chunk_rows", [30, 41, 8192])
def test_features_equal_pandas(make_sales, skewed, chunk_rows):
    got = feats.series_features(make_sales(skewed), chunk_rows=chunk_rows).toPandas()
    for product, values in skewed.items():
        want = brute_features(values)
        mine = got[got.product_id == product].sort_values("date").reset_index(drop=True)
        assert len(mine) == len(want) == max(0, len(values) - 30)
        for column in want:
            np.testing.assert_allclose(mine[column].astype(float), want[column], rtol=1e-12, atol=1e-9)
        assert list(mine.frame_no) == list(range(1, len(want) + 1))
        assert set(mine.frame_rows) <= {len(want)}


def test_shifted_features_leave_the_row_out(make_sales):
    values = list(range(1, 51))
    got = feats.series_features(make_sales({"A": values}), shifted=True, chunk_rows=33).orderBy("date").toPandas()
    q = pd.Series(values, dtype=float)
    want = q.shift(1).rolling(7, min_periods=1).mean()[30:]
    np.testing.assert_allclose(got.rolling_mean_7, want)


def test_warm_up_rows_can_be_kept(make_sales):
    got = feats.series_features(make_sales({"A": [4]}), keep_warm_up=True).first()
    assert got.rolling_std_7 == 0 and got.lag_1 is None and got.lag_30 is None


def test_numbers_and_first_values(spark):
    rows = [("A", "2022-03-05", "late"), ("A", "2022-01-02", "early"), ("B", "2022-02-01", "b"), ("A", "2022-01-01", None)]
    df = dated(spark.createDataFrame(rows, "product_id string, date string, category string"))
    want = {("A", "2022-01-01"): (1, 3), ("A", "2022-01-02"): (2, 3), ("A", "2022-03-05"): (3, 3), ("B", "2022-02-01"): (1, 1)}
    numbered = series.number_rows(df).collect()
    assert {(r.product_id, str(r.date)): (r.row_no, r.series_rows) for r in numbered} == want
    for chunk_rows in (1, 2, 100):
        rows = series.uncut(series.number_and_cut(df, 1, chunk_rows=chunk_rows, first=("category",))).collect()
        assert {(r.product_id, str(r.date)): (r.row_no, r.series_rows) for r in rows} == want
        assert {(r.product_id, r.first_category) for r in rows} == {("A", None), ("B", "b")}


def test_no_window_group_outgrows_a_chunk(make_sales, skewed):
    numbered = series.number_rows(dated(make_sales(skewed)))
    groups = series.cut(numbered, 30, 50).groupBy("product_id", "chunk").count().collect()
    assert max(r["count"] for r in groups) <= 80
    assert sum(r["count"] for r in groups if r.product_id == "HOT") == 420 + 30 * 8
    # chunks of whole months: at most a month more, and two months of rows before
    groups = series.number_and_cut(dated(make_sales(skewed)), 30, chunk_rows=50).groupBy("product_id", "chunk").count()
    assert max(r["count"] for r in groups.collect()) <= 50 + 31 + 62


def test_sparse_and_dense_months(spark):
    """Months of very different size, so that chunks are skipped and short ones follow each other."""
    rng = np.random.default_rng(2)
    sizes = [3, 200, 1, 1, 90, 2, 60, 5, 5, 5, 70, 1]
    rows = [("A", f"2022-{m + 1:02d}-01", i, int(rng.integers(1, 99))) for m, n in enumerate(sizes) for i in range(n)]
    df = dated(spark.createDataFrame(rows, "product_id string, date string, n int, quantity_sold int"))
    want = pd.Series([r[3] for r in rows])
    for chunk_rows in (30, 31, 64):
        cut = series.number_and_cut(df, 30, order=("date", "n"), chunk_rows=chunk_rows)
        by = series.chunk_order(order=("date", "n"))
        got = series.uncut(cut.withColumn("lag", F.lag("quantity_sold", 30).over(by))).orderBy("row_no").toPandas()
        assert list(got.row_no) == list(range(1, len(rows) + 1))
        assert list(got.lag.fillna(-1)) == list(want.shift(30).fillna(-1))


def test_halo_must_fit_a_chunk(make_sales):
    numbered = series.number_rows(dated(make_sales({"A": [1]})))
    with pytest.raises(ValueError):
        series.cut(numbered, 30, 29)


@pytest.mark.parametrize("block_rows", [1, 7, 512])
def test_ledger_equals_loop(make_sales, block_rows):
    rng = np.random.default_rng(8)
    data = {"A": rng.integers(1, 60, 200), "B": rng.integers(1, 20, 45), "C": rng.integers(30, 90, 130)}
    base, lead, factor = 10, 4, 1.5
    numbered = series.number_rows(dated(make_sales(data)).drop("current_stock"))
    got = ledger.stock_ledger(
        numbered, F.lit(base), F.lit(factor), F.lit(lead), block_rows=block_rows
    ).orderBy("product_id", "date").toPandas()
    for product, values in data.items():
        stock, want = base * rules.OPENING_STOCK_DAYS, []
        for day, sold in enumerate(values):
            if day % lead == 0:
                stock += int(base * factor * lead * rules.DELIVERY_FACTOR)
            stock = max(0, stock - sold)
            want.append(stock)
        assert list(got[got.product_id == product].current_stock) == want
    assert (got.current_stock == 0).any()


def test_sequences_equal_numpy(make_sales, skewed):
    features = feats.series_features(make_sales(skewed))
    got = feats.sequences(feats.scaled(features), chunk_rows=37).toPandas()
    frame = features.toPandas()
    for product in skewed:
        rows = frame[frame.product_id == product].sort_values("date")[list(rules.FEATURES)].to_numpy(float)
        mine = got[got.product_id == product].sort_values("date")
        assert len(mine) == max(0, len(rows) - 30)
        if not len(mine):
            continue
        low, high = rows.min(axis=0), rows.max(axis=0)
        scaled = (rows - low) / np.where(high == low, 1, high - low)
        for i, (x, y, seq_no) in enumerate(zip(mine.x, mine.y, mine.seq_no)):
            np.testing.assert_allclose(np.stack([np.asarray(v) for v in x]), scaled[i:i + 30], atol=1e-12)
            assert seq_no == i + 1 and abs(y - scaled[i + 30, 0]) < 1e-12


def test_moving_averages_wait_for_a_full_frame(make_sales):
    values = np.arange(1, 81)
    got = feats.moving_averages(feats.series_features(make_sales({"A": values})), chunk_rows=31).orderBy("date").toPandas()
    kept = pd.Series(values[30:], dtype=float)
    np.testing.assert_allclose(got.ma_7, kept.rolling(7).mean())
    np.testing.assert_allclose(got.ma_30, kept.rolling(30).mean())


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_a_month_with_a_third_of_all_rows(spark, broadcast):
    """Same features as uncut pandas work; neither a range nor a window group grows with the hot month."""
    rng = np.random.default_rng(4)
    sizes = {("HOT", "2022-03-05"): 4000, ("HOT", "2022-03-06"): 500, ("HOT", "2021-01-01"): 20}
    sizes |= {(p, f"2022-{m:02d}-{d:02d}"): 10 for p in "ABCDE" for m in (1, 2, 3, 7) for d in (1, 9)} | {("F", "2022-01-01"): 7000}
    rows = [(p, day, n, int(rng.integers(1, 99)), f"{p}-{day}") for (p, day), count in sizes.items() for n in range(count)]
    want = pd.DataFrame(rows, columns=["product_id", "date", "n", "quantity_sold", "category"]).sort_values(["product_id", "date", "n"])
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "product_id string, date string, n int, quantity_sold int, category string").repartition(6)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        numbered = series.number_dense(dated(df), order=("date", "n"), first=("category",))
        got = feats.series_features(df, order=("date", "n"), dense=True, chunk_rows=600, keep_warm_up=True)
        mine = got.toPandas().sort_values(["product_id", "row_no"]).reset_index(drop=True)
        plain = feats.series_features(df, order=("date", "n"), keep_warm_up=True).toPandas()
        groups = series.cut(numbered, 30, 600).groupBy("product_id", "chunk").count().collect()
        firsts = {(r.product_id, r.first_category) for r in numbered.select("product_id", "first_category").distinct().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert list(zip(mine.product_id, mine.n, mine.quantity_sold)) == list(zip(want.product_id, want.n, want.quantity_sold))
    by = want.groupby("product_id")["quantity_sold"]
    assert list(mine.row_no) == list(want.groupby("product_id").cumcount() + 1)
    assert list(mine.series_rows) == list(by.transform("size"))
    np.testing.assert_allclose(mine.lag_30.astype(float), by.shift(30).reset_index(drop=True))
    np.testing.assert_allclose(
        mine.rolling_mean_30, by.rolling(30, min_periods=1).mean().reset_index(level=0, drop=True).reset_index(drop=True))
    plain = plain.sort_values(["product_id", "row_no"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(mine[sorted(mine)], plain[sorted(plain)], check_dtype=False, atol=1e-9, rtol=1e-12)
    assert firsts == {(p, min(c for _, _, _, _, c in rows if c.startswith(p))) for p in {r[0] for r in rows}}
    assert max(r["count"] for r in groups) <= 630
    # ranges: rows of the hot month are dealt over several
    ranged = dated(df).repartitionByRange(8, "product_id", "date", "n")
    hot = ranged.filter("product_id = 'HOT'").groupBy(F.spark_partition_id()).count().collect()
    assert len(hot) >= 2 and max(r["count"] for r in hot) <= 2 * len(rows) / 8


def test_dense_numbers_of_an_empty_table(make_sales):
    assert series.number_dense(dated(make_sales({"A": [1]}).limit(0))).count() == 0
