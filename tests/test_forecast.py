from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.operators import features as feats, forecast, regression
from stockloom.operators.metrics import forecast_metrics


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    made = {f"P{i:03d}": rng.integers(1, 150, 75 + i) for i in range(12)}
    made["FALL"] = np.concatenate([np.full(40, 500), np.arange(300, 1, -10)[:30] + rng.integers(0, 4, 30)])
    made["SHORT"] = rng.integers(1, 9, 33)
    return made


@pytest.fixture(scope="module")
def features(make_sales, data):
    return feats.series_features(make_sales(data)).persist()


def want_days(values, horizon, noise=None):
    last = np.asarray(values[30:][-30:], dtype=float)
    slope = np.polyfit(range(len(last)), last, 1)[0] if len(last) > 1 else 0
    extra = np.zeros(horizon) if noise is None else noise * last.std() * 0.3
    return [max(1, int(last.mean() + slope * d + extra[d])) for d in range(horizon)]


def test_trend_forecast_equals_polyfit(features, data):
    trend = forecast.recent_trend(features)
    got = forecast.forecast_days(trend, 60).orderBy("product_id", "day_no").toPandas()
    totals = {r.product_id: r.predicted_demand for r in forecast.with_total(trend, 60).collect()}
    for product, values in data.items():
        want = want_days(values, 60)
        assert list(got[got.product_id == product].quantity) == want
        assert totals[product] == sum(want)
    assert got[got.product_id == "FALL"].quantity.iloc[-1] == 1
    assert str(got[got.product_id == "SHORT"].date.iloc[0]) == "2022-02-03"


def test_noisy_forecast_uses_one_seeded_stream(features, data):
    noise = np.random.RandomState(42).standard_normal(60)
    trend = forecast.recent_trend(features)
    got = forecast.noisy_forecast_days(trend, 60).orderBy("product_id", "day_no").toPandas()
    spans = {(r.product_id, r.horizon): (r.predicted_demand, r.avg_forecast) for r in forecast.with_horizon_totals(trend).collect()}
    for product, values in data.items():
        want = want_days(values, 60, noise)
        assert list(got[got.product_id == product].quantity) == want
        for horizon in (7, 30, 60):
            assert spans[product, horizon] == (sum(want[:horizon]), np.mean(want[:horizon]))


def test_band(features):
    row = forecast.with_band(forecast.forecast_days(forecast.recent_trend(features), 1)).first()
    assert row.upper == row.quantity * 1.15 and row.lower == row.quantity * 0.85


def test_naive_repeats_last_training_value(features, data):
    got = forecast.naive_forecast(features).toPandas()
    for product, values in data.items():
        kept = values[30:]
        split = int(len(kept) * 0.8)
        mine = got[got.product_id == product].sort_values("step")
        assert list(mine.y) == list(kept[split:]) and set(mine.y_pred) == {kept[split - 1]}


def brute_metrics(y, p):
    y, p = np.asarray(y, float), np.asarray(p, float)
    some = y != 0
    return (
        np.abs(y - p).mean(), np.sqrt(((y - p) ** 2).mean()),
        np.abs((y[some] - p[some]) / y[some]).mean() * 100 if some.any() else None,
        (np.sign(np.diff(y)) == np.sign(np.diff(p))).mean() * 100 if len(y) > 1 else None,
    )


@pytest.mark.parametrize("chunk_rows", [1, 3, 8192])
def test_metrics_equal_numpy(spark, chunk_rows):
    rng = np.random.default_rng(1)
    series = {"A": rng.integers(0, 9, 50), "B": rng.integers(0, 9, 2), "ONE": [5], "ZERO": [0, 0, 0]}
    rows, want = [], {}
    for product, y in series.items():
        p = rng.integers(0, 9, len(y))
        want[product] = brute_metrics(y, p)
        rows += [(product, "m", i + 1, len(y), float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    df = spark.createDataFrame(rows, "product_id string, model string, step long, steps long, y double, y_pred double")
    for r in forecast_metrics(df, chunk_rows=chunk_rows).collect():
        got = (r.mae, r.rmse, r.mape, r.directional_accuracy)
        for g, w, digits in zip(got, want[r.product_id], (4, 4, 2, 2)):
            assert (g is None) == (w is None)
            assert g is None or abs(g - w) <= 0.6 * 10 ** -digits
        assert r.test_samples == len(series[r.product_id])


@pytest.fixture(scope="module")
def trained(features):
    scaled = feats.scaled(features).persist()
    rows = regression.regression_rows(scaled, chunk_rows=33).persist()
    return scaled, rows, regression.fit(rows).persist()


def test_regression_equals_numpy(trained):
    _, rows, weights = trained
    frame = rows.filter("is_train").toPandas()
    got = {r.product_id: np.array(r.weights) for r in weights.collect()}
    assert "SHORT" not in got
    for product, w in got.items():
        mine = frame[frame.product_id == product]
        x, y = np.stack([np.asarray(v) for v in mine.x]), mine.y.to_numpy()
        shrink = np.diag([regression.RIDGE] * (x.shape[1] - 1) + [1e-9])
        np.testing.assert_allclose(w, np.linalg.solve(x.T @ x + shrink, x.T @ y), rtol=1e-6, atol=1e-8)


def test_regression_learns_a_pattern(make_sales):
    week = np.tile([10, 40, 90, 20, 60, 30, 80], 60)
    features = feats.series_features(make_sales({"A": week}))
    rows = regression.regression_rows(feats.scaled(features))
    tested = regression.test_predictions(rows, regression.fit(rows, ridge=1e-6)).toPandas()
    assert np.abs(tested.y - tested.y_pred).max() < 1


def test_inputs_are_the_rows_before(trained):
    scaled, rows, _ = trained
    frame = scaled.filter("product_id = 'P003'").orderBy("date").toPandas()
    names = list(scaled.columns)
    got = rows.filter("product_id = 'P003'").orderBy("date").toPandas()
    from stockloom import rules

    for i, x in enumerate(got.x):
        np.testing.assert_allclose(x[:30], frame.quantity_sold[i:i + 30])
        np.testing.assert_allclose(x[30:46], frame.iloc[i + 29][list(rules.TABULAR_FEATURES)].astype(float))
        assert x[46] == 1 and len(x) == 47
    assert names.count("target_min") == 1


def test_roll_out_equals_loop(trained):
    scaled, _, weights = trained
    from stockloom import rules

    got = regression.roll_out(scaled, weights, 10).toPandas()
    frame = scaled.toPandas()
    for r in weights.collect():
        mine = frame[frame.product_id == r.product_id].sort_values("date")
        w = np.array(r.weights)
        past, rest = list(mine.quantity_sold[-30:]), mine.iloc[-1][list(rules.TABULAR_FEATURES)].to_numpy(float)
        low, high = mine.target_min.iloc[0], mine.target_max.iloc[0]
        want = []
        for _ in range(10):
            value = np.dot(past, w[:30]) + np.dot(rest, w[30:46]) + w[46]
            want.append(int(max(0, value * (high - low) + low)))
            past = past[1:] + [value]
        assert list(got[got.product_id == r.product_id].sort_values("day_no").quantity) == want


def test_weights_are_stored(spark, trained, tmp_path):
    path = str(tmp_path / "weights")
    regression.save_weights(trained[2], path)
    assert regression.load_weights(spark, path).count() == trained[2].count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        regression.load_weights(spark, str(tmp_path / "none"))


def test_predictions_keep_every_test_row(trained):
    _, rows, weights = trained
    tested = regression.test_predictions(rows, weights)
    expected = rows.filter(~F.col("is_train")).join(weights, "product_id", "left_semi").count()
    assert tested.count() == expected
