"""The reservoir forecaster equals plain numpy loops, and learns what a line can't."""

from __future__ import annotations

import numpy as np
import pytest

from stockloom import rules
from stockloom.operators import features as feats, regression, reservoir


@pytest.fixture(scope="module")
def scaled(make_sales):
    rng = np.random.default_rng(3)
    days = np.arange(260)
    wave = 40 + 20 * np.sin(days / 5) + rng.integers(0, 6, 260)
    return feats.scaled(feats.series_features(make_sales({"A": wave, "B": rng.integers(1, 50, 120), "C": range(1, 70), "D": range(1, 50)}))).persist()


def plain_inputs(rows, length=rules.WINDOW_ROWS):
    """Inputs and targets of one series, one unit and one day at a time."""
    between, into, offset = reservoir.drawn()
    out = []
    for end in range(length, len(rows) + 1):
        state = [0.0] * reservoir.UNITS
        for day in rows[end - length:end]:
            drive = [sum(day[k] * into[k, u] for k in range(len(day))) + sum(state[v] * between[v, u] for v in range(len(state)))
                     for u in range(len(state))]
            state = [0.7 * s + 0.3 * np.tanh(d + o) for s, d, o in zip(state, drive, offset)]
        out.append([*state, *rows[end - 1], 1.0])
    return np.array(out)


def frame_of(scaled, product):
    return scaled.filter(scaled.product_id == product).orderBy("frame_no").toPandas()


@pytest.mark.parametrize("chunk_rows", [31, 8192])
def test_rows_and_fit_equal_numpy(scaled, chunk_rows):
    rows = reservoir.reservoir_rows(scaled, chunk_rows=chunk_rows)
    weights = {r.product_id: np.array(r.weights) for r in regression.fit(rows).collect()}
    tested = regression.test_predictions(rows, regression.fit(rows)).toPandas()
    for product in "BC":
        frame = frame_of(scaled, product)
        values = frame[list(rules.FEATURES)].to_numpy(float)
        x, y = plain_inputs(values)[:-1], values[30:, 0]
        mine = np.array([r.x for r in rows.filter(rows.product_id == product).orderBy("seq_no").collect()])
        np.testing.assert_allclose(mine, x, atol=1e-9)
        train = int(len(y) * 0.8)
        shrink = np.diag([1.0] * (x.shape[1] - 1) + [1e-9])
        want = np.linalg.solve(x[:train].T @ x[:train] + shrink, x[:train].T @ y[:train])
        np.testing.assert_allclose(weights[product], want, rtol=1e-6, atol=1e-8)
        low, high = frame.target_min[0], frame.target_max[0]
        got = tested[tested.product_id == product].sort_values("step")
        np.testing.assert_allclose(got.y_pred, x[train:] @ want * (high - low) + low, rtol=1e-6, atol=1e-6)
    assert set(weights) == {"A", "B", "C"}  # D has too few days for a window and its target


def test_roll_out_equals_a_loop(scaled):
    weights = regression.fit(reservoir.reservoir_rows(scaled))
    got = reservoir.roll_out(scaled, weights, 5).toPandas()
    w = {r.product_id: np.array(r.weights) for r in weights.collect()}
    for product in "AC":
        frame = frame_of(scaled, product)
        values, low, high = frame[list(rules.FEATURES)].to_numpy(float)[-30:], frame.target_min[0], frame.target_max[0]
        want = []
        for _ in range(5):
            y = float(plain_inputs(values)[-1] @ w[product])
            want.append(int(max(0.0, y * (high - low) + low) + 1e-9))
            values = np.vstack([values[1:], [y, *values[-1][1:]]])
        mine = got[got.product_id == product].sort_values("day_no")
        assert np.abs(np.array(mine.quantity) - want).max() <= 1 and list(mine.day_no) == [1, 2, 3, 4, 5]
    assert set(got.product_id) == {"A", "B", "C"}


def test_it_follows_a_wave(scaled):
    rows = reservoir.reservoir_rows(scaled)
    tested = regression.test_predictions(rows, regression.fit(rows)).filter("product_id = 'A'").toPandas()
    error = np.abs(tested.y - tested.y_pred).mean()
    assert error < 0.5 * np.abs(tested.y - tested.y.mean()).mean()


def test_weights_repeat_and_fade():
    a, b = reservoir.drawn(), reservoir.drawn()
    assert all((x == y).all() for x, y in zip(a, b))
    rng = np.random.default_rng(1)
    windows = rng.uniform(0, 1, (4, 30, len(rules.FEATURES)))
    changed = windows.copy()
    changed[:, 0] = 0
    late = windows.copy()
    late[:, -1] = 0
    far = np.abs(reservoir.states(windows, a) - reservoir.states(changed, a)).max()
    near = np.abs(reservoir.states(windows, a) - reservoir.states(late, a)).max()
    assert far < 0.1 * near  # old days fade, as they should


def test_no_rows(scaled):
    assert reservoir.reservoir_rows(scaled.limit(0)).count() == 0
