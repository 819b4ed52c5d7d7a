from __future__ import annotations

import random

import numpy as np
import pytest

from stockloom import rules
from stockloom.operators import boosting, features as feats


def plain_trees(rows, trees, seed):
    """Boosted trees by loops over lists: (number of the row, values, target) of one series to a function from values to a forecast."""
    lows = [min(v[f] for _, v, _ in rows) for f in range(boosting.WIDTH)]
    highs = [max(v[f] for _, v, _ in rows) for f in range(boosting.WIDTH)]

    def code(values, f):
        if values[f] is None:
            return 0
        share = 0.0 if highs[f] == lows[f] else (values[f] - lows[f]) / (highs[f] - lows[f]) * 127
        return min(max(int(share // 1), 0), 126) + 1

    start = round(sum(y for _, _, y in rows) * 1024 / len(rows))
    left_over = [y * 1024 - start for _, _, y in rows]
    coded = [[code(v, f) for f in range(boosting.WIDTH)] for _, v, _ in rows]

    def grow(seen, columns, depth):
        total = sum(left_over[i] for i in seen)
        node = {"step": round(0.05 * total / (len(seen) + 1.0))}
        if depth == 0:
            return node
        best = (1e-6, None)
        for f in columns:
            for last in range(127):
                left = [i for i in seen if coded[i][f] <= last]
                if not left or len(left) == len(seen):
                    continue
                a, b = sum(left_over[i] for i in left) / 1024, (total - sum(left_over[i] for i in left)) / 1024
                gain = a * a / (len(left) + 1.0) + b * b / (len(seen) - len(left) + 1.0) - (total / 1024) ** 2 / (len(seen) + 1.0)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, last))
        if best[1]:
            f, last = best[1]
            node |= {"f": f, "last": last, "left": grow([i for i in seen if coded[i][f] <= last], columns, depth - 1),
                     "right": grow([i for i in seen if coded[i][f] > last], columns, depth - 1)}
        return node

    def step(node, codes):
        while "f" in node:
            node = node["left"] if codes[node["f"]] <= node["last"] else node["right"]
        return node["step"]

    grown = []
    for number in range(trees):
        drawn = boosting.drawn_rows(np.array([n for n, _, _ in rows]), number, seed)
        tree = grow([i for i in range(len(rows)) if drawn[i]], list(boosting.drawn_columns(number, seed)), boosting.DEPTH)
        left_over = [r - step(tree, c) for r, c in zip(left_over, coded)]
        grown.append(tree)
    return lambda values: max(0.0, (start + sum(step(t, [code(values, f) for f in range(boosting.WIDTH)]) for t in grown)) / 1024)


@pytest.fixture(scope="module")
def frame(make_sales):
    draw = random.Random(4)
    series = {f"P{k}": [max(1, int(20 * k + 10 * ((i % 7) > 4) + draw.gauss(0, 5) + i * 0.1)) for i in range(60 + 70 * k)] for k in (1, 2, 3)}
    return feats.series_features(make_sales({**series, "P4": [5, 6, 7]})).cache()


def rows_of(frame):
    rows = frame.select("product_id", "frame_no", "quantity_sold", *rules.TABULAR_FEATURES, feats.is_train().alias("train")).collect()
    by_product = {}
    for r in rows:
        values = [None if r[c] is None else float(r[c]) for c in rules.TABULAR_FEATURES]
        by_product.setdefault(r.product_id, []).append((r.frame_no, values, r.quantity_sold, r.train))
    return by_product


def test_forecasts_are_the_plain_ones(frame):
    model = boosting.fit(frame, trees=4, seed=7)
    got = {(r.product_id, r.frame_no): r.y_pred for r in boosting.predict(frame, model).collect()}
    for product, rows in rows_of(frame).items():
        forecast = plain_trees([r[:3] for r in rows if r[3]], 4, 7)
        for frame_no, values, _, _ in rows:
            assert got[product, frame_no] == pytest.approx(forecast(values), abs=1e-9)


def test_long_series_get_the_same_trees(frame):
    def trees(**options):
        rows = boosting.fit(frame, trees=3, **options).collect()
        return {r.product_id: (r.start, list(r.features), list(r.bins), list(r.steps)) for r in rows}

    assert trees() == trees(long_rows=100) == trees(long_rows=0)


def test_places_and_order_of_rows_dont_matter(frame):
    def trees(df):
        return {r.product_id: (list(r.features), list(r.steps)) for r in boosting.fit(df, trees=2, long_rows=100).collect()}

    assert trees(frame) == trees(frame.orderBy("quantity_sold").repartition(5))


def test_more_trees_fit_better_and_beat_the_mean(frame):
    def error(trees):
        tested = boosting.test_predictions(frame, boosting.fit(frame, trees)).toPandas()
        return (tested.y - tested.y_pred).abs().mean()

    assert error(80) < 0.7 * error(1)


def test_missing_features_and_targets(spark, frame):
    holes = frame.selectExpr(
        *[c for c in frame.columns if c not in ("lag_7", "quantity_sold")],
        "if(frame_no % 9 = 0, null, lag_7) as lag_7", "if(frame_no % 11 = 0, null, quantity_sold) as quantity_sold")
    model = boosting.fit(holes, trees=2)
    assert model.count() == 3 and boosting.predict(holes, model).filter("y_pred is null").count() == 0


def test_series_without_training_rows_have_no_model(frame):
    model = boosting.fit(frame, trees=1)
    assert {r.product_id for r in model.collect()} == {"P1", "P2", "P3"}
    assert boosting.fit(frame.limit(0), trees=1).count() == 0


def test_a_stored_model_is_the_same(spark, frame, tmp_path):
    model = boosting.fit(frame, trees=2)
    boosting.save_model(model, f"file://{tmp_path}/trees")
    again = boosting.load_model(spark, f"file://{tmp_path}/trees")
    assert sorted(boosting.predict(frame, model).collect()) == sorted(boosting.predict(frame, again).collect())


def test_rows_of_a_long_series_never_meet_in_a_group(frame):
    """The plan of a level has no exchange of the rows: only of sums, and of the trees."""
    rows = boosting.binned(frame, boosting.feature_ranges(frame)).withColumn("residual", frame["quantity_sold"].cast("long"))
    blocks = boosting.packed_blocks(rows, ["product_id"])
    plan = boosting.level_histograms(blocks, ["product_id"], 0, 0, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("MapInPandas") and "total" in plan
