"""Boosted regression trees over the tabular features, one model per series.

Features are cut into bins once, and from then on a tree only needs counts and sums of residuals by (node, feature, bin). Residuals are
whole numbers of 1/``SCALE`` units, so sums don't depend on the order or the place they were added up in. A series of up to
``LONG_ROWS`` training rows is trained within its group, all series side by side; a longer one never comes together: each
level of its trees is one Spark aggregate of partial histograms. Both ways give the same trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stockloom import rules
from stockloom.operators.features import is_train
from stockloom.operators.series import SERIES
from stockloom.session import scratch_path
from stockloom.sources import files

TREES, DEPTH, RATE = 300, 6, 0.05
#: Shares of the rows and of the features that a tree sees, and the shrinkage of leaves and gains.
ROW_SHARE, COLUMN_SHARE, SHRINK = 0.8, 0.8, 1.0
LEAST_GAIN = 1e-6

#: Bins of a feature; bin 0 holds what is missing.
BINS = 128
SCALE = 1024
NODES = 2 ** (DEPTH + 1) - 1
WIDTH = len(rules.TABULAR_FEATURES)

#: Training rows of a series up to which one task holds them: 32 bytes a row, and some 200 more while it works.
LONG_ROWS = 200_000
#: Training rows of a task on average, a second's work per hundred trees or so.
TASK_ROWS = 5_000
#: Rows of a series that are predicted together, and that a long series is packed by.
BLOCK_ROWS, PACKED_ROWS = 100_000, 1024

TREE_FIELDS = [
    T.StructField("features", T.ArrayType(T.ByteType())),
    T.StructField("bins", T.ArrayType(T.ByteType())),
    T.StructField("steps", T.ArrayType(T.LongType())),
]


# --- bins ----------------------------------------------------------------------------------


def feature_ranges(train: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Lowest and highest value of each feature and the number of training rows, one row per series."""
    values = [F.col(c).cast("double") for c in rules.TABULAR_FEATURES]
    return train.groupBy(*series).agg(
        F.array(*[F.min(v) for v in values]).alias("lows"), F.array(*[F.max(v) for v in values]).alias("highs"),
        F.count(F.lit(1)).alias("train_rows"), F.sum("quantity_sold").cast("long").alias("_units"))


def bin_of(value: Column, low: Column, high: Column) -> Column:
    """The bin of a value: equal parts of the training range, what lies outside in the outermost, what is missing in bin 0."""
    share = (value - low) / F.nullif(high - low, F.lit(0.0)) * (BINS - 1)
    inner = F.least(F.greatest(F.floor(F.coalesce(share, F.lit(0.0))), F.lit(0)), F.lit(BINS - 2))
    return F.when(value.isNull() | low.isNull(), F.lit(0)).otherwise(inner + 1).cast("long")


def binned(rows: DataFrame, ranges: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """``rows`` with the bins of all features in two numbers, ``codes_0`` and ``codes_1``, a byte a feature."""
    codes = [
        bin_of(F.col(c).cast("double"), F.col("lows")[i], F.col("highs")[i]) for i, c in enumerate(rules.TABULAR_FEATURES)]

    def packed(part: list[Column]) -> Column:
        total = F.lit(0).cast("long")
        for k, code in enumerate(part):
            total = total.bitwiseOR(F.shiftleft(code, 8 * k))
        return total

    return rows.join(ranges, list(series)).withColumns({"codes_0": packed(codes[:8]), "codes_1": packed(codes[8:])})


def unpacked(frame: pd.DataFrame) -> np.ndarray:
    """The bins, a row of bytes per row."""
    packed = np.column_stack([frame["codes_0"].to_numpy("<i8"), frame["codes_1"].to_numpy("<i8")])
    return np.ascontiguousarray(packed).view(np.uint8).reshape(len(frame), 16)[:, :WIDTH]


# --- what a tree sees ----------------------------------------------------------------------


def drawn_columns(tree: int, seed: int) -> np.ndarray:
    order = np.random.default_rng([seed, tree]).permutation(WIDTH)
    return np.sort(order[:max(1, int(WIDTH * COLUMN_SHARE))])


def drawn_rows(frame_no: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Which rows a tree is grown from: a hash of row number and tree, the same wherever the row is."""
    with np.errstate(over="ignore"):
        x = frame_no.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + tree) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x < np.uint64(int(ROW_SHARE * 2 ** 64))


# --- trees: heaps of nodes, children of i at 2i + 1 and 2i + 2 ---------------------------------


def empty_tree() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split feature (-1: leaf), last bin that goes left, and step of every node."""
    return np.full(NODES, -1, np.int8), np.zeros(NODES, np.int8), np.zeros(NODES, np.int64)


def routed(codes: np.ndarray, features: np.ndarray, bins: np.ndarray, levels: int = DEPTH) -> np.ndarray:
    """The node that each row has come to."""
    node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for _ in range(levels):
        feature = features[node]
        right = codes[rows, feature] > bins[node]
        node = np.where(feature < 0, node, 2 * node + 1 + right)
    return node


def histograms(codes: np.ndarray, residuals: np.ndarray, node: np.ndarray, level: int, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the rows in the nodes of a level, by (node, column, bin)."""
    first, width = 2 ** level - 1, 2 ** level
    here = node >= first
    cell = ((node[here, None] - first) * len(columns) + np.arange(len(columns))) * BINS + codes[here][:, columns]
    shape, size = (width, len(columns), BINS), width * len(columns) * BINS
    counts = np.bincount(cell.ravel(), minlength=size).reshape(shape)
    # Exact: whole numbers below 2 ** 53 in all.
    sums = np.bincount(cell.ravel(), np.repeat(residuals[here], len(columns)), size).reshape(shape)
    return counts, sums.astype(np.int64)


def split_level(tree, level: int, columns: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
    """Split the nodes of a level where that gains most, the first feature and lowest bin of equal ones; the others become leaves."""
    features, bins, steps = tree
    nodes = np.arange(2 ** level - 1, 2 ** (level + 1) - 1)
    n, total = counts[:, 0].sum(axis=1), sums[:, 0].sum(axis=1)
    steps[nodes] = np.rint(RATE * total / (n + SHRINK)).astype(np.int64)
    if level == DEPTH:
        return
    left_n, left = counts.cumsum(axis=2)[:, :, :-1], sums.cumsum(axis=2)[:, :, :-1] / SCALE
    all_n, whole = n[:, None, None], (total / SCALE)[:, None, None]
    right_n, right = all_n - left_n, whole - left
    gain = left * left / (left_n + SHRINK) + right * right / (right_n + SHRINK) - whole * whole / (all_n + SHRINK)
    gain = np.where((left_n > 0) & (right_n > 0), gain, 0.0).reshape(len(nodes), -1)
    best = gain.argmax(axis=1)
    worth = gain[np.arange(len(nodes)), best] > LEAST_GAIN
    features[nodes[worth]] = columns[best[worth] // (BINS - 1)]
    bins[nodes[worth]] = best[worth] % (BINS - 1)


# --- training ------------------------------------------------------------------------------


def fit_group(frame: pd.DataFrame, trees: int, seed: int) -> list[np.ndarray]:
    """All trees of one series: split features, bins and steps, tree after tree."""
    codes, frame_no = unpacked(frame), frame["frame_no"].to_numpy()
    residuals = frame["residual"].to_numpy("int64").copy()
    grown = []
    for number in range(trees):
        tree, columns = empty_tree(), drawn_columns(number, seed)
        seen = drawn_rows(frame_no, number, seed)
        seen_codes, seen_residuals = codes[seen], residuals[seen]
        for level in range(DEPTH + 1):
            node = routed(seen_codes, tree[0], tree[1], level)
            if not (node >= 2 ** level - 1).any():
                break
            split_level(tree, level, columns, *histograms(seen_codes, seen_residuals, node, level, columns))
        residuals -= tree[2][routed(codes, tree[0], tree[1])]
        grown.append(tree)
    return [np.concatenate(part) for part in zip(*grown)]


def tree_schema(rows: DataFrame, series: Sequence[str]) -> T.StructType:
    return T.StructType([*[rows.schema[k] for k in series], *TREE_FIELDS])


def fit_short(rows: DataFrame, series: Sequence[str], trees: int, seed: int, n_rows: int) -> DataFrame:
    keys = list(series)

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*frame[keys].iloc[0], *fit_group(frame, trees, seed)]], columns=[*keys, "features", "bins", "steps"])

    # A task's work is far more than its bytes tell, so that partitions must not be merged by size.
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) + n_rows // TASK_ROWS
    return rows.repartition(parts, *keys).groupBy(*keys).applyInPandas(train, tree_schema(rows, keys))


def packed_blocks(rows: DataFrame, series: Sequence[str]) -> DataFrame:
    """Rows in blocks of ``PACKED_ROWS``: a block's numbers, bins and residuals as bytes, so that a tree can be joined to blocks."""
    keys = list(series)
    fields = [T.StructField(c, T.BinaryType()) for c in ("numbers", "codes", "residuals")]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        parts = (frame["frame_no"].to_numpy("<i8"), np.ascontiguousarray(unpacked(frame)), frame["residual"].to_numpy("<i8"))
        return pd.DataFrame([[*frame[keys].iloc[0], *[part.tobytes() for part in parts]]], columns=[*keys, "numbers", "codes", "residuals"])

    return rows.groupBy(*keys, F.expr(f"frame_no div {PACKED_ROWS}")).applyInPandas(
        pack, T.StructType([*[rows.schema[k] for k in keys], *fields]))


def of_blocks(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, bins and residuals of some blocks of one series."""
    numbers, codes, residuals = (b"".join(frame[c]) for c in ("numbers", "codes", "residuals"))
    return np.frombuffer(numbers, "<i8"), np.frombuffer(codes, np.uint8).reshape(-1, WIDTH), np.frombuffer(residuals, "<i8")


def tree_of(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = {"features": np.int8, "bins": np.int8, "steps": np.int64}
    return tuple(np.array(frame[c].iloc[0], kind) for c, kind in kinds.items())


def level_histograms(blocks: DataFrame, series: Sequence[str], number: int, level: int, seed: int) -> DataFrame:
    """``cell, n, total`` per series: tasks add up what they hold of a series, and Spark adds up the tasks' sums."""
    keys, columns = list(series), drawn_columns(number, seed)
    schema = T.StructType([*[blocks.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in ("cell", "n", "total")]])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(keys, sort=False):
                numbers, codes, residuals = of_blocks(part)
                seen = drawn_rows(numbers, number, seed)
                codes, residuals = codes[seen], residuals[seen]
                node = routed(codes, *tree_of(part)[:2], level) if level else np.zeros(len(codes), np.int64)
                counts, sums = histograms(codes, residuals, node, level, columns)
                cell = np.flatnonzero(counts)
                yield pd.DataFrame({**dict(zip(keys, key)), "cell": cell, "n": counts.ravel()[cell], "total": sums.ravel()[cell]})

    return blocks.mapInPandas(partial, schema).groupBy(*keys, "cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def fit_long(rows: DataFrame, series: Sequence[str], trees: int, seed: int) -> DataFrame:
    """The same trees, level by level: a group holds a level's histogram, which is bounded, never a series' rows.

    Each level reads the blocks of all long series once and each tree writes them once; its predecessor's blocks are removed.
    """
    spark, keys = rows.sparkSession, list(series)
    schema = tree_schema(rows, keys)

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    def grown(number: int, level: int, histogram: DataFrame, before: DataFrame | None) -> DataFrame:
        columns = drawn_columns(number, seed)
        shape = (2 ** level, len(columns), BINS)

        def split(cells: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            parts = empty_tree() if tree.empty else tree_of(tree)
            if len(cells):
                counts, sums = np.zeros(np.prod(shape), np.int64), np.zeros(np.prod(shape), np.int64)
                counts[cells["cell"]], sums[cells["cell"]] = cells["n"], cells["total"]
                split_level(parts, level, columns, counts.reshape(shape), sums.reshape(shape))
            key = cells[keys].iloc[0] if len(cells) else tree[[f"_{k}" for k in keys]].iloc[0]
            return pd.DataFrame([[*key, *parts]], columns=schema.names)

        known = (spark.createDataFrame([], schema) if before is None else before).withColumnsRenamed({k: f"_{k}" for k in keys})
        return histogram.groupBy(*keys).cogroup(known.groupBy(*[f"_{k}" for k in keys])).applyInPandas(split, schema)

    def stepped(blocks: DataFrame, tree: DataFrame) -> DataFrame:
        """The blocks with what the tree leaves of the residuals."""
        columns = blocks.columns

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for i in range(len(batch)):
                    block = batch.iloc[i:i + 1]
                    _, codes, residuals = of_blocks(block)
                    features, bins, steps = tree_of(block)
                    out.append((residuals - steps[routed(codes, features, bins)]).astype("<i8").tobytes())
                yield batch[columns].assign(residuals=out)

        return blocks.join(tree, keys).mapInPandas(step, blocks.schema)

    blocks, path = kept(packed_blocks(rows, keys), "boosted")
    done = []
    for number in range(trees):
        tree = None
        for level in range(DEPTH + 1):
            seen = blocks if tree is None else blocks.join(tree, keys)
            tree, _ = kept(grown(number, level, level_histograms(seen, keys, number, level, seed), tree), "tree")
        done.append(tree.withColumn("number", F.lit(number)))
        before = path
        blocks, path = kept(stepped(blocks, tree), "boosted")
        files.remove(spark, before)
    # One row per series and tree: the list's length is the number of trees.
    listed = reduce(DataFrame.union, done).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("number", "features", "bins", "steps"))).alias("_trees"))
    return listed.select(*keys, *[F.flatten(f"_trees.{c}").alias(c) for c in ("features", "bins", "steps")])


def fit(
    features: DataFrame, trees: int = TREES, seed: int = 42, series: Sequence[str] = SERIES, long_rows: int = LONG_ROWS
) -> DataFrame:
    """Train on the training rows of each series: one row of bounds, start value and trees per series.

    Rows without a target stay out; a series without training rows has no model.
    """
    keys = list(series)
    train = features.filter(is_train()).filter("quantity_sold is not null").select(
        *keys, "frame_no", "quantity_sold", *rules.TABULAR_FEATURES)
    ranges = feature_ranges(train, keys).withColumn(
        "start", F.rint(F.col("_units") * SCALE / F.col("train_rows")).cast("long")).drop("_units")
    rows = binned(train, ranges, keys).withColumn("residual", F.col("quantity_sold").cast("long") * SCALE - F.col("start"))
    rows = rows.select(*keys, "frame_no", "codes_0", "codes_1", "residual", "train_rows")
    is_long = F.col("train_rows") > long_rows
    counts = ranges.agg(*[F.coalesce(F.sum(F.when(part, F.col("train_rows"))), F.lit(0)) for part in (~is_long, is_long)]).first()
    model = fit_short(rows.filter(~is_long).drop("train_rows"), keys, trees, seed, counts[0])
    if counts[1]:
        model = model.union(fit_long(rows.filter(is_long).drop("train_rows"), keys, trees, seed))
    return ranges.join(model, keys)


def predict(rows: DataFrame, model: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """``y_pred`` for each ``frame_no``, in units; forecasts below 0 become 0. Blocks of rows meet their series' model."""
    keys = list(series)
    block = F.expr(f"frame_no div {BLOCK_ROWS}").alias("_block")
    coded = binned(rows, model.select(*keys, "lows", "highs"), keys).select(*keys, "frame_no", "codes_0", "codes_1", block)
    wanted = rows.select(*keys, block).distinct().join(model.select(*keys, "start", "features", "bins", "steps"), keys)
    renamed = wanted.withColumnsRenamed({k: f"_{k}" for k in keys}).withColumnRenamed("_block", "_of_block")
    schema = T.StructType([*[rows.schema[k] for k in keys], rows.schema["frame_no"], T.StructField("y_pred", T.DoubleType())])

    def apply(frame: pd.DataFrame, of_series: pd.DataFrame) -> pd.DataFrame:
        features, bins, steps = (np.array(of_series[c].iloc[0]).reshape(-1, NODES) for c in ("features", "bins", "steps"))
        codes = unpacked(frame)
        total = np.full(len(frame), of_series["start"].iloc[0], np.int64)
        for f, b, s in zip(features, bins, steps):
            total += s[routed(codes, f, b)]
        return frame[[*keys, "frame_no"]].assign(y_pred=np.maximum(total / SCALE, 0.0))

    return coded.groupBy(*keys, "_block").cogroup(
        renamed.groupBy(*[f"_{k}" for k in keys], "_of_block")).applyInPandas(apply, schema)


def test_predictions(features: DataFrame, model: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Actual and predicted units over the test rows."""
    keys = list(series)
    split = F.floor(F.col("frame_rows").cast("double") * F.lit(rules.TRAIN_SHARE))
    rows = features.filter(~is_train())
    return rows.join(predict(rows, model, keys), [*keys, "frame_no"]).select(
        *keys, "date", (F.col("frame_no") - split).alias("step"), (F.col("frame_rows") - split).alias("steps"),
        F.col("quantity_sold").cast("double").alias("y"), "y_pred")


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """Stored trees; Spark's path error if nothing was trained yet."""
    return spark.read.parquet(path)
