"""Train the forecasters, score them side by side and keep the results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stockloom.operators import boosting, features as feats, forecast, regression
from stockloom.operators.metrics import forecast_metrics
from stockloom.operators.series import SERIES
from stockloom.session import scratch_path
from stockloom.sources.versions import Versions

NAIVE, BOOSTED, SEQUENCE = "Naive", "GBT", "AR"


def select_products(df: DataFrame, product_ids: DataFrame) -> DataFrame:
    """Rows of the requested products."""
    return df.join(product_ids, "product_id", "left_semi")


def unknown_products(product_ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requested products the catalog does not know."""
    return product_ids.join(catalog, "product_id", "left_anti")


def predictions(
    features: DataFrame,
    scaled: DataFrame | None = None,
    trees: int = 300,
    booster: DataFrame | None = None,
    weights: DataFrame | None = None,
    series: Sequence[str] = SERIES,
) -> DataFrame:
    """Test-span predictions of the three models, one below the other; models are trained unless given.

    The tabular models are tested on the last fifth of the feature rows, the sequence model on the
    last fifth of the sequences, which starts later.
    """
    scaled = feats.scaled(features, series=series) if scaled is None else scaled
    rows = regression.regression_rows(scaled, series)
    booster = boosting.fit(features, trees, series=series) if booster is None else booster
    weights = regression.fit(rows, series) if weights is None else weights
    frames = {
        NAIVE: forecast.naive_forecast(features, series),
        BOOSTED: boosting.test_predictions(features, booster, series),
        SEQUENCE: regression.test_predictions(rows, weights, series),
    }
    tagged = [frame.withColumn("model", F.lit(name)) for name, frame in frames.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def compare(products: DataFrame, tested: DataFrame) -> DataFrame:
    """Accuracy per product and model. A model for whose test span a series is too short has a status instead; that is so
    for the sequence model first."""
    scores = forecast_metrics(tested)
    models = F.explode(F.array(*[F.lit(m) for m in (NAIVE, BOOSTED, SEQUENCE)])).alias("model")
    return products.select("product_id", "product_name", models).join(scores, ["product_id", "model"], "left").withColumn(
        "status", F.when(F.col("test_samples").isNull(), "too_short").otherwise("evaluated")
    )


def training_record(features: DataFrame, tested: DataFrame) -> DataFrame:
    """Per product and model: rows of the feature frame, training and test rows, and the errors in units scaled by the
    product's range. Seconds per product mean nothing in a pooled job and aren't kept."""
    spans = features.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("frame_rows"),
        (F.max("quantity_sold") - F.min("quantity_sold")).cast("double").alias("_range"))
    error = (F.col("y") - F.col("y_pred")) / F.nullif(F.col("_range"), F.lit(0.0))
    return tested.join(spans, "product_id").groupBy("product_id", "model", "frame_rows").agg(
        F.count(F.lit(1)).alias("test_rows"), F.avg(error * error).alias("scaled_mse"), F.avg(F.abs(error)).alias("scaled_mae"),
    ).withColumn("train_rows", F.col("frame_rows") - F.col("test_rows"))


def recorded(comparison: DataFrame, record: DataFrame) -> DataFrame:
    """The comparison with the training record beside each score."""
    return comparison.join(record, ["product_id", "model"], "left")


def ranked(comparison: DataFrame) -> DataFrame:
    """The models of each product by MAE, the best one noted."""
    order = Window.partitionBy("product_id").orderBy("mae", "model")
    return (
        comparison.filter("status = 'evaluated'")
        .withColumn("rank", F.row_number().over(order))
        .withColumn("notes", F.when(F.col("rank") == 1, "Best").otherwise(""))
    )


def nested(comparison: DataFrame) -> DataFrame:
    """One row per product with the scores of each model as a struct; the status is that of its worst model."""
    def scores(model: str):
        fields = F.struct("mae", "rmse", "mape", "directional_accuracy")
        return F.max(F.when((F.col("model") == model) & F.col("mae").isNotNull(), fields)).alias(model)

    return (
        comparison.groupBy("product_id", "product_name")
        .agg(F.max("status").alias("status"), scores(NAIVE), scores(BOOSTED), scores(SEQUENCE))
        .select(
            "product_id", F.col("product_name").alias("name"), "status",
            F.struct(NAIVE, BOOSTED, SEQUENCE).alias("comparison"),
        )
    )


COMPARISON_SCHEMA = (
    "product_id string, product_name string, model string, test_samples bigint, mae double, rmse double, "
    "mape double, directional_accuracy double, status string"
)


#: The tables of a training.
PARTS = ("features", "scaler", "weights", "booster", "table", "record")


def save_comparison(comparison: DataFrame, folder: str) -> None:
    """The long table as Parquet, and per product as JSON."""
    comparison.write.parquet(f"{folder}/table")
    nested(comparison.sparkSession.read.parquet(f"{folder}/table")).write.json(f"{folder}/json")


def artefacts(spark: SparkSession, path: str, version: int | None = None) -> str | None:
    """The folder with all that a training stored (``features``, ``scaler``, ``weights``, ``booster``, ``table``, ``json``, ``record``), by
    default the newest one's; None if there was none."""
    versions = Versions(spark, path, "training")
    version = versions.newest() if version is None else version
    return None if version is None else versions.folder(version)


def load_comparison(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored table of a training, by default the newest; no rows if there was none."""
    folder = artefacts(spark, path, version)
    if folder is None:
        return spark.createDataFrame([], COMPARISON_SCHEMA)
    return spark.read.schema(COMPARISON_SCHEMA).parquet(f"{folder}/table")


def train(
    sales: DataFrame, catalog: DataFrame, path: str, product_ids: DataFrame | None = None, trees: int = 300
) -> DataFrame:
    """Train on all or the requested products, store scaler, models and scores; returns the scores.

    Everything goes into one new version, published when all of it is there: a failure half-way leaves the training before
    as it was, and nobody meets new weights beside old scores. A training of requested products takes over what the newest
    version has of the others. Of the versions the newest three and those of the last days stay.
    """
    spark = sales.sparkSession
    versions = Versions(spark, path, "training")
    if product_ids is None:
        number = versions.add(lambda folder: _train_into(folder, sales, catalog, trees))
    else:
        trained = scratch_path(spark, "training")
        _train_into(trained, select_products(sales, product_ids), select_products(catalog, product_ids), trees)
        number = versions.publish(lambda folder, newest: _merge_into(folder, spark, trained, None if newest is None else versions.folder(newest), product_ids))
    versions.remove_old(3)
    return load_comparison(spark, path, number)


def _merge_into(folder: str, spark: SparkSession, trained: str, before: str | None, product_ids: DataFrame) -> None:
    """What was trained, and what there was of other products before."""
    for part in PARTS:
        rows = spark.read.parquet(f"{trained}/{part}")
        if before:
            rows = spark.read.parquet(f"{before}/{part}").join(product_ids, "product_id", "left_anti").unionByName(rows)
        rows.write.parquet(f"{folder}/{part}")
    nested(spark.read.parquet(f"{folder}/table")).write.json(f"{folder}/json")


def _train_into(folder: str, sales: DataFrame, catalog: DataFrame, trees: int) -> None:
    spark = sales.sparkSession
    # The feature frame is used by both trainings and all scores, so it is written first.
    feats.series_features(sales).write.parquet(f"{folder}/features")
    features = spark.read.parquet(f"{folder}/features")
    feats.scaler_table(feats.scaler_params(features)).write.parquet(f"{folder}/scaler")
    scaled = feats.scaled(features, feats.scaler_from_table(spark.read.parquet(f"{folder}/scaler")))
    regression.save_weights(regression.fit(regression.regression_rows(scaled)), f"{folder}/weights")
    boosting.save_model(boosting.fit(features, trees), f"{folder}/booster")
    tested = predictions(
        features, scaled,
        booster=boosting.load_model(spark, f"{folder}/booster"), weights=regression.load_weights(spark, f"{folder}/weights"),
    )
    save_comparison(compare(catalog, tested), folder)
    training_record(features, tested).write.parquet(f"{folder}/record")
