"""Deriving sales from order lines when one part number holds a third of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stockloom.sources.lineitem_sales import daily_units


@pytest.fixture(scope="module")
def hot_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hot"))
    lines = spark.range(0, 600_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).cast("long").alias("l_partkey"),
        (F.col("id") % 50 + 1).cast("double").alias("l_quantity"),
        F.date_add(F.lit("1995-01-01"), (F.col("id") % 900).cast("int")).cast("timestamp_ntz").alias("l_shipdate"),
        F.sha2(F.col("id").cast("string"), 256).alias("l_comment"),
    )
    lines.write.parquet(f"{path}/lineitem.parquet")
    spark.range(5000).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("id") % 25 + 1).alias("p_brand"),
        (F.col("id") % 7 + 1).cast("double").alias("p_retailprice"),
    ).write.parquet(f"{path}/part.parquet")
    return path


def result(spark, path):
    return sorted(map(tuple, daily_units(spark, path).collect()))


def test_hot_part_is_split_and_nothing_is_lost(spark, hot_dir):
    broadcast = result(spark, hot_dir)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        df = daily_units(spark, hot_dir)
        shuffled = sorted(map(tuple, df.collect()))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert "SortMergeJoin" in plan and "skew=true" in plan
    assert shuffled == broadcast
    assert sum(row[2] for row in shuffled) == sum(i % 50 + 1 for i in range(600_000))
    assert "l_comment" not in plan
