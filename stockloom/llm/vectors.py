"""Embeddings that take part in searches, and bounded samples of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from stockloom.llm.common import written


def usable(vector: str | Column) -> Column:
    """Whether a vector is neither null, empty nor zero and all its components are finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def one_per_id(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, vector`` (doubles, null if it takes no part), one row per id: of rows that repeat an id, the usable
    vector that sorts first. Vectors without id and those of another length than most take no part."""
    named = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    taking_part = F.when(F.col("vec_id").isNotNull() & usable("vector"), F.col("vector"))
    single = written(named.groupBy("vec_id").agg(F.min(taking_part).alias("vector")), "vectors")
    size = F.size("vector")
    common = single.filter("vector is not null").groupBy(size.alias("size")).count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return single
    return single.withColumn("vector", F.when(size == common["size"], F.col("vector")))


def sample(vectors: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` usable vectors, those with the smallest hash of their id; they fit an index on the driver."""
    rows = vectors.filter("vector is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("vector").toPandas()
    return np.array(rows["vector"].tolist(), np.float64) if len(rows) else np.zeros((0, 0))
