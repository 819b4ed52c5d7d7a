"""Stock counts as a stream: the newest count of each product is kept as state, and what changes goes to the stored inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from stockloom.operators.inventory import latest_counts
from stockloom.sources.inventory_store import InventoryStore


def newest_counts(counts: DataFrame) -> DataFrame:
    """The newest count (product_id, new_quantity, ts) of each product seen so far, as a streaming aggregate.

    Counts are combined before the shuffle, so a hot product costs a row per task; the state is one row per product. A late count
    leaves the state as it is, of counts of the same moment the largest stays.
    """
    return latest_counts(counts).select("product_id", F.col("_quantity").alias("new_quantity"), F.col("_ts").alias("ts"))


def apply_counts(
    counts: DataFrame, open_store: Callable[..., InventoryStore], checkpoint: str
) -> StreamingQuery:
    """Apply a stream of counts (product_id, new_quantity, ts) until its source is used up.

    Each micro-batch publishes the products whose counts came in it, never the whole inventory. The newest count of a
    product wins by its time, so a batch that runs again after a failure changes nothing.
    """

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        open_store(batch.sparkSession).append(batch)

    return (
        newest_counts(counts).writeStream.outputMode("update").foreachBatch(apply_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
