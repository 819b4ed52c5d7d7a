"""Stock ledger: a running balance that never falls below zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom import rules
from stockloom.functions.numeric import whole
from stockloom.operators.series import SERIES

# A block is what one task walks through; a series of n rows leaves n / BLOCK_ROWS rows to carry on.
BLOCK_ROWS = 65_536


def clamped_balance(
    numbered: DataFrame,
    change: Column,
    opening: Column,
    series: Sequence[str] = SERIES,
    block_rows: int = BLOCK_ROWS,
    name: str = "current_stock",
) -> DataFrame:
    """Add ``max(0, balance + change)`` carried from row to row of each numbered series.

    With ``s`` the opening plus all changes so far, the clamped balance is
    ``s - min(0, lowest s so far)``. Sums and minima combine, so each series is worked in blocks
    of rows: running figures inside the blocks, then one row per block to carry them on.
    """
    block = [*series, "_block"]
    rows = (
        numbered.withColumn("_block", F.expr(f"(row_no - 1) div {int(block_rows)}"))
        .withColumn("_change", change.cast("long"))
        .withColumn("_opening", opening.cast("long"))
    )
    so_far = Window.partitionBy(*block).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("_sum", F.sum("_change").over(so_far)).withColumn("_low", F.min("_sum").over(so_far))

    blocks = running.groupBy(*block).agg(F.sum("_change").alias("_total"), F.min("_sum").alias("_lowest"))
    earlier = Window.partitionBy(*series).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocks.withColumn("_start", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .withColumn("_floor", F.min(F.col("_start") + F.col("_lowest")).over(earlier))
        .select(*block, "_start", "_floor")
    )
    level = F.col("_opening") + F.col("_start") + F.col("_sum")
    # The opening is never negative, so only the rows' own levels can pull the minimum below 0.
    lowest = F.least(
        F.lit(0).cast("long"),
        F.col("_opening") + F.col("_start") + F.col("_low"),
        F.col("_opening") + F.col("_floor"),
    )
    return (
        running.join(carried, block)
        .withColumn(name, level - lowest)
        .drop("_block", "_change", "_opening", "_sum", "_low", "_start", "_floor")
    )


def stock_ledger(
    numbered: DataFrame,
    base: Column,
    factor: Column,
    lead: Column,
    delivery_factor: Column | float = rules.DELIVERY_FACTOR,
    opening_days: int = rules.OPENING_STOCK_DAYS,
    series: Sequence[str] = SERIES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Stock at the end of each day: a delivery every ``lead`` days, then the day's sales."""
    share = delivery_factor if isinstance(delivery_factor, Column) else F.lit(float(delivery_factor))
    arrives = (F.col("row_no") - 1) % lead == 0
    delivery = F.when(arrives, whole(base * factor * lead * share)).otherwise(F.lit(0))
    return clamped_balance(
        numbered, delivery - F.col("quantity_sold"), base * opening_days, series, block_rows
    )
