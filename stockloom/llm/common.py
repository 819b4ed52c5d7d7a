"""Small helpers that the operators share."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockloom.session import scratch_path

#: What separates words: the ASCII white space characters (space, tab, line feed, vertical tab, form feed, return).
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, kept when an executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs meanwhile hands batches of about ``most`` bytes to mapInArrow, not 10,000 rows of any length, unless the session has a limit."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name)


def parts_for(spark: SparkSession, rows: int, rows_per_part: int) -> int:
    """How many parts to deal rows into: so that none is large, and every task slot gets some."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / rows_per_part))


def word_count(text: str | Column) -> Column:
    """The number of runs of characters other than ASCII white space; 0 for null."""
    spaced = F.trim(F.translate(text, ASCII_SPACE, " " * len(ASCII_SPACE)))
    return F.when(F.length(spaced) > 0, F.size(F.split(spaced, " +"))).otherwise(0).cast("long")


def in_blocks(texts: list[str | None], characters: int) -> Iterator[list[str | None]]:
    """Consecutive texts, as many at once as stay below a number of characters, or one."""
    block, held = [], 0
    for text in texts:
        if block and held + len(text or "") > characters:
            yield block
            block, held = [], 0
        block.append(text)
        held += len(text or "")
    if block:
        yield block
