"""Pairs of 64-bit codes that differ in few bits, found through tables of bit groups.

A table is a group of bit positions. Every code is an *entry* under its own key in each table and a *probe* under all
keys within a radius of it. Entries and probes that meet under a key are compared in whole, block by block, with
numpy; a key with more rows than a block is cut into a grid of blocks, so that no task gets all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stockloom.llm.common import parts_for, written

Tables = Sequence[Sequence[int]]  # the bit positions of each table, lowest first

#: Rows under one key before it is cut, rows that a group of keys holds on average, and candidates compared at once.
BLOCK_ROWS = 4_000
GROUP_ROWS = 100_000
COMPARED = 2_000_000


def keys_of(codes: np.ndarray, bits: Sequence[int]) -> np.ndarray:
    """The values that the given bits of the codes make."""
    codes = codes.view(np.uint64) if codes.dtype == np.int64 else codes
    out = np.zeros(len(codes), np.int64)
    for place, bit in enumerate(bits):
        out |= (((codes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)) << place
    return out


def flips(width: int, radius: int) -> np.ndarray:
    """Masks that flip exactly ``radius`` of ``width`` bits."""
    return np.array([sum(1 << i for i in chosen) for chosen in combinations(range(width), radius)], np.int64)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def meet(df: DataFrame, tables: Tables, radii: Callable[[np.ndarray], np.ndarray], largest: int = 2) -> DataFrame:
    """``cell, id, code, probe`` rows of a frame of distinct ``id`` and their ``code``.

    ``radii(codes)`` gives the radius of each code (row) in each table (column), ``largest`` at most; -1 leaves the table
    out. A cell is a key of a table; its lowest 8 bits are the table's number.
    """
    masks = [[flips(len(bits), r) for r in range(largest + 1)] for bits in tables]

    def emit(batches):
        for batch in batches:
            ids, codes = batch["id"].to_numpy(np.int64), batch["code"].to_numpy(np.int64)
            reach = radii(codes)
            for t, bits in enumerate(tables):
                keys = keys_of(codes, bits)
                yield pd.DataFrame({"cell": keys << 8 | t, "id": ids, "code": codes, "probe": False})
                for r in range(int(reach[:, t].max(initial=-1)) + 1):
                    chosen = reach[:, t] >= r
                    near = (keys[chosen, None] ^ masks[t][r][None, :]).ravel()
                    times = len(masks[t][r])
                    yield pd.DataFrame({
                        "cell": near << 8 | t, "id": np.repeat(ids[chosen], times),
                        "code": np.repeat(codes[chosen], times), "probe": True})

    return df.select("id", "code").mapInPandas(emit, "cell long, id long, code long, probe boolean")


def dealt(rows: DataFrame, count: int) -> DataFrame:
    """The rows with ``part``: one part holds whole cells, or one block of entries and one of probes of a large cell."""
    spark = rows.sparkSession
    large = written(
        rows.groupBy("cell").agg(F.count_if(F.col("probe")).alias("probes"), F.count_if(~F.col("probe")).alias("entries"))
        .filter((F.col("probes") + F.col("entries") > BLOCK_ROWS) & (F.col("probes") > 0) & (F.col("entries") > 0))
        .select("cell", F.ceil(F.col("probes") * 2 / BLOCK_ROWS).cast("int").alias("down"),
                F.ceil(F.col("entries") * 2 / BLOCK_ROWS).cast("int").alias("across")),
        "large_cells",
    )
    down, across = F.coalesce("down", F.lit(1)), F.coalesce("across", F.lit(1))
    own = F.pmod(F.xxhash64("id", F.lit("block")), F.when(F.col("probe"), down).otherwise(across)).cast("int")
    block = F.when(F.col("probe"), F.transform(F.sequence(F.lit(0), across - 1), lambda j: own * across + j)).otherwise(
        F.transform(F.sequence(F.lit(0), down - 1), lambda i: i * across + own))
    parts = parts_for(spark, count, GROUP_ROWS)
    return rows.join(large, "cell", "left").select(
        *rows.columns, F.explode(block).alias("block"),
    ).withColumn("part", F.pmod(F.xxhash64("cell", "block"), F.lit(parts)))


def candidates(cells: np.ndarray, ids: np.ndarray, codes: np.ndarray, probe: np.ndarray, most: int, visit) -> None:
    """Call ``visit(probe rows, entry rows)`` for pairs of different ids under the same cell whose codes differ in at most
    ``most`` bits. ``cells`` names cell and block."""
    entries, probes = np.flatnonzero(~probe), np.flatnonzero(probe)
    entries = entries[np.argsort(cells[entries], kind="stable")]
    probes = probes[np.argsort(cells[probes], kind="stable")]
    low = np.searchsorted(cells[entries], cells[probes], "left")
    counts = np.searchsorted(cells[entries], cells[probes], "right") - low
    keep = counts > 0
    probes, low, counts = probes[keep], low[keep], counts[keep]
    ends = np.cumsum(counts)
    start = 0
    while start < len(probes):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + COMPARED, "right")))
        n = counts[start:stop]
        p = np.repeat(probes[start:stop], n)
        e = entries[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[start:stop], n)]
        near = popcount(codes[p].view(np.uint64) ^ codes[e].view(np.uint64))
        keep = (near <= most) & (ids[p] != ids[e])
        if keep.any():
            visit(p[keep], e[keep])
        start = stop


def named_blocks(frame: pd.DataFrame) -> np.ndarray:
    """One number for each cell and block of a part."""
    cells = frame["cell"].to_numpy(np.int64)
    blocks = frame["block"].to_numpy(np.int64)
    if not blocks.any():
        return cells
    return np.unique(np.stack([cells, blocks]), axis=1, return_inverse=True)[1].ravel()


def forest(nodes: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest node that each node of 0..nodes-1 reaches through the edges."""
    root = np.arange(nodes)
    while len(left):
        a, b = root[left], root[right]
        np.minimum.at(root, a, b)
        np.minimum.at(root, b, a)
        root = root[root]
        while (root != root[root]).any():
            root = root[root]
        open_ = root[left] != root[right]
        left, right = left[open_], right[open_]
    return root
