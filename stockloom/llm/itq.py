"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact cosines."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stockloom.llm import hamming
from stockloom.llm.common import parts_for, written
from stockloom.llm.components import connected_components
from stockloom.llm.vectors import one_per_id, sample

#: The rotation is fitted on at most FITTED vectors; codes have at most 64 bits.
FITTED, ROUNDS, BITS, SEED = 16_384, 40, 64, 7
MIN_COSINE = 0.9
#: Codes meet in tables of bit groups, within a radius. How wide the groups are, how many tables and what radius it takes follows from the
#: number of rows and from pairs at the minimum cosine that are made from the sample: the cheapest way that lets FOUND of these meet.
#: Wider groups make more rows to be dealt and fewer comparisons; one dealt row costs as much as ROW_COST comparisons of codes.
FOUND, WIDTHS, RADII, MOST_TABLES, ROW_COST = 0.995, range(6, 41), (0, 1, 2, 3, 4), 120, 100
#: Codes that differ in more bits than this share of the made pairs' do aren't reranked.
WITHIN = 0.9995
#: Pairs whose cosines are computed at once.
RERANKED = 50_000


@dataclass
class Rotation:
    """Centre and the product of principal axes and learned rotation (dimension x bits)."""

    centre: np.ndarray
    axes: np.ndarray

    def codes(self, unit: np.ndarray) -> np.ndarray:
        bits = (unit - self.centre) @ self.axes >= 0
        padded = np.zeros((len(bits), 64), bool)
        padded[:, :bits.shape[1]] = bits
        return np.packbits(padded, axis=1, bitorder="little").view(np.int64).ravel()


def unit(rows: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components neither overflow nor vanish
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def fit(rows: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> Rotation:
    """Principal axes of the sample, turned so that the signs along them lose least: alternately the signs, then the rotation
    that brings the projections nearest to them. Signs around the centre keep the bits balanced."""
    rows = unit(rows)
    centre = rows.mean(axis=0)
    _, axes = np.linalg.eigh((rows - centre).T @ (rows - centre))
    axes = axes[:, ::-1][:, :bits]
    projected = (rows - centre) @ axes
    turn = np.linalg.qr(np.random.default_rng(SEED).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
        turn = (left @ right).T
    return Rotation(centre, axes @ turn)


def differences(rotation: Rotation, rows: np.ndarray, min_cosine: float) -> np.ndarray:
    """The bits in which the codes of pairs at the minimum cosine differ. Each row of the sample gets two partners: one towards
    another row, one in any direction; both see the vectors' common mean as real pairs do."""
    rows = unit(rows)
    rng = np.random.default_rng(SEED)
    out = []
    for towards in (rows[rng.permutation(len(rows))], rng.normal(size=rows.shape)):
        across = towards - (towards * rows).sum(axis=1, keepdims=True) * rows
        length = np.sqrt((across**2).sum(axis=1, keepdims=True))
        some = length[:, 0] > 1e-6
        partner = min_cosine * rows[some] + np.sqrt(max(0.0, 1 - min_cosine**2)) * across[some] / length[some]
        out.append(rotation.codes(rows[some]).view(np.uint64) ^ rotation.codes(partner).view(np.uint64))
    return np.concatenate(out)


def marks_of(tables: list[list[int]]) -> list[np.uint64]:
    return [np.uint64(sum(1 << b for b in bits)) for bits in tables]


def runs_of(bits: int, width: int) -> list[list[int]]:
    """Bit groups of a width, from the bits in order and then in fixed random orders, ``MOST_TABLES`` of them."""
    rng = np.random.default_rng(SEED)
    tables, order = [], np.arange(bits)
    while len(tables) < MOST_TABLES:
        tables += [sorted(int(b) for b in order[at:at + width]) for at in range(0, bits - width + 1, width)]
        order = rng.permutation(bits)
    return tables[:MOST_TABLES]


def planned(differ: np.ndarray, bits: int, rows: int) -> tuple[list[list[int]], int, int]:
    """Tables, radius and the most bits that differ: of the widths and radii whose tables let the share FOUND of the differences meet,
    the cheapest for so many rows. Comparing all codes, in one table without bits, is always such a way."""
    differing = hamming.popcount(differ)
    most = int(np.quantile(differing, WITHIN, method="higher")) if len(differ) else bits
    best = (float(rows), [[]], 0)
    for width in (w for w in WIDTHS if w <= bits):
        tables = runs_of(bits, width)
        apart = np.stack([hamming.popcount(differ & mark) for mark in marks_of(tables)]) if len(differ) else np.zeros((MOST_TABLES, 1), np.uint8)
        closest = np.minimum.accumulate(apart, axis=0)
        for radius in RADII:
            enough = np.flatnonzero((closest <= radius).mean(axis=1) >= FOUND)
            if len(enough):
                n, probes = int(enough[0]) + 1, sum(math.comb(width, r) for r in range(radius + 1))
                cost = n * (ROW_COST * (probes + 1) + rows * probes / 2 ** width)
                best = min(best, (cost, tables[:n], radius), key=lambda way: way[0])
    return best[1], best[2], most


def links(rows: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``id, links, root`` from distinct vectors (``id, copies, vector``): partial sums of the copies that each is linked to,
    and edges to the smallest id of its links, group by group. Pairs aren't given out.

    First only codes are compared. The vectors of those that have a candidate then join their cells, and each pair is
    counted in the first table in which it meets.
    """
    spark = rows.sparkSession
    named = rows.select(F.col("id").alias("vec_id"), "vector")
    fitted = sample(named, FITTED)
    if not fitted.size:
        return spark.createDataFrame([], "id long, links long, root long")
    learnt = fit(fitted)
    rotation = spark.sparkContext.broadcast(learnt)
    tables, radius, most = planned(differences(learnt, fitted, min_cosine), min(BITS, fitted.shape[1]), rows.count())
    marks = marks_of(tables)

    @F.pandas_udf("long")
    def code(vectors: pd.Series) -> pd.Series:
        rows_ = np.array(vectors.tolist(), np.float64)
        return pd.Series(rotation.value.codes(unit(rows_)) if len(rows_) else [], dtype="int64")

    coded = written(rows.withColumn("code", code("vector")), "codes")
    met = written(hamming.meet(coded, tables, lambda codes: np.full((len(codes), len(tables)), radius), radius), "itq_cells")
    total = met.count()

    def first_met(frame: pd.DataFrame, visit) -> None:
        table, codes = frame["cell"].to_numpy() & 255, frame["code"].to_numpy(np.int64)

        def new(p, e):
            differ = codes[p].view(np.uint64) ^ codes[e].view(np.uint64)
            before = np.zeros(len(p), bool)
            for t, mark in enumerate(marks):
                before |= (table[p] > t) & (hamming.popcount(differ & mark) <= radius)
            visit(p[~before], e[~before])

        hamming.candidates(
            hamming.named_blocks(frame), frame["id"].to_numpy(np.int64), codes, frame["probe"].to_numpy(bool), most, new)

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(len(frame), bool)

        def mark(p, e):
            seen[p] = seen[e] = True

        first_met(frame, mark)
        return frame.loc[seen, ["cell", "block", "id", "code", "probe"]]

    found = written(hamming.dealt(met, total).groupBy("part").applyInPandas(
        near, "cell long, block int, id long, code long, probe boolean"), "itq_candidates")
    parts = parts_for(spark, found.count(), hamming.BLOCK_ROWS * 2)

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        vectors = unit(np.array(frame["vector"].tolist(), np.float64))
        ids, copies = frame["id"].to_numpy(np.int64), frame["copies"].to_numpy(np.int64)
        names, place = np.unique(ids, return_inverse=True)
        linked, root = np.zeros(len(names), np.int64), np.arange(len(names))

        def exact(p, e):
            for at in range(0, len(p), RERANKED):
                a, b = p[at:at + RERANKED], e[at:at + RERANKED]
                keep = (vectors[a] * vectors[b]).sum(axis=1) >= min_cosine
                a, b = a[keep], b[keep]
                np.add.at(linked, place[a], copies[b])
                nodes = np.arange(len(names))
                root[:] = hamming.forest(
                    len(names), np.concatenate([nodes, place[a]]), np.concatenate([root, place[b]]))

        first_met(frame, exact)
        some = (linked > 0) | (root != np.arange(len(names)))
        return pd.DataFrame({"id": names[some], "links": linked[some], "root": names[root[some]]})

    joined = found.join(coded.select("id", "copies", "vector"), "id").withColumn(
        "part", F.pmod(F.xxhash64("cell", "block"), F.lit(parts)))
    return joined.groupBy("part").applyInPandas(verify, "id long, links long, root long")


def classes(rows: DataFrame, min_cosine: float = MIN_COSINE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per id: ``vec_id, n_links, component_id, kept``.

    Links join vectors with a cosine of at least ``min_cosine``; exact copies are compared once and counted as often as they
    occur. Vectors that are null, zero or not finite have no links and are kept. Ids that repeat count once; rows
    without an id are one row, which is not kept. An empty table gives no rows; further columns are not read.
    """
    single = one_per_id(rows, vec_id, vector)
    distinct = written(
        single.filter("vec_id is not null and vector is not null").groupBy("vector").agg(
            F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "distinct_vectors")
    partial = written(links(distinct, min_cosine), "itq_links")
    counts = partial.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(partial.filter("id != root").select(F.col("id").alias("src"), F.col("root").alias("dst")))
    named = (
        distinct.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("root", "id").alias("component_id"))
    )
    return single.join(named, "vector", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
