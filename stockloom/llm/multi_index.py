"""Approximate nearest neighbours by largest inner product with an inverted multi-index."""

from __future__ import annotations

import math
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.llm.common import written
from stockloom.llm.vectors import one_per_id, sample

#: The index is fitted on at most FITTED vectors; each half has CENTROIDS centroids, so that there are CENTROIDS ** 2 cells.
FITTED, CENTROIDS, ROUNDS = 16_384, 128, 12
#: A traversal gathers the least share of all entries that holds this share of the nearest entries of ASKED queries, and LEAST
#: entries at least.
RECALL, ASKED, LEAST = 0.97, 128, 2_000
#: The traversal also goes on until it holds that share when exact copies count once and no cell for more than OVERSIZED times
#: the median cell, so that a hot group doesn't use it up.
OVERSIZED = 4
#: Rows whose distances tell how far seeds lie apart.
SPACED = 1_024
#: Entries and queries that come together in a group, and how many of these queries are compared at once.
ENTRY_BLOCK, QUERY_BLOCK, SLICE = 4_096, 4_096, 512


def seeds(rows: np.ndarray, count: int) -> np.ndarray:
    """The first distinct rows (the sample is in hash order) that lie apart by half the median distance, so that a group of near
    copies gets one; if these are too few, the first others too."""
    _, first = np.unique(rows, axis=0, return_index=True)
    rows = rows[np.sort(first)]
    some = rows[:SPACED]
    apart = (some**2).sum(axis=1)[:, None] + (some**2).sum(axis=1)[None, :] - 2 * some @ some.T
    limit = np.median(apart[np.triu_indices(len(some), 1)]) / 4 if len(some) > 1 else 0.0
    nearest, chosen = np.full(len(rows), np.inf), np.zeros(len(rows), bool)
    while chosen.sum() < count and (nearest > limit).any():
        one = int(np.argmax(nearest > limit))
        chosen[one] = True
        nearest = np.minimum(nearest, ((rows - rows[one]) ** 2).sum(axis=1))
    others = np.flatnonzero(~chosen)[:count - int(chosen.sum())]
    return rows[[*np.flatnonzero(chosen), *others]]


def centroids(rows: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means, started from spaced rows; fewer rows give fewer centroids."""
    middle = seeds(rows, count)
    for _ in range(rounds):
        nearest = assign(rows, middle)
        counts = np.bincount(nearest, minlength=len(middle))
        sums = np.zeros_like(middle)
        np.add.at(sums, nearest, rows)
        middle = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], middle)
    return middle


def in_line(middle: np.ndarray) -> np.ndarray:
    """The centroids in the order of the direction in which they differ most, so that neighbours in number lie near."""
    if not middle.size:
        return middle
    spread = middle - middle.mean(axis=0)
    return middle[np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")]


def assign(rows: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row (ties: the first)."""
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 8192):
        part = rows[at:at + 8192]
        out[at:at + 8192] = np.argmax(part @ middle.T - (middle**2).sum(axis=1) / 2, axis=1)
    return out


@dataclass
class MultiIndex:
    """The centroids of both halves and how many entries each pair of them holds (CENTROIDS ** 2 counts); ``light`` are the
    counts without copies and without what is beyond OVERSIZED. ``first`` and ``parts`` deal the cells into blocks."""

    halves: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    light: np.ndarray | None = None
    first: np.ndarray | None = None
    parts: np.ndarray | None = None

    def deal(self, most: int) -> int:
        """Deal cells into blocks of at most ``most`` entries and return the number of blocks. A cell goes to block ``first``;
        a larger one has ``parts`` blocks from there on to itself."""
        self.parts = np.maximum(1, -(-self.counts // most))
        self.first = np.zeros(len(self.counts), np.int64)
        block = held = 0
        for cell, (n, parts) in enumerate(zip(self.counts.tolist(), self.parts.tolist())):
            if held and held + n > most:
                block, held = block + 1, 0
            self.first[cell] = block
            held += n
            if parts > 1:
                block, held = block + parts, 0
        return block + bool(held)

    def blocks(self, depth: np.ndarray, place: np.ndarray, total: int) -> np.ndarray:
        """The blocks that hold entries of the visited cells."""
        cells = np.flatnonzero((place[None, :] < depth[:, None]).ravel() & (self.counts > 0))
        edges = np.zeros(total + 1, np.int64)
        np.add.at(edges, self.first[cells], 1)
        np.add.at(edges, self.first[cells] + self.parts[cells], -1)
        return np.flatnonzero(np.cumsum(edges)[:total])

    def share_before(self, query: np.ndarray) -> np.ndarray:
        """By cell: the share of all entries that a traversal holds before it visits the cell, by the full or the light
        counts, whichever is less."""
        far = -(self.halves[0] @ query[:self.split])[:, None] - (self.halves[1] @ query[self.split:])[None, :]
        order = np.argsort(far.ravel(), kind="stable")
        out = np.ones(len(order))
        for counts in (self.counts, self.light):
            inside = counts[order]
            out[order] = np.minimum(out[order], (np.cumsum(inside) - inside) / inside.sum())
        return out

    @property
    def split(self) -> int:
        return self.halves[0].shape[1]

    def cells(self, rows: np.ndarray) -> np.ndarray:
        first, second = assign(rows[:, :self.split], self.halves[0]), assign(rows[:, self.split:], self.halves[1])
        return first * len(self.halves[1]) + second

    def traverse(self, query: np.ndarray, needed: int, needed_light: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Visit pairs of centroids by summed distance, nearest first, until they hold ``needed`` entries, and ``needed_light`` by
        the light counts.

        The distance of a half is its negative inner product with the centroid. For each centroid of the first half the
        visited pairs are the nearest ones of the second half; so the result is how many (``depth``, by centroid of the first
        half) and at which place each centroid of the second half comes (``place``).
        """
        d1, d2 = -(self.halves[0] @ query[:self.split]), -(self.halves[1] @ query[self.split:])
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        counts = self.counts.reshape(len(d1), len(d2))[o1][:, o2].tolist()
        light = counts if self.light is None else self.light.reshape(len(d1), len(d2))[o1][:, o2].tolist()
        s1, s2 = d1[o1].tolist(), d2[o2].tolist()
        n1, n2 = len(s1), len(s2)
        depth = [0] * (n1 + 1)
        heap = [(s1[0] + s2[0], 0, 0)]
        found = found_light = 0
        while heap and (found < needed or found_light < needed_light):
            _, i, j = heappop(heap)
            found += counts[i][j]
            found_light += light[i][j]
            depth[i] = j + 1
            if j + 1 < n2 and (i == 0 or depth[i - 1] > j + 1):
                heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
            if i + 1 < n1 and depth[i + 1] == j:
                heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
        by_first, place = np.empty(n1, np.uint16), np.empty(n2, np.uint16)
        by_first[o1] = depth[:n1]
        place[o2] = np.arange(n2)
        return by_first, place


def fit(vectors: DataFrame, count: int = CENTROIDS, most: int = FITTED) -> MultiIndex | None:
    """Centroids from a bounded sample; the counts are of all vectors."""
    rows = sample(vectors, most)
    if not rows.size:
        return None
    half = (rows.shape[1] + 1) // 2
    halves = in_line(centroids(rows[:, :half], count)), in_line(centroids(rows[:, half:], count))
    return MultiIndex(halves, np.zeros(0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def index_entries(vectors: DataFrame, index: MultiIndex) -> DataFrame:
    """``vec_id, vector, cell`` of all vectors that take part."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("int")
    def cell(rows: pd.Series) -> pd.Series:
        return pd.Series(shared.value.cells(matrix(rows)) if len(rows) else [], dtype="int32")

    return vectors.filter("vector is not null").withColumn("cell", cell("vector"))


def best_of(scores: np.ndarray, rows: np.ndarray, query: np.ndarray, ids: np.ndarray, own: int, k: int):
    """The k best visited rows by exact inner product (ties: smaller id, which come first in ``rows``)."""
    visited = np.flatnonzero(scores > -np.inf)
    visited = visited[ids[visited] != own]
    if len(visited) > k:
        least = np.partition(scores[visited], len(visited) - k)[len(visited) - k]
        visited = visited[scores[visited] >= least - 1e-9 * max(1.0, abs(least))]
    # equal vectors get equal sums here, whatever block they were multiplied in
    exact = (rows[visited] * query).sum(axis=1)
    order = np.lexsort((ids[visited], -exact))[:k]
    return ids[visited[order]], exact[order]


def least_share(entries: DataFrame, queries: DataFrame, index: MultiIndex, k: int, recall: float = RECALL, most: int = ASKED) -> float:
    """The least share of the entries that holds ``recall`` of the true ``k`` nearest of at most ``most`` queries.

    The queries are of as many cells as can be, so that those of a hot group don't speak for all; they are compared with every
    entry, in one pass.
    """
    spark = entries.sparkSession
    by_cell = queries.groupBy("cell").agg(F.min_by(F.struct("query_id", "vector"), F.xxhash64("query_id")).alias("q"))
    asked = by_cell.orderBy(F.xxhash64("cell")).limit(most).select("q.*").toPandas()
    if not len(asked):
        return 0.0
    vectors, own = matrix(asked["vector"]), asked["query_id"].to_numpy()
    shared = spark.sparkContext.broadcast((vectors, own))

    def nearest(batches):
        vectors, own = shared.value
        for batch in batches:
            if not len(batch):
                continue
            ids, cells = batch["vec_id"].to_numpy(), batch["cell"].to_numpy()
            scores = np.where(own[:, None] == ids[None, :], -np.inf, vectors @ matrix(batch["vector"]).T)
            best = np.argpartition(-scores, min(k, len(ids)) - 1, axis=1)[:, :k]
            who = np.repeat(np.arange(len(own)), best.shape[1])
            yield pd.DataFrame({"q": who, "cell": cells[best.ravel()], "score": scores[who, best.ravel()]})

    found = entries.select("vec_id", "vector", "cell").mapInPandas(nearest, "q int, cell int, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cell"))
    # at most ``most`` times ``k`` rows
    true = found.filter("score > double('-Infinity')").withColumn("rank", rank).filter(F.col("rank") <= k).select("q", "cell").toPandas()
    if not len(true):
        return 0.0
    before = np.concatenate([index.share_before(vectors[q])[part["cell"].to_numpy()] for q, part in true.groupby("q")])
    return float(np.sort(before)[math.ceil(recall * len(before)) - 1]) + 1e-9


def search(
    rows: DataFrame, is_query: Column | str, k: int, vec_id: str = "vec_id", vector: str = "embedding",
    share: float | None = None, count: int = CENTROIDS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k found vectors with the largest inner product, for every row that
    ``is_query`` holds for, among all other rows.

    Entries lie in blocks of neighbouring cells, a large cell in several; a query goes to the blocks that hold cells it visits.
    Each gives its own k best and these are merged. ``share`` is the share of entries that a traversal gathers, by default
    the least that suffices (``least_share``). Vectors that are null, zero or not finite, or have no id, take no part. Ids that repeat
    count once. Tables smaller than LEAST are searched whole; a table without queries gives no rows. Ties go to the smaller id.
    """
    spark = rows.sparkSession
    is_query = F.expr(is_query) if isinstance(is_query, str) else is_query
    out = "query_id long, vec_id long, score double"
    usable = one_per_id(rows, vec_id, vector).filter("vec_id is not null and vector is not null")
    index = fit(usable, count)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    entries = written(index_entries(usable, index), "entries")
    index.counts = np.zeros(len(index.halves[0]) * len(index.halves[1]), np.int64)
    index.light = np.zeros_like(index.counts)
    copies = entries.groupBy("cell", F.xxhash64("vector").alias("_copy")).count()
    for row in copies.groupBy("cell").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("distinct")).collect():
        index.counts[row["cell"]], index.light[row["cell"]] = row["n"], row["distinct"]  # at most CENTROIDS ** 2 rows
    index.light = np.minimum(index.light, math.ceil(OVERSIZED * np.median(index.light[index.light > 0])))
    queries = entries.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector", "cell")
    share = least_share(entries, queries, index, k) if share is None else share
    total = int(index.counts.sum())
    needed, needed_light = max(math.ceil(share * total), min(total, LEAST)), math.ceil(share * index.light.sum())
    entry_blocks = index.deal(ENTRY_BLOCK)
    query_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    shared = spark.sparkContext.broadcast(index)

    def visit(batches):
        for batch in batches:
            found = [shared.value.traverse(q, needed, needed_light) for q in matrix(batch["vector"])] if len(batch) else []
            yield batch.assign(
                depth=[d.tobytes() for d, _ in found], place=[p.tobytes() for _, p in found],
                visited=[shared.value.blocks(d, p, entry_blocks) for d, p in found])

    planned = written(queries.drop("cell").mapInPandas(
        visit, "query_id long, vector array<double>, depth binary, place binary, visited array<int>"), "queries")

    @F.pandas_udf("int")
    def block(cells: pd.Series, spread: pd.Series) -> pd.Series:
        at = cells.to_numpy()
        return pd.Series(shared.value.first[at] + spread.to_numpy() % shared.value.parts[at], dtype="int32")

    query_block = F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")
    left = planned.withColumn("q", query_block).withColumn("e", F.explode("visited")).drop("visited")
    right = entries.withColumn("e", block("cell", F.xxhash64("vec_id"))).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def rerank(queries_: pd.DataFrame, entries_: pd.DataFrame) -> pd.DataFrame:
        if not len(queries_) or not len(entries_):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        n2 = len(shared.value.halves[1])
        entries_ = entries_.sort_values(["cell", "vec_id"])
        ids, vectors = entries_["vec_id"].to_numpy(), matrix(entries_["vector"])
        first, second = np.divmod(entries_["cell"].to_numpy(), n2)
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        parts = []
        for at in range(0, len(queries_), SLICE):
            some = queries_.iloc[at:at + SLICE]
            asked = matrix(some["vector"])
            depth = np.frombuffer(b"".join(some["depth"]), np.uint16).reshape(len(asked), -1)
            place = np.frombuffer(b"".join(some["place"]), np.uint16).reshape(len(asked), -1)
            scores = np.full((len(asked), len(ids)), -np.inf)
            for a, b in zip(starts, [*starts[1:], len(ids)]):
                who = np.flatnonzero(depth[:, first[a]])
                inside = place[who][:, second[a:b]] < depth[who, first[a], None]
                scores[who, a:b] = np.where(inside, asked[who] @ vectors[a:b].T, -np.inf)
            for i, own in enumerate(some["query_id"]):
                near, exact = best_of(scores[i], vectors, asked[i], ids, own, k)
                parts.append(pd.DataFrame({"query_id": own, "vec_id": near, "score": exact}))
        return pd.concat(parts, ignore_index=True)

    found = left.groupBy("q", "e").cogroup(right.groupBy("q", "e")).applyInPandas(rerank, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
