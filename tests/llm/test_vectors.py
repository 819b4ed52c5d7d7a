from __future__ import annotations

import numpy as np
import pytest

from stockloom.llm import hamming, itq, multi_index

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, code string, cell string, vector string, id string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def clustered(n, dimension, seed, noise=0.05):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(n // 8, dimension))
    rows = middles[rng.integers(0, len(middles), n)]
    return (rows + rng.normal(size=rows.shape) * noise * rng.uniform(0, 10, (n, 1))).astype(np.float32)


ODD = [(100, None), (101, [0.0] * 16), (102, [NAN] * 16), (103, [INF] + [0.0] * 15), (104, [None] + [1.0] * 15), (105, []), (None, [1.0] * 16)]


def test_search_finds_nearly_all_and_scores_exactly(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "LEAST", 100)
    monkeypatch.setattr(multi_index, "ENTRY_BLOCK", 400)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 30)
    rows = clustered(3000, 16, 1)
    ids = np.arange(1000, 4000)
    found = multi_index.search(table_of(spark, [*ODD, *zip(ids.tolist(), rows.tolist())]), "vec_id % 20 = 0", 20).toPandas()
    exact, hits, queries = rows.astype(np.float64), 0, np.flatnonzero(ids % 20 == 0)
    for q in queries:
        scores = (exact * exact[q]).sum(axis=1)
        scores[q] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]])
        mine = found[found["query_id"] == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine["score"], scores[mine["vec_id"].to_numpy() - 1000], atol=1e-12)
        hits += len(best & set(mine["vec_id"]))
    assert hits / len(queries) / 20 >= 0.9
    assert set(found["query_id"]) == set(ids[queries].tolist())


def test_the_share_follows_the_vectors(spark):
    """Clustered vectors need a small share of the entries, and queries then reach few blocks; random ones need much more."""
    rng = np.random.default_rng(3)
    ids, shares = list(range(6000)), []
    for spread in (0.1, 10.0):
        middles = itq.unit(rng.normal(size=(120, 32)))
        rows = itq.unit(middles[rng.integers(0, 120, 6000)] + spread * itq.unit(rng.normal(size=(6000, 32))))
        usable = spark.createDataFrame(list(zip(ids, rows.tolist())), "vec_id long, vector array<double>")
        index = multi_index.fit(usable, 24)
        entries = multi_index.index_entries(usable, index)
        cells = index.cells(rows)
        index.counts = index.light = np.bincount(cells, minlength=24 * 24)
        queries = entries.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
        shares.append(multi_index.least_share(entries, queries, index, 10))
        before = []
        for q in range(0, 6000, 20):
            scores = rows @ rows[q]
            scores[q] = -np.inf
            before.extend(index.share_before(rows[q])[cells[np.argsort(-scores)[:10]]] < shares[-1])
        assert np.mean(before) >= 0.94
    assert shares[0] < 0.1 and 2 * shares[0] < shares[1]


def test_blocks_hold_whole_cells_or_parts_of_large_ones():
    index = multi_index.MultiIndex((np.zeros((2, 1)), np.zeros((4, 1))), np.array([3, 0, 5, 25, 9, 1, 0, 11]))
    assert index.deal(10) == 7
    assert index.first.tolist() == [0, 0, 0, 1, 4, 4, 4, 5]
    assert index.parts.tolist() == [1, 1, 1, 3, 1, 1, 1, 2]
    # the first centroid's nearest pair is the fourth of the second half, the other's all
    assert index.blocks(np.array([1, 4]), np.array([3, 1, 2, 0]), 8).tolist() == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("spread", [0.0, 0.05])
def test_a_hot_third_does_not_use_up_the_search(spark, spread):
    rng = np.random.default_rng(11)
    rows, middle = itq.unit(rng.normal(size=(9000, 64))), itq.unit(rng.normal(size=(1, 64)))
    rows[:3000] = itq.unit(middle + spread * rng.normal(size=(3000, 64)))
    ids = np.arange(9000)
    towards = 3000 + np.flatnonzero(rows[3000:] @ middle[0] > 0.2)[:150]
    ids[towards] += 100_000  # these ask
    rows = rows.astype(np.float32)
    found = multi_index.search(table_of(spark, zip(ids.tolist(), rows.tolist())), "vec_id >= 100000", 20).toPandas()
    exact, hits = rows.astype(np.float64), 0
    for q in towards:
        scores = (exact * exact[q]).sum(axis=1)
        scores[q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -scores))[:20]]) & set(found[found["query_id"] == ids[q]]["vec_id"]))
    assert hits / len(towards) / 20 >= 0.93


def test_search_of_copies_takes_the_smallest_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(300, [9.0, 9.0, 9.0])] * 2
    found = multi_index.search(table_of(spark, rows), "vec_id = 40", 5).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [300, 0, 1, 2, 3]
    assert [r.score for r in found] == [54.0, 14.0, 14.0, 14.0, 14.0]


@pytest.mark.parametrize("rows", [[], [(20, None)], ODD[:1]])
def test_search_without_vectors(spark, rows):
    assert multi_index.search(table_of(spark, rows), "vec_id % 20 = 0", 3).count() == 0
    assert multi_index.search(table_of(spark, [*rows, (7, [1.0])]), "vec_id % 20 = 0", 3).count() == 0


def test_fewer_candidates_than_asked_for(spark):
    found = multi_index.search(table_of(spark, [(20, [1.0, 0.0]), (21, [0.5, 1.0]), (22, [-1.0, 0.0])]), "vec_id = 20", 20)
    assert [(r.vec_id, r.score) for r in found.orderBy("rank").collect()] == [(21, 0.5), (22, -1.0)]


def test_traversal_goes_by_summed_distance():
    rng = np.random.default_rng(4)
    halves = (rng.normal(size=(12, 3)), rng.normal(size=(9, 4)))
    index = multi_index.MultiIndex(halves, rng.integers(0, 4, 108))
    for _ in range(20):
        query, needed = rng.normal(size=7), int(rng.integers(1, index.counts.sum()))
        depth, place = index.traverse(query, needed)
        visited = place[None, :] < depth[:, None]
        order = np.argsort(-(halves[0] @ query[:3])[:, None] - (halves[1] @ query[3:])[None, :], axis=None)
        expected = np.zeros(108, bool)
        expected[order[:np.searchsorted(np.cumsum(index.counts[order]), needed) + 1]] = True
        assert (visited.ravel() == expected).all()


def brute_classes(ids, rows):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(rows))
    while True:
        new = np.minimum(root, np.where(near, root[None, :], len(rows)).min(axis=1))
        if (new == root).all():
            return near.sum(axis=1), np.asarray(ids)[root]
        root = new


@pytest.mark.parametrize("block", [hamming.BLOCK_ROWS, 40])
def test_classes_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hamming, "BLOCK_ROWS", block)
    rows = np.concatenate([clustered(500, 64, 2), np.repeat(clustered(8, 64, 3), 20, axis=0)])
    rows[5] = rows[600] * 3  # equal but for its length
    ids = np.arange(len(rows)) * 3 + 7
    links, component = brute_classes(ids, rows.astype(np.float64))
    found = itq.classes(table_of(spark, zip(ids.tolist(), rows.tolist()))).toPandas().set_index("vec_id").loc[ids]
    missed = np.abs(found["n_links"].to_numpy() - links).sum()
    assert missed <= 0.02 * links.sum() and (found["n_links"].to_numpy() <= links).all()
    assert (found["component_id"].to_numpy() == component).mean() >= 0.98
    assert (found["kept"] == (found["component_id"] == found.index)).all()


@pytest.mark.parametrize("mean", [0.0, 0.7, 0.8])
def test_links_of_vectors_with_a_common_mean(spark, mean):
    rng = np.random.default_rng(8)
    rows = mean * np.eye(64)[0] + np.sqrt(1 - mean**2) * itq.unit(rng.normal(size=(1200, 64)))
    across = rng.normal(size=rows.shape)
    rows, across = itq.unit(rows), across - (across * itq.unit(rows)).sum(axis=1, keepdims=True) * itq.unit(rows)
    pairs = 0.901 * rows + np.sqrt(1 - 0.901**2) * itq.unit(across)
    both = np.concatenate([rows, pairs])
    near = itq.unit(both) @ itq.unit(both).T >= 0.9
    found = itq.classes(table_of(spark, enumerate(both.tolist()))).toPandas()
    assert found["n_links"].sum() >= 0.98 * (near.sum() - len(both)) > 0


def test_classes_of_odd_rows(spark):
    rows = [*ODD, (1, [1.0] * 16), (2, [2.0] * 16), (3, [1.0] * 16), (3, [1.0] * 16), (4, [-1.0] * 16), (5, [1e30] * 16)]
    found = {r.vec_id: r for r in itq.classes(table_of(spark, rows)).collect()}
    assert len(found) == 12
    for i in (100, 101, 102, 103, 104, 105, 4):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    for i in (1, 2, 3, 5):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (3, 1, i == 1)
    assert (found[None].n_links, found[None].component_id, found[None].kept) == (0, None, False)


def test_classes_without_vectors(spark):
    assert itq.classes(table_of(spark, [])).count() == 0
    assert itq.classes(table_of(spark, [(1, None)])).collect()[0].n_links == 0
    assert [r.n_links for r in itq.classes(table_of(spark, [(1, [1.0]), (2, [3.0]), (3, [-1.0])])).orderBy("vec_id").collect()] == [1, 1, 0]


def test_rotation_balances_and_preserves():
    rows = itq.unit(clustered(2000, 64, 6).astype(np.float64))
    rotation = itq.fit(rows)
    turned = rotation.axes.T @ rotation.axes
    assert np.allclose(turned, np.eye(64), atol=1e-8)
    codes = rotation.codes(rows).view(np.uint8).reshape(-1, 8)
    share = np.unpackbits(codes, axis=1).mean(axis=0)
    assert 0.2 < share.min() and share.max() < 0.8
