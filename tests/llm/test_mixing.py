from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.llm import mixing


def filled(sizes, weights, repeats):
    """Shares of the whole by weight, none above its limit; what is cut off is shared again and again."""
    sizes, weights = np.array(sizes, float), np.array(weights, float)
    share, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while free.any():
        new = np.where(free, (sizes.sum() - share[~free].sum()) * weights / weights[free].sum(), share)
        over = free & (new > sizes * repeats)
        if not over.any():
            return new
        share[over] = (sizes * repeats)[over]
        free &= ~over
    return share


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 10, 10, 5], [1, 1, 1000, 0, 7], [7], [0, 0], [5, 900, 3, 40, 2, 8, 1]])
def test_targets(spark, sizes):
    sources = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    found = [r.target for r in mixing.targets(sources).orderBy("place").collect()]
    assert np.allclose(found, filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3))


def test_sources_go_by_code_point_with_null_last(spark):
    sources = spark.createDataFrame([(s, 10) for s in ("b", None, "É", "Z", "a", "", "10", "9")], "source string, source_size long")
    assert [r.source for r in mixing.targets(sources).orderBy("place").collect()] == ["", "10", "9", "Z", "a", "b", "É", None]


def documents(spark, n=900, sources=7):
    words = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(60)) + F.when(F.col("doc_id") % 50 == 0, 900).otherwise(1)
    hot = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % sources)
    return spark.range(n).withColumnRenamed("id", "doc_id").select(
        "doc_id", F.repeat(F.lit("wörd "), words.cast("int")).alias("text"), F.concat(F.lit("s"), hot).alias("source"))


def test_taken_words_come_near_the_targets(spark):
    rows = mixing.assigned(documents(spark)).toPandas()
    again = mixing.assigned(documents(spark).repartition(5)).toPandas()
    both = rows.merge(again, on="doc_id")
    assert len(both) == 900 and (both["taken_x"] == both["taken_y"]).all()
    assert (rows["taken"] == rows["size"] * rows["shards"].map(len)).all() and (rows["taken"] <= 3 * rows["size"]).all()
    per_source = rows.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (np.abs(per_source["taken"] - per_source["target"]) <= 0.02 * per_source["target"] + 20).all()
    held = rows["shards"].explode().dropna().astype(int).value_counts()
    assert set(held.index) <= set(range(mixing.SHARDS))


@pytest.mark.parametrize("huge", [20_000, 60_000])
def test_a_very_long_document_does_not_end_the_draw(spark, huge):
    rows = spark.range(20 * 2_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 20).alias("source"),
        F.when(F.col("id") < 20, huge).otherwise(F.pmod(F.xxhash64("id"), F.lit(199)) + 1).cast("long").alias("size"))
    taken = mixing.plan_of(rows).joined(rows, "doc_id", "source").groupBy("source").agg(
        F.first("target").alias("target"), F.sum(F.col("size") * F.size("shards")).alias("taken")).collect()
    assert len(taken) == 20 and max(abs(r.taken - r.target) / r.target for r in taken) <= 0.002


def test_mixed_rows_are_the_assigned_copies(spark):
    docs = documents(spark, 300).withColumns({"shards": F.lit(1), "place": F.lit("x"), "_row": F.lit(2.0)})
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    expected = {r.doc_id: len(r.shards) for r in mixing.assigned(docs).collect() if r.shards}
    assert copies == expected


def test_odd_rows(odd_docs, no_docs):
    rows = mixing.assigned(odd_docs).collect()
    assert len(rows) == 13
    sizes = {r.doc_id: r["size"] for r in rows}
    assert (sizes[1], sizes[2], sizes[3], sizes[4], sizes[9], sizes[10]) == (10, 0, 0, 0, 1, 5)
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert mixing.assigned(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    assert mixing.mixed(odd_docs).columns == odd_docs.columns


def test_word_count_splits_at_ascii_space_only(spark):
    texts = ["", " ", "a", " a  b ", "a b c", "a\tb\nc\x0bd\x0ce\rf", " ", None, "a\x1cb"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.word_count("text").alias("n")).collect()
    assert [r.n for r in rows] == [0, 0, 1, 2, 2, 6, 1, 0, 1]


@pytest.mark.parametrize("total, good, draws", [(500, 120, 200), (40, 39, 20), (10, 0, 5), (10, 10, 4), (100_000, 30_000, 50_000)])
def test_hypergeometric_draws(spark, total, good, draws):
    uniform = F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    values = [F.lit(x).cast("long") for x in (total, good, draws)]
    k = spark.range(3000).select(mixing.hypergeometric(*values, uniform).alias("k")).toPandas()["k"]
    p = good / total
    mean, variance = draws * p, draws * p * (1 - p) * (total - draws) / (total - 1)
    assert k.between(max(0, draws + good - total), min(draws, good)).all()
    assert abs(k.mean() - mean) <= 5 * (variance / 3000) ** 0.5 + 1e-9
    assert abs(k.var() - variance) <= 0.15 * variance + 1e-9


def test_tree_gives_all_blocks_to_equal_shards(spark):
    quotas = [13, 0, 400, 77, 1]
    sources = spark.createDataFrame(list(enumerate(quotas)), "place int, quota long")
    ends = {r.place: r.ends for r in mixing.shard_quotas(sources, 8, 1).collect()}
    assert [ends[i][-1] for i in range(5)] == quotas and all(len(e) == 8 for e in ends.values())
    per_shard = np.diff(np.array([[0, *ends[i]] for i in range(5)]), axis=1).sum(axis=0)
    assert (np.diff(np.array([[0, *ends[i]] for i in range(5)]), axis=1) >= 0).all()
    assert per_shard.max() - per_shard.min() <= 1
