from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from stockloom.llm import mixing, packing, pii, quality, simhash
from stockloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def stages(spark):
    """The documents and what each stage makes of what the one before kept."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF_DIR).persist())
    return out


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns or df.columns).collect()), key=repr)


def test_all_queries_are_registered():
    names = set(contract.queries())
    assert set(QUERIES) | {"pipeline"} <= names and sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_columns_stay_to_the_last_stage(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = stages[1].select("doc_id")
    assert kept.exceptAll(stages[0].select("doc_id")).count() == 0
    judged = labels.join(kept, "doc_id", "left_semi")
    assert judged.filter("quality = 0").count() <= 0.05 * labels.filter("quality = 0").count()
    assert judged.filter("quality = 1").count() >= 0.98 * labels.filter("quality = 1").count()


def test_near_duplicate_stage(stages):
    texts = {r.doc_id: r.text for r in stages[1].collect()}
    codes = {i: simhash.fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in codes}
    changed = True
    while changed:  # the smallest id reached through links, by brute force
        changed = False
        for a in codes:
            for b in codes:
                if root[b] < root[a] and (codes[a] ^ codes[b]).bit_count() <= 4:
                    root[a], changed = root[b], True
    assert rows_of(stages[2]) == rows_of(stages[1].filter(F.col("doc_id").isin([i for i in root if root[i] == i])))


def test_personal_data_stage(stages):
    assert rows_of(stages[3].drop("n_chars")) == rows_of(pii.pseudonymised(stages[2]).drop("n_chars"))
    assert stages[3].filter(F.length("text") != F.col("n_chars")).count() == 0
    assert stages[3].filter(F.col("text").contains("@mail")).count() == stages[2].filter(F.col("text").contains("@mail")).count()


def test_mixture_stage(stages):
    taken = {r.doc_id: len(r.shards) for r in mixing.assigned(stages[3]).collect() if r.shards}
    assert {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()} == taken
    assert stages[4].distinct().exceptAll(stages[3].distinct()).count() == 0


def test_packing_stage(stages):
    assert stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).filter(F.col("n") > packing.CAPACITY).count() == 0
    assert stages[5].select("doc_id").distinct().count() == stages[4].select("doc_id").distinct().count()
    assert stages[5].filter("piece = 0").count() == stages[4].count()


def test_run_applies_all_stages(spark, stages):
    assert rows_of(corpus_pipeline.run(spark, SF_DIR), "doc_id", "piece", "length", "ids_crc32") == rows_of(
        stages[5], "doc_id", "piece", "length", "ids_crc32")


def test_scores_hold_for_kept_rows(spark, stages):
    model = quality.fit(stages[0], spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    assert stages[1].filter(quality.score_of(stages[1], model) < 0.5).count() == 0
