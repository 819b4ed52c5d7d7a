"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.llm import (
    html_text, itq, line_rules, merkle, mixing, multi_index, packing, pii, quality, simhash, spelling, sql, token_counts, url_filter)
from stockloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer_path(name: str) -> str:
    """Where the files of public tokenizers lie on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth one."""
    return multi_index.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


@query
def op2_iterative_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every vector."""
    return itq.classes(table(spark, sf_dir, "embeddings"))


#: All pairs, and all that is reachable through them.
ORACLES["op2_iterative_quantisation"] = """
with recursive v as materialized (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where len(embedding) > 0 and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
    and len([x for x in embedding if x <> 0]) > 0),
near as materialized (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (select vec_id as a, vec_id as b from v union select r.a, n.b from reach r join near n on r.b = n.a),
links as (select a, count(*) as n from near group by a),
least as (select a, min(b) as b from reach group by a)
select vec_id, coalesce(n, 0) as n_links, coalesce(b, vec_id) as component_id, coalesce(b, vec_id) = vec_id as kept
from embeddings left join links on links.a = vec_id left join least on least.a = vec_id
"""


@query
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, and the output shards that hold its copies."""
    return mixing.assigned(table(spark, sf_dir, "documents"))


@query
def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal numbers, dates and addresses replaced by keyed pseudonyms of the same format."""
    return pii.pseudonymised(table(spark, sf_dir, "documents"), count="n_replaced")


@query
def op5_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a third of the ids is held out from the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.score_of(docs, model).alias("score"))
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_heap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    text = F.coalesce("text", F.lit(""))
    counted = table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
        token_counts.token_count("text", tokenizer_path("piece_bpe_32k.model")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@query
def op7_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


@query
def op8_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.classes(table(spark, sf_dir, "documents"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2,048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op10_block_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_text.extracted("html").alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


@query
def op11_pivotal_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words' number, its form and the root of its forms."""
    return spelling.variants(table(spark, sf_dir, "documents"))


ORACLES["op11_pivotal_spellings"] = sql.VARIANTS


@query
def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and whether it stays after the cleaning of its lines."""
    judged = table(spark, sf_dir, "documents").select("doc_id", line_rules.judged("text").alias("_lines"))
    return judged.select("doc_id", *[f"_lines.{name}" for name in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


ORACLES["op12_line_rules"] = sql.line_cleaning()


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what a tampered leaf folds to."""
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered_leaf())


ORACLES["op13_merkle_manifest"] = sql.MANIFEST
