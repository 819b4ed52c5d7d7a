from __future__ import annotations

import pytest
from pyspark.sql import types as T

#: A document table with all awkward rows, and columns whose names the operators use inside.
ODD = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(name, T.StringType()) for name in (
        "code", "size", "_row", "_text", "_found", "_new", "_rank", "_id", "score", "place", "block", "node", "root", "part", "n")],
])


def odd_row(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["x"] * (len(ODD) - 5))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, texts, sources; empty, blank and very long texts; repeated rows and copies."""
    long_text = "many words in a very long text that goes on and on " * 4000
    rows = [
        odd_row(1, "The first text has just a few words in it."), odd_row(2, None), odd_row(3, ""), odd_row(4, " \n\t "),
        odd_row(5, long_text), odd_row(6, long_text), odd_row(7, "The first text has just a few words in it."),
        odd_row(7, "The first text has just a few words in it."), odd_row(8, "one", None), odd_row(None, "no id here at all", None, None),
        odd_row(None, None, None, None), odd_row(9, "x" * 50_000, "t"), odd_row(10, "ünïcödé 🦙 中文 \x00 text", "t"),
    ]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD)
