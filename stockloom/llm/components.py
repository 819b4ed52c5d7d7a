"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stockloom.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``src``, ``dst``): root is the smallest node reachable.

    Each round every node takes the smallest root among its neighbours' and then its root's root, until nothing
    changes. Minima are combined before the shuffle and the joins carry one row on one side, so a node with very many
    edges is split by the skew join. Each round is written to the shared folder. An empty edge table gives no rows;
    repeated edges and loops change nothing.
    """
    pairs = written(
        edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(),
        "pairs",
    )
    roots = written(
        pairs.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("_least"))
        .select("node", F.least("node", "_least").alias("root"), F.lit(True).alias("changed")),
        "roots",
    )
    while not roots.filter("changed").isEmpty():
        near = (
            pairs.join(roots.select(F.col("node").alias("dst"), "root"), "dst")
            .groupBy(F.col("src").alias("node")).agg(F.min("root").alias("_near"))
        )
        hooked = written(
            roots.join(near, "node").select(
                "node", F.least("root", "_near").alias("root"), F.col("root").alias("_before")),
            "hooked",
        )
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("_above"))
        roots = written(
            hooked.join(above, "root", "left").select(
                "node", F.coalesce("_above", "root").alias("root"),
                (F.coalesce("_above", "root") != F.col("_before")).alias("changed")),
            "roots",
        )
    return roots.select("node", "root")
