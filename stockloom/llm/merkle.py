"""Merkle manifest of a document table: leaves, subtree roots, proofs, and what they say of tampered rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stockloom.llm.common import written

#: The columns a leaf covers, in order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")

#: A superblock has 2 ** LEVELS nodes. A block is one group of ``applyInPandas``, so this bounds a task's memory.
LEVELS = 12

#: One in so many rows (by check sum of its id) is tampered with.
TAMPERED = 7

#: What a node needs from beyond its block: the siblings up to the root, each behind its side, ``-`` where there is none.
OUTER = "tree string, idx long, path array<string>, subroot string, root string"
BLOCK = "tree string, idx long, size long, digest string, whole boolean"


def field(value: Column) -> Column:
    """A value as it goes into a leaf: its length in bytes and the value, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a row, with other values for some of its columns."""
    return F.sha2(F.concat(*[field(changed.get(name, F.col(name))) for name in COVERED]), 256)


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def reduced(level: list[str], size: int, height: int) -> list[list[str]]:
    """The levels over a block's nodes, in a tree of so many: until one remains if the block is the tree, else ``height`` of them."""
    levels = [level]
    while len(levels[-1]) > 1 if size <= 2 ** height else len(levels) <= height:
        below = levels[-1]
        levels.append([digest(*below[i:i + 2]) for i in range(0, len(below), 2)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """The siblings of a node of the lowest level, upwards."""
    path = []
    for level in levels[:-1]:
        other = at ^ 1
        path.append("-" if other >= len(level) else ("L" if other < at else "R") + level[other])
        at >>= 1
    return path


def folded(node: str, path: list[str]) -> str:
    """The root that a node and its siblings lead to."""
    for step in path:
        node = digest(step[1:], node) if step[0] == "L" else digest(node, step[1:])
    return node


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``idx``, each one's place in its ``tree`` by ``order``, from 0, and ``size``, the nodes of the tree.

    Rows are dealt by ranges of tree and order, so a tree of any size is many tasks; a place is the rows of the tree in earlier
    ranges, from a table of one row for each range and tree, plus the place in the range. Equal rows are dealt by where
    they were read, which is why ``nodes`` must be a written table.
    """
    read = nodes.withColumn("_read", F.monotonically_increasing_id())
    keys = [F.col(name).asc_nulls_first() for name in ("tree", *order, "_read")]
    dealt = written(
        read.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop("_read"),
        "dealt").withColumn("_range", F.shiftright("_at", 33))
    ranges = dealt.groupBy("tree", "_range").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    of_tree = W.partitionBy("tree")
    before = F.sum("_rows").over(of_tree.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_rows")
    starts = ranges.select("tree", "_range", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(of_tree).alias("size"))
    return dealt.join(starts, ["tree", "_range"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def block_number(height: int) -> Column:
    return F.shiftright("idx", height).alias("block")


def block_roots(nodes: DataFrame, height: int) -> DataFrame:
    """What remains of each superblock, as ``BLOCK``: numbered within its tree, with the number of the tree's blocks."""

    def root_of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        tree, idx, size = frame["tree"].iloc[0], int(frame["idx"].iloc[0]), int(frame["size"].iloc[0])
        top = reduced(list(frame["digest"]), size, height)[-1][0]
        return pd.DataFrame([(tree, idx >> height, -(-size >> height), top, size <= 2 ** height)], columns=["tree", "idx", "size", "digest", "whole"])

    return nodes.select("tree", "idx", "size", "digest").groupBy("tree", block_number(height)).applyInPandas(root_of, BLOCK)


def tiers_of(nodes: DataFrame, height: int) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """The nodes of each tier with the trees that end in it, and every tree's root (``tree, digest``).

    The blocks' roots are the next tier's nodes, which is ``2 ** height`` times smaller.
    """
    tiers, roots = [], None
    while True:
        blocks = written(block_roots(nodes, height), "blocks")
        ended = blocks.filter("whole").select("tree", "digest")
        tiers.append((nodes, ended.select("tree")))
        roots = ended if roots is None else roots.union(ended)
        nodes = blocks.filter("not whole").drop("whole")
        if nodes.isEmpty():
            return tiers, roots


def exchanged(nodes: DataFrame, outer: DataFrame, finish: Callable, schema: str, height: int) -> DataFrame:
    """Every superblock's nodes and the one row of outer nodes it needs, cogrouped, reduced and finished.

    ``finish(nodes in order, their whole paths, subroot, root)`` gives the block's rows.
    """

    def joined(frame: pd.DataFrame, needed: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        levels = reduced(list(frame["digest"]), int(frame["size"].iloc[0]), height)
        beyond, subroot, root = needed[["path", "subroot", "root"]].iloc[0]
        return finish(frame, [siblings(levels, at) + list(beyond) for at in range(len(frame))], subroot, root)

    needed = outer.select(F.col("tree").alias("of_tree"), F.col("idx").alias("of_block"), "path", "subroot", "root")
    return nodes.groupBy("tree", block_number(height)).cogroup(needed.groupBy("of_tree", "of_block")).applyInPandas(joined, schema)


def handed_down(tiers: list[tuple[DataFrame, DataFrame]], above: DataFrame, height: int) -> DataFrame:
    """The outer rows of the lowest tier's blocks; ``above`` has those of the trees' roots (``OUTER`` with idx 0)."""

    def finish(frame, paths, subroot, root):
        return pd.DataFrame({"tree": frame["tree"], "idx": frame["idx"], "path": paths, "subroot": subroot, "root": root})

    def needed(ended: DataFrame) -> DataFrame:
        return above.join(ended, "tree")

    outer = needed(tiers[-1][1])
    for (nodes, _), (_, ended) in zip(tiers[:0:-1], tiers[-2::-1]):
        outer = needed(ended).unionByName(written(exchanged(nodes, outer, finish, OUTER, height), "outer"))
    return outer


def over_roots(roots: DataFrame, height: int) -> DataFrame:
    """What lies over every subroot (``tree, digest``): the tree of the subroots in order of their names."""

    def finish(frame, paths, subroot, root):
        return pd.DataFrame({"tree": frame["name"], "idx": 0, "path": paths, "subroot": frame["digest"], "root": root})

    named = written(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "subroots")
    nodes = written(placed(named, ["name"]), "top")
    tiers, tops = tiers_of(nodes, height)
    end = tops.select("tree", F.lit(0).cast("long").alias("idx"), F.array().cast("array<string>").alias("path"),
                      F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    return written(exchanged(nodes, handed_down(tiers, end, height), finish, OUTER, height), "over")


def manifest(docs: DataFrame, presented: Column | None = None, proofs: bool = False, height: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row, and ``proof`` if asked for.

    A leaf is the digest of the row's ``COVERED`` columns. The leaves of a language form a tree by ``doc_id`` (null first, of equal ids
    by leaf), the roots of the languages one by name (null first). ``presented`` is the leaf that is to be verified against
    the row's siblings, by default the row's own. ``proof`` lists the siblings upwards, ``L`` or ``R`` (the sibling's side) before the
    digest and ``-`` where a node is alone. Superblocks have ``2 ** height`` nodes. Texts are hashed where they are read and never shuffled. Null and empty values
    have leaves of their own, repeated rows equal leaves at places of their own, and an empty table has no rows.
    """
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    leaves = written(docs.select(
        tree.alias("tree"), "doc_id", leaf().alias("digest"), (leaf() if presented is None else presented).alias("presented")), "leaves")
    nodes = written(placed(leaves, ["doc_id", "digest"]).withColumn("doc_id", F.col("doc_id").cast("string")), "nodes")
    tiers, roots = tiers_of(nodes, height)
    outer = handed_down(tiers, over_roots(roots, height), height)

    def finish(frame, paths, subroot, root):
        rows = pd.DataFrame({"doc_id": frame["doc_id"], "leaf": frame["digest"], "subroot": subroot, "root": root})
        rows["proof_sha256"] = [digest(*[step[1:] for step in path]) for path in paths]
        rows["folded_root"] = [folded(node, path) for node, path in zip(frame["presented"], paths)]
        rows["verified"] = rows["folded_root"] == root
        if proofs:
            rows["proof"] = paths
        return rows

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    done = exchanged(nodes, outer, finish, schema + (", proof array<string>" if proofs else ""), height)
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def tampered_leaf() -> Column:
    """The leaf after one is added to ``n_chars`` of every seventh row by its id's check sum; null ids and null counts stay."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, F.lit(False))
    return F.when(hit, leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)).otherwise(leaf())
