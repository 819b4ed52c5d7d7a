"""Near-duplicate documents by SimHash fingerprints and a generalised pigeonhole search."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from stockloom.llm import hamming
from stockloom.llm.common import written
from stockloom.llm.components import connected_components

SHINGLE_WORDS = 4
MAX_BITS = 4
PARTITIONS = 4
HASH_SEED = 42


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text: a bit is set if more than half of the shingles' hashes have it set.

    A-Z are lower-cased and words are runs of bytes other than ASCII white space. A text of fewer words than a shingle
    is one shingle; a null, empty or blank text has the fingerprint 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle_words + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, (ends[shingle_words - 1:] - 1).tolist())])
    counts = np.zeros(64, np.int64)
    per_byte = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for block in range(0, n, 65536):
        counts += np.unpackbits(per_byte[block:block + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``code``, the fingerprint as a signed long."""
    schema = docs.select(*[F.col(c) for c in keep]).schema

    def batches(source):
        for batch in source:
            codes = np.fromiter(
                (fingerprint(t, shingle_words) for t in batch.column(len(keep)).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keep))], pa.array(codes.view(np.int64))], [*keep, "code"])

    out = schema.add("code", "long")
    return docs.select(*keep, text).mapInArrow(batches, out)


def bit_groups(codes: DataFrame, partitions: int) -> list[list[int]]:
    """The 64 bits in equal groups of correlated bits.

    Spark sums up how often each pair of bits is equal over all codes (4,096 sums). A group starts with the lowest bit
    left and takes, one by one, the bit whose strongest correlation with the group is largest (ties: the lowest).
    """
    def sums(batches):
        both, total = np.zeros((64, 64)), 0
        for batch in batches:
            values = batch["code"].to_numpy(np.int64).view(np.uint64)
            for at in range(0, len(values), 65536):
                bits = np.unpackbits(values[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                signs = bits.astype(np.float32) * 2 - 1
                both += signs.T @ signs
                total += len(bits)
        if total:
            i, j = np.triu_indices(64, 1)
            yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "agree": both[i, j], "n": total})

    rows = codes.select("code").mapInPandas(sums, "i int, j int, agree double, n long").groupBy("i", "j").agg(
        F.sum("agree").alias("agree"), F.sum("n").alias("n")).collect()
    strength = np.zeros((64, 64))
    for row in rows:
        strength[row.i, row.j] = strength[row.j, row.i] = abs(row.agree) / row.n
    left, groups = list(range(64)), []
    for g in range(partitions):
        group = [left.pop(0)]
        while len(group) < (64 * (g + 1)) // partitions - (64 * g) // partitions:
            group.append(max(left, key=lambda b: (strength[b, group].max(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def key_counts(codes: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """How many codes have each value of each group: tables of at most 2**16 counts a group of 16 bits."""
    def count(batches):
        tables = [np.zeros(1 << len(bits), np.int64) for bits in groups]
        for batch in batches:
            values = batch["code"].to_numpy(np.int64)
            for t, bits in enumerate(groups):
                tables[t] += np.bincount(hamming.keys_of(values, bits), minlength=len(tables[t]))
        for t, counts in enumerate(tables):
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"t": np.full(len(used), t, np.int32), "key": used, "n": counts[used]})

    out = [np.zeros(1 << len(bits), np.int64) for bits in groups]
    total = codes.select("code").mapInPandas(count, "t int, key long, n long").groupBy("t", "key").agg(F.sum("n").alias("n")).toPandas()
    for t in range(len(groups)):
        rows = total[total["t"] == t]
        out[t][rows["key"].to_numpy()] = rows["n"].to_numpy()
    return out


def allocate(costs: np.ndarray, most: int) -> np.ndarray:
    """Thresholds by dynamic programming: for each code (first axis) one per group, least summed cost.

    ``costs[c, g, r]`` estimates the candidates of code c in group g at threshold r - 1 (threshold -1 leaves the group
    out at cost 0). By the generalised pigeonhole principle thresholds that sum up to ``most - groups + 1`` lose no
    pair within ``most`` bits.
    """
    n, groups, choices = costs.shape
    budget = most + 1  # the thresholds plus one each sum up to this
    best = np.full((n, budget + 1), np.inf)
    best[:, 0] = 0
    picks = np.zeros((n, groups, budget + 1), np.int8)
    for g in range(groups):
        new = np.full((n, budget + 1), np.inf)
        for spent in range(budget + 1):
            for r in range(min(choices - 1, spent) + 1):
                cost = best[:, spent - r] + costs[:, g, r]
                better = cost < new[:, spent]
                new[better, spent] = cost[better]
                picks[better, g, spent] = r
        best = new
    out = np.zeros((n, groups), np.int64)
    spent = np.full(n, budget)
    for g in reversed(range(groups)):
        out[:, g] = picks[np.arange(n), g, spent]
        spent = spent - out[:, g]
    return out - 1


def radius_finder(groups: list[list[int]], counts: list[np.ndarray], most: int, largest: int = 2):
    """A function from codes to the thresholds of each code."""
    masks = [[hamming.flips(len(bits), r) for r in range(largest + 1)] for bits in groups]

    def radii(codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), len(groups)), np.int64)
        for at in range(0, len(codes), 8192):
            part = codes[at:at + 8192]
            costs = np.zeros((len(part), len(groups), largest + 2))
            for g, bits in enumerate(groups):
                keys = hamming.keys_of(part, bits)
                seen = np.zeros(len(part))
                for r in range(largest + 1):
                    # each probed key costs about as much as a candidate
                    seen = seen + counts[g][keys[:, None] ^ masks[g][r][None, :]].sum(axis=1) + len(masks[g][r])
                    costs[:, g, r + 1] = seen
            out[at:at + 8192] = allocate(costs, most)
        return out

    return radii


def links(codes: DataFrame, most: int = MAX_BITS, partitions: int = PARTITIONS) -> DataFrame:
    """``src, dst`` edges that join up all distinct codes within ``most`` bits of each other.

    Each group of candidates gives a spanning forest of its links instead of all its pairs, so a group of copies gives
    as many edges as it has members.
    """
    groups = bit_groups(codes, partitions)
    radii = radius_finder(groups, key_counts(codes, groups), most)
    met = written(hamming.meet(codes.select(F.col("code").alias("id"), "code"), groups, radii).drop("id"), "simhash_cells")

    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        cells, values = hamming.named_blocks(frame), frame["code"].to_numpy(np.int64)
        names, place = np.unique(values, return_inverse=True)
        left, right = [], []

        def visit(p, e):
            # a chunk of pairs is reduced to the edges that it adds
            a, b = place[p], place[e]
            root = hamming.forest(len(names), np.concatenate([*left, a]), np.concatenate([*right, b]))
            nodes = np.flatnonzero(root != np.arange(len(names)))
            left[:], right[:] = [nodes], [root[nodes]]

        hamming.candidates(cells, values, values, frame["probe"].to_numpy(bool), most, visit)
        src = np.concatenate(left) if left else np.zeros(0, np.int64)
        dst = np.concatenate(right) if right else np.zeros(0, np.int64)
        return pd.DataFrame({"src": names[dst], "dst": names[src]})

    rows = met.count()
    return hamming.dealt(met.withColumn("id", F.col("code")), rows).drop("id").groupBy("part").applyInPandas(edges, "src long, dst long").distinct()


def classes(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, most: int = MAX_BITS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest doc_id that
    links of at most ``most`` differing bits reach, itself included.

    Documents without words have the fingerprint 0 and link like any other. Repeated rows stay repeated. A null doc_id
    gets the smallest id of its class, null if the class has none. An empty table gives an empty result; other
    columns of the input are not read.
    """
    input_ = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = written(fingerprints(input_, shingle_words), "fingerprints")
    least = written(prints.groupBy("code").agg(F.min("doc_id").alias("least")), "codes")
    roots = connected_components(links(least, most))
    class_of = least.join(roots, F.col("code") == F.col("node"), "left").select(
        "code", "least", F.coalesce("root", "code").alias("root"))
    ids = class_of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(class_of.join(ids, "root").select("code", "component_id"), "classes")
    return prints.join(named, "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class: the row whose id is the smallest of the class (of rows that repeat the id, the one
    with the smallest text). A row without an id can't be named as a copy and stays. All columns are returned."""
    found = classes(docs, text=text, doc_id=doc_id, **options)
    firsts = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct()
    named = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rank = F.row_number().over(Window.partitionBy("_id").orderBy("_text"))
    kept = named.join(firsts, "_id", "left_semi").withColumn("_rank", rank).filter("_rank = 1").select("_row.*")
    return kept.unionByName(docs.filter(F.col(doc_id).isNull()))
