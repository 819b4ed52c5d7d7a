"""Packing tokenised documents into sequences of a fixed length: bulk-synchronous best fit.

Pieces and gaps are sorted by size and kept as runs (all pieces of one length, all gaps of one size). A superstep takes
the longest run of pieces left, sweeps to the successor gaps (the smallest that hold it), resolves who gets which gap
by the pieces' ranks within their run, and updates the gaps; pieces without a gap open new sequences. The sweeps see
runs only, at most as many as a sequence has tokens, whatever the number of rows. Rows never meet in one task: they only look up what their
run's ranks got.
"""

from __future__ import annotations

import bisect
import math
import os
import re
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from stockloom.llm.common import arrow_batches, written

CAPACITY = 2048
END_ID = 0
#: Rows of a part of a run on average, should one run hold all rows; parts are ranked side by side.
PART_ROWS = 100_000
#: Words whose ids a worker remembers, and their longest in characters (about 200 bytes each in all). Words that come once in a block,
#: most of the different ones, are encoded again instead.
REMEMBERED, LONGEST = 500_000, 32
#: Bytes of texts that are encoded at once.
BLOCK_BYTES = 4_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Words of small letters and perhaps one mark, and some to try whether a tokenizer leaves such words as they are.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([.,;:!?]?)")
TRIED = ("the", "a", "straße,", "élan.", "señor;", "çà!", "thanedble", "zzzzzzzz?", "don", "s", "re", "ll:", "ñandúes", "øre", "fi", "ie.")

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Token ids of texts by a tokenizer that splits at white space, word by word through a bounded memory.

    White space never joins two words of such a tokenizer, and letters are lower-cased by it, so the ids of a text are
    those of its lower-cased words, one after another. Texts that hold the special tokens' opening are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.splitter = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.known: dict[str, bytes] = {}
        self.plain = self.splitter is not None and all(self.direct(PLAIN.fullmatch(word)) == self.whole(word) for word in TRIED)

    @classmethod
    def at(cls, path: str) -> "WordEncoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def direct(self, parts: re.Match[str]) -> bytes:
        """The ids of a plain word: its letters and its mark go to the model, with other letters than ASCII's as the bytes that it knows."""
        pieces = filter(None, parts.groups()) if parts[0].isascii() else (p for p, _ in self.splitter.pre_tokenize_str(parts[0]))
        ids = [token.id for piece in pieces for token in self.model.tokenize(piece)]
        return pack(f"<{len(ids)}I", *ids)

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet; those that the tokenizer doesn't normalise, in its model alone."""
        if self.plain:
            others = []
            for word in words:
                parts = PLAIN.fullmatch(word)
                if parts:
                    self.known[word] = self.direct(parts)
                else:
                    others.append(word)
            words = others
        for at in range(0, len(words), 20_000):
            part = words[at:at + 20_000]
            for word, encoding in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                ids = encoding.ids
                self.known[word] = pack(f"<{len(ids)}I", *ids)

    def ids(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of whole texts as little-endian 32-bit numbers; none for a null or empty text.

        Only the different words of the texts are looked up one by one; their ids are then laid out by Arrow.
        """
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        if not len(texts):
            return []
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        counts = np.bincount(coded.indices, minlength=len(words)).tolist()
        new = {word: n for word, n in zip(words, counts) if word not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {word: self.known[word] for word in words if word in self.known}
        self.learn(list(new))
        found = pa.array([self.known[word] for word in words], pa.large_binary())
        for word, n in new.items():
            if n == 1 or len(word) > LONGEST:
                del self.known[word]
        _, ends, data = found.take(coded.indices).buffers()
        bounds = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist()
        out = [data[first:last].to_pybytes() for first, last in zip(bounds[:-1], bounds[1:])]
        for i in np.flatnonzero(pc.match_substring(texts, "<|")).tolist():
            out[i] = self.whole(texts[i].as_py())
        return out


def in_slices(texts: pa.Array, most: int) -> Iterator[slice]:
    """Consecutive ranges of texts, as many at once as stay within a number of bytes, or one."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    first = held = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, held + most, "right")))
        yield slice(first, last)
        first, held = last, int(ends[last - 1])


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, whose ids end with END_ID; ``ids`` adds them as binary."""
    def cut(batches):
        encoder = WordEncoder.at(path)
        for batch in batches:
            for block in in_slices(batch.column(1), BLOCK_BYTES):
                columns = [[], [], [], [], [], []]
                for doc, whole in zip(batch.column(0)[block].to_pylist(), encoder.ids(batch.column(1)[block])):
                    data = whole + END_ID.to_bytes(4, "little")
                    for n, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at:at + 4 * capacity]
                        for column, value in zip(columns, (doc, n, at // 4, len(part) // 4, zlib.crc32(part), part if ids else None)):
                            column.append(value)
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays[:6 if ids else 5], names[:6 if ids else 5])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(cut, PIECES + (", ids binary" if ids else ""))


def sweep(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> pd.DataFrame:
    """Where the pieces of each run go: ``length, first`` (rank), ``sequence``, ``each`` (pieces side by side), ``place``.

    A piece of rank r in the run from ``first`` on goes into sequence + (r - first) // each, at place + length *
    ((r - first) % each).
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs of sequences (first, count)
    sizes: list[int] = []  # those of gaps, sorted
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def add(size: int, first: int, count: int) -> None:
        if size and count:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(sizes, size)
            gaps[size].append((first, count))

    for length, left in sorted(zip(lengths.tolist(), counts.tolist()), reverse=True):
        rank = 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    out.append((length, rank, opened, each, 0))
                    add(capacity - each * length, opened, full)
                    opened += full
                if rest:
                    out.append((length, rank + full * each, opened, rest, 0))
                    add(capacity - rest * length, opened, 1)
                    opened += 1
                break
            size = sizes[at]
            first, count = gaps[size].pop()
            if not gaps[size]:
                del gaps[size], sizes[at]
            each = min(size // length, left)
            taken = left // each if left // each < count else count
            out.append((length, rank, first, each, capacity - size))
            add(size, first + taken, count - taken)
            add(size - each * length, first, taken)
            rank, left = rank + taken * each, left - taken * each
    return pd.DataFrame(out, columns=["length", "first", "sequence", "each", "place"])


def packed(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """``pieces`` (with ``doc_id, piece, length, ids_crc32``) and where they go: ``sequence_id, offset``.

    Sequences hold at most ``capacity`` and have no holes. Pieces of equal length are ranked by parts of a hash and there by doc_id,
    piece and check sum; repeated rows are packed as often as they occur. An empty table gives no rows.
    """
    with arrow_batches(pieces.sparkSession, BLOCK_BYTES):
        rows = written(pieces, "pieces")
    parts = max(16, math.ceil(rows.count() / part_rows))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    counted = written(dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "runs")

    def all_runs(runs: pd.DataFrame) -> pd.DataFrame:
        return sweep(runs["length"].to_numpy(), runs["n"].to_numpy(), capacity)

    plan = (
        counted.groupBy("length").agg(F.sum("n").alias("n"))
        .groupBy().applyInPandas(all_runs, "length long, first long, sequence long, each long, place long")
        .groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "sequence", "each", "place"))).alias("steps"))
    )
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_run = written(
        counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(plan, "length")
        .select("length", "part", "before", "steps"), "run_parts")
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(within)).join(of_run, ["length", "part"]).withColumn(
        "_rank", F.col("_rank") - 1 + F.col("before"))
    step = F.element_at(F.filter("steps", lambda s: s["first"] <= F.col("_rank")), -1)
    placed = ranked.withColumn("_step", step).withColumn("_at", F.col("_rank") - F.col("_step.first"))
    return placed.select(
        *rows.columns,
        (F.col("_step.sequence") + F.floor(F.col("_at") / F.col("_step.each"))).alias("sequence_id"),
        (F.col("_step.place") + F.pmod("_at", "_step.each") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False, **columns) -> DataFrame:
    """Tokenise and pack whole documents. Null texts are empty documents of one id; null ids stay null."""
    return packed(pieces_of(docs, path, capacity, ids=ids, **columns), capacity)
