"""Spelling variants: words one edit apart, found by pivotal grams, grouped under their most frequent form."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stockloom.llm.common import written

#: A word is a maximal run of these; only A to Z are lower-cased.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: One in so many runs of a document (by check sum) loses a character: the variants that the grouping is to find.
DAMAGED = 199
SHORTEST, FEWEST, TIMES = 6, 5, 5

#: Grams have two characters and words are one edit apart: the rarest q + 1 grams of a word are its prefix, two of them pivots.
GRAM, PREFIX = 2, 3


def occurrences(docs: DataFrame) -> DataFrame:
    """``word`` for every run of letters of every text; a null text has none, a null id counts as an empty one."""
    texts = docs.select("doc_id", F.translate("text", UPPER, LOWER).alias("text"))
    runs = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= SHORTEST)
    check = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (check % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.select(F.when(check % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of the words long and frequent enough; counts are combined before the shuffle."""
    words = occurrences(docs).filter(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= FEWEST)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """In how many words each gram occurs. There are at most 90 letters, hence 8,100 grams, whatever the data."""
    grams = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(GRAM))))
    counts = words.select(F.explode(grams).alias("gram")).groupBy("gram").count()
    return {row["gram"]: row["count"] for row in counts.collect()}


def chosen(word: str, rank: dict[str, int], expected) -> tuple[list[int], int, int, int]:
    """The places of the grams in a word's prefix, the two pivots' places, and the rank of the prefix's last gram.

    The prefix holds the rarest grams and whatever equals the last of them, so that no occurrence of a gram up to that rank is
    left out. Of all pairs of disjoint grams in it a sweep over the places keeps the cheapest left pivot behind it.
    """
    ranks = sorted(rank[word[i:i + GRAM]] for i in range(len(word) - 1))
    last = ranks[PREFIX - 1]
    places = [i for i in range(len(word) - 1) if rank[word[i:i + GRAM]] <= last]
    left: list[tuple[float, int]] = []  # the cheapest left pivot up to each place of the prefix
    best = (math.inf, 0, 0)
    for place in places:
        behind = [x for x, p in zip(left, places) if p + GRAM <= place]
        if behind:
            cost = behind[-1][0] + expected(word[place:])
            best = min(best, (cost, behind[-1][1], place))
        here = (expected(word[:place + GRAM]), place)
        left.append(min(left[-1], here) if left else here)
    return places, best[1], best[2], last


ENTRIES = "word string, n long, size int, last int, entry array<struct<side: int, piece: string>>, pivot array<struct<side: int, piece: string, size: int, head: string, tail: string>>"


def grammed(words: DataFrame) -> DataFrame:
    """Every word with the index entries of its prefix and the probes of its two pivots.

    One edit leaves a pivot whole. If it lies behind the first pivot, the word up to that pivot's end is whole as well
    (side 0); else the word from the second pivot on is (side 1). So a place is matched together with all that
    lies on the whole side of it, which also says where in the other word the gram must be.
    """
    counts = gram_counts(words)
    total = sum(counts.values())
    rank = {gram: i for i, gram in enumerate(sorted(counts, key=lambda gram: (counts[gram], gram)))}
    letters: dict[str, int] = {}
    for gram, count in counts.items():
        letters[gram[0]] = letters.get(gram[0], 0) + count

    def expected(piece: str) -> float:
        """How many words share the piece, if each letter depended on the one before alone."""
        share = math.log(counts[piece[:GRAM]] / total)
        share += sum(math.log(counts[piece[i:i + GRAM]] / letters[piece[i]]) for i in range(1, len(piece) - 1)
                     if letters.get(piece[i]))
        return math.exp(share)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for word, n in zip(frame["word"], frame["n"]):
                places, a, b, last = chosen(word, rank, expected)
                entry = [{"side": 0, "piece": word[:i + GRAM]} for i in places]
                entry += [{"side": 1, "piece": word[i:]} for i in places]
                pivot = []
                for size in (len(word) - 1, len(word), len(word) + 1):
                    # Behind the first pivot: before the second, which leaves the tail from there, or not, which leaves the head up to there.
                    pivot.append({"side": 0, "piece": word[:a + GRAM], "size": size, "head": word[:b], "tail": word[b:]})
                    pivot.append({"side": 1, "piece": word[b:], "size": size, "head": None, "tail": word[a + GRAM:]})
                out.append((word, n, len(word), last, entry, pivot))
            yield pd.DataFrame(out, columns=["word", "n", "size", "last", "entry", "pivot"])

    return words.select("word", "n").mapInPandas(rows, ENTRIES)


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b, a_n, b_n``: every two distinct words of ``words`` (``word, n``) exactly one edit apart, once, ``a`` before ``b``.

    A pivot of the word whose prefix ends at the rarer gram is in the other word's prefix, so pivots are joined
    with prefixes that don't end before their own. Words have three letters at least.
    """
    grams = written(grammed(words), "grams")
    index = grams.select(F.col("word").alias("b"), F.col("n").alias("b_n"), "size", F.col("last").alias("b_last"),
                         F.explode("entry").alias("e")).select("*", "e.side", "e.piece").drop("e")
    probes = grams.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("last").alias("a_last"),
                          F.explode("pivot").alias("p")).select("*", "p.*").drop("p")
    whole = F.col("b").endswith(F.col("tail")) | F.coalesce(F.col("b").startswith(F.col("head")), F.lit(False))
    met = probes.join(index, ["side", "piece", "size"]).filter(
        (F.col("a_last") <= F.col("b_last")) & (F.col("a") != F.col("b")) & whole)
    near = met.filter(F.levenshtein("a", "b", 1) == 1)
    first = F.col("a") < F.col("b")

    def ordered(x: str, y: str) -> list[Column]:
        return [F.when(first, F.col(x)).otherwise(F.col(y)).alias(x), F.when(first, F.col(y)).otherwise(F.col(x)).alias(y)]

    return near.select(*chain(ordered("a", "b"), ordered("a_n", "b_n"))).distinct()


def followed(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of the chain of ``word, form``. Each round doubles the steps; a form occurs ``TIMES`` as often, so rounds are few."""
    ends = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "ends")
    while not ends.filter("moved").isEmpty():
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        ends = written(ends.join(on, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "ends")
    return ends.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of at least six letters and five occurrences.

    Near words differ by one inserted, deleted or replaced letter. The form is the most frequent near word (of equal ones the first in
    code-point order), if it occurs five times as often; the root is where forms of forms end. ``docs`` needs ``doc_id`` and
    ``text``; null and empty texts give no words, repeated rows count again, a very long text is cut into runs
    in its own row, and no words give no rows.
    """
    words = written(vocabulary(docs), "words")
    pairs = written(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).union(
        pairs.select("b", "b_n", "a", "a_n"))
    best = both.groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("top"))
    is_form = -F.col("top.minus") >= TIMES * F.col("n")
    best = written(best.select(
        "word", "n_near", F.when(is_form, F.col("top.other")).alias("form"), F.when(is_form, -F.col("top.minus")).alias("form_n")), "best")
    roots = followed(best.filter("form is not null"))
    return words.join(best, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast(T.LongType()).alias("n_near"), "form_n")
