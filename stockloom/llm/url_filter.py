"""Allow or block URLs by rules, and by a character language-model ratio where no rule fits.

Two smoothed Markov models of variable order, one of accepted and one of rejected URLs, give each character a
probability after its context; longer contexts are interpolated with shorter ones by how often they were seen. A URL is
judged by the difference of the log likelihoods per character, against a threshold calibrated on labelled URLs that the
models haven't seen.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stockloom.llm.common import written

#: Longest context. All contexts are counted exactly, in tables that grow with the URLs.
ORDER = 4
#: Weights of grams are whole numbers of 1 / UNIT; at most FREQUENT grams are looked up without a shuffle.
UNIT, FREQUENT = 1 << 36, 4096
#: Weight of the shorter context, in characters.
SMOOTHING = 2.0
#: One of this many labelled URLs (by hash) calibrates the threshold; scores are counted in bins of 1 / BINS.
FOLDS, BINS, SPAN = 5, 200, 10

Rule = tuple[str, str]  # verdict, host/path

# The rules of the registered query.
RULES: tuple[Rule, ...] = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule whose host is the URL's or above it and whose path starts the URL's, and its verdict; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: len(r[1])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def characters(urls: list[str]) -> np.ndarray:
    """Places of the URLs' own bytes, between paddings."""
    lengths = np.array([len(u.encode("utf-8", "surrogatepass")) for u in urls], np.int64)
    starts = np.cumsum(lengths + ORDER) - lengths
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def grams_of(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of the URLs with the ORDER bytes before each, as numbers (the character lowest, the nearest byte next),
    and how many each URL has."""
    encoded = [u.encode("utf-8", "surrogatepass") for u in urls]
    data, here = np.frombuffer(b"".join(b"\0" * ORDER + u for u in encoded), np.uint8), characters(urls)
    grams = np.zeros(len(here), np.int64)
    for back in range(ORDER + 1):
        grams |= data[here - back].astype(np.int64) << (8 * back)
    return grams, np.array([len(u) for u in encoded], np.int64)


def count_grams(urls: DataFrame) -> DataFrame:
    """``gram, n, n0, n1``: every distinct gram of ``urls`` (``url, rows, accepted, held``), how often it occurs in all rows and
    in the rows of both classes that the models learn from. Batches add up before the shuffle."""
    def count(batches):
        for batch in batches:
            grams, lengths = grams_of(batch["url"].tolist())
            rows = batch["rows"].to_numpy(np.int64)
            learnt = ~batch["held"].to_numpy(bool)
            parts = [rows, *(rows * (learnt & (batch["accepted"] == bool(c)).to_numpy(bool)) for c in (0, 1))]
            names, place = np.unique(grams, return_inverse=True)
            sums = [np.zeros(len(names), np.int64) for _ in parts]
            for total, part in zip(sums, parts):
                np.add.at(total, place, np.repeat(part, lengths))
            yield pd.DataFrame({"gram": names, **dict(zip(("n", "n0", "n1"), sums))})

    return urls.select("url", "rows", "accepted", "held").mapInPandas(count, "gram long, n long, n0 long, n1 long").groupBy(
        "gram").agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")])


def weighed(grams: DataFrame) -> DataFrame:
    """``gram, n, weight``: the log chance of a gram's character after its context if accepted minus if rejected, in units of
    1 / UNIT.

    The counts of shorter contexts are sums of those of the grams that end alike. At most 2**16 grams of a table look up
    one key of an order above 1; the tables of shorter keys have at most 2**16 rows and go to all tasks.
    """
    out = grams.withColumns({"_chance0": F.lit(1 / 256), "_chance1": F.lit(1 / 256)})
    for order in range(ORDER + 1):
        pair = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))
        context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * order) - 1))
        seen = grams.groupBy(pair.alias("_pair")).agg(*[F.sum(f"n{c}").alias(f"_seen{c}") for c in (0, 1)])
        total = grams.groupBy(context.alias("_context")).agg(*[F.sum(f"n{c}").alias(f"_total{c}") for c in (0, 1)])
        seen, total = F.broadcast(seen) if order < 2 else seen, F.broadcast(total) if order < 3 else total
        out = out.withColumns({"_pair": pair, "_context": context}).join(seen, "_pair").join(total, "_context").select(
            "gram", "n", *[
                ((F.col(f"_seen{c}") + SMOOTHING * F.col(f"_chance{c}")) / (F.col(f"_total{c}") + SMOOTHING)).alias(f"_chance{c}")
                for c in (0, 1)])
    return out.select("gram", "n", F.round((F.log("_chance1") - F.log("_chance0")) * UNIT).cast("long").alias("weight"))


def scored_urls(urls: DataFrame) -> DataFrame:
    """``urls`` (``id, url, rows, accepted, held``) with ``score``: the mean weight of a URL's grams; 0 for an empty URL.

    The grams that make up more than a share of 1 / FREQUENT of all go to every task; the others are exploded and joined,
    so that no key has more than that share of the rows. Sums are of whole numbers, so their order doesn't matter.
    """
    weights = written(weighed(written(count_grams(urls), "url_grams")), "gram_weights")
    total = weights.agg(F.sum("n")).first()[0] or 0
    frequent = weights.filter(F.col("n") > F.lit(total / FREQUENT)).select("gram", "weight").orderBy("gram").toPandas()
    shared = urls.sparkSession.sparkContext.broadcast((frequent["gram"].to_numpy(np.int64), frequent["weight"].to_numpy(np.int64)))

    def split(batches):
        names, values = shared.value
        for batch in batches:
            grams, lengths = grams_of(batch["url"].tolist())
            owner = np.repeat(np.arange(len(batch)), lengths)
            place = np.minimum(np.searchsorted(names, grams), max(0, len(names) - 1))
            known = names[place] == grams if len(names) else np.zeros(len(grams), bool)
            part = np.zeros(len(batch), np.int64)
            np.add.at(part, owner[known], values[place[known]])
            ends = np.cumsum(np.bincount(owner[~known], minlength=len(batch)))
            rare = np.split(grams[~known], ends[:-1]) if len(batch) else []
            yield pd.DataFrame({"id": batch["id"], "length": lengths, "part": part, "rare": rare})

    parts = written(urls.select("id", "url").mapInPandas(split, "id long, length long, part long, rare array<long>"), "url_parts")
    rest = parts.select("id", F.explode("rare").alias("gram")).join(weights.select("gram", "weight"), "gram").groupBy("id").agg(
        F.sum("weight").alias("rest"))
    score = (F.col("part") + F.coalesce("rest", F.lit(0))) / F.lit(float(UNIT)) / F.greatest("length", F.lit(1))
    return urls.join(parts.join(rest, "id", "left").select("id", score.alias("score")), "id")


def calibrated(scored: DataFrame) -> float:
    """The threshold with the best mean of both classes' accuracies on the rows of held URLs (ties: the one nearest to 0); 0 if
    a class is missing. Scores are counted in bins by Spark."""
    bins = scored.filter("held and accepted is not null").select(
        "accepted", "rows", F.greatest(F.lit(-SPAN * BINS), F.least(F.lit(SPAN * BINS), F.floor(
            F.col("score") * BINS))).cast("int").alias("bin")).groupBy("accepted", "bin").agg(F.sum("rows").alias("count")).toPandas()
    counts = np.zeros((2, 2 * SPAN * BINS + 1))
    counts[bins["accepted"].astype(int), bins["bin"] + SPAN * BINS] = bins["count"]
    return best_edge(counts)


def best_edge(counts: np.ndarray) -> float:
    """The lower edge of a bin that parts the counts of both classes (rows) best."""
    if not counts.sum(axis=1).all():
        return 0.0
    below = np.cumsum(counts, axis=1) / counts.sum(axis=1, keepdims=True)
    gain = np.concatenate([[0], (below[0] - below[1])[:-1]])  # of a threshold at the lower end of each bin
    edges = np.arange(-SPAN * BINS, SPAN * BINS + 1) / BINS
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url") -> DataFrame:
    """All columns of ``pages`` and ``host, path, rule, verdict, score``.

    Rules label the URLs that they fit; the models learn from all of these but one in FOLDS, which calibrate the threshold. The
    others are allowed if their score reaches it. A null URL and one without ``://`` have an empty host and path and are
    scored as they are (an empty one scores 0). Without labelled URLs of both kinds the threshold is 0. Repeated rows get
    equal verdicts; columns of the input with the names of the new ones are replaced.
    """
    apart = pages.select(F.struct(*pages.columns).alias("_row"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = longest_rule(host, path, rules)
    # URLs are numbered when they are written, so that the numbers stay
    urls = written(apart.groupBy("url").agg(F.count(F.lit(1)).alias("rows")).select(
        F.monotonically_increasing_id().alias("id"), "url", "rows", (verdict == "allow").alias("accepted"),
        (F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0).alias("held")), "urls")
    scores = written(scored_urls(urls), "url_scores")
    threshold = calibrated(scores)
    scored = apart.join(scores.select("url", "score"), "url")
    default = F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block")
    new = {"host": host, "path": path, "rule": rule, "verdict": F.coalesce(verdict, default), "score": F.col("score")}
    return scored.select(
        *[F.col("_row").getField(c).alias(c) for c in pages.columns if c not in new], *[c.alias(n) for n, c in new.items()])
