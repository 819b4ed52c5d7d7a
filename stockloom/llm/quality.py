"""Quality of documents by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed pairs of neighbouring characters, hashed triples of character classes and the share of repeated
words. Latent-semantic analysis (log counts, inverse document frequency, truncated SVD) is fitted on the labelled
sample; every document then votes with exact cosines against all of the sample's vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Documented bounds of the model: labelled rows, hashed terms and latent dimensions. They fix the broadcast size.
MAX_LABELLED = 2000
PAIRS, SHAPES, REPEATS = 1024, 1000, 8  # pairs: a hash of 10 bits; shapes: CLASSES ** 3
TERMS = PAIRS + SHAPES + REPEATS
DIMENSIONS = 48
NEIGHBOURS = 15
#: Documents whose cosines are computed at once, and characters of a text whose terms are counted at once.
BLOCK = 256
CHARACTERS = 1 << 20

# Character classes: other, lower case, upper case, digit, space, line break, letter beyond ASCII, sentence sign,
# symbol, bar.
CLASSES = 10


def _classes() -> np.ndarray:
    table = np.zeros(129, np.int16)
    for name, members in enumerate(
        ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", "", ".,;:?'\"-()",
         "!#$%&*+/<=>@[\\]^_`{}~", "|"], start=1
    ):
        for c in members:
            table[ord(c)] = name
    table[128] = 6
    return table


CLASS_OF = _classes()


def term_counts(text: str | None) -> np.ndarray:
    """How often each term occurs in the whole text; zeros for a null or empty text."""
    counts = np.zeros(TERMS)
    text = text or ""
    for at in range(0, len(text), CHARACTERS):
        # the two characters before a block complete the terms that cross its start
        points = np.frombuffer(text[max(0, at - 2):at + CHARACTERS].encode("utf-32-le", "surrogatepass"), np.uint32)
        first = 1 if at else 0
        pairs = (points[first:-1] * np.uint32(2654435761) + points[first + 1:] * np.uint32(2246822519)) >> np.uint32(22)
        counts[:PAIRS] += np.bincount(pairs, minlength=PAIRS)
        kinds = CLASS_OF[np.minimum(points, 128)]
        shapes = kinds[:-2] * np.int16(100) + kinds[1:-1] * np.int16(10) + kinds[2:]
        counts[PAIRS:PAIRS + SHAPES] += np.bincount(shapes, minlength=SHAPES)
    words = text.split()
    if words:
        repeated = 1 - len(set(words)) / len(words)
        counts[PAIRS + SHAPES + min(REPEATS - 1, int(repeated * REPEATS))] = len(words)
    return counts


def weights(counts: np.ndarray) -> np.ndarray:
    """Term weights of rows of counts: square roots of shares of the three kinds of terms, so that length plays no part."""
    parts = np.split(counts, [PAIRS, PAIRS + SHAPES], axis=1)
    return np.hstack([np.sqrt(part / np.maximum(part.sum(axis=1, keepdims=True), 1)) for part in parts])


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """What is broadcast: at most TERMS * (DIMENSIONS + 1) + MAX_LABELLED * (DIMENSIONS + 1) doubles (under 2 MB)."""

    inverse_frequency: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return unit(weights(counts) * self.inverse_frequency @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors, weighted by their cosine; the prior counts as one weak vote."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosines = self.latent(counts) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        # all vectors as near as the k-th vote, so that ties don't depend on an order
        least = np.partition(cosines, len(self.labels) - k, axis=1)[:, len(self.labels) - k, None]
        weight = np.where(cosines >= least, np.maximum(cosines, 0), 0) ** 4
        prior = self.labels.mean()
        return (weight @ self.labels + 0.01 * prior) / (weight.sum(axis=1) + 0.01)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled documents, those with the smallest hash of their id. Null labels or ids don't count."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = (
        docs.select("doc_id").filter("doc_id is not null").distinct().join(known, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by ``most`` rows


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, neighbours: int = NEIGHBOURS) -> Model:
    """Fit on the labelled documents. The tasks send back vectors of terms, not texts."""
    def vectors(batches):
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "quality": batch["quality"].astype("float64"),
                "terms": [term_counts(t).astype(np.float32).tobytes() for t in batch["text"]]})

    rows = labelled_sample(docs, labels, most).mapInPandas(vectors, "doc_id long, quality double, terms binary").toPandas()
    rows = rows.sort_values(["doc_id", "terms"], ignore_index=True).head(most)
    counts = np.array([np.frombuffer(t, np.float32) for t in rows["terms"]], np.float64).reshape(-1, TERMS)
    weighted = weights(counts)
    inverse = np.log((1 + len(weighted)) / (1 + (weighted > 0).sum(axis=0))) + 1
    weighted = weighted * inverse
    if len(weighted):
        values, axes = np.linalg.eigh(weighted.T @ weighted)
        axes = axes[:, ::-1][:, :DIMENSIONS]
    else:
        axes = np.zeros((TERMS, DIMENSIONS))
    return Model(inverse, axes, unit(weighted @ axes), rows["quality"].to_numpy(np.float64), neighbours)


def score_of(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score from 0 to 1 that a document is good, as a column of ``docs``.

    Each whole text is scored; null and empty texts have no terms and are scored by the labelled vectors nearest to none,
    that is by the sample's prior. Without any labelled row every score is 0.5. Equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = [
            shared.value.score(np.array([term_counts(t) for t in texts.iloc[at:at + BLOCK]]))
            for at in range(0, len(texts), BLOCK)
        ]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score(F.col(text))


def kept(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches ``least``."""
    return docs.filter(score_of(docs, model, text) >= least)
