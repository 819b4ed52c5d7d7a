"""Token counts by byte-pair merging with a heap and a linked list; no ids are made."""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from stockloom.llm.common import in_blocks

#: Pieces between spaces whose counts a worker remembers, their longest in characters (about 200 bytes each in all), and
#: characters counted at once.
REMEMBERED, LONGEST = 1_000_000, 32
BLOCK_CHARACTERS = 2_000_000
#: The character that stands for a space in the vocabulary.
SPACE = "▁"
POSITION_BITS = 40

_counters: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Counts of a byte-pair vocabulary with a score for each piece, byte fallback and an added leading space.

    Only the vocabulary is read with the tokenizer's library; merging is done here. No piece holds a space after another
    character, so that a text falls apart into pieces that start with their spaces and merge on their own; the counts of
    frequent ones are remembered.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [
            i for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {model.id_to_piece(i): model.get_score(i) for i in usable}
        if any(SPACE in piece.lstrip(SPACE) for piece in scores):
            raise ValueError("a piece holds a space after another character")
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: order[score] << POSITION_BITS for piece, score in scores.items()}
        self.known: dict[str, int] = {}

    @classmethod
    def at(cls, path: str) -> "PieceCounter":
        if path not in _counters:
            _counters[path] = cls(path)
        return _counters[path]

    def merged(self, symbols: str) -> int:
        """Tokens of a string of symbols: its symbols (bytes for those not in the vocabulary) minus its merges.

        The heap holds rank and place of adjacent pairs: the lowest rank comes first, of equal ones the leftmost. An entry
        counts only while its pair is still there (``wanted``).
        """
        rank, n = self.rank, len(symbols)
        part = list(symbols)
        left = n
        for s in part:
            if s not in rank:
                left += len(s.encode("utf-8", "surrogatepass")) - 1
        wanted = [rank.get(a + b, -1) for a, b in zip(part, part[1:])]
        heap = [r + i for i, r in enumerate(wanted) if r >= 0]
        if not heap:
            return left
        wanted.append(-1)
        heapify(heap)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        mask = (1 << POSITION_BITS) - 1
        while heap:
            entry = heappop(heap)
            i = entry & mask
            if wanted[i] != entry - i:
                continue
            j = following[i]
            whole = part[i] = part[i] + part[j]
            left -= 1
            wanted[j] = -1
            k = following[i] = following[j]
            if k < n:
                before[k] = i
                r = wanted[i] = rank.get(whole + part[k], -1)
                if r >= 0:
                    heappush(heap, r + i)
            else:
                wanted[i] = -1
            h = before[i]
            if h >= 0:
                r = wanted[h] = rank.get(part[h] + whole, -1)
                if r >= 0:
                    heappush(heap, r + h)
        return left

    def split(self, text: str) -> list[str]:
        """What stands between spaces; of several spaces all but the first lead the next word."""
        text = text.replace(SPACE, " ")
        if "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ")
        return [chunk[1:] for chunk in re.findall(" +[^ ]*", " " + text)]

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text; 0 for a null or empty one."""
        split = [self.split(t) if t else [] for t in texts]
        words = set().union(*split)
        new = [word for word in words if word not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(words)
        known, merged = self.known, self.merged
        for word in new:
            known[word] = merged(SPACE + word.replace(" ", SPACE))
        found = [sum(map(known.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > LONGEST:
                del known[word]
        return found


def token_count(text: str | Column, path: str) -> Column:
    """The number of tokens of the whole text by the vocabulary at ``path``; 0 for null and empty texts."""
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        counter = PieceCounter.at(path)
        return pd.Series(np.fromiter(
            (n for block in in_blocks(texts.tolist(), BLOCK_CHARACTERS) for n in counter.counts(block)), np.int64, len(texts)))

    return count(F.col(text) if isinstance(text, str) else text)
