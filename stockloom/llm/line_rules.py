"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much of its text goes as well."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed values of the rules.
#: What a sentence ends with, and what may close behind it.
ENDS, CLOSERS = ".!?…:;。！？：；", "])\"'”’»"
SYMBOLS = "#*$%&|<>"
#: Words that only part the entries of a menu.
SEPARATORS = ("|", "||", "»", "›", "·", "•", ">", ">>", "::", "/", "→")
#: Whole lines of page furniture.
NAVIGATION = (
    "home", "menu", "search", "login", "log in", "sign in", "sign up", "register", "subscribe", "next", "previous", "next page", "previous page",
    "read more", "continue reading", "share", "share this", "tweet", "print", "back to top", "skip to content", "contact us", "about us",
    "startseite", "suche", "anmelden", "weiterlesen", "nach oben", "accueil", "recherche", "connexion", "lire la suite", "haut de page",
    "inicio", "buscar", "iniciar sesión", "leer más", "volver arriba",
)
#: Notices, in lines of at most so many words.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "cookie policy", "terms of use", "terms of service", "terms and conditions", "uses cookies", "use cookies",
    "accept cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "licensed under", "released under the", "copyright ©", "copyright (c)",
    "sign up for our newsletter", "alle rechte vorbehalten", "datenschutzerklärung", "verwendet cookies", "tous droits réservés",
    "politique de confidentialité", "utilise des cookies", "todos los derechos reservados", "política de privacidad", "utiliza cookies",
)
NOTICE_WORDS = 40

#: The base rules: fewer words, or more words per hundred in repeated windows of three, and a document fails at once.
FEWEST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
#: How many words per hundred may go with the lines.
MOST_LOST = 30

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]*"
FINISHED = rf"[{ENDS}][\{CLOSERS}]*{SPACE}$"
#: A line that goes on where the one before was broken off: it doesn't start with a capital, digit or sign.
GOES_ON = rf"^{SPACE}[\p{{Ll}}\p{{Lo}}]"
SHOUTS = r"[!?]{2,}"
NOTICE = "|".join(regex.escape(phrase) for phrase in BOILERPLATE)
TO_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_to_punctuation", "lost_to_navigation", "lost_to_boilerplate")
RESULT = T.StructType([
    T.StructField("text", T.StringType()), *[T.StructField(name, T.LongType()) for name in COUNTS],
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
])


def repeated_words(words: list[str]) -> int:
    """How many words lie in windows that occur twice or more."""
    if len(words) <= WINDOW:
        return 0
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(word, len(ids)) for word in words), np.int64, len(words))
    pairs = codes[:-1] * len(ids) + codes[1:]
    if len(ids) > 1_000_000:  # three codes in one number would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, window, times = np.unique(pairs[:-1] * len(ids) + codes[2:], return_inverse=True, return_counts=True)
    repeated = times[window] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(WINDOW):
        covered[shift:shift + len(repeated)] |= repeated
    return int(covered.sum())


class Rules:
    """The rules with their patterns compiled, once for each task."""

    def __init__(self):
        self.word, self.finished, self.goes_on, self.shouts, self.notice = (
            regex.compile(pattern) for pattern in (WORD, FINISHED, GOES_ON, SHOUTS, NOTICE))

    def failed(self, line: str, words: list[str], following: str) -> str | None:
        """The kind of rule that a line with words fails; ``following`` is the next line with words."""
        n = len(words)
        plain = " ".join(words).translate(TO_LOWER)
        if n <= NOTICE_WORDS and self.notice.search(plain):
            return "boilerplate"
        parted = sum(word in SEPARATORS for word in words)
        if plain in NAVIGATION or (parted >= 2 and 3 * parted >= n):
            return "navigation"
        if not self.finished.search(line) and not self.goes_on.search(following):
            return "punctuation"
        if 10 * sum(map(line.count, SYMBOLS)) > 3 * n or 5 * len(self.shouts.findall(line)) > n:
            return "punctuation"
        return None

    def judged(self, text: str | None) -> tuple:
        text = text or ""
        lines = text.split("\n")
        worded = [(i, line, words) for i, line in enumerate(lines) if (words := self.word.findall(line))]
        all_words = [word for _, _, words in worded for word in words]
        lost = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
        gone = set()
        for (i, line, words), following in zip(worded, [*[line for _, line, _ in worded[1:]], ""]):
            rule = self.failed(line, words, following)
            if rule:
                lost[rule] += len(words)
                gone.add(i)
        n = len(all_words)
        repeated = repeated_words(all_words)
        base_failed = n < FEWEST_WORDS or 100 * repeated > MOST_REPEATED * n
        return (
            "\n".join(line for i, line in enumerate(lines) if i not in gone), n, sum(map(len, all_words)),
            sum(map(text.count, SYMBOLS)), len(worded) - len({line for _, line, _ in worded}), repeated,
            *lost.values(), base_failed, not base_failed and 100 * sum(lost.values()) <= MOST_LOST * n)


@F.pandas_udf(RESULT)
def judged(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The cleaned text, the counts over the whole text, the words lost to each kind of rule, and the verdicts.

    A null text counts as an empty one, which has no words and so fails. Texts are judged whole, one at a time, however long.
    """
    rules = Rules()
    for texts in frames:
        yield pd.DataFrame([rules.judged(text) for text in texts], columns=RESULT.names)


def cleaned(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """The documents that stay, without their failing lines; all columns, and no row more than once for each of its copies."""
    found = docs.withColumn("_lines", judged(text))
    return found.filter("_lines.kept").withColumn("text", F.col("_lines.text")).drop("_lines")
