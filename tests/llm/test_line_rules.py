from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stockloom.llm import line_rules

WORDS = "river hill house road bridge tower garden window lake stone field market morning winter letter table".split()
DRAW = random.Random(5)
PROSE = "\n".join("The " + " ".join(DRAW.choice(WORDS) for _ in range(15)) + " ends here." for _ in range(8))


def counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))


def judge(spark, *texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.j for r in frame.select("i", line_rules.judged("t").alias("j")).orderBy("i").collect()]


@pytest.mark.parametrize("line,kind", [
    ("Home | News | Sport | Contact", "navigation"), ("Read more", "navigation"), ("Startseite » Themen » Wetter", "navigation"),
    ("© 2020 Some Firm. All rights reserved.", "boilerplate"), ("This site uses cookies to serve you better.", "boilerplate"),
    ("a list of words without any end", "punctuation"), ("BUY!! NOW!! IT!! IS!! CHEAP!!", "punctuation"),
    ("so*** many### signs$$$ in%%% one&&& line.", "punctuation"),
])
def test_failing_lines_go(spark, line, kind):
    (found,) = judge(spark, f"{PROSE}\n{line}\n{PROSE[:0]}")
    assert found.text == f"{PROSE}\n" and found[f"lost_to_{kind}"] == len(line.split()) and found.kept


def test_good_lines_stay(spark):
    wrapped = "A sentence that is broken off here\nand goes on in the next line, as in old books.\n“Quoted speech ends so.”\n完了しました。"
    (found,) = judge(spark, f"{PROSE}\n{wrapped}")
    assert found.text == f"{PROSE}\n{wrapped}" and found.kept


def test_a_document_that_loses_too_much_goes(spark):
    menu = [f"a{i} | b{i} | c{i} | d{i}" for i in range(20)]
    few, many = judge(spark, "\n".join([PROSE, *menu[:3]]), "\n".join([PROSE, *menu]))
    assert few.kept and not many.kept and not many.base_failed


def test_base_rules(spark):
    short, repeated, fine = judge(spark, "Only a few words.", "the same three words. " * 40, PROSE)
    assert short.base_failed and repeated.base_failed and not fine.base_failed
    assert not short.kept and not repeated.kept and fine.kept


def test_counts_are_the_plain_ones(spark, odd_docs):
    texts = [r.text for r in odd_docs.collect()] + [
        PROSE + "\n" + PROSE, "a b c a b c", "a a a a", "a a a", "x y \x1c z\n\n\t\nx y \x1c z", "# a & b < c > d | e * f % g $ h"]
    for text, found in zip(texts, judge(spark, *texts)):
        assert (found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words) == counts(text)


def test_windows_of_very_many_different_words():
    words = [str(i) for i in range(1_000_100)] + ["1", "2", "3"]
    assert line_rules.repeated_words(words) == 6


def test_odd_rows_and_columns(odd_docs):
    kept = line_rules.cleaned(odd_docs.union(odd_docs.limit(1).withColumn("text", F.lit(PROSE))))
    assert kept.columns == odd_docs.columns and [r.text for r in kept.collect()] == [PROSE]


def test_empty_table(no_docs):
    assert line_rules.cleaned(no_docs).count() == 0
