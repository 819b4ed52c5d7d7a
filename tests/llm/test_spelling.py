from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from stockloom.llm import spelling


def one_edit(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_words(docs):
    words = Counter()
    for doc_id, text in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def plain_variants(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 5 * words[w]:
            form[w] = best
    rows = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(rows)


@pytest.mark.parametrize("letters,longest", [("ab", 9), ("abcé", 8), ("abcdefgh", 12)])
def test_pivots_find_all_near_words(spark, letters, longest):
    draw = random.Random(longest)
    words = {"".join(draw.choices(letters, k=draw.randint(6, longest))) for _ in range(400)}
    for w in list(words)[:150]:
        i, c = draw.randrange(len(w)), draw.choice(letters)
        words |= {w[:i] + c + w[i:], w[:i] + c + w[i + 1:]} | ({w[:i] + w[i + 1:]} if len(w) > 6 else set())
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    found = [(r.a, r.b) for r in spelling.near_pairs(frame).collect()]
    assert sorted(found) == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_variants_are_the_plain_ones(spark):
    draw = random.Random(3)
    words = ["colour", "colours", "colouring", "Señorita", "aaaaaa", "aaaaaaa", "abababab", "ßtraßen"]
    docs = []
    for i in range(300):
        text = " ".join(draw.choice(words) for _ in range(60))
        if i % 10 == 0:
            text += " colur colur color coloor senorita aaaaab 2colours, colours-colour"
        docs.append((i, text))
    rows = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in rows) == plain_variants(plain_words(docs))


def test_roots_follow_all_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)], "word string, form string")
    assert {r.root for r in spelling.followed(forms).collect()} == {"w11"}


def test_forms_of_forms_and_ties(spark):
    counts = {"walked": 5, "walkedd": 25, "walkeddd": 125, "talked": 4, "balked": 25}
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    rows = {r.word: r for r in spelling.variants(spark.createDataFrame([(None, text)], "doc_id long, text string")).collect()}
    assert "talked" not in rows  # four occurrences
    assert rows["walked"].form == "balked" and rows["walked"].n_near == 2 and rows["walked"].form_n == 25  # first of two equal
    assert rows["walkedd"].root == rows["walkeddd"].word and rows["walkeddd"].form is None and rows["balked"].root == "balked"


def test_odd_rows(odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in spelling.variants(odd_docs).collect()) == plain_variants(plain_words(docs))


def test_empty_table(no_docs):
    assert spelling.variants(no_docs).count() == 0


def test_one_word_holds_nearly_all_rows(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('thousand ', 50) || 'thousend' as text").repartition(16)
    rows = {r.word: r for r in spelling.variants(docs).collect()}
    assert rows["thousend"].root == "thousand" and rows["thousand"].n + sum(
        r.n for w, r in rows.items() if w != "thousand") >= 2000 * 50
