"""Quality, token counts, packing and main text."""

from __future__ import annotations

import random
import re
import tracemalloc
import zlib
from html import unescape

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stockloom.llm import html_text, packing, quality, token_counts
from stockloom.llm.common import arrow_batches

PIECES, WORDS = str(public_tokenizers.path("piece_bpe_32k.model")), str(public_tokenizers.path("word_bpe_49k.json"))


# --- quality -------------------------------------------------------------------------------------


def prose(rng, words=60):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(words)) + "."


def labelled_texts(n=400):
    rng = random.Random(2)
    spoil = (lambda t: t.upper() + "!!", lambda t: t.replace(" ", "*** "), lambda t: " | ".join(t.split()), lambda t: " ".join(["spam spam"] * 40))
    rows = [(i, prose(rng)) for i in range(n)]
    return [(i, rng.choice(spoil)(t) if i % 4 == 0 else t, int(i % 4 > 0)) for i, t in rows]


def test_neighbours_tell_held_out_texts_apart(spark):
    docs = spark.createDataFrame(labelled_texts(), "doc_id long, text string, quality int")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality.fit(docs, docs.filter(~held).select("doc_id", "quality"))
    rows = docs.filter(held).select("quality", quality.score_of(docs, model).alias("score")).collect()
    assert len(rows) > 50 and np.mean([(r.score >= 0.5) == bool(r.quality) for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert quality.kept(docs, model).columns == docs.columns


def test_votes_are_those_of_all_cosines():
    rng = np.random.default_rng(0)
    model = quality.Model(np.ones(quality.TERMS), rng.normal(size=(quality.TERMS, 8)), quality.unit(rng.normal(size=(50, 8))), rng.integers(0, 2, 50).astype(float), 7)
    counts = rng.integers(0, 5, (20, quality.TERMS)).astype(float)
    cosines = model.latent(counts) @ model.vectors.T
    for row, score in zip(cosines, model.score(counts)):
        near = np.argsort(-row)[:7]
        weight = np.maximum(row[near], 0) ** 4
        assert np.isclose(score, ((weight * model.labels[near]).sum() + 0.01 * model.labels.mean()) / (weight.sum() + 0.01))


def test_terms_do_not_depend_on_blocks(monkeypatch):
    text = "Some text, with ünïcödé 🦙 and\nlines! " * 30
    whole = quality.term_counts(text)
    monkeypatch.setattr(quality, "CHARACTERS", 37)
    assert (quality.term_counts(text) == whole).all()
    assert whole[:quality.PAIRS].sum() == len(text) - 1 and not quality.term_counts(None).any()


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (9, 0), (None, 0), (8, None), (77, 1)], "doc_id long, quality int")
    model = quality.fit(odd_docs, labels)
    scores = {r.doc_id: r.s for r in odd_docs.select("doc_id", quality.score_of(odd_docs, model).alias("s")).collect()}
    assert len(model.labels) == 2 and all(0 <= s <= 1 for s in scores.values()) and scores[2] == scores[3] == 0.5
    empty = quality.fit(odd_docs, labels.limit(0))
    assert {r[0] for r in odd_docs.select(quality.score_of(odd_docs, empty)).collect()} == {0.5}
    assert no_docs.select(quality.score_of(no_docs, model)).count() == 0 and quality.kept(no_docs, empty).count() == 0


# --- token counts ----------------------------------------------------------------------------------


def test_counts_equal_the_library():
    rng = random.Random(1)
    library, counter = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.PieceCounter(PIECES)
    texts = ["", " ", "  ", "a  b", " a ", "▁▁a", "a▁", "\0", "🦙🦙", "<s> </s>", "<0x0A>", "\n\n \t", "a" * 5000, "ab " * 100 + "   ", "é́", "中文  テスト", "=" * 40]
    texts += ["".join(rng.choice(" ▁ab\ncdeé中🦙<>s/0x=-") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["the quick brown fox jumps over the lazy dog " * 50, prose(rng, 500)]
    assert counter.counts(texts) == [len(ids) for ids in library.encode(texts)]
    assert counter.counts([None]) == [0]


def test_counts_with_a_small_memory(monkeypatch):
    texts = [prose(random.Random(i), 30) for i in range(30)]
    whole = token_counts.PieceCounter(PIECES).counts(texts)
    monkeypatch.setattr(token_counts, "REMEMBERED", 40)
    small = token_counts.PieceCounter(PIECES)
    assert [small.counts([t])[0] for t in texts] == whole


def test_counts_of_odd_rows(odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for row in odd_docs.select("text", token_counts.token_count("text", PIECES).alias("n_tokens")).collect():
        assert row.n_tokens == len(library.encode(row.text or ""))
    assert no_docs.select(token_counts.token_count("text", PIECES)).count() == 0


# --- packing ---------------------------------------------------------------------------------------


def check_places(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= length]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


@pytest.mark.parametrize("part_rows", [10**6, 10])
def test_packing_is_as_tight_as_best_fit(spark, part_rows):
    rng = random.Random(5)
    lengths = [min(100, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(500)] + [100] * 40
    rows = [(i, 0, 0, n, i) for i, n in enumerate(lengths)]
    packed = packing.packed(spark.createDataFrame(rows, packing.PIECES), 100, part_rows).collect()
    assert sorted(r.doc_id for r in packed) == list(range(540))
    used, best = check_places(packed, 100), best_fit_decreasing(lengths, 100)
    assert used <= best * 1.01 + 1


def test_plain_words_have_the_library_ids():
    encoder, draw = packing.WordEncoder(WORDS), random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
    words = {"".join(draw.choices(letters, k=draw.randint(1, 12))) + draw.choice(["", "", ",", ".", "!", "?", ";", ":"]) for _ in range(4000)}
    words |= {a + b for a in ("s", "t", "re", "ve", "m", "ll", "d", "i") for b in ("", ".", ",")} | {"×a", "a÷b", "a..", "'s", "don't", "É", "e\u0301"}
    assert encoder.plain
    encoder.learn(sorted(words))
    assert all(encoder.known[word] == encoder.whole(word) for word in words)


def test_long_words_are_not_remembered():
    encoder, counter = packing.WordEncoder(WORDS), token_counts.PieceCounter(PIECES)
    texts = ["中文" * 200 + " short", "x" * 400 + " short"]
    assert encoder.ids(texts) == [encoder.whole(text) for text in texts] and set(encoder.known) == {"short"}
    assert counter.counts(texts) == counter.counts(texts) and set(counter.known) == {"short"}


def test_pieces_hold_the_library_ids(spark, odd_docs, no_docs):
    library = Tokenizer.from_file(WORDS)
    extra = spark.createDataFrame([(20, "A <|endoftext|> b's IT'S <|STARTOFTEXT|>"), (21, "Ǆ ﬁ É　x don't"), (22, "a b c 123 !?")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(extra)
    rows = packing.pack_documents(docs, WORDS, ids=True).collect()
    check_places(rows, packing.CAPACITY)
    expected = []
    for doc in docs.collect():
        ids = np.array([*library.encode(doc.text or "", add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048].tobytes()
            expected.append((doc.doc_id, n, at, len(part) // 4, zlib.crc32(part), part))
    key = lambda r: (str(r[0]), r[1], r[4])
    assert sorted([tuple(r)[:5] + (bytes(r["ids"]),) for r in rows], key=key) == sorted(expected, key=key)
    assert packing.pack_documents(no_docs, WORDS).count() == 0


def test_a_large_batch_is_encoded_block_by_block(spark, monkeypatch):
    texts = pa.array([f"{prose(random.Random(i), 40)} " * 100 for i in range(100)] * 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], ["doc_id", "text"])
    docs, made, rows = spark.createDataFrame([], "doc_id long, text string"), [], 0
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, function, schema: made.append(function))
    packing.pieces_of(docs, WORDS)
    tracemalloc.start()
    try:
        for out in made[0](iter([batch])):
            rows += out.num_rows
        assert rows >= len(texts) and texts.nbytes > 20_000_000 and tracemalloc.get_traced_memory()[1] < texts.nbytes / 2
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("most", [1, 90, 10**6])
def test_blocks_of_a_batch_have_the_library_ids(most):
    library, encoder = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS)
    texts = ["Ünïcödé 🦙 中文", None, "", " \n\t ", "A <|endoftext|> b", *[prose(random.Random(i), i % 30) + " É" for i in range(60)], "last", None]
    column = pa.array(["left out, ", *texts, "left out"])[1:-1]
    blocks = list(packing.in_slices(column, most))
    assert [i for b in blocks for i in range(b.start, b.stop)] == list(range(len(texts)))
    assert all(b.stop - b.start == 1 or sum(len((t or "").encode()) for t in texts[b]) <= most for b in blocks)
    found = [ids for b in blocks for ids in encoder.ids(column[b])]
    assert found == [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.ids([]) == [] and list(packing.in_slices(column[:0], most)) == []


def test_full_memory_keeps_the_words_in_use(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 6)
    encoder = packing.WordEncoder(WORDS)
    encoder.ids(["a b c d e once", "e d c b a"])
    assert set(encoder.known) >= set("abcde") and "once" not in encoder.known
    encoder.ids(["d e f g f g"])
    assert set(encoder.known) >= set("defg") and not set("abc") & set(encoder.known)
    learnt = []
    monkeypatch.setattr(encoder, "learn", lambda words: learnt.extend(words))
    assert encoder.ids(["d e"]) and not learnt


def test_batches_are_bounded_while_pieces_are_written(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(i, "word " * 200) for i in range(300)], "doc_id long, text string").coalesce(1)

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    with arrow_batches(spark, 50_000):
        assert docs.mapInArrow(rows, "n long").agg(F.max("n")).first()[0] < 100
    assert spark.conf.get(name, None) is None
    spark.conf.set(name, "20000")
    try:
        with arrow_batches(spark, 50_000):
            assert spark.conf.get(name) == "20000"
        assert spark.conf.get(name) == "20000"
    finally:
        spark.conf.unset(name)


def test_encoder_with_a_small_memory(monkeypatch):
    texts = [prose(random.Random(i), 30) for i in range(20)]
    whole = packing.WordEncoder(WORDS).ids(texts)
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    small = packing.WordEncoder(WORDS)
    assert [small.ids([t])[0] for t in texts] == whole


# --- main text -------------------------------------------------------------------------------------

TREE = html_text.trained()
PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{}</style><script>x="</p>";</script></head><body class="post">
<header><a href=/>Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="ad">Buy this thing now.</div>
<div class="cookie-notice">We use cookies on this site, please do accept all of them now.</div>
<article><header><h1>The title</h1></header><p>First &amp; main&nbsp;&lt;part&gt;,<script>no("<p>")</script> with <a href=x>a link</a>.<br>More
   of   it<p>Short.<!-- no <p>text --></p><form>Name <input name=a> <button>Send it</button></form><aside>Related things</aside><p><b>Bold</b> end
<section class="comments"><article><p>I am a reader and say that this is good.</p></article></section></article>
<div id="sidebar"><p>About the author of this site and more of the kind.</p></div><footer>&copy; 2020</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE, TREE) == "The title\nFirst & main <part>, with a link. More of it\nShort.\nBold end"


def test_pages_without_a_main_element():
    long = "This is a paragraph of a page without any markup that says so, and it has a good number of words."
    page = f"<body><div><a href=1>Home</a> <a href=2>About</a></div><div>{long}</div><div>{long}</div><div><a href=3>Imprint</a></div></body>"
    assert html_text.main_text(page, TREE) == f"{long}\n{long}"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p></p> ", ""), ("<article>cut <a href='x", "cut"), ("<article><p>a &am", "a &am"),
    ("<article><p>x < y & z</p><script>never closed", "x < y & z"), ("<main>1<hr>2<br/>3</main>", "1\n2 3"),
    ("<ARTICLE><P TITLE='a > b'>Upper</P></ARTICLE>", "Upper"), ("</div></article><article>late</article>", "late")])
def test_broken_pages(page, text):
    assert html_text.main_text(page, TREE) == text


@pytest.mark.parametrize("page, text", [
    ("<article><p>Before</p><svg class='i'/><p>Article text</p></article>", "Before\nArticle text"),
    ("<article><p>Before</p><button class=x><p>Article text</p><p>More <button>Send</button> text</p></article>", "Before\nArticle text\nMore text"),
    ("<article><p>One <svg><path d='x'/><g><svg>in</svg></g><text>out</text></svg> two <object data=x>no</object></p>Three</article>", "One two\nThree"),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> hold</p></article>", "Let x=1 hold"),
    ("<article><p>A <canvas>b <!-- </canvas> --> c</p><script>'</canvas>'</script><p>d</p></article>", "A b c\nd"),
    ("<body class='comments-open'><article><p>Article text</p></article></body>", "Article text"),
    ("<html class='no-comments'><main id=reply><article class='post comment-open'><p>Article text</p></article></main>", "Article text"),
    ("<main><p>Article text</p><article class='comment'><p>A reader</p></article></main>", "Article text")])
def test_icons_buttons_and_open_comments_do_not_take_the_article(page, text):
    assert html_text.main_text(page, TREE) == text


def test_many_unclosed_buttons_take_linear_time():
    assert html_text.main_text("<article>" + "<p>word <button>" * 20_000, TREE) == "\n".join(["word"] * 20_000)


def test_deep_and_long_pages_take_linear_time():
    assert html_text.main_text("<article>" + "<div>" * 20_000 + "x" + "</div>" * 20_000, TREE) == "x"
    assert html_text.main_text("<article>" + "<p>word " * 20_000, TREE) == "\n".join(["word"] * 20_000)


def test_tree_learns_its_table():
    rows = html_text.labelled()
    assert len(rows) > 700 and (TREE.classify(rows[:, :-1]) == rows[:, -1]).mean() > 0.98


def test_tree_uses_words_and_densities_of_neighbours():
    used, nodes = set(), [TREE]
    while nodes:
        node = nodes.pop()
        if node.low is not None:
            used.add(html_text.FEATURES[node.feature])
            nodes += [node.low, node.high]
    assert {"words", "link_density", "words_after", "density_before", "hint", "main"} <= used


NAV = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">All sports</a></li></ul>'
LONG = "<p>" + "A paragraph of the article with quite a few words in it, as articles have. " * 3 + "</p>"
ARTICLE = "<h1>What the head line says</h1>" + LONG + LONG + "<p><a href='/x'>All of this paragraph is one link to some other place</a></p>" + LONG + "<p>A short one.</p>" + LONG


@pytest.mark.parametrize("open_,close", [
    ('<div class="post-content no-sidebar">', "</div>"), ('<div id="content" class="with-sidebar">', "</div>"),
    ('<div class="elementor-widget elementor-widget-theme-post-content">', "</div>"), ('<div class="entry has-header-image">', "</div>"),
    ('<div class="post hentry comments-open">', "</div>"), ('<div class="story privacy-law">', "</div>"),
    ('<div class="content share-buttons-top">', "</div>"), ('<form id="all"><div class="x">', "</div></form>"), ("<div>", "</div>"),
])
def test_names_that_only_sound_like_boilerplate(open_, close):
    page = f"<body>{NAV}{open_}{ARTICLE}{close}{NAV}<p>Copyright 2020 Firm</p></body>"
    wanted = [" ".join(re.sub("<[^>]*>", "", block).split()) for block in re.findall("<(?:p|h1)>.*?</(?:p|h1)>", ARTICLE)]
    assert html_text.main_text(page, TREE).split("\n") == wanted


def test_a_section_of_an_article_with_a_misleading_name():
    page = f'{NAV}<article><h1>Title of it</h1><section class="alert-levels">{LONG}{LONG}</section>{LONG}</article>{NAV}'
    assert html_text.main_text(page, TREE).count("A paragraph of the article") == 9


@pytest.mark.parametrize("name", [
    "sidebar", "main-sidebar", "sidebar-content", "footer-wrapper", "nav-container", "ad", "cookie-banner", "siteFooter", "comment-list", "post-comments",
    "shareButtons"])
def test_what_is_named_boilerplate_goes(name):
    page = f'<article><h1>Title of it</h1>{LONG}<div class="{name}">{LONG.replace("article", "other")}</div>{LONG}</article>'
    text = html_text.main_text(page, TREE)
    assert "of the other" not in text and text.count("A paragraph of the article") == 6


def test_extracted_column(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = pages.select("page_id", html_text.extracted("html").alias("text")).collect()
    assert [r.text for r in sorted(out, key=lambda r: r.page_id)] == [html_text.main_text(PAGE, TREE)] * 2 + ["", ""]
    assert pages.limit(0).select(html_text.extracted("html")).count() == 0


def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for row in pages.select("html", html_text.extracted("html").alias("text")).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", row.html, re.S)[1]
        parts = (" ".join(unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert row.text == "\n".join(p for p in parts if p)
