from __future__ import annotations

import math
import re

import numpy as np

from stockloom.llm import url_filter

RULES = dict((text, verdict) for verdict, text in url_filter.RULES)


def plain(url):
    """Host, path and rule by string handling."""
    rest = (url or "").split("://", 1)
    if len(rest) < 2:
        return "", "", None
    host = re.split(r"[/?#]", rest[1])[0]
    path = re.split(r"[?#]", rest[1][len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fitting = [r for r in RULES if ("." + host).endswith("." + r.split("/")[0]) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fitting, key=len, default=None)


URLS = [
    None, "", "no scheme", "://", "HTTP://EXAMPLE.Org/es/1?x", "a://b.org", "a://b.org/", "x://c.com/fr/q#a://d", "h://xorg/",
    "https://blog.example.org/en/17", "https://example.org/en/2", "h://m.com:80/de/1", "h://m.com/de/1?u=h://n.org/",
    "h://É.org/ü", "h://a.org?x/", "h://com/de/", "h://a.com/fr", "h://user@a.org/x\ny"]


def pages_of(spark, urls):
    schema = "page_id long, url string, score string, host string, _row string, accepted string"
    return spark.createDataFrame([(i, u, "x", "x", "x", "x") for i, u in enumerate(urls)], schema)


def test_hosts_paths_and_rules(spark):
    rows = url_filter.judged(pages_of(spark, [*URLS, *URLS])).collect()
    assert len(rows) == 2 * len(URLS)
    for row in rows:
        assert (row.host, row.path, row.rule) == plain(row.url)
        assert row.verdict == RULES[row.rule] if row.rule else row.verdict in ("allow", "block")


def test_empty_table_and_missing_labels(spark):
    assert url_filter.judged(pages_of(spark, [])).count() == 0
    rows = url_filter.judged(pages_of(spark, [None, "h://a.net/x"])).collect()
    assert [(r.verdict, r.score) for r in rows] == [("allow", 0.0)] * 2


def slow_difference(accepted, rejected, url):
    """The models with plain dictionaries."""
    total = 0.0
    for urls, sign in ((accepted, 1), (rejected, -1)):
        pairs, contexts = {}, {}
        for u in urls:
            data = b"\0" * 4 + u.encode()
            for i in range(4, len(data)):
                for n in range(5):
                    key = (n, data[i - n:i])
                    pairs[key, data[i]] = pairs.get((key, data[i]), 0) + 1
                    contexts[key] = contexts.get(key, 0) + 1
        data = b"\0" * 4 + url.encode()
        for i in range(4, len(data)):
            p = 1 / 256
            for n in range(5):
                key = (n, data[i - n:i])
                p = (pairs.get((key, data[i]), 0) + 2 * p) / (contexts.get(key, 0) + 2)
            total += sign * math.log(p)
    return total / max(1, len(url.encode()))


def test_scores_are_those_of_plain_models(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "FREQUENT", 40)  # so that some grams are joined
    urls = [f"http://good{i}.org/page/{i * 7919 % 1000}" for i in range(30)] + [f"http://spam{i}.com/de/win{i}" for i in range(30)]
    asked = ["http://good.net/page", "http://spam.net/de/win", "é://x", "no scheme", ""]
    rows = url_filter.judged(pages_of(spark, [*urls, *urls[:9], *asked, None])).collect()
    held = {r.url for r in spark.createDataFrame([(u,) for u in urls], "url string").filter(
        f"pmod(xxhash64(url), {url_filter.FOLDS}) = 0").collect()}
    learnt = [u for u in [*urls, *urls[:9]] if u not in held]
    good, bad = [u for u in learnt if ".org" in u], [u for u in learnt if ".com" in u]
    assert len(rows) == len(urls) + 9 + 6 and good and bad and held
    assert np.allclose([r.score for r in rows], [slow_difference(good, bad, r.url or "") for r in rows], atol=1e-8)


def test_models_tell_unlabelled_urls_apart(spark):
    labelled = [f"http://site{i}.org/story/{i}" for i in range(60)] + [f"http://shop{i}.com/de/cheap-{i}" for i in range(60)]
    rows = url_filter.judged(pages_of(spark, [*labelled, "http://site.net/story/5", "http://shop.net/de/cheap-7"])).collect()
    verdicts = {r.url: r.verdict for r in rows}
    assert verdicts["http://site.net/story/5"] == "allow" and verdicts["http://shop.net/de/cheap-7"] == "block"


def test_threshold_parts_the_classes():
    counts = np.zeros((2, 2 * url_filter.SPAN * url_filter.BINS + 1))
    middle = url_filter.SPAN * url_filter.BINS
    counts[1, middle + 100:middle + 120], counts[0, middle - 30:middle + 60] = 1, 1
    limit = url_filter.best_edge(counts)
    assert 60 / url_filter.BINS <= limit <= 100 / url_filter.BINS
    assert url_filter.best_edge(np.zeros_like(counts)) == 0.0
