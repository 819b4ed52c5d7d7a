from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from stockloom.llm import hamming, simhash
from stockloom.llm.components import connected_components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_is_the_plain_one(spark, odd_docs):
    for row in odd_docs.collect():
        assert simhash.fingerprint(row.text) == plain_fingerprint(row.text)


def test_classes_of_odd_rows(odd_docs):
    rows = simhash.classes(odd_docs).collect()
    assert len(rows) == 13
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[2].fingerprint == by_id[3].fingerprint == by_id[4].fingerprint == "0" * 16
    assert by_id[2].component_id == by_id[3].component_id == by_id[4].component_id == 2
    assert by_id[6].component_id == 5 and by_id[7].component_id == 1
    assert {r.component_id for r in rows if r.doc_id is None} == {None, 2}


def test_one_row_of_each_class_stays(odd_docs):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 5, 8, 9, 10]
    assert kept.filter("doc_id is null").count() == 2


def test_empty_table(no_docs):
    assert simhash.classes(no_docs).count() == 0 and simhash.keep_first(no_docs).count() == 0


def near_codes(n, seed):
    """Codes in chains: each a few flipped bits from an earlier one."""
    rng = random.Random(seed)
    codes = [rng.getrandbits(64) for _ in range(n // 10)]
    while len(codes) < n:
        code = rng.choice(codes)
        for _ in range(rng.randint(1, 6)):
            code ^= 1 << rng.randrange(64)
        codes.append(code)
    return sorted(set(codes))


@pytest.mark.parametrize("block", [hamming.BLOCK_ROWS, 30])
def test_links_join_all_codes_within_four_bits(spark, monkeypatch, block):
    monkeypatch.setattr(hamming, "BLOCK_ROWS", block)
    signed = [int(np.uint64(c).astype(np.int64)) for c in near_codes(600, 3)]
    edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "code long"))
    found = {r.node: r.root for r in connected_components(edges).collect()}
    as_bits = [c & (1 << 64) - 1 for c in signed]
    pairs = [(signed[i], signed[j]) for i, j in combinations(range(len(signed)), 2) if (as_bits[i] ^ as_bits[j]).bit_count() <= 4]
    assert {c: found.get(c, c) for c in signed} == plain_components(signed, pairs)


def test_thresholds_sum_up_and_cost_least():
    rng = np.random.default_rng(1)
    costs = np.cumsum(rng.integers(1, 100, (50, 4, 4)), axis=2).astype(float)
    costs[:, :, 0] = 0
    chosen = simhash.allocate(costs, 4)
    assert (chosen.sum(axis=1) == 4 - 4 + 1).all()
    for c, t in zip(costs, chosen):
        best = min(
            sum(c[g, r] for g, r in enumerate(pick))
            for pick in np.ndindex(4, 4, 4, 4) if sum(pick) == 5)
        assert sum(c[g, r + 1] for g, r in enumerate(t)) == best


def test_bits_are_grouped_once_each(spark):
    rows = [(int(np.uint64(c).astype(np.int64)),) for c in near_codes(300, 5)]
    groups = simhash.bit_groups(spark.createDataFrame(rows, "code long"), 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} == {16}


def test_components_of_long_chains_and_a_hub(spark):
    rng = random.Random(0)
    names = rng.sample(range(10_000), 700)
    chain = list(zip(names[:200], names[1:200]))
    hub = [(names[300], n) for n in names[301:600]]
    edges = spark.createDataFrame([*chain, *hub, (5, 5), *chain[:3]], "src long, dst long")
    found = {r.node: r.root for r in connected_components(edges).collect()}
    nodes = {n for pair in [*chain, *hub, (5, 5)] for n in pair}
    assert found == plain_components(nodes, [*chain, *hub])
