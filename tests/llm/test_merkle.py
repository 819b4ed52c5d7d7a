from __future__ import annotations

import hashlib
import zlib

import pytest

from stockloom.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(leaves):
    """Root, and every leaf's siblings as (side, digest) or None, level by level."""
    nodes, paths, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            other = i ^ 1
            paths[k].append(None if other >= len(nodes) else ("L" if other < i else "R", nodes[other]))
        nodes = [digest(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], paths


def plain_manifest(rows):
    """(leaf, subroot, root, proof, folded, verified) rows, by plain loops over (doc_id, source, lang, n_chars, text)."""
    order = lambda v: (v is not None, v)
    names = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in names:
        of_lang = sorted([r for r in rows if r[2] == lang], key=lambda r: (order(r[0]), plain_leaf(r)))
        trees[lang] = (of_lang, *plain_tree([plain_leaf(r) for r in of_lang]))
    root, tops = plain_tree([trees[lang][1] for lang in names])
    out = []
    for lang, top in zip(names, tops):
        of_lang, subroot, paths = trees[lang]
        for row, path in zip(of_lang, paths):
            node = plain_leaf(row)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            folded = plain_leaf((*row[:3], row[3] + 1, row[4])) if hit else node
            for step in path + top:
                folded = digest(folded) if step is None else digest(step[1], folded) if step[0] == "L" else digest(folded, step[1])
            proof = digest(*[step[1] for step in path + top if step])
            out.append((str(row[0]), node, subroot, root, proof, folded, folded == root))
    return sorted(out)


def mine(docs, height=merkle.LEVELS):
    rows = merkle.manifest(docs, merkle.tampered_leaf(), height=height).collect()
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows)


def some_rows(sizes):
    return [(1000 * k + i if i % 50 else None, f"s{i % 3}", lang, i if i % 11 else None, f"text {i} é\n")
            for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]


@pytest.mark.parametrize("height", [1, 2, 5, 12])
def test_manifest_is_the_plain_one(spark, height):
    rows = some_rows({"en": 77, None: 5, "": 1, "é": 16, "z": 17, "de": 33})
    assert mine(spark.createDataFrame(rows, COLUMNS).repartition(7), height) == plain_manifest(rows)


def test_many_languages_are_a_tree_of_several_blocks(spark):
    rows = some_rows({f"l{i}": 1 + i % 3 for i in range(40)})
    assert mine(spark.createDataFrame(rows, COLUMNS), 2) == plain_manifest(rows)


def test_one_row_is_its_own_root(spark):
    rows = [(1, "s", "en", 3, "abc")]
    (found,) = merkle.manifest(spark.createDataFrame(rows, COLUMNS), proofs=True).collect()
    assert found.leaf == found.subroot == found.root == found.folded_root and found.proof == [] and found.verified


def test_repeated_rows_have_places_of_their_own(spark):
    rows = [(7, "s", "en", 3, "abc")] * 9 + [(None, None, None, None, None)] * 3
    assert mine(spark.createDataFrame(rows, COLUMNS), 2) == plain_manifest(rows)


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd_docs.collect()]
    assert mine(odd_docs) == plain_manifest(rows)


def test_proofs_fold_to_the_root(spark):
    rows = some_rows({"en": 40, "fr": 9})
    for r in merkle.manifest(spark.createDataFrame(rows, COLUMNS), proofs=True, height=3).collect():
        assert merkle.folded(r.leaf, r.proof) == r.root and r.verified


def test_empty_table(no_docs):
    assert merkle.manifest(no_docs).count() == 0


def test_texts_are_not_shuffled(spark):
    docs = spark.createDataFrame(some_rows({"en": 3}), COLUMNS)
    plan = merkle.manifest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "CartesianProduct" not in plan
