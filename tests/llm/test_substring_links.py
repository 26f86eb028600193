"""No link between equal passages is lost, whatever else the first documents of a group hold."""

from collections import defaultdict

import numpy as np
import pytest
from emberline.llm import substring_dedup
from emberline.llm.decontaminate import words_of


def some(seed, n):
    return ["".join(chr(97 + c) for c in row) for row in np.random.default_rng(seed).integers(0, 26, (n, 6))]


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def roots(links, nodes):
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def found(spark, texts):
    return roots([(r.doc_id, r.match_doc_id) for r in substring_dedup.passages(frame(spark, texts)).collect()], texts)


def planted(length, part, edit, decoys=12, count=40):
    """Two documents for each of ``count`` passages, and ``decoys`` earlier ones that hold ``part`` words of it."""
    texts = {}
    for k in range(count):
        p = some(1000 + k, length)
        for d in range(decoys if part else 0):
            lo = (d * 7) % (length - part + 1)
            texts[1000 * k + d] = " ".join(some(50_000 + 100 * k + d, 30) + p[lo : lo + part] + some(90_000 + 100 * k + d, 30))
        q = p[:edit] + ["changed"] + p[edit + 1 :] if edit is not None else p
        texts[1000 * k + 500] = " ".join(some(2000 + k, 40) + p + some(3000 + k, 40))
        texts[1000 * k + 501] = " ".join(some(4000 + k, 25) + q + some(5000 + k, 60))
    return texts


@pytest.mark.parametrize("length, part", [(50, 0), (50, 36), (50, 44), (80, 36), (80, 49)])
def test_equal_passages_meet_beside_decoys(spark, length, part):
    texts = planted(length, part, None)
    got = found(spark, texts)
    assert all(got[1000 * k + 500] == got[1000 * k + 501] for k in range(40))


@pytest.mark.parametrize("length, part, edit", [(50, 0, 24), (50, 30, 24), (50, 30, 8), (80, 36, 40), (120, 30, 60)])
def test_edited_passages_beside_decoys(spark, length, part, edit):
    texts = planted(length, part, edit)
    got = found(spark, texts)
    assert sum(got[1000 * k + 500] == got[1000 * k + 501] for k in range(40)) >= 37


def test_all_equal_passages_of_a_corpus_are_linked(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    first, links = {}, []
    for i, t in docs.items():
        w = words_of(t)
        for k in range(len(w) - 49):
            links.append((i, first.setdefault(tuple(w[k : k + 50]), i)))
    want, got = roots(links, docs), found(spark, docs)
    groups = defaultdict(set)
    for i, r in want.items():
        groups[r].add(got[i])
    assert sum(len(g) == 1 for g in groups.values()) == len(groups)


def test_a_common_line_in_a_third_of_all_documents(spark):
    line, passage = some(1, 30), some(2, 60)
    texts = {i: " ".join(some(10 + i, 20) + (line if i % 3 == 0 else []) + some(9000 + i, 40)) for i in range(1500)}
    for i in (601, 1204):
        texts[i] = " ".join(some(7 * i, 20) + line + passage + some(8 * i, 20))
    got = found(spark, texts)
    assert got[601] == got[1204] == 601
    assert sum(got[i] == i for i in texts) == 1499


def test_null_and_repeated_ids(spark):
    p = " ".join(some(3, 70))
    df = spark.createDataFrame([(None, p + " x"), (1, "y " + p), (1, "z " + p), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.match_doc_id) for r in substring_dedup.passages(df).collect()}
    assert got == {(1, None)}
