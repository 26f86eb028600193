import numpy as np
import pytest
import xxhash
from conftest import ROWS
from emberline.llm import components, queries, simhash_dedup, substring_dedup
from emberline.llm.decontaminate import words_of
from pyspark.sql import functions as F


def brute_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(n, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """doc_id -> smallest reachable doc_id, by comparing all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    prints = {i: brute_fingerprint(t) for i, t in zip(docs.doc_id, docs.text)}
    want = brute_components(prints)
    got = queries.op6_simhash(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert int(r.fingerprint, 16) == prints[r.doc_id] and r.component_id == want[r.doc_id]


def test_spark_hash_is_xxh64(spark):
    r = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert r.h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("long", [2, 5, 256])
def test_links_in_dense_balls(spark, long):
    """Short lists are paired, long ones dealt again and at last linked by flips: always the same components."""
    rng = np.random.default_rng(3)
    prints = set()
    for _ in range(4):
        centre = int(rng.integers(0, 2**62))
        for _ in range(30):
            x = centre
            for b in rng.integers(0, 64 if long != 2 else 24, rng.integers(0, 5)):
                x ^= 1 << int(b)
            prints.add(x)
    signed = {x - (1 << 64) if x >= 1 << 63 else x for x in prints}
    df = spark.createDataFrame([(x,) for x in signed], "f long")
    got = {r.node: r.root for r in components.components(simhash_dedup.links(df, long), "a", "b").collect()}
    numbered = {x % 2**64: x for x in signed}
    root = brute_components(numbered | {})  # keys stand for themselves
    same = {}
    for x in numbered:
        same.setdefault(root[x], set()).add(numbered[x])
    want = {frozenset(v) for v in same.values() if len(v) > 1}
    found = {}
    for node, r in got.items():
        found.setdefault(r, set()).add(node)
    assert {frozenset(v) for v in found.values()} == want



def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


def test_near_odd_rows(odd, empty):
    got = simhash_dedup.group(odd).collect()
    assert len(got) == len(ROWS)
    none = [r for r in got if r.doc_id in (4, 5, 6)]
    assert {r.f for r in none} == {0} and {r.component_id for r in none} == {4}
    near = simhash_dedup.drop_near_duplicates(odd)
    assert near.columns == odd.columns and near.count() == len({r.component_id for r in got})
    kept = simhash_dedup.drop_similar(odd)
    # by 5-word shingles: the rows of equal words (1, 2, 7, 7 and the null doc_id), and those without a word
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 8, 9, 10]
    assert simhash_dedup.group(empty).count() == 0 and simhash_dedup.drop_near_duplicates(empty).count() == 0
    assert simhash_dedup.drop_similar(empty).count() == 0


def test_copies_at_a_similarity(spark):
    base = [passage(200 + i, 220) for i in range(3)]
    rows = []
    for g, words in enumerate(base):
        for c in range(40):
            w = list(words)
            for k in range(c % 4):
                w[(31 * c + 53 * k) % len(w)] = f"edit{c}{k}"
            rows.append((1000 * g + c, " ".join(w), "x"))
    rows += [(9000 + i, " ".join(passage(300 + i, 220)), "x") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, best string")
    got = {r.doc_id: r.component_id for r in simhash_dedup.group_similar(df).collect()}
    joined = sum(got[i] == 1000 * (i // 1000) for i, *_ in rows if i < 9000)
    assert joined >= 0.95 * 120 and all(got[i] == i for i, *_ in rows if i >= 9000)
    kept = {r.doc_id for r in simhash_dedup.drop_similar(df).collect()}
    assert kept == set(got.values())


def test_substring_finds_every_repeated_passage(spark, sf):
    docs = {r.doc_id: words_of(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = {}
    for i, w in docs.items():
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = set().union(*[v for v in seen.values() if len(v) > 1])
    got = queries.op4_substring_dedup(spark, sf).collect()
    assert want <= {r.doc_id for r in got} | {r.match_doc_id for r in got}
    for r in got:  # what is reported is near-duplicate indeed
        if r.end_word is not None:
            a = docs[r.doc_id][r.first_word : r.end_word]
            b = {tuple(docs[r.match_doc_id][k : k + 5]) for k in range(len(docs[r.match_doc_id]) - 4)}
            mine = {tuple(a[k : k + 5]) for k in range(len(a) - 4)}
            assert len(a) >= 50 and len(mine & b) >= 0.6 * len(mine)


def passage(seed, n=60):
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]


def test_substring_spans_edits_and_common_lines(spark):
    p, line = passage(0, 70), passage(1, 12)
    edited = p[:30] + ["changed"] + p[31:]
    rows = [(i, " ".join(passage(10 + i) + line + passage(50 + i)), "x") for i in range(30)]  # a common line is no passage
    rows += [(100, " ".join(passage(80) + p + passage(81)), "x"), (101, " ".join(p), "x"), (102, " ".join(passage(82) + edited), "x"), (103, None, "x"), (104, "", "x"), (105, " ".join(p), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, similarity string")
    got = {(r.doc_id, r.match_doc_id): r for r in substring_dedup.passages(df).collect()}
    # a document may have two partners, by the whole key and by a half passage
    assert {(101, 100), (102, 100), (105, 101), (104, 103)} <= set(got) <= {(101, 100), (102, 100), (102, 101), (105, 101), (104, 103)}
    assert (got[101, 100].first_word, got[101, 100].end_word, got[101, 100].similarity) == (0, 70, 1.0)
    assert got[102, 100].end_word - got[102, 100].first_word >= 50 and got[102, 100].similarity >= 0.8
    assert got[105, 101].end_word is None and got[105, 101].similarity == 1.0


def test_substring_odd_rows(odd, empty):
    assert substring_dedup.passages(empty).count() == 0
    got = substring_dedup.passages(odd).collect()
    assert {r.doc_id for r in got if r.match_doc_id == 4} == {5, 6} or {r.match_doc_id for r in got if r.doc_id in (4, 5, 6)}


def test_compact_windows_by_brute_force():
    rng = np.random.default_rng(0)
    for width in (1, 4, 9):
        for _ in range(40):
            h = rng.integers(0, rng.choice([3, 1000]), 50).astype(np.uint64)
            l, c, r = substring_dedup.compact_windows(h, np.array([0, 20]), np.array([20, 50]), width)
            cover = {}
            for a, m, b in zip(l, c, r):
                assert h[a : b + 1].min() == h[m] and b - a + 1 >= width
                for i in range(a, m + 1):
                    for j in range(m, b + 1):
                        if j - i + 1 >= width:
                            cover[i, j] = cover.get((i, j), 0) + 1
            spans = {(i, j) for lo, end in ((0, 20), (20, 50)) for i in range(lo, end) for j in range(i + width - 1, end)}
            assert set(cover) == spans and set(cover.values()) == {1}  # each subsequence in exactly one window
