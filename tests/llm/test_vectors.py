"""Centroid clustering and hard negatives against plain Python, on odd tables, and against their SQL."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from emberline.llm import centroid_clustering as C
from emberline.llm import hard_negatives as H
from emberline.llm import queries, vectors
from tests.test_queries import canon


def test_bounds_never_exceed_a_distance():
    rng = np.random.default_rng(4)
    for size in (3, 1000, 1 << 26):
        v, c, p = (rng.integers(-size, size, (n, 6)) for n in (400, 9, 5))
        v[:20], c[0], p[1] = v[0], v[0], p[0]
        bounds = C.lower_bounds(np.sqrt(C.distances(v, p)), p, c)
        exact = C.distances(v, c)
        assert (bounds <= exact).all() and (bounds > 0).mean() > 0.5
        arg, best, tried = C.nearest(v, np.sqrt(C.distances(v, p)), p, c)
        assert (arg == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all() and tried < exact.size


def test_pivots_spare_distances_between_groups():
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (8, 16))
    v = centres[rng.integers(0, 8, 2000)] + rng.integers(-20, 20, (2000, 16))
    pivots = C.choose_pivots(v[:256], 6)
    tried = C.nearest(v, np.sqrt(C.distances(v, pivots)), pivots, centres)[2]
    assert tried < 1.2 * len(v)  # of 8 for each


def plain_clusters(rows, k, rounds):
    """Lloyd's rounds one vector at a time."""
    kept = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in kept[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centroids)]
    return sorted((i, *reversed(assign(v))) for i, v in kept), centroids


@pytest.mark.parametrize("spread", [3, 40])
def test_clusters_equal_plain_rounds(spark, spread):
    rng = np.random.default_rng(spread)
    rows = [(i, rng.integers(-spread, spread, 4).tolist()) for i in range(300)] + [(7, [0, 0, 0, 0])] * 100
    df = spark.createDataFrame([(i, [float(x) / 8 for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    got, centroids = C.cluster(df, k=5, rounds=4, scale=8, dims=4)
    want, end = plain_clusters(rows, 5, 4)
    assert sorted(tuple(r) for r in got.collect()) == want and centroids.tolist() == end


ODD = [
    (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.5], 1), (None, [0.5, 0.5], 2), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan"), 0.0], 1),
    (6, [float("inf"), 0.0], 1), (8, [1.0], 2), (9, [], 2), (10, [1e30, -1e30], 2), (100, [0.9, 0.1], 1), (100, [0.9, 0.1], 1), (200, [0.2, 0.7], None), (300, [0.4, 0.1], 9),
]
ODD_SCHEMA = "vec_id long, embedding array<double>, label int"


def test_odd_and_empty_tables(spark):
    df = spark.createDataFrame(ODD, ODD_SCHEMA).selectExpr("*", "'x' AS v", "0 AS uid", "1 AS cluster", "2 AS c")
    got, centroids = C.cluster(df, dims=2)
    ids = sorted(str(r["vec_id"]) for r in C.with_inertia(got, centroids).collect())
    assert ids == sorted(["1", "1", "2", "None", "10", "100", "100", "200", "300"])
    mined = H.mine(df).collect()
    assert {(r["anchor_id"], r["positive_id"]) for r in mined} == {(100, 1), (100, 2), (100, 100)}
    assert {r["negative_id"] for r in mined} <= {8, 10, 300}
    for some in (df.limit(0), df.filter("embedding IS NULL"), df.filter("vec_id = 9")):
        none, at = C.cluster(some, dims=2)
        assert C.with_inertia(none, at).count() == 0 and len(at) == 0
        assert H.mine(some).collect() == []
    one, at = C.cluster(df.filter("vec_id = 2"), dims=2)
    assert [tuple(r) for r in C.with_inertia(one, at).collect()] == [(2, 0, 0, 0, 0, hashlib.sha256(b"512,512").hexdigest())]


@pytest.mark.parametrize("size", [1, 3, 300, 1 << 20])
def test_packed_products_are_exact(size):
    rng = np.random.default_rng(size)
    for n in (1, 2, 3, 100):
        a, c = rng.integers(-size, size + 1, (7, 33)), rng.integers(-size, 2 * size, (n, 33))
        p = H.Packing(int(c.min()), int(c.max()), int(np.abs(a).sum(axis=1).max()), 1 << 26)
        assert size > 3 or p.fields > 4
        assert (p.products(a, p.pack(c), n) == a @ c.T).all()


def plain_negatives(rows):
    """Every anchor against every row, with Python integers."""
    kept = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, v, label in rows]
    out = []
    for i, label, v in kept:
        if i % 100 == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in kept if j != i]
            for s, j, _ in sorted(x for x in scored if x[2] == label)[:5]:
                hard = sorted(x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
                out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(hard)]
    return sorted(out)


def test_hard_negatives_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, np.round(rng.normal(0, 0.3, 5), 1).tolist(), int(rng.integers(0, 3))) for i in range(0, 2000, 5)]
    rows += [(i, rows[0][1], i % 2) for i in range(2001, 2200)]  # a vector that a third of the rows have
    df = spark.createDataFrame(rows, ODD_SCHEMA)
    want = plain_negatives(rows)
    assert len(want) > 500 and sorted(tuple(r) for r in H.mine(df).collect()) == want
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 8 * 5 * 7)  # three blocks of anchors
    assert sorted(tuple(r) for r in H.mine(df).collect()) == want


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    df = spark.range(1000).repartition(7)
    parts = lambda: vectors.spread(df).rdd.getNumPartitions()
    assert parts() == 1
    monkeypatch.setattr(vectors, "TASK_ROWS", 100)
    assert parts() == min(10, 3 * spark.sparkContext.defaultParallelism)
    monkeypatch.setattr(vectors, "MOST_ROWS", 20)
    assert parts() == 50


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op13_hard_negatives"])
def test_query_equals_its_sql(spark, sf, name):
    path = f"{sf}/embeddings.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    want = con.execute(queries.ORACLES[name]).fetchdf()
    assert len(want) and canon(queries.QUERIES[name](spark, sf).toPandas()) == canon(want)
