"""Points in polygons against a plain ray cast of every point and edge."""

import math

import numpy as np
import pytest
from emberline.operators import quadtree, spatial

PARTS = "admin string, parts array<array<struct<x:double,y:double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def star(n, cx, cy, r, seed):
    rng = np.random.default_rng(seed)
    return ring(*[(cx + q * math.cos(t), cy + q * math.sin(t)) for t, q in zip(np.sort(rng.uniform(0, 2 * math.pi, n)), r * rng.uniform(0.3, 1, n))])


def inside(x, y, parts):
    """Whether points lie in or on the border of a polygon, by the even-odd rule, one edge at a time."""
    odd, border = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for r in parts:
        p = [(q["x"], q["y"]) for q in r]
        for (x0, y0), (x1, y1) in zip(p, p[1:] + p[:1]):
            cross = (x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)
            border |= (cross == 0) & (x >= min(x0, x1)) & (x <= max(x0, x1)) & (y >= min(y0, y1)) & (y <= max(y0, y1))
            if y0 != y1:
                odd ^= ((y0 > y) != (y1 > y)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
    return odd | border


SHAPES = {
    "stars": [[star(200, 7 * i - 20, 3 * i - 10, 12, i)] for i in range(6)],
    "on the lattice": [
        [ring((0, 0), (8, 0), (8, 8), (0, 8)), ring((2, 2), (4, 2), (4, 4), (2, 4))],
        [ring((-3, 1), (5, 9), (5, 1))],
        [ring((1, 1), (1, 6), (6, 6), (3, 3), (6, 1))],
        [ring((-8, -8), (-8, 8), (-8, -8)), ring((-1, -1))],
    ],
    "spikes": [[star(1500, 1, 2, 40, 9)]],
}


def places(n=3000):
    rng = np.random.default_rng(0)
    k = np.arange(-36, 37) / 4
    x, y = (v.ravel() for v in np.meshgrid(k, k))
    return np.concatenate([x, rng.uniform(-45, 45, n), rng.uniform(-10, 10, n)]), np.concatenate([y, rng.uniform(-45, 45, n), rng.uniform(-10, 10, n)])


@pytest.mark.parametrize("name", SHAPES)
def test_cells_agree_with_every_edge(name):
    x, y = places()
    cells = [(i, *c) for i, parts in enumerate(SHAPES[name]) for c in quadtree.cover(parts)]
    polygon, level, cx, cy, within, corner, edges = zip(*cells)
    tree = quadtree.Lookup(*(np.array(v, np.int64) for v in (polygon, level, cx, cy)), np.array(within), np.array(corner), np.array([len(e) for e in edges]), np.concatenate(edges))
    at, found = tree.find(x, y)
    want = {(int(j), i) for i, parts in enumerate(SHAPES[name]) for j in np.flatnonzero(inside(x, y, parts))}
    assert len(at) == len(want) and set(zip(at.tolist(), found.tolist())) == want
    if name != "spikes":
        assert max(map(len, edges)) <= quadtree.FEW
    n_edges = sum(len(r) for parts in SHAPES[name] for r in parts)
    assert len(cells) <= quadtree.CELLS_PER_EDGE * n_edges + len(SHAPES[name]) * (quadtree.CELLS_MORE + 200)


@pytest.mark.parametrize("way", ["broadcast", "tile"])
def test_points_join_every_polygon_that_holds_them(spark, monkeypatch, way):
    if way == "tile":
        monkeypatch.setattr(spatial, "COVER_BYTES", -1)
        monkeypatch.setattr(spatial, "TILE_POINTS", 500)
    shapes = [p for name in ("stars", "on the lattice") for p in SHAPES[name]]
    polygons = spark.createDataFrame([(f"P{i}", parts) for i, parts in enumerate(shapes)] + [("none", None), ("empty", []), ("odd", [[]])], PARTS)
    x, y = places(500)
    x, y = np.concatenate([x, np.full(3000, 3.5)]), np.concatenate([y, np.full(3000, 7.25)])  # one place on a third of the rows
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(-1, None, 1.0), (-2, float("nan"), 0.0), (-3, 1e300, 0.0), (-4, float("inf"), 0.0)]
    points = spark.createDataFrame(rows, "id long, lon180 double, lat double").selectExpr("*", "'x' AS parts", "1 AS polygon")
    got = [(r["id"], r["admin"]) for r in spatial.join_country(points, polygons, ["admin"]).collect()]
    want = {(int(j), f"P{i}") for i, parts in enumerate(shapes) for j in np.flatnonzero(inside(x, y, parts))}
    alone = {i for i, _, _ in rows} - {i for i, _ in want}
    assert len(got) == len(set(got)) and set(got) == want | {(i, None) for i in alone}
    assert spatial.join_country(points.limit(0), polygons, ["admin"]).count() == 0
    assert {r["admin"] for r in spatial.join_country(points.limit(20), polygons.limit(0), ["admin"]).collect()} == {None}


def test_plan_has_no_polygon_in_a_row(spark):
    polygons = spark.createDataFrame([("P", SHAPES["stars"][0])], PARTS)
    points = spark.range(100).selectExpr("id", "double(id) AS lat", "double(id) AS lon180")
    plan = spatial.join_country(points, polygons, ["admin"])._jdf.queryExecution().executedPlan().toString()
    assert "struct<polygon:bigint" in plan and "parts" not in plan
