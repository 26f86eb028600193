"""Quadtree covers of polygons, and points looked up in them.

The plane is cut into square tiles, and the tiles that a polygon meets into quarters, until a cell lies inside the polygon
(no point of it needs a test) or is met by a few edges only, or is as small as cells get; a polygon has at most a few cells for each of its
edges, so where many edges run side by side a cell keeps more of them. A border cell keeps those edges, and on which
side of the border its lower right corner lies. A point of the cell is then inside or outside by the edges
between it and that corner: those crossed on the way to the cell's right side, and on that side down to the corner. Both counts
come from the sign of one product for the place where the way turns, so they cannot contradict each other by rounding.

Tiles and cells are powers of two wide, so their sides are exact numbers. Inside and outside follow the even-odd rule
over all rings of a polygon; points on an edge count as inside.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Side of a tile, the number of times it is quartered at most, and edges that end the quartering.
TILE, DEPTH, FEW = 8.0, 12, 4
#: Cells beside which an edge passes at less than this share of their side keep it too; more edges change no result.
NEAR = 1e-9
#: Cells of a polygon at most, besides its tiles, for each of its edges and in any case.
CELLS_PER_EDGE, CELLS_MORE = 4, 256
_HALF = 1 << 25


def edges_of(parts: list) -> np.ndarray:
    """x0, y0, x1, y1 of every edge of the rings; a ring is closed if it is not."""
    out = [np.zeros((0, 4))]
    for ring in parts or []:
        p = np.array([(q["x"], q["y"]) for q in ring or []], float).reshape(-1, 2)
        if len(p):
            out.append(np.concatenate([p, np.roll(p, -1, axis=0)], axis=1))
    e = np.concatenate(out)
    return e[np.isfinite(e).all(axis=1)]


def _sides(x, y, e: np.ndarray) -> np.ndarray:
    """Positive where (x, y) is to the left of the edge as it goes upwards, negative to the right, 0 on its line."""
    up = np.where(e[..., 3] >= e[..., 1], 1.0, -1.0)
    return up * ((y - e[..., 1]) * (e[..., 2] - e[..., 0]) - (x - e[..., 0]) * (e[..., 3] - e[..., 1]))


def _below(x, y, e: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether the edge's line passes below (x, y), which counts as a little higher, and first as a little further right."""
    dx, dy = e[..., 2] - e[..., 0], e[..., 3] - e[..., 1]
    right = np.where(dy == 0, 1.0, np.sign(dx * np.where(dy >= 0, 1.0, -1.0)))  # an edge that goes up to the right has its left side above
    return np.where(side == 0, dx * dy <= 0, np.where(dy == 0, (y - e[..., 1]) > 0, side * right > 0))


def crossed(x, y, right, low, e: np.ndarray) -> np.ndarray:
    """Whether the way from (x, y) to the right side at x = ``right``, and there down to y = ``low``, crosses each edge an odd number of times."""
    at = _sides(right, y, e)
    level = (e[..., 1] > y) != (e[..., 3] > y)
    across = level & (_sides(x, y, e) > 0) & ~(at > 0)
    upright = (e[..., 0] > right) != (e[..., 2] > right)
    down = upright & _below(right, y, e, at) & ~_below(right, low, e, _sides(right, low, e))
    return across ^ down


def on_edge(x, y, e: np.ndarray) -> np.ndarray:
    return (
        (_sides(x, y, e) == 0)
        & (x >= np.minimum(e[..., 0], e[..., 2])) & (x <= np.maximum(e[..., 0], e[..., 2]))
        & (y >= np.minimum(e[..., 1], e[..., 3])) & (y <= np.maximum(e[..., 1], e[..., 3]))
    )


def _odd(x: float, y: float, e: np.ndarray) -> bool:
    """Whether a ray from (x, y) to the right, a little above it, crosses the edges an odd number of times."""
    return bool((((e[:, 1] > y) != (e[:, 3] > y)) & (_sides(x, y, e) > 0)).sum() % 2)


def _meets(x: float, y: float, side: float, e: np.ndarray) -> np.ndarray:
    """Whether each edge may meet the closed square at (x, y)."""
    more = side * NEAR
    x0, y0, x1, y1 = x - more, y - more, x + side + more, y + side + more
    box = (np.minimum(e[:, 0], e[:, 2]) <= x1) & (np.maximum(e[:, 0], e[:, 2]) >= x0) & (np.minimum(e[:, 1], e[:, 3]) <= y1) & (np.maximum(e[:, 1], e[:, 3]) >= y0)
    corners = np.stack([_sides(a, b, e) for a in (x0, x1) for b in (y0, y1)])
    return box & (corners.min(axis=0) <= 0) & (corners.max(axis=0) >= 0)


def cover(parts: list, tile: float = TILE, depth: int = DEPTH, few: int = FEW) -> list[tuple]:
    """(level, x, y, inside, corner, edges) of the cells of a polygon; x and y count the cells of the level."""
    e = edges_of(parts)
    if not len(e):
        return []
    out, todo = [], []  # the cells with the most edges are quartered first
    ends = np.floor(e.reshape(-1, 2) / tile).astype(int)
    (tx0, ty0), (tx1, ty1) = ends.min(axis=0), ends.max(axis=0)
    for ty in range(ty0, ty1 + 1):
        row = e[(np.minimum(e[:, 1], e[:, 3]) <= (ty + 1 + NEAR) * tile) & (np.maximum(e[:, 1], e[:, 3]) >= (ty - NEAR) * tile)]
        for tx in range(tx0, tx1 + 1):
            own = row[_meets(tx * tile, ty * tile, tile, row)]
            todo.append((-len(own), len(todo), 0, tx, ty, own, _odd((tx + 1) * tile, ty * tile, row)))
    heapq.heapify(todo)
    made, most = len(todo), len(todo) + CELLS_PER_EDGE * len(e) + CELLS_MORE
    while todo:
        n, _, level, x, y, own, corner = heapq.heappop(todo)
        if not n and not corner:
            continue
        if -n <= few or level == depth or made >= most:
            out.append((level, x, y, not n, corner, own))
            continue
        side = tile / (1 << (level + 1))
        for cx in (2 * x, 2 * x + 1):
            for cy in (2 * y, 2 * y + 1):
                right, low = (cx + 1) * side, cy * side
                odd = crossed(right, low, (x + 1) * 2 * side, y * 2 * side, own).sum() % 2
                near = own[_meets(cx * side, low, side, own)]
                made += 1
                heapq.heappush(todo, (-len(near), made, level + 1, cx, cy, near, corner ^ bool(odd)))
    return out


def codes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of the smallest cells, such that every cell of the tree holds consecutive ones."""
    a, b = (v.astype(np.int64) + _HALF for v in (x, y))
    out = np.zeros(len(a), np.int64)
    for bit in range(26):
        out |= (a >> bit & 1) << (2 * bit) | (b >> bit & 1) << (2 * bit + 1)
    return out


class Lookup:
    """Cells of many polygons in arrays, in which batches of points find the polygons that hold them."""

    def __init__(self, polygon: np.ndarray, level: np.ndarray, x: np.ndarray, y: np.ndarray, inside: np.ndarray, corner: np.ndarray, sizes: np.ndarray, edges: np.ndarray, tile: float = TILE, depth: int = DEPTH):
        """``sizes`` counts each cell's rows of ``edges``."""
        self.tile, self.depth = tile, depth
        self.polygon, self.inside, self.corner, self.sizes, self.edges = polygon, inside, corner, sizes, edges
        self.first = np.cumsum(sizes) - sizes
        side = tile / (1 << level.astype(np.int64))
        self.right, self.low = (x + 1) * side, y * side
        begin = codes(x << (depth - level), y << (depth - level))
        end = begin + (np.int64(1) << 2 * (depth - level).astype(np.int64))
        # between neighbouring breaks the same cells hold every point
        self.breaks = np.unique(np.concatenate([begin, end]))
        lo, hi = np.searchsorted(self.breaks, begin), np.searchsorted(self.breaks, end)
        cell = np.repeat(np.arange(len(polygon)), hi - lo)
        place = _counted(lo, hi - lo)
        order = np.argsort(place, kind="stable")
        self.cells = cell[order]
        self.counts = np.bincount(place, minlength=len(self.breaks))
        self.starts = np.cumsum(self.counts) - self.counts

    def find(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the point, polygon) for every polygon that holds a point, in the points' order."""
        none = np.zeros(0, np.int64)
        small, scale = np.full(len(x), -1), (1 << self.depth) / self.tile
        with np.errstate(invalid="ignore"):
            fx, fy = np.floor(x * scale), np.floor(y * scale)
            there = np.flatnonzero((np.abs(fx) < _HALF) & (np.abs(fy) < _HALF))
        if not len(there) or not len(self.breaks):
            return none, none
        small[there] = np.searchsorted(self.breaks, codes(fx[there], fy[there]), side="right") - 1
        at = np.flatnonzero(small >= 0)
        n = self.counts[small[at]]
        point, cell = np.repeat(at, n), self.cells[_counted(self.starts[small[at]], n)]
        hit = self.inside[cell].copy()
        open_ = np.flatnonzero(~hit)
        if len(open_):
            c, p = cell[open_], point[open_]
            m = self.sizes[c]
            pair, e = np.repeat(np.arange(len(c)), m), self.edges[_counted(self.first[c], m)]
            px, py = x[p][pair], y[p][pair]
            odd = np.bincount(pair, weights=crossed(px, py, self.right[c][pair], self.low[c][pair], e), minlength=len(c)) % 2 == 1
            border = np.bincount(pair, weights=on_edge(px, py, e), minlength=len(c)) > 0
            hit[open_] = (odd ^ self.corner[c]) | border
        return point[hit], self.polygon[cell[hit]]


def _counted(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, n numbers, in a row."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
