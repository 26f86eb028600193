"""Rank statistics and small regressions in numpy, for batches of short series inside tasks.

A batch is two matrices x and y of one row a series; missing values are NaN in both.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value, c, d = 1.0, 1.0, 1.0 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, df: float) -> float:
    return beta_tail(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_quantile(p: float, df: float) -> float:
    """The t that both tails beyond have probability ``p``."""
    lo, hi = 0.0, 1e4
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > p else (lo, mid)
    return lo


@lru_cache(maxsize=256)
def _inversions(n: int) -> tuple:
    """Cumulative share of the orders of n things with at most k inversions."""
    ways = np.ones(1)
    for m in range(2, n + 1):
        ways = np.convolve(ways, np.ones(m)) / m
    return tuple(np.cumsum(ways))


def _ties(v: np.ndarray) -> np.ndarray:
    n = np.unique(v, return_counts=True)[1].astype(float)
    return n[n > 1]


#: Pairs of values that a step on short series holds at one time.
PAIRS = 1 << 21
#: Series of more values are ranked in n log n steps, one by one; shorter ones by all pairs, many at a time.
SHORT = 512
#: Values that are compared directly at the bottom of a merge sort.
_BASE = 32


def discordant(ranks: np.ndarray, also_equal: bool = False) -> int:
    """Pairs i < j with ranks[i] > ranks[j] (or, with ``also_equal``, >=), counted while blocks of sorted values are merged."""
    n = len(ranks)
    if n < 2:
        return 0
    top = int(ranks.max()) + 1
    pad = -n % _BASE
    v = np.concatenate([ranks.astype(np.int64), np.full(pad, top)])  # what fills the last block is larger than all before it
    rows = v.reshape(-1, _BASE)
    found = 0
    for k in range(1, _BASE):
        left, right = rows[:, :-k], rows[:, k:]
        found += int(((left >= right) & (right < top) if also_equal else left > right).sum())
    width = _BASE
    v = np.sort(rows, axis=1).ravel()
    while width < len(v):
        place = np.arange(len(v))
        block = place // (2 * width)
        key = block * (top + 2) + v
        is_left = place % (2 * width) < width
        left = key[is_left]
        right, of = key[~is_left], block[~is_left]
        real = v[~is_left] < top
        ends = np.searchsorted(left, (of + 1) * (top + 2))  # end of the left half of each block
        found += int((ends - np.searchsorted(left, right, side="left" if also_equal else "right"))[real].sum())
        v = np.sort(key) - block * (top + 2)
        width *= 2
    return found


def _rank(v: np.ndarray) -> np.ndarray:
    return np.unique(v, return_inverse=True)[1].reshape(-1)


def _equal_pairs(*columns: np.ndarray) -> int:
    n = np.unique(np.column_stack(columns), axis=0, return_counts=True)[1] if len(columns) > 1 else np.unique(columns[0], return_counts=True)[1]
    return int((n * (n - 1) // 2).sum())


def kendall_long(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """tau-b and p of one series without missing values, in n log n steps."""
    n = len(x)
    total = n * (n - 1) // 2
    order = np.lexsort((y, x))
    against = discordant(_rank(y[order]))
    tx, ty, both = _equal_pairs(x), _equal_pairs(y), _equal_pairs(x, y)
    s = total - tx - ty + both - 2 * against
    if total in (tx, ty):
        return math.nan, math.nan
    return s / math.sqrt(float(total - tx) * float(total - ty)), kendall_p(s, x, y)


class Slopes:
    """The slopes between all pairs of points of one long series, of which any rank can be found without listing them.

    The slopes up to t are the pairs whose order by y - t x turns, which merge sort counts; a bisection closes in on the t of a rank.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.lexsort((y, x))
        # a shift of x or y changes no slope and keeps y - t x precise
        self.x, self.y = x[order] - np.median(x), y[order] - np.median(y)
        self.same = _equal_pairs(x, y)
        self.count = len(x) * (len(x) - 1) // 2 - _equal_pairs(x)
        rng = np.random.default_rng(0)
        i, j = rng.integers(0, len(x), (2, 20_000))
        use = self.x[i] != self.x[j]
        self.some = np.sort((self.y[j] - self.y[i])[use] / (self.x[j] - self.x[i])[use]) if use.any() else np.zeros(1)
        self.known: dict[float, int] = {}

    def up_to(self, t: float) -> int:
        if t not in self.known:
            z = self.y - t * self.x
            order = np.lexsort((z, self.x))
            self.known[t] = discordant(_rank(z[order]), also_equal=True) - self.same
        return self.known[t]

    def of_rank(self, k: int) -> float:
        """The slope with ``k`` smaller ones, to the last few digits."""
        at, near = round(len(self.some) * (k + 0.5) / max(1, self.count)), max(2, len(self.some) // 100)
        lo, hi = (float(self.some[min(max(at + d, 0), len(self.some) - 1)]) for d in (-near, near))
        step = max(hi - lo, abs(hi), 1e-300) * 1e-3
        while self.up_to(lo) > k:
            lo, step = lo - step, step * 4
        while self.up_to(hi) <= k:
            hi, step = hi + step, step * 4
        while hi - lo > 2e-14 * max(abs(lo), abs(hi)) and hi - lo > 1e-300:
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if self.up_to(mid) > k else (mid, hi)
        return hi


def _limit_ranks(m, sigma, z: float):
    return np.maximum(np.rint((m + z * sigma) / 2) - 1, 0).astype(np.int64), np.minimum(np.rint((m - z * sigma) / 2), m - 1).astype(np.int64)


def theil_sen_long(x: np.ndarray, y: np.ndarray, alpha: float = 0.05) -> tuple[float, float, float, float]:
    """Slope, intercept and limits of one series without missing values; slopes are selected by rank."""
    slopes, n = Slopes(x, y), len(x)
    m = slopes.count
    if not m:
        return (math.nan,) * 4
    ties = sum((t * (t - 1) * (2 * t + 5)).sum() for t in (_ties(x), _ties(y)))
    sigma = math.sqrt(max(0.0, (n * (n - 1.0) * (2 * n + 5) - ties) / 18))
    lo, hi = (int(r) for r in _limit_ranks(m, sigma, NORMAL.inv_cdf(alpha / 2)))
    middle = {slopes.of_rank(k) for k in {(m - 1) // 2, m // 2}}
    slope = sum(middle) / len(middle)
    return slope, np.median(y) - slope * np.median(x), slopes.of_rank(lo), slopes.of_rank(hi)


def kendall_p(concordance: float, x: np.ndarray, y: np.ndarray) -> float:
    """Two-sided p of a number of concordant minus discordant pairs: exact without ties in short series, else normal."""
    tx, ty = _ties(x), _ties(y)
    sums = [np.array([(t * (t - 1) * k).sum()]) for t in (tx, ty) for k in (2 * t + 5, 1, t - 2)]
    return float(kendall_ps(np.array([float(concordance)]), np.array([len(x)]), *sums)[0])


def kendall_ps(s: np.ndarray, n: np.ndarray, x5: np.ndarray, x1: np.ndarray, x2: np.ndarray, y5: np.ndarray, y1: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """p of many series at once, from their numbers of values and the sums of t(t-1)(2t+5), t(t-1) and t(t-1)(t-2) over ties in x and in y."""
    p = np.full(len(s), np.nan)
    less = np.rint((n * (n - 1.0) / 2 - np.abs(s)) / 2)
    exact = (x1 == 0) & (y1 == 0) & (n > 1) & ((n <= 33) | (less <= 1))
    for k in np.unique(n[exact]):
        at = np.flatnonzero(exact & (n == k))
        if k <= 33:
            p[at] = np.minimum(1.0, 2 * np.asarray(_inversions(int(k)))[less[at].astype(int)])
        else:  # one order, or k of them, of k!
            p[at] = 2 * np.exp(np.log(np.where(less[at] == 0, 1.0, k)) - math.lgamma(k + 1))
    rest = np.flatnonzero(~exact & (n > 1))
    if len(rest):
        m = n[rest] * (n[rest] - 1.0)
        var = (m * (2 * n[rest] + 5) - x5[rest] - y5[rest]) / 18 + x1[rest] * y1[rest] / (2 * m)
        var += np.where(n[rest] > 2, x2[rest] * y2[rest] / (9 * m * np.maximum(n[rest] - 2, 1)), 0)
        z = np.abs(s[rest]) / np.sqrt(np.where(var > 0, var, np.nan)) / math.sqrt(2)
        p[rest] = [math.erfc(v) if v == v else math.nan for v in z]
    return p


def _by_length(x: np.ndarray, y: np.ndarray, width: int, many, one) -> np.ndarray:
    """Results of ``many`` on steps of short rows, which hold PAIRS pairs, and of ``one`` on each long row without its gaps."""
    n = (~np.isnan(x) & ~np.isnan(y)).sum(axis=1)
    out = np.full((len(x), width), np.nan)
    short = np.flatnonzero(n <= SHORT)
    if len(short):
        # gaps go to the end, so that a short row is as wide as it has values
        gaps = np.isnan(x[short]) | np.isnan(y[short])
        order = np.argsort(gaps, axis=1, kind="stable")[:, : max(1, n[short].max())]
        a, b = (np.take_along_axis(np.where(gaps, np.nan, v[short]), order, axis=1) for v in (x, y))
        step = max(1, PAIRS // a.shape[1] ** 2)
        for lo in range(0, len(short), step):
            out[short[lo : lo + step]] = np.column_stack(many(a[lo : lo + step], b[lo : lo + step]))
    for k in np.flatnonzero(n > SHORT):
        ok = ~np.isnan(x[k]) & ~np.isnan(y[k])
        out[k] = one(x[k, ok], y[k, ok])
    return out


def _tie_sums(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of t(t-1)(2t+5), t(t-1) and t(t-1)(t-2) over the groups of t equal values of each row."""
    t = (v[:, :, None] == v[:, None, :]).sum(axis=2).astype(float)
    more = np.maximum(t - 1, 0)
    return (more * (2 * t + 5)).sum(axis=1), more.sum(axis=1), (more * (t - 2)).sum(axis=1)


def _kendall_short(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.triu_indices(x.shape[1], 1)
    sx, sy = np.sign(x[:, j] - x[:, i]), np.sign(y[:, j] - y[:, i])
    s = np.nansum(sx * sy, axis=1)
    both = ~np.isnan(sx * sy)
    nx, ny = ((sx != 0) & both).sum(axis=1), ((sy != 0) & both).sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        tau = s / np.sqrt(nx * ny.astype(float))
    p = kendall_ps(s, (~np.isnan(x)).sum(axis=1), *_tie_sums(x), *_tie_sums(y))
    return tau, np.where(np.isnan(tau), np.nan, p)


def kendall(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """tau-b and p of every row; NaN where a side is constant or fewer than two values are there."""
    out = _by_length(x, y, 2, _kendall_short, kendall_long)
    return out[:, 0], out[:, 1]


def theil_sen(x: np.ndarray, y: np.ndarray, alpha: float = 0.05) -> np.ndarray:
    """Slope, intercept, and lower and upper limit of the slope, of every row."""

    def short(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        i, j = np.triu_indices(a.shape[1], 1)
        n = (~np.isnan(a)).sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            dx = a[:, j] - a[:, i]
            slopes = np.sort(np.where(dx == 0, np.nan, (b[:, j] - b[:, i]) / dx), axis=1)
        m = (~np.isnan(slopes)).sum(axis=1)
        if not slopes.shape[1]:
            return [np.full(len(a), np.nan)] * 4
        sigma = np.sqrt(np.maximum(0.0, (n * (n - 1.0) * (2 * n + 5) - _tie_sums(a)[0] - _tie_sums(b)[0]) / 18))
        get = lambda rank: slopes[np.arange(len(a)), np.clip(rank, 0, slopes.shape[1] - 1)]
        lo, hi = _limit_ranks(m, sigma, NORMAL.inv_cdf(alpha / 2))
        slope = (get((m - 1) // 2) + get(m // 2)) / 2
        middle = [np.sort(v, axis=1) for v in (a, b)]
        mx, my = ((v[np.arange(len(v)), np.maximum(n - 1, 0) // 2] + v[np.arange(len(v)), np.minimum(n // 2, v.shape[1] - 1)]) / 2 for v in middle)
        return [np.where(m > 0, v, np.nan) for v in (slope, my - slope * mx, get(lo), get(hi))]

    return _by_length(x, y, 4, short, lambda a, b: theil_sen_long(a, b, alpha))


def linear_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Slope, intercept, correlation and its two-sided p."""
    n = len(x)
    if n < 2 or np.ptp(x) == 0:
        return (math.nan,) * 4
    dx, dy = x - x.mean(), y - y.mean()
    slope = (dx * dy).sum() / (dx * dx).sum()
    spread = math.sqrt((dx * dx).sum() * (dy * dy).sum())
    r = (dx * dy).sum() / spread if spread else math.nan
    if n == 2 or math.isnan(r):
        p = 1.0 if n == 2 else math.nan
    else:
        p = t_two_sided(r * math.sqrt((n - 2) / max(1e-300, (1 - r) * (1 + r))), n - 2)
    return slope, y.mean() - slope * x.mean(), r, p


@lru_cache(maxsize=64)
def _rank_sums(a: int, b: int) -> tuple:
    """Shares of the orders of a and b things by their U."""
    ways = np.zeros((a + 1, a * b + 1))
    ways[0, 0] = 1
    for larger in range(1, a + b + 1):  # things in rank order; taking one as the k-th of a adds its rank minus k
        for k in range(min(a, larger), 0, -1):
            shift = larger - k
            if shift <= a * b:
                ways[k, shift:] += ways[k - 1, : a * b + 1 - shift]
    return tuple(ways[a] / ways[a].sum())


def mann_whitney(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """U of ``a`` and the two-sided p: exact for small samples without ties, else normal with corrections."""
    n1, n2 = len(a), len(b)
    if not n1 or not n2:
        return math.nan, math.nan
    u = float((a[:, None] > b[None, :]).sum() + (a[:, None] == b[None, :]).sum() / 2)
    top = max(u, n1 * n2 - u)
    ties = _ties(np.concatenate([a, b]))
    if not len(ties) and min(n1, n2) <= 8:
        return u, min(1.0, 2 * sum(_rank_sums(n1, n2)[int(top) :]))
    n = n1 + n2
    s = math.sqrt(n1 * n2 / 12 * (n + 1 - (ties**3 - ties).sum() / (n * (n - 1))))
    return u, min(1.0, normal_two_sided(max(0.0, top - n1 * n2 / 2 - 0.5) / s)) if s else 1.0


def levene(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Median-centred test of equal spread: F and p."""
    za, zb = np.abs(a - np.median(a)), np.abs(b - np.median(b))
    n1, n2 = len(a), len(b)
    whole = np.concatenate([za, zb]).mean()
    within = ((za - za.mean()) ** 2).sum() + ((zb - zb.mean()) ** 2).sum()
    if n1 + n2 <= 2 or within == 0:
        return math.nan, math.nan
    f = (n1 + n2 - 2) * (n1 * (za.mean() - whole) ** 2 + n2 * (zb.mean() - whole) ** 2) / within
    return f, f_tail(f, 1, n1 + n2 - 2)


def _line(n, sx, sy, sxx, sxy, syy):
    """Slope, intercept, sum of squared residuals, and spread of x, of the lines through points with these sums."""
    xx, xy, yy = sxx - sx * sx / n, sxy - sx * sy / n, syy - sy * sy / n
    slope = xy / xx
    return slope, (sy - slope * sx) / n, np.maximum(yy - slope * xy, 0.0), xx


def segmented(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """The break of a line with one change of slope and its 95 % limits; NaN where none is found.

    Every place of the break is searched. With the first k points on its left, the best break lies where the lines through both sides meet,
    if that is between points k and k + 1, or else on a point; sums from the left give all these fits at once. The limits follow from
    the gap between the two lines at the break (delta method). Both sides need two points, and points of one x stay on one side.
    """
    missing = (math.nan,) * 3
    order = np.argsort(x, kind="stable")
    middle = np.median(x) if len(x) else 0.0
    u, v = x[order] - middle, y[order]
    v = v - v.mean() if len(v) else v
    n = len(u)
    if n < 6:
        return missing
    upto = np.cumsum(np.stack([np.ones(n), u, v, u * u, u * v, v * v]), axis=1)
    whole = upto[:, -1:]
    k = np.flatnonzero((u[1:] > u[:-1]) & (u[:-1] > u[0]) & (u[1:] < u[-1]))  # the last point on the left: two xs on each side
    if not len(k):
        return missing
    left, right = upto[:, k], whole - upto[:, k]
    with np.errstate(invalid="ignore", divide="ignore"):
        (bl, al, rl, xl), (br, ar, rr, xr) = _line(*left), _line(*right)
        meet = (al - ar) / (br - bl)
        apart = np.where((meet >= u[k]) & (meet <= u[k + 1]), rl + rr, np.inf)
        # a line, and a second slope from point k on
        m, sx, sy, sxx, sxy, _ = right
        t = u[k]
        h, hh, xh, hy = sx - m * t, sxx - 2 * t * sx + m * t * t, sxx - t * sx, sxy - t * sy
        _, tx, ty, txx, txy, tyy = whole[:, 0]
        cxx, chh, cxh = txx - tx * tx / n, hh - h * h / n, xh - tx * h / n
        cxy, chy, cyy = txy - tx * ty / n, hy - h * ty / n, tyy - ty * ty / n
        on = cyy - (cxy * cxy * chh - 2 * cxy * chy * cxh + chy * chy * cxx) / (cxx * chh - cxh * cxh)
    tried, places = np.concatenate([apart, on]), np.round(np.concatenate([meet, t]) + middle, 9)
    tried[np.isnan(tried)] = np.inf
    # of equal errors the earlier break, then the one with more points on its left
    equal = np.flatnonzero(tried <= tried.min() + 1e-9 * (1 + cyy))
    best = int(equal[np.lexsort((-np.tile(left[0], 2)[equal], places[equal]))[0]])
    at = best % len(k)
    psi, change = places[best] - middle, br[at] - bl[at]
    if not np.isfinite(tried[best]) or abs(change) < 1e-12:
        return missing
    spread = sum(1 / c + (psi - s / c) ** 2 / xx for c, s, xx in ((left[0, at], left[1, at], xl[at]), (right[0, at], right[1, at], xr[at])))
    half = t_quantile(0.05, n - 4) * math.sqrt((rl[at] + rr[at]) / (n - 4) * spread) / abs(change)
    return psi + middle, psi + middle - half, psi + middle + half
