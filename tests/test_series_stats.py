import itertools
import math

import numpy as np
import pytest
from emberline.functions import series_stats as N


def tau_by_pairs(x, y):
    pairs = list(itertools.combinations(range(len(x)), 2))
    s = sum(np.sign(x[j] - x[i]) * np.sign(y[j] - y[i]) for i, j in pairs)
    return s, s / math.sqrt(sum(x[i] != x[j] for i, j in pairs) * sum(y[i] != y[j] for i, j in pairs))


@pytest.mark.parametrize("n", [3, 4, 5, 6])
def test_kendall_exact_by_permutations(n):
    rng = np.random.default_rng(n)
    x, y = np.arange(n, dtype=float), rng.permutation(n).astype(float)
    s, tau = tau_by_pairs(x, y)
    all_s = [abs(tau_by_pairs(x, p)[0]) for p in itertools.permutations(range(n))]
    got = N.kendall(x[None], y[None])
    assert got[0][0] == pytest.approx(tau)
    assert got[1][0] == pytest.approx(np.mean([a >= abs(s) for a in all_s]))


def test_kendall_ties_gaps_and_constants():
    x = np.array([[1, 2, 3, 4, 5, np.nan], [1, 2, 3, 4, 5, 6], [1, np.nan, np.nan, np.nan, np.nan, np.nan]])
    y = np.array([[3, 3, 1, 2, 2, np.nan], [7, 7, 7, 7, 7, 7], [1, np.nan, np.nan, np.nan, np.nan, np.nan]])
    tau, p = N.kendall(x, y)
    assert tau[0] == pytest.approx(tau_by_pairs(x[0, :5], y[0, :5])[1]) and 0 < p[0] <= 1
    assert np.isnan(tau[1:]).all() and np.isnan(p[1:]).all()


def test_theil_sen():
    x, y = np.arange(9.0), 2 * np.arange(9.0) + 1
    y[3] = 50
    slope, intercept, lower, upper = N.theil_sen(x[None], y[None])[0]
    slopes = sorted((y[j] - y[i]) / (x[j] - x[i]) for i, j in itertools.combinations(range(9), 2))
    assert slope == np.median(slopes) == 2 and intercept == np.median(y) - 2 * 4
    sigma = math.sqrt(9 * 8 * 23 / 18)
    assert lower == slopes[round((36 - 1.959964 * sigma) / 2) - 1] and upper == slopes[round((36 + 1.959964 * sigma) / 2)]


def test_tails():
    assert N.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert N.t_quantile(0.05, 10) == pytest.approx(2.228138852, abs=1e-6)
    assert N.f_tail(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert N.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-8)


@pytest.mark.parametrize("sizes", [(2, 3), (3, 4), (4, 4)])
def test_mann_whitney_by_enumeration(sizes):
    n1, n2 = sizes
    rng = np.random.default_rng(5)
    v = rng.permutation(n1 + n2).astype(float)
    u, p = N.mann_whitney(v[:n1], v[n1:])
    every = []
    for chosen in itertools.combinations(range(n1 + n2), n1):
        a, b = v[list(chosen)], np.delete(v, list(chosen))
        every.append(sum(x > y for x in a for y in b))
    top = max(u, n1 * n2 - u)
    assert p == pytest.approx(min(1, 2 * np.mean([e >= top for e in every])))


def test_levene_and_fit():
    a, b = np.array([1.0, 2, 3, 4, 10]), np.array([2.0, 2.1, 2.2, 2.3])
    f, p = N.levene(a, b)
    assert f > 0 and 0 < p < 1 and math.isnan(N.levene(np.ones(3), np.ones(3))[1])
    x = np.array([1.0, 2, 3, 4])
    slope, intercept, r, p = N.linear_fit(x, np.array([2.0, 4.1, 5.9, 8.2]))
    assert slope == pytest.approx(2.04) and intercept == pytest.approx(-0.05)
    assert r == pytest.approx(np.corrcoef(x, [2.0, 4.1, 5.9, 8.2])[0, 1]) and p == pytest.approx(N.t_two_sided(r * math.sqrt(2 / (1 - r * r)), 2))


def test_planted_break():
    x = np.arange(1986.0, 2017)
    rng = np.random.default_rng(0)
    y = np.where(x < 2003, x - 1986, 17 - 2 * (x - 2003)) + rng.normal(scale=0.3, size=len(x))
    cp, lo, hi = N.segmented(x, y)
    assert abs(cp - 2003) < 1 and lo < cp < hi and hi - lo < 2
    assert all(math.isnan(v) for v in N.segmented(x[:4], y[:4]))


def one_by_one(x, y):
    """tau, p, slope, intercept and limits from lists of all pairs."""
    n = len(x)
    i, j = np.triu_indices(n, 1)
    s, tau = int((np.sign(x[j] - x[i]) * np.sign(y[j] - y[i])).sum()), None
    use = x[j] != x[i]
    tau = s / math.sqrt(use.sum() * (y[j] != y[i]).sum())
    slopes = np.sort((y[j] - y[i])[use] / (x[j] - x[i])[use])
    ties = [np.unique(v, return_counts=True)[1].astype(float) for v in (x, y)]
    sigma = math.sqrt((n * (n - 1) * (2 * n + 5) - sum((t * (t - 1) * (2 * t + 5)).sum() for t in ties)) / 18)
    m, z = len(slopes), N.NORMAL.inv_cdf(0.025)
    lower, upper = slopes[max(round((m + z * sigma) / 2) - 1, 0)], slopes[min(round((m - z * sigma) / 2), m - 1)]
    return s, tau, np.median(slopes), np.median(y) - np.median(slopes) * np.median(x), lower, upper


def series(kind, n, seed):
    rng = np.random.default_rng(seed)
    x = np.sort(rng.integers(0, n // 2 + 1, n)).astype(float) if kind == "ties" else 1900.0 + np.arange(n)
    y = rng.integers(0, 20, n).astype(float) if kind == "ties" else 0.003 * x + rng.normal(size=n)
    order = rng.permutation(n)
    return x[order], y[order]


@pytest.mark.parametrize("kind", ["ties", "plain"])
@pytest.mark.parametrize("n", [2, 3, 31, 33, 100, 700])
def test_long_and_short_ways_agree_with_all_pairs(kind, n):
    for seed in range(4):
        x, y = series(kind, n, seed)
        if len(np.unique(x)) < 2 or len(np.unique(y)) < 2:
            continue
        s, tau, slope, intercept, lower, upper = one_by_one(x, y)
        p = N.kendall_p(s, x, y)
        for got in ((*N.kendall_long(x, y), *N.theil_sen_long(x, y)), (*(v[0] for v in N.kendall(x[None], y[None])), *N.theil_sen(x[None], y[None])[0])):
            assert got == pytest.approx((tau, p, slope, intercept, lower, upper), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 64, 65, 1000])
def test_discordant_pairs(n):
    v = np.random.default_rng(n).integers(0, max(1, n // 2), n)
    pairs = list(itertools.combinations(v.tolist(), 2))
    assert N.discordant(v) == sum(a > b for a, b in pairs) and N.discordant(v, True) == sum(a >= b for a, b in pairs)


def test_a_batch_gives_each_row_its_own_figures():
    rng = np.random.default_rng(8)
    x, y = np.full((60, 40), np.nan), np.full((60, 40), np.nan)
    for k in range(60):
        n = int(rng.integers(0, 40))
        x[k, :n], y[k, :n] = np.arange(n), rng.integers(0, 6 if k % 2 else 10**6, n)
        y[k, rng.random(40) < 0.1] = np.nan
    tau, p = N.kendall(x, y)
    sen = N.theil_sen(x, y)
    for k in range(60):
        ok = ~np.isnan(x[k]) & ~np.isnan(y[k])
        if ok.sum() > 1 and len(np.unique(y[k, ok])) > 1:
            s, *want = one_by_one(x[k, ok], y[k, ok])
            assert (tau[k], *sen[k]) == pytest.approx(tuple(want)) and p[k] == pytest.approx(N.kendall_p(s, x[k, ok], y[k, ok]))
        else:
            assert np.isnan(tau[k]) and np.isnan(p[k])


def test_a_series_of_100_000_points_in_bounded_memory():
    import tracemalloc

    n = 100_000
    x = np.arange(n, dtype=float)
    y = 0.25 * x + np.random.default_rng(1).normal(scale=1000, size=n)
    tracemalloc.start()
    tau, p = N.kendall_long(x, y)
    slope, intercept, lower, upper = N.theil_sen_long(x, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6 and tau > 0.8 and p < 1e-9
    assert lower < slope < upper and abs(slope - 0.25) < 1e-3 and upper - lower < 1e-3


def error_of(psi, x, y):
    design = np.column_stack([np.ones_like(x), x - 2000, np.maximum(x - psi, 0)])
    coef = np.linalg.lstsq(design, y, rcond=None)[0]
    return ((y - design @ coef) ** 2).sum()


@pytest.mark.parametrize("seed", range(12))
def test_break_is_the_best_of_a_fine_grid(seed):
    rng = np.random.default_rng(seed)
    x = np.sort(rng.choice(np.arange(1986.0, 2017), 12 + seed, replace=False))
    y = rng.normal(size=len(x)) if seed % 3 == 0 else np.abs(x - rng.uniform(1992, 2010)) * (1 + seed) + rng.normal(size=len(x))
    cp, lo, hi = N.segmented(x, y)
    grid = np.arange(x[1], x[-2] + 1e-9, 0.01)
    errors = np.array([error_of(g, x, y) for g in grid])
    assert error_of(cp, x, y) <= errors.min() * (1 + 1e-9) + 1e-9
    if errors.min() < np.sort(errors[np.abs(grid - grid[errors.argmin()]) > 1])[0] * 0.999:
        assert abs(cp - grid[errors.argmin()]) < 0.02
    # limits from the least squares fit with a jump at the break
    design = np.column_stack([np.ones_like(x), x - 2000, np.maximum(x - cp, 0), -(x > cp).astype(float)])
    if 1 < (x <= cp + 1e-9).sum() < len(x) - 1 and np.abs(x - cp).min() > 1e-6:
        coef, rest = np.linalg.lstsq(design, y, rcond=None)[:2]
        cov = np.linalg.inv(design.T @ design) * rest[0] / (len(x) - 4)
        assert (hi - lo) / 2 == pytest.approx(N.t_quantile(0.05, len(x) - 4) * math.sqrt(cov[3, 3]) / abs(coef[2]), rel=1e-6)


def test_no_break_in_lines_and_few_points():
    x = np.arange(1990.0, 2010)
    assert all(math.isnan(v) for v in N.segmented(x, np.full(20, 3.0)))
    assert all(math.isnan(v) for v in N.segmented(np.array([1.0, 1, 1, 2, 2, 3]), np.arange(6.0)))
    assert N.segmented(x[::-1], np.abs(x - 1999.5)[::-1])[0] == pytest.approx(1999.5)
