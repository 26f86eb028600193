"""Queries on trends, tests and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import scalars as X
from emberline.functions import series_stats as N95
from emberline.operators import agreement as A
from emberline.operators import grid as G
from emberline.operators import statistics as S
from emberline.operators.hotspots import annual_counts
from emberline.plans import sql as Q
from emberline.plans.grids import _SEASON, GRID, _days, _grid
from emberline.plans.hotspots import valid
from emberline.plans.registry import query
from emberline.plans.seasons import _LENGTH, R, _counts
from emberline.operators import climate as C
from emberline.operators import season as N

_R6 = lambda df, *cs: df.withColumns({c: F.round(c, 6) for c in cs})


def _pairs(table: str, key: str, x: str, y: str) -> str:
    """tau, slope and intercept of each key by all pairs of its rows."""
    return f"""pq AS (SELECT a.{key}, sign(b.{x} - a.{x}) AS sx, sign(b.{y} - a.{y}) AS sy, (b.{y} - a.{y}) / nullif(b.{x} - a.{x}, 0)::DOUBLE AS s FROM {table} a JOIN {table} b ON a.{key} IS NOT DISTINCT FROM b.{key} AND a.{x} < b.{x}),
tk AS (SELECT {key}, sum(sx * sy) / nullif(sqrt(sum(sx * sx)::DOUBLE * sum(sy * sy)), 0) AS tau, quantile_cont(s, 0.5) AS slope FROM pq GROUP BY {key})"""


def _series(spark, d):
    return annual_counts(valid(spark, d)).groupBy("gfed", "year").agg(F.sum("count").alias("count"))


_S = f"{Q.ANNUAL}, rs AS (SELECT gfed, year, CAST(sum(count) AS DOUBLE) AS count FROM ac GROUP BY ALL)"


@query(f"WITH {_S}, {_pairs('rs', 'gfed', 'year', 'count')}, md AS (SELECT gfed, quantile_cont(year, 0.5) AS mx, quantile_cont(count, 0.5) AS my FROM rs GROUP BY ALL) SELECT gfed, round(tau, 6) AS tau, round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept FROM tk JOIN md USING (gfed)")
def h01_kendall_theilsen(spark, d):
    """Trend of annual counts by region: tau, slope and intercept."""
    return _R6(S.kendall_theilsen(_series(spark, d), ["gfed"], "year", "count"), "tau", "slope", "intercept").select("gfed", "tau", "slope", "intercept")


def _erfc(x: str) -> str:
    """1 - erf of a number from 0 on, by a series of positive terms."""
    v = f"greatest(1e-300::DOUBLE, {x})"
    terms = f"list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln({v}) + 2 * k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)))"
    return f"greatest(0, 1 - 2 / sqrt(pi()) * exp(-{v} * {v}) * list_sum({terms}))"


#: Share of the orders of n things with k inversions, by adding one thing at a time.
_ORDERS = (
    "mh1 AS MATERIALIZED (SELECT 0::BIGINT AS k, 1::DOUBLE AS w), "
    + ", ".join(f"mh{n} AS MATERIALIZED (SELECT k + j AS k, sum(w) / {n} AS w FROM mh{n - 1}, range({n}) r(j) GROUP BY k + j)" for n in range(2, 34))
    + ", mh AS (SELECT things, k, sum(w) OVER (PARTITION BY things ORDER BY k) AS upto FROM ("
    + " UNION ALL ".join(f"SELECT {n} AS things, * FROM mh{n}" for n in range(1, 34))
    + "))"
)


def _trend(table: str, key: str, x: str, y: str) -> str:
    """tau, p, slope and what the intercept and the limits need, of each key: the table ``pv``."""
    return f"""{_pairs(table, key, x, y)}, {_ORDERS},
md AS (SELECT {key}, quantile_cont({x}, 0.5) AS mx, quantile_cont({y}, 0.5) AS my, count(*) AS n, min({x}) AS first, max({x}) AS last FROM {table} GROUP BY {key}),
tt AS (SELECT {key}, sum(t * (t - 1) * (2 * t + 5)) AS t5 FROM (SELECT {key}, count(*) AS t FROM {table} GROUP BY {key}, {y}) GROUP BY {key}),
sp AS (SELECT {key}, sum(sx * sy) AS s, list_sort(list(s) FILTER (WHERE s IS NOT NULL)) AS slopes FROM pq GROUP BY {key}),
st AS (SELECT *, n * (n - 1) * (2 * n + 5) - t5 AS v18, len(slopes) AS m, sqrt(greatest(0, n * (n - 1) * (2 * n + 5) - t5) / 18.0::DOUBLE) AS sigma, 1.9599639845400538::DOUBLE AS z
  FROM md JOIN tt USING ({key}) LEFT JOIN tk USING ({key}) LEFT JOIN sp USING ({key})),
pv AS (SELECT *, round_even((m - z * sigma) / 2, 0) AS rl, round_even((m + z * sigma) / 2, 0) AS ru FROM (SELECT st.*, CASE WHEN tau IS NULL THEN NULL WHEN t5 = 0 AND n <= 33 THEN least(1, 2 * upto) ELSE {_erfc("abs(s) / sqrt(v18 / 18.0::DOUBLE) / sqrt(2)")} END AS p
  FROM st LEFT JOIN mh ON mh.things = st.n AND mh.k = CAST((st.n * (st.n - 1) / 2 - abs(s)) / 2 AS BIGINT)))"""


_FIGURES = """round(tau, 6) AS tau, round(p, 6) AS p, round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept,
round(slopes[1 + greatest(CAST(rl AS BIGINT) - 1, 0)], 6) AS lower, round(slopes[1 + least(CAST(ru AS BIGINT), m - 1)], 6) AS upper"""


@query(f"WITH {_S}, {_trend('rs', 'gfed', 'year', 'count')} SELECT gfed, {_FIGURES} FROM pv")
def h01_kendall_theilsen_limits(spark, d):
    """The same trends with p (exact where nothing is tied) and the limits of the slope."""
    return _R6(S.kendall_theilsen(_series(spark, d), ["gfed"], "year", "count"), "tau", "p", "slope", "intercept", "lower", "upper")


_G = f"""{GRID}, c2 AS (SELECT (y // 20) * 1000 + x // 20 AS cell, year, sum(value) AS value FROM gr GROUP BY ALL),
few AS (SELECT cell FROM c2 GROUP BY cell HAVING avg(CAST(value IN (0, 1) AS DOUBLE)) < 0.6),
nm AS (SELECT cell, year, CASE WHEN first = 0 THEN value + 1 ELSE value / first END AS value FROM (SELECT *, first_value(value) OVER (PARTITION BY cell ORDER BY year) AS first FROM c2 WHERE cell IN (SELECT cell FROM few)))"""


def _cells2(spark, d):
    c = G.coarsen(_grid(spark, d), ["year"], 20, "sum")
    return c.select((F.col("y") * 1000 + F.col("x")).alias("cell"), "year", "value")


@query(f"WITH {_G}, {_pairs('nm', 'cell', 'year', 'value')} SELECT cell, round(tau, 6) AS tau, round(slope, 6) AS slope FROM tk")
def h02_grid_trend(spark, d):
    """Trend of each 2-degree cell relative to its first year; cells with mostly 0 or 1 fires are left out."""
    out = S.grid_trend(_cells2(spark, d), ["cell"])
    return _R6(out.filter("slope IS NOT NULL"), "tau", "slope").select("cell", "tau", "slope")


_CORR = f"""{_SEASON}, ab AS (SELECT a.y, a.x, a.year, a.value AS a, b.value AS b FROM sd a JOIN sd b ON a.y = b.y AND a.x = b.x AND a.year = b.year AND a.dataset = 'geff_fwi' AND b.dataset = 'geff_bi'),
df AS (SELECT y, x, a - lag(a) OVER w AS a, b - lag(b) OVER w AS b FROM ab WINDOW w AS (PARTITION BY y, x ORDER BY year))"""


@query(f"WITH {_CORR} SELECT y, x, round(corr(a, b), 6) AS stat FROM df WHERE a IS NOT NULL GROUP BY ALL")
def h03_grid_corr(spark, d):
    """Correlation of the year-to-year differences of two season-length grids."""
    s = C.season_days(_days(spark, d))
    out = S.grid_corr(s.filter("dataset = 'geff_fwi'"), s.filter("dataset = 'geff_bi'"), ["y", "x"], "pearson", True)
    return _R6(out, "stat").select("y", "x", "stat")


@query(f"WITH {_S} SELECT gfed, round(regr_slope(count, year), 5) AS fit_slope, round(regr_intercept(count, year), 5) AS fit_intercept, round(corr(count, year), 5) AS fit_r FROM rs GROUP BY ALL")
def h05_pair_stats(spark, d):
    return S.pair_stats(_series(spark, d), ["gfed"], "year", "count").select("gfed", "fit_slope", "fit_intercept", "fit_r")


_T = """ft AS (SELECT o_orderkey AS cell, (o_orderkey * 7 % 2001 - 1000) / 1000.0::DOUBLE AS tau, (o_orderkey * 13 % 401) / 2000.0::DOUBLE AS p, (o_custkey * 11 % 2001 - 1000) / 1000.0::DOUBLE AS ctau, (o_custkey * 17 % 401) / 2000.0::DOUBLE AS cp FROM orders),
q0 AS (SELECT cell, CASE WHEN p < 0.1 THEN tau END AS f, CASE WHEN cp < 0.1 THEN ctau ELSE 0 END AS c FROM ft),
qd AS (SELECT cell, CASE WHEN f < 0 AND c < 0 THEN 1 WHEN f > 0 AND c > 0 THEN 2 WHEN f > 0 AND c < 0 THEN 3 WHEN f < 0 AND c > 0 THEN 4 WHEN f <> 0 AND c = 0 THEN 5 END AS class FROM q0)"""


def _trends(spark, d):
    """Trends of made-up strength for every order, as two tables."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    fire = o.select(F.col("o_orderkey").alias("cell"), F.expr("(o_orderkey * 7 % 2001 - 1000) / 1000.0D").alias("tau"), F.expr("(o_orderkey * 13 % 401) / 2000.0D").alias("p"))
    climate = o.select(F.col("o_orderkey").alias("cell"), F.expr("(o_custkey * 11 % 2001 - 1000) / 1000.0D").alias("tau"), F.expr("(o_custkey * 17 % 401) / 2000.0D").alias("p"))
    return fire, climate


@query(f"WITH {_T} SELECT * FROM qd")
def h06_quadrant(spark, d):
    """Agreement class of given fire and climate trends."""
    return A.quadrant(*_trends(spark, d), ["cell"])


@query(f"WITH {_T} SELECT cell, ctau AS tau, cp AS p FROM ft JOIN qd USING (cell) WHERE class <= 2 AND cp < 0.1")
def h07_matching_corr(spark, d):
    fire, climate = _trends(spark, d)
    return A.matching_corr(climate, A.quadrant(fire, climate, ["cell"]), ["cell"])


@query(f"WITH {_T} SELECT class, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS percent FROM qd WHERE class IS NOT NULL GROUP BY class")
def d29_quadrant_counts(spark, d):
    return A.quadrant_counts(A.quadrant(*_trends(spark, d), ["cell"]))


#: The t that 5 % lie beyond, by degrees of freedom.
_T95 = ", ".join(f"({n}, {N95.t_quantile(0.05, n)!r}::DOUBLE)" for n in range(2, 30))


def _breaks(table: str, key: str, x: str, y: str) -> str:
    """cp, its limits and width of each key: the best of all lines with one change of slope."""
    sums = {"n": "1", "sx": "u", "sy": "v", "sxx": "u * u", "sxy": "u * v", "syy": "v * v"}
    upto = ", ".join(f"sum(({e})::DOUBLE) OVER w AS l{c}, sum(({e})::DOUBLE) OVER (PARTITION BY {key}) AS t{c}" for c, e in sums.items())
    rest = ", ".join(f"t{c} - l{c} AS r{c}" for c in sums)
    line = lambda s: f"({s}sxy - {s}sx * {s}sy / {s}n) / ({s}sxx - {s}sx * {s}sx / {s}n) AS {s}b, {s}sxx - {s}sx * {s}sx / {s}n AS {s}x"
    error = lambda s: f"greatest(0, {s}syy - {s}sy * {s}sy / {s}n - {s}b * ({s}sxy - {s}sx * {s}sy / {s}n))"
    return f"""b0 AS (SELECT {key}, ({x} - 2000)::DOUBLE AS u, {y}::DOUBLE - avg({y}) OVER (PARTITION BY {key}) AS v FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
b1 AS (SELECT {key}, u, lead(u) OVER w AS u2, min(u) OVER (PARTITION BY {key}) AS u0, max(u) OVER (PARTITION BY {key}) AS u9, {upto} FROM b0 WINDOW w AS (PARTITION BY {key} ORDER BY u)),
b2 AS (SELECT *, {rest} FROM b1 WHERE tn >= 6 AND u2 > u AND u > u0 AND u2 < u9),
b3 AS (SELECT *, {line("l")}, {line("r")} FROM b2),
b4 AS (SELECT *, (lsy - lb * lsx) / ln AS la, (rsy - rb * rsx) / rn AS ra, {error("l")} AS le, {error("r")} AS re,
  txx - tsx * tsx / tn AS cxx, rsxx - 2 * u * rsx + rn * u * u - h * h / tn AS chh, rsxx - u * rsx - tsx * h / tn AS cxh, tsxy - tsx * tsy / tn AS cxy, rsxy - u * rsy - h * tsy / tn AS chy, tsyy - tsy * tsy / tn AS cyy
  FROM (SELECT *, tsxx AS txx, rsx - rn * u AS h FROM b3)),
b5 AS (SELECT *, cyy - (cxy * cxy * chh - 2 * cxy * chy * cxh + chy * chy * cxx) / nullif(cxx * chh - cxh * cxh, 0) AS one, u AS psi FROM b4 UNION ALL
  SELECT *, CASE WHEN (la - ra) / nullif(rb - lb, 0) BETWEEN u AND u2 THEN le + re END, (la - ra) / nullif(rb - lb, 0) FROM b4),
b6 AS (SELECT * FROM (SELECT *, min(one) OVER (PARTITION BY {key}) AS least FROM b5 WHERE one IS NOT NULL) WHERE one <= least + 1e-9 * (1 + cyy)
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY round(psi + 2000, 9), ln DESC) = 1),
b7 AS (SELECT {key}, round(psi + 2000, 9) AS cp, q * sqrt((le + re) / (tn - 4) * (1 / ln + (psi - lsx / ln) ** 2 / lx + 1 / rn + (psi - rsx / rn) ** 2 / rx)) / abs(rb - lb) AS half
  FROM b6 JOIN (VALUES {_T95}) t(df, q) ON df = tn - 4 WHERE abs(rb - lb) >= 1e-12),
bp AS (SELECT k.{key}, cp, cp - half AS cp_lower, cp + half AS cp_upper, round_even(cp + half - (cp - half), 0) AS width FROM (SELECT DISTINCT {key} FROM b0) k LEFT JOIN b7 ON b7.{key} = k.{key})"""


@query(f"WITH {_S}, {_breaks('rs', 'gfed', 'year', 'count')} SELECT gfed, round(cp, 4) AS cp, round(cp_lower, 4) AS cp_lower, round(cp_upper, 4) AS cp_upper, width FROM bp")
def h08_change_points(spark, d):
    """Change point of annual counts by region."""
    return S.change_points(_series(spark, d), ["gfed"], "year", "count").withColumns({c: F.round(c, 4) for c in ("cp", "cp_lower", "cp_upper")})


@query(f"""WITH {_S}, {_breaks("rs", "gfed", "year", "count")}, lm AS (SELECT gfed, year, 'count' AS metric, count AS v FROM rs UNION ALL SELECT gfed, year, 'count_norm', count / avg(count) OVER (PARTITION BY gfed) FROM rs),
lg AS (SELECT gfed, metric, 'all' AS segment, year, v FROM lm UNION ALL SELECT gfed, metric, CASE WHEN year <= cp THEN 'before' ELSE 'after' END, year, v FROM lm JOIN bp USING (gfed) WHERE cp IS NOT NULL),
lk AS (SELECT struct_pack(gfed, metric, segment) AS key, year, v FROM lg), {_trend("lk", "key", "year", "v")}
SELECT key.gfed AS gfed, key.metric AS metric, key.segment AS segment, {_FIGURES}, first AS year_start, last AS year_end FROM pv""")
def h04_trend_table(spark, d):
    """Trends of counts and of relative counts by region, for all years and around the region's change point."""
    from emberline.operators.shape import normalise_to_mean

    s = normalise_to_mean(_series(spark, d), ["gfed"], "count").withColumn("count", F.col("count").cast("double"))
    cps = S.change_points(s, ["gfed"], "year", "count").filter("cp IS NOT NULL")
    return S.trend_table(s, ["gfed"], ["count", "count_norm"], cps)


_CP = """cps AS (SELECT o_orderkey AS cell, 1980 + o_orderkey * 7 % 400 / 10.0::DOUBLE AS cp, 1980 + o_orderkey * 7 % 400 / 10.0::DOUBLE - o_custkey % 9 AS cp_lower, 1980 + o_orderkey * 7 % 400 / 10.0::DOUBLE + o_custkey % 7 AS cp_upper FROM orders),
ok AS (SELECT * FROM cps WHERE cp BETWEEN 1993 AND 2009 AND cp_lower >= 1986 AND cp_upper <= 2016 AND cp_upper - cp_lower < 10)"""


def _cps(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("cell"), F.expr("1980 + o_orderkey * 7 % 400 / 10.0D").alias("cp"), "o_custkey")
    return o.select("cell", "cp", (F.col("cp") - F.col("o_custkey") % 9).alias("cp_lower"), (F.col("cp") + F.col("o_custkey") % 7).alias("cp_upper"))


@query(f"WITH {_CP} SELECT * FROM ok")
def h09_valid_change_points(spark, d):
    return S.valid_change_points(_cps(spark, d), 1993, 2009, 10)


@query(f"""WITH {_G}, {_breaks("c2", "cell", "year", "value")}, sg AS (SELECT struct_pack(cell := c2.cell, segment := CASE WHEN year <= cp THEN 'before' ELSE 'after' END) AS key, year, value FROM c2 JOIN bp ON bp.cell = c2.cell WHERE cp IS NOT NULL),
sn AS (SELECT key, year, CASE WHEN first = 0 THEN value + 1 ELSE value / first END AS v FROM (SELECT *, first_value(value) OVER (PARTITION BY key ORDER BY year) AS first FROM sg)), {_trend("sn", "key", "year", "v")}
SELECT key.cell AS cell, key.segment AS segment, round(tau, 6) AS tau, round(p, 6) AS p, round(slope, 6) AS slope FROM pv""")
def h10_split_trend(spark, d):
    """Trends of 2-degree cells before and after their change point."""
    cells = _cells2(spark, d)
    cps = S.change_points(cells, ["cell"], "year", "value").filter("cp IS NOT NULL")
    return _R6(S.split_trend(cells, ["cell"], cps), "tau", "p", "slope")


@query(f"WITH {_CP}, {_T} SELECT count(ok.cell) AS n_cp, count(t.cell) AS n_trend, count(*) FILTER (WHERE ok.cell IS NOT NULL AND t.cell IS NOT NULL) AS n_both, round(count(*) FILTER (WHERE ok.cell IS NOT NULL AND t.cell IS NOT NULL) / nullif(count(ok.cell), 0) * 100, 2) AS percent FROM ok FULL JOIN (SELECT cell FROM ft WHERE p < 0.1) t ON ok.cell = t.cell")
def h11_change_point_overlap(spark, d):
    return S.cp_overlap(S.valid_change_points(_cps(spark, d), 1993, 2009, 10), _trends(spark, d)[0], ["cell"])


def _eras(spark, d):
    return N.season_length(_counts(spark, d), R).withColumn("era", X.era("year"))


@query(f"WITH {_LENGTH}, e AS (SELECT gfed, CASE WHEN year < 2001 THEN 1 ELSE 2 END AS era, unnest(['days_mean', 'days_median']) AS metric, unnest([days_mean, days_median]) AS v FROM sl) SELECT a.gfed, a.metric, CAST(sum(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0 END) AS DOUBLE) AS u FROM e a JOIN e b ON a.gfed = b.gfed AND a.metric = b.metric AND a.era = 1 AND b.era = 2 GROUP BY ALL")
def h12_era_u(spark, d):
    """U of the season lengths of the two eras."""
    return S.era_tests(_eras(spark, d), ["gfed"], ["days_mean", "days_median"]).select("gfed", "metric", "u")


#: Ways to choose some of the ranks 0, 1, ... by how many are chosen and their sum, by adding one rank at a time.
_CHOICES = (
    "ch0 AS MATERIALIZED (SELECT 0::BIGINT AS a, 0::BIGINT AS total, 1::DOUBLE AS w), "
    + ", ".join(f"ch{n} AS MATERIALIZED (SELECT a, total, sum(w) AS w FROM (SELECT * FROM ch{n - 1} UNION ALL SELECT a + 1, total + {n - 1}, w FROM ch{n - 1}) GROUP BY a, total)" for n in range(1, 32))
    + ", ch AS (SELECT n, a, total - a * (a - 1) // 2 AS u, w / sum(w) OVER (PARTITION BY n, a) AS share FROM ("
    + " UNION ALL ".join(f"SELECT {n} AS n, * FROM ch{n}" for n in range(2, 32))
    + "))"
)
#: Probability that a t of nu degrees of freedom lies within -t and t, by its finite sums.
_WITHIN = """CASE WHEN nu % 2 = 0 THEN sin(th) * list_sum(list_transform(range(0, nu // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * k * ln(2) - 2 * lgamma(k + 1) + 2 * k * ln(cos(th)))))
  ELSE 2 / pi() * (th + sin(th) * coalesce(list_sum(list_transform(range(0, (nu - 1) // 2), lambda k: exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2) + (2 * k + 1) * ln(cos(th))))), 0)) END"""
_ERAS = f"""{_LENGTH}, {_CHOICES},
e AS (SELECT gfed, CASE WHEN year < 2001 THEN 1 ELSE 2 END AS era, unnest(['days_mean', 'days_median']) AS metric, unnest([days_mean, days_median]) AS v FROM sl),
uu AS (SELECT a.gfed, a.metric, CAST(sum(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0 END) AS DOUBLE) AS u FROM e a JOIN e b ON a.gfed = b.gfed AND a.metric = b.metric AND a.era = 1 AND b.era = 2 GROUP BY ALL),
nn AS (SELECT gfed, metric, count(*) FILTER (WHERE era = 1) AS n1, count(*) FILTER (WHERE era = 2) AS n2 FROM e GROUP BY ALL),
et AS (SELECT gfed, metric, sum(t ** 3 - t) AS t3 FROM (SELECT gfed, metric, count(*) AS t FROM e GROUP BY gfed, metric, v) GROUP BY ALL),
up AS (SELECT *, greatest(u, n1 * n2 - u) AS top, sqrt(n1 * n2 / 12.0::DOUBLE * (n1 + n2 + 1 - t3 / ((n1 + n2) * (n1 + n2 - 1)))) AS s FROM uu JOIN nn USING (gfed, metric) JOIN et USING (gfed, metric)),
ex AS (SELECT gfed, metric, sum(share) AS tail FROM up JOIN ch ON ch.n = n1 + n2 AND ch.a = n1 AND ch.u >= CAST(floor(top) AS BIGINT) GROUP BY ALL),
zv AS (SELECT gfed, metric, era, abs(v - quantile_cont(v, 0.5) OVER (PARTITION BY gfed, metric, era)) AS z FROM e),
zm AS (SELECT *, avg(z) OVER (PARTITION BY gfed, metric) AS whole, avg(z) OVER (PARTITION BY gfed, metric, era) AS own FROM zv),
lv AS (SELECT gfed, metric, count(*) - 2 AS nu, (count(*) - 2) * sum((own - whole) ** 2) / nullif(sum((z - own) ** 2), 0) AS f FROM zm GROUP BY ALL),
lp AS (SELECT gfed, metric, 1 - {_WITHIN} AS levene_p FROM (SELECT gfed, metric, nu, atan(sqrt(f / nu)) AS th FROM lv WHERE nu > 0 AND f IS NOT NULL))"""


@query(f"""WITH {_ERAS} SELECT gfed, metric, u, round(CASE WHEN t3 = 0 AND least(n1, n2) <= 8 THEN least(1, 2 * tail) WHEN s > 0 THEN least(1, {_erfc("greatest(0, top - n1 * n2 / 2 - 0.5) / s / sqrt(2)")}) ELSE 1 END, 6) AS u_p, round(levene_p, 6) AS levene_p
FROM up LEFT JOIN ex USING (gfed, metric) LEFT JOIN lp USING (gfed, metric)""")
def h12_era_tests(spark, d):
    """The same tests with their probabilities, exact for small samples without ties."""
    return _R6(S.era_tests(_eras(spark, d), ["gfed"], ["days_mean", "days_median"]), "u_p", "levene_p")


_AR = f"""{Q.H}, {Q.CELLS}, ca AS (SELECT (9000 - lat_ix) // 10 AS y, lon_ix // 10 AS x, gfed, CASE WHEN lc % 3 = 0 THEN NULL ELSE (lc - 8) / 10.0::DOUBLE END AS fire, (lc % 5 - 2) / 10.0::DOUBLE AS weather,
  (2 * pi() * 6367470.0::DOUBLE / 360) ** 2 * 0.01 * cos((90 - ((9000 - lat_ix) // 10 + 0.5) * 0.1::DOUBLE) * pi() / 180) / 1e12 AS area, CASE WHEN lc % 6 = 0 THEN NULL ELSE lc % 6 END AS class FROM cells)"""


def _areas(spark, d):
    from emberline.sources import standins as V

    c = V.cells(spark, d).withColumns({"y": F.floor((9000 - F.col("lat_ix")) / 10).cast("int"), "x": F.floor(F.col("lon_ix") / 10).cast("int")})
    return c.select(
        "y", "x", "gfed", F.expr("CASE WHEN lc % 3 = 0 THEN NULL ELSE (lc - 8) / 10.0D END").alias("fire"), F.expr("(lc % 5 - 2) / 10.0D").alias("weather"),
        X.square_metres_to_mkm2(X.cell_area(G.latitude("y", 0.1), 0.1, 0.1)).alias("area"), F.expr("CASE WHEN lc % 6 = 0 THEN NULL ELSE lc % 6 END").alias("class"),
    )


_SIGN = ", ".join(f"sum(CASE WHEN {c} THEN area ELSE 0 END) AS {n}" for n, c in (("total", "TRUE"), ("positive", "tau > 0"), ("negative", "tau < 0"), ("none", "tau IS NULL OR tau = 0")))


@query(f"""WITH {_AR}, l AS (SELECT gfed, area, 'fire' AS variable, fire AS tau FROM ca UNION ALL SELECT gfed, area, 'weather', weather FROM ca),
s AS (SELECT variable, gfed, {_SIGN} FROM l GROUP BY ALL UNION ALL SELECT variable, 15, {_SIGN} FROM l GROUP BY ALL)
SELECT variable, gfed, round(total, 6) AS total, round(positive, 6) AS positive, round(negative, 6) AS negative, round("none", 6) AS "none", round(positive / total * 100, 1) AS positive_pct, round(negative / total * 100, 1) AS negative_pct, round("none" / total * 100, 1) AS none_pct FROM s""")
def d27_signed_area(spark, d):
    return _R6(A.signed_area(_areas(spark, d), ["fire", "weather"]), "total", "positive", "negative", "none")


@query(f"""WITH {_AR}, n AS (SELECT 'fire' AS variable, gfed, coalesce(CAST(class AS VARCHAR), 'no_data') AS class, sum(area) AS area FROM ca GROUP BY ALL),
f AS (SELECT k.*, coalesce(area, 0) AS area FROM (SELECT * FROM (SELECT DISTINCT variable, gfed FROM n) a, (SELECT DISTINCT class FROM n) b) k LEFT JOIN n USING (variable, gfed, class))
SELECT variable, gfed, class, round(area, 6) AS area, round(area / sum(area) OVER (PARTITION BY gfed) * 100, 2) AS pct_total, CASE WHEN class <> 'no_data' THEN round(area / nullif(sum(area) FILTER (WHERE class <> 'no_data') OVER (PARTITION BY gfed), 0) * 100, 2) END AS pct_valid FROM f""")
def d28_class_area(spark, d):
    return _R6(A.class_area(_areas(spark, d).withColumn("variable", F.lit("fire"))), "area")


@query(f"WITH {_AR} SELECT y, x, gfed, nullif(weather, 0) AS tau FROM ca WHERE gfed > 0 AND y BETWEEN 300 AND 1100 AND class IN (1, 2, 3)")
def b30_analysis_cells(spark, d):
    cells = _areas(spark, d)
    out = A.analysis_cells(cells.withColumnRenamed("weather", "tau"), cells.filter("class IN (1, 2, 3)"), ["y", "x"], 300, 1100)
    return out.select("y", "x", "gfed", "tau")
