"""Queries on compositing periods, profiles and seasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import scalars as X
from emberline.operators import season as N
from emberline.operators import shape
from emberline.operators.calendar import join_periods, month_index
from emberline.plans import sql as Q
from emberline.plans.hotspots import valid
from emberline.plans.registry import query

R = ["gfed", "gfed_name"]

PERIODS = f"""{Q.VALID},
cal AS (SELECT make_date(y, 1, 1) + CAST(n AS INT) AS d, n // 8 + 1 AS comp_period FROM range(1979, 2019) a(y), range(368) b(n)),
pj AS (SELECT hv.*, CAST(comp_period AS INT) AS comp_period FROM hv JOIN cal ON date_lst = d),
pc AS (SELECT sat_yr, sat, year, comp_period, gfed, gfed_name, count(*) AS count FROM pj GROUP BY ALL
       UNION ALL SELECT sat_yr, sat, year, comp_period, 99, 'Global', count(*) FROM pj GROUP BY ALL),
pf AS (SELECT k.*, coalesce(count, 0) AS count FROM (SELECT * FROM (SELECT DISTINCT sat_yr, sat, year FROM pc) a, (SELECT DISTINCT comp_period FROM pc) b, (SELECT DISTINCT gfed, gfed_name FROM pc) c) k
       LEFT JOIN pc USING (sat_yr, sat, year, comp_period, gfed, gfed_name))"""
PROFILE = f"""{PERIODS},
pr AS (SELECT gfed, gfed_name, comp_period, avg(count) AS mean, quantile_cont(count, 0.5) AS median FROM pf GROUP BY ALL)"""
SEASON = f"""{PROFILE},
fm AS (SELECT gfed, CASE WHEN gfed_name = 'EQAS' THEN 16 ELSE arg_min(comp_period, mean * 1000 + comp_period / 1000.0) END AS first FROM pr GROUP BY gfed, gfed_name),
fo AS (SELECT pr.*, (comp_period - first + 46) % 46 AS period_rank FROM pr JOIN fm USING (gfed)),
fs AS (SELECT *, sum(mean) OVER (PARTITION BY gfed ORDER BY period_rank) / sum(mean) OVER (PARTITION BY gfed) AS prop FROM fo)"""


def _counts(spark, d):
    return N.period_counts(valid(spark, d))


@query(f"WITH {PERIODS} SELECT sat_yr, gfed, comp_period, count(*) AS n FROM pj GROUP BY ALL")
def c04_join_periods(spark, d):
    """Hotspots of each period; early January counts in two."""
    return join_periods(valid(spark, d)).groupBy("sat_yr", "gfed", "comp_period").agg(F.count("*").alias("n"))


@query(f"WITH {PERIODS} SELECT sat_yr, sat, year, comp_period, gfed, gfed_name, count FROM pf")
def c09_d03_period_counts(spark, d):
    return _counts(spark, d)


@query(f"WITH {PROFILE} SELECT gfed, gfed_name, comp_period, round(mean, 6) AS mean, round(median, 6) AS median FROM pr")
def d04_period_profile(spark, d):
    return N.period_profile(_counts(spark, d), R).withColumns({c: F.round(c, 6) for c in ("mean", "median")})


_ERA = f"""{PERIODS}, pe AS (SELECT *, CASE WHEN year < 2001 THEN 1 ELSE 2 END AS era FROM pf),
pp AS (SELECT gfed, gfed_name, era, comp_period, count(*) AS n, avg(count) AS mean, stddev_samp(count) AS std, 1.96 * stddev_samp(count) / sqrt(count(*)) AS ci95 FROM pe GROUP BY ALL)"""


@query(f"WITH {_ERA} SELECT gfed, gfed_name, era, comp_period, n, round(mean, 6) AS mean, round(std, 6) AS std, round(ci95, 6) AS ci95 FROM pp")
def d20_profile_by_era(spark, d):
    df = N.profile_by_era(_counts(spark, d).withColumn("era", X.era("year")), [*R, "era"])
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std", "ci95")})


_SMOOTH = "avg({0}) OVER (PARTITION BY {1} ORDER BY comp_period ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"


def _padded(table: str, keys: str, cols: list[str]) -> str:
    smooth = ", ".join(f"round({_SMOOTH.format(c, keys)}, 6) AS {c}_smooth" for c in cols)
    return f"""pad AS (SELECT * FROM {table} UNION ALL SELECT * REPLACE (CASE WHEN comp_period = 1 THEN 47 ELSE 0 END AS comp_period) FROM {table} WHERE comp_period IN (1, 46)),
sm AS (SELECT {keys}, comp_period, {smooth} FROM pad) SELECT * FROM sm WHERE comp_period BETWEEN 1 AND 46"""


@query(f"WITH {PROFILE}, {_padded('pr', 'gfed, gfed_name', ['mean', 'median'])}")
def e01_smooth_profile(spark, d):
    df = N.smooth_circular(N.period_profile(_counts(spark, d), R), R, ["mean", "median"])
    return df.select(*R, "comp_period", *[F.round(f"{c}_smooth", 6).alias(f"{c}_smooth") for c in ("mean", "median")])


@query(f"WITH {_ERA}, {_padded('pp', 'gfed, gfed_name, era', ['mean', 'std', 'ci95'])}")
def e02_smooth_profile_by_era(spark, d):
    keys = [*R, "era"]
    df = N.profile_by_era(_counts(spark, d).withColumn("era", X.era("year")), keys)
    df = N.smooth_circular(df, keys, ["mean", "std", "ci95"])
    return df.select(*keys, "comp_period", *[F.round(f"{c}_smooth", 6).alias(f"{c}_smooth") for c in ("mean", "std", "ci95")])


def _season(spark, d):
    profile = N.period_profile(_counts(spark, d), R)
    return N.fire_season(N.fire_year_order(profile, R, "mean", {"EQAS": 16}), R, "mean")


@query(f"WITH {SEASON} SELECT gfed, gfed_name, comp_period, period_rank, round(prop, 6) AS prop, CAST(round(prop, 9) BETWEEN 0.1 AND 0.9 AS INT) AS season FROM fs")
def e03_e04_fire_season(spark, d):
    """Fire-year order, cumulative share and season flag."""
    return _season(spark, d).select(*R, "comp_period", "period_rank", F.round("prop", 6).alias("prop"), "season")


@query(f"""WITH {SEASON}, fl AS (SELECT *, round(prop, 9) BETWEEN 0.1 AND 0.9 AS s FROM fs)
SELECT gfed, gfed_name, coalesce(arg_min(comp_period, period_rank) FILTER (WHERE s), -9999) AS season_start, coalesce(arg_max(comp_period, period_rank) FILTER (WHERE s), -9999) AS season_end,
  arg_min(comp_period, mean * 1000 + period_rank / 1000.0) AS year_min, arg_min(comp_period, -mean * 1000 + period_rank / 1000.0) AS year_max, count(*) FILTER (WHERE s) AS season_len FROM fl GROUP BY ALL""")
def e05_season_summary(spark, d):
    return N.season_summary(_season(spark, d), R, "mean")


@query(f"WITH {PERIODS} SELECT gfed, gfed_name, year, max(count) AS peak FROM pf GROUP BY ALL")
def d21_peak_activity(spark, d):
    return N.peak_activity(_counts(spark, d), R)


_LENGTH = f"""{PERIODS}, av AS (SELECT gfed, avg(count) AS m, quantile_cont(count, 0.5) AS md FROM pf GROUP BY ALL),
sl AS (SELECT gfed, gfed_name, year, count(*) FILTER (WHERE count > m) * 8 AS days_mean, count(*) FILTER (WHERE count > md) * 8 AS days_median FROM pf JOIN av USING (gfed) GROUP BY ALL)"""


@query(f"WITH {_LENGTH} SELECT * FROM sl")
def d22_season_length(spark, d):
    return N.season_length(_counts(spark, d), R)


_DESC = f"""{_LENGTH}, ds AS (SELECT gfed, gfed_name, CASE WHEN year < 2001 THEN 1 ELSE 2 END AS era, count(*) AS n, avg(days_mean) AS mean, stddev_samp(days_mean) AS std, min(days_mean) AS least,
  quantile_cont(days_mean, 0.25) AS q25, quantile_cont(days_mean, 0.5) AS q50, quantile_cont(days_mean, 0.75) AS q75, max(days_mean) AS most FROM sl GROUP BY ALL)"""


def _described(spark, d):
    return N.describe_by(N.season_length(_counts(spark, d), R).withColumn("era", X.era("year")), [*R, "era"], "days_mean")


@query(f"WITH {_DESC} SELECT gfed, gfed_name, era, n, round(mean, 6) AS mean, round(std, 6) AS std, least, q25, q50, q75, most FROM ds")
def d23_describe(spark, d):
    return _described(spark, d).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(f"""WITH {_DESC}, w AS (SELECT gfed, gfed_name, max(q50) FILTER (WHERE era = 1) AS a, max(q50) FILTER (WHERE era = 2) AS b, max(q75 - q25) FILTER (WHERE era = 1) AS c, max(q75 - q25) FILTER (WHERE era = 2) AS d FROM ds GROUP BY ALL)
SELECT gfed, gfed_name, round_even((b - a) / nullif(a, 0) * 100, 0) AS median_change, round_even((d - c) / nullif(c, 0) * 100, 0) AS iqr_change FROM w""")
def d34_g05_era_change(spark, d):
    """Era columns by pivot, and the change between them."""
    return N.era_change(_described(spark, d), R)


_LAT = f"""{Q.VALID}, lc AS (SELECT CAST(round_even(lat, 0) AS INT) AS lat_bin, year, month, count(*) AS count FROM hv GROUP BY ALL),
lf AS (SELECT k.*, coalesce(count, 0) AS count FROM (SELECT * FROM (SELECT DISTINCT lat_bin FROM lc) a, (SELECT DISTINCT year FROM lc) b, (SELECT DISTINCT month FROM lc) c) k LEFT JOIN lc USING (lat_bin, year, month))"""


@query(f"WITH {_LAT} SELECT * FROM lf")
def d30_lat_month_counts(spark, d):
    return N.lat_month_counts(valid(spark, d))


@query(f"""WITH {_LAT}, st AS (SELECT lat_bin, month, avg(count) AS m, stddev_samp(count) AS s FROM lf WHERE year > 2000 GROUP BY ALL)
SELECT lat_bin, year, month, count, round((count - m) / nullif(s, 0), 6) AS z, (year - 1986) * 12 + month - 1 AS month_index FROM lf LEFT JOIN st USING (lat_bin, month)""")
def d31_lat_month_anomaly(spark, d):
    df = N.lat_month_anomaly(N.lat_month_counts(valid(spark, d)))
    return df.withColumn("z", F.round("z", 6)).withColumn("month_index", month_index("year", "month"))


_SERIES = f"{Q.ANNUAL}, rs AS (SELECT gfed, gfed_name, year, count FROM ac)"


def _series(spark, d):
    from emberline.operators.hotspots import annual_counts

    return annual_counts(valid(spark, d)).select("gfed", "gfed_name", "year", "count")


@query(f"""WITH {_SERIES} SELECT *, round(count / max(CASE WHEN year = 2003 THEN count END) OVER (PARTITION BY gfed), 6) AS to_2003, round(count / avg(count) OVER (PARTITION BY gfed), 6) AS to_mean,
  round(count / first_value(count) OVER (PARTITION BY gfed ORDER BY year), 6) AS to_first FROM rs""")
def c05_c06_e07_normalise(spark, d):
    """A series relative to one year, to its mean, and to its first value."""
    s = _series(spark, d)
    a = shape.normalise_to_year(s, ["gfed"], "count", 2003).withColumnRenamed("count_norm", "to_2003")
    b = shape.normalise_to_mean(a, ["gfed"], "count").withColumnRenamed("count_norm", "to_mean")
    c = shape.norm_to_first(b, ["gfed"], "year", "count").withColumnRenamed("count_norm", "to_first")
    return c.withColumns({n: F.round(n, 6) for n in ("to_2003", "to_mean", "to_first")})


@query(f"""WITH {_SERIES}, w AS (SELECT *, lag(year) OVER p AS ly, lag(count) OVER p AS lc, row_number() OVER (PARTITION BY gfed ORDER BY count DESC, year) - 1 AS rank FROM rs WINDOW p AS (PARTITION BY gfed ORDER BY year))
SELECT gfed, gfed_name, year, count, count - lc AS count_diff, CASE WHEN year - ly = 1 THEN count - lc END AS count_diff_gap, rank FROM w""")
def e06_e08_difference_rank(spark, d):
    """Differences from row to row and from year to year, and the rank within a region."""
    s = _series(spark, d)
    gap = shape.first_diff(s, ["gfed"], "year", "count", True).withColumnRenamed("count_diff", "count_diff_gap")
    return shape.add_rank(shape.first_diff(gap, ["gfed"], "year", "count"), ["gfed"], [F.desc("count"), "year"])


@query(f"""WITH {_SERIES} SELECT gfed, gfed_name, arg_max(year, count * 10000 - year) AS most_year, arg_min(year, count * 10000 + year) AS least_year, min(year) AS first_year, max(year) AS last_year FROM rs GROUP BY ALL ORDER BY gfed""")
def f01_f02_first_last(spark, d):
    """Years of most and least fires and of the ends of a series, sorted by region."""
    df = _series(spark, d).groupBy("gfed", "gfed_name").agg(
        F.max_by("year", F.struct("count", -F.col("year"))).alias("most_year"), F.min_by("year", F.struct("count", "year")).alias("least_year"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )
    return df.orderBy("gfed")
