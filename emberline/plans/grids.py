"""Queries on grids, climate, sensors and countries."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import scalars as X
from emberline.operators import climate as C
from emberline.operators import grid as G
from emberline.operators import hotspots as H
from emberline.operators import matching as M
from emberline.operators import shape
from emberline.operators import spatial as P
from emberline.plans import sql as Q
from emberline.plans.hotspots import valid
from emberline.plans.registry import query
from emberline.sources import files, rasters
from emberline.sources import standins as V

GRID = f"""{Q.CLEAN}, gr AS (SELECT year, CAST(1799 - least(floor((lat + 90) * 10), 1799) AS INT) AS y, CAST(least(floor(lon360 * 10), 3599) AS INT) AS x, CAST(count(*) AS DOUBLE) AS value FROM hc GROUP BY ALL)"""
AREA = "((2 * pi() * 6367470.0::DOUBLE / 360) ** 2 * {0} * {0} * cos((90 - (y + 0.5) * {0}) * pi() / 180))"


def _grid(spark, d):
    return G.grid_counts(H.clean(V.hotspots(spark, d)))


@query(f"WITH {GRID} SELECT * FROM gr")
def d05_grid_counts(spark, d):
    return _grid(spark, d)


@query(f"WITH {GRID} SELECT year, sum(value) AS total FROM gr GROUP BY ALL")
def d06_grid_totals(spark, d):
    return G.grid_totals(_grid(spark, d))


@query(f"""WITH {GRID}, a AS (SELECT year, y // 20 AS yy, x // 20 AS xx, sum(value) AS s, sum(value * {AREA.format('0.1::DOUBLE')}) AS w FROM gr GROUP BY ALL)
SELECT year, CAST(yy AS INT) AS y, CAST(xx AS INT) AS x, s AS total, round(s / 400, 6) AS mean, round(w / ((2 * pi() * 6367470.0::DOUBLE / 360) ** 2 * 4 * cos((90 - (yy + 0.5) * 2) * pi() / 180)), 6) AS area_mean FROM a""")
def d07_d17_coarsen(spark, d):
    """Blocks of 2 degrees: sum, mean, and mean weighted by cell areas."""
    g = _grid(spark, d)
    out = G.coarsen(g, ["year"], 20, "sum").withColumnRenamed("value", "total")
    for algo in ("mean", "area_mean"):
        out = out.join(G.coarsen(g, ["year"], 20, algo).withColumnRenamed("value", algo), ["year", "y", "x"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "area_mean")})


_DAYS = f"{Q.CLIMATE}, dy AS (SELECT dataset, date, year(date) AS year, y, x, round_even(value * 10, 0) / 10 AS value FROM cl)"


def _days(spark, d):
    return C.daily(V.climate(spark, d))


@query(f"WITH {_DAYS} SELECT dataset, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST(year AS INT) AS year, round(avg(value), 6) AS value FROM dy GROUP BY dataset, y // 2, x // 2, year")
def d08_coarsen_mean_valid(spark, d):
    return G.coarsen_mean_valid(_days(spark, d), ["dataset", "year"], 2).withColumn("value", F.round("value", 6))


_CLS = f"{Q.H}, {Q.CELLS}, k AS (SELECT (9000 - lat_ix) // 10 AS y, lon_ix // 10 AS x, gfed AS class FROM cells)"


def _classes(spark, d):
    cells = V.cells(spark, d)
    return cells.select(F.floor((9000 - F.col("lat_ix")) / 10).cast("int").alias("y"), F.floor(F.col("lon_ix") / 10).cast("int").alias("x"), F.col("gfed").alias("class"))


@query(f"""WITH {_CLS}, n AS (SELECT y // 5 AS yy, x // 5 AS xx, class, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY yy, xx) AS tot, row_number() OVER (PARTITION BY yy, xx ORDER BY n DESC, class) AS r FROM n)
SELECT CAST(yy AS INT) AS y, CAST(xx AS INT) AS x, class FROM t WHERE r = 1 AND tot / 25.0 >= 0.1""")
def d09_coarsen_mode(spark, d):
    return G.coarsen_mode(_classes(spark, d), 5)


@query(f"""WITH {_CLS}, n AS (SELECT y // 5 AS yy, x // 5 AS xx, class, count(*) AS n, min(((y % 5 - 2) * (y % 5 - 2) + (x % 5 - 2) * (x % 5 - 2)) * 100000000 + y * 10000 + x) AS near FROM k GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY yy, xx) AS tot, row_number() OVER (PARTITION BY yy, xx ORDER BY n DESC, near) AS r FROM n)
SELECT CAST(yy AS INT) AS y, CAST(xx AS INT) AS x, class FROM t WHERE r = 1 AND tot / 25.0 >= 0.1""")
def d10_coarsen_mode_centred(spark, d):
    return G.coarsen_mode(_classes(spark, d), 5, centred=True)


@query(f"WITH {GRID}, m AS (SELECT y // 20 AS y, x // 20 AS x, sum(value) / (SELECT count(DISTINCT year) FROM gr) AS mean FROM gr GROUP BY ALL) SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(mean, 6) AS mean, CAST(mean >= 1 AS INT) AS frequent FROM m WHERE mean <> 0")
def d11_mean_activity(spark, d):
    g = _grid(spark, d)
    years = g.select("year").distinct().count()
    return G.mean_activity(G.coarsen(g, ["year"], 20, "sum"), years).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {GRID}, c AS (SELECT year, CAST(y // 20 AS INT) AS y, CAST(x // 20 AS INT) AS x, sum(value) AS value FROM gr GROUP BY ALL)
SELECT year, y, x, CASE WHEN (y BETWEEN 20 AND 30 AND x BETWEEN 10 AND 60) OR (y BETWEEN 0 AND 14) THEN 0 ELSE value END AS value FROM c""")
def b29_blank_boxes(spark, d):
    c = G.coarsen(_grid(spark, d), ["year"], 20, "sum")
    return G.blank_boxes(c, [(20, 30, 10, 60), (0, 14, 0, 179)], 0.0).select("year", "y", "x", "value")


@query(f"WITH {_DAYS} SELECT dataset, y, x, min(value) AS low, max(value) AS high, round((min(value) + max(value)) / 2, 6) AS middle FROM dy GROUP BY ALL")
def d12_fire_weather_range(spark, d):
    return C.fire_weather_range(_days(spark, d)).withColumn("middle", F.round("middle", 6))


_SEASON = f"""{_DAYS}, rg AS (SELECT dataset, y, x, (min(value) + max(value)) / 2 AS middle FROM dy GROUP BY ALL),
sd AS (SELECT dataset, y, x, year, CAST(count(*) FILTER (WHERE value > middle) AS DOUBLE) AS value FROM dy JOIN rg USING (dataset, y, x) WHERE middle IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_SEASON} SELECT * FROM sd")
def d13_season_days(spark, d):
    return C.season_days(_days(spark, d))


@query(f"""WITH {_DAYS} SELECT dataset, y, x, year, CASE WHEN count(value) = count(*) THEN round(avg(value), 6) END AS mean, CASE WHEN count(value) = count(*) THEN round(quantile_cont(value, 0.5), 6) END AS median,
CASE WHEN count(value) = count(*) THEN max(value) END AS most, CASE WHEN count(value) = count(*) THEN min(value) END AS least FROM dy GROUP BY ALL""")
def d14_annual_stats(spark, d):
    return C.annual_stats(_days(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean", "median")})


FIVE = ["gfwed_merra_fwi", "gfwed_cpc_fwi", "geff_fwi", "geff_bi", "geff_fdi"]
_ENS = f"""{_SEASON}, en AS (SELECT 'all' AS dataset, year, y, x, CASE WHEN count(value) = 5 THEN avg(value) END AS value FROM sd GROUP BY ALL
UNION ALL SELECT 'geff', year, y, x, CASE WHEN count(value) = 3 THEN avg(value) END FROM sd WHERE dataset LIKE 'geff%' GROUP BY ALL)"""


def _ensembles(spark, d):
    s = C.season_days(_days(spark, d))
    return C.ensemble_mean(s, FIVE, "all").unionByName(C.ensemble_mean(s, FIVE[2:], "geff"))


@query(f"WITH {_ENS} SELECT dataset, year, y, x, round(value, 6) AS value FROM en")
def d15_ensemble_mean(spark, d):
    return _ensembles(spark, d).withColumn("value", F.round("value", 6))


@query(f"WITH {_ENS}, m AS (SELECT DISTINCT y, x FROM en WHERE dataset = 'all' AND value IS NOT NULL AND year = (SELECT min(year) FROM en WHERE dataset = 'all' AND value IS NOT NULL)) SELECT dataset, y, x, year, value FROM sd WHERE (y, x) IN (SELECT (y, x) FROM m)")
def d16_common_mask(spark, d):
    s = C.season_days(_days(spark, d))
    return G.apply_mask(s, G.common_mask(C.ensemble_mean(s, FIVE, "all")))


@query(f"""WITH {_SEASON} SELECT dataset, year, CAST(ty AS INT) AS y, CAST((tx + 30) % 60 AS INT) AS x, value FROM sd, range(40) a(ty), range(60) b(tx) WHERE floor((ty + 0.5) * 4.5 / 45) = y AND floor((tx + 0.5) * 6 / 60) = x""")
def c16_resample_nearest(spark, d):
    """A grid of 45 x 60 degrees on one of 4.5 x 6 degrees."""
    s = C.season_days(_days(spark, d))
    return G.resample_nearest(s, ["dataset", "year"], 10.0, 1.0, 60.0, 40.0, turn=True)


_WM = f"""{_SEASON}, w AS (SELECT *, {AREA.format('45.0::DOUBLE')} AS a, CAST((y * 6 + x) % 15 AS INT) AS gfed FROM sd),
wm AS (SELECT dataset, year, gfed, sum(a * value) / sum(a) AS wmean FROM w GROUP BY ALL UNION ALL SELECT dataset, year, 99, sum(a * value) / sum(a) FROM w GROUP BY ALL)"""


def _regional(spark, d):
    s = C.season_days(_days(spark, d)).withColumn("gfed", ((F.col("y") * 6 + F.col("x")) % 15).cast("int"))
    regions = G.weighted_mean(s, ["dataset", "year", "gfed"], 45.0)
    return regions.unionByName(G.weighted_mean(s, ["dataset", "year"], 45.0).withColumn("gfed", F.lit(99)))


@query(f"WITH {_WM} SELECT dataset, year, gfed, round(wmean, 6) AS wmean FROM wm")
def d18_weighted_mean(spark, d):
    """Area-weighted season length of regions and of the globe."""
    return _regional(spark, d).withColumn("wmean", F.round("wmean", 6))


@query(f"""WITH {_WM}, e AS (SELECT gfed, year, count(wmean) AS n, avg(wmean) AS mean, stddev_samp(wmean) AS std, min(wmean) AS least, max(wmean) AS most, 1.96 * stddev_samp(wmean) / sqrt(count(wmean)) AS ci95 FROM wm GROUP BY ALL),
b AS (SELECT gfed, mean AS base FROM e WHERE year = 1995)
SELECT gfed, year, n, round(mean, 6) AS mean, round(std, 6) AS std, round(least, 6) AS least, round(most, 6) AS most, round(ci95, 6) AS ci95, round(mean / base, 6) AS mean_norm, round(std / base, 6) AS std_norm, round(least / base, 6) AS least_norm, round(most / base, 6) AS most_norm, round(ci95 / base, 6) AS ci95_norm FROM e LEFT JOIN b USING (gfed)""")
def d19_ensemble_stats(spark, d):
    df = C.ensemble_stats(_regional(spark, d), ["gfed"], "wmean", 1995)
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


_MATCH = f"""{Q.SENSOR}, sb AS (SELECT *, floor(lat / 2) * 2 AS la, floor(lon180 / 2) * 2 AS lo, year(ts) AS year FROM sen),
tr AS (SELECT *, CAST(EXISTS (SELECT 1 FROM sb b WHERE b.sensor = 'test' AND b.la = a.la AND b.lo = a.lo AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 21600000000) AS INT) AS matched FROM sb a WHERE sensor = 'truth'),
te AS (SELECT *, CAST(EXISTS (SELECT 1 FROM sb b WHERE b.sensor = 'truth' AND b.la = a.la AND b.lo = a.lo AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 21600000000) AS INT) AS matched FROM sb a WHERE sensor = 'test')"""


TRUTH = "sensor = 'truth'"


def _matched(spark, d):
    return M.match_sensors(M.with_cells(V.sensor(spark, d), 2).withColumn("year", F.year("ts")), TRUTH)


@query(f"WITH {_MATCH} SELECT event_id, sensor, matched FROM tr UNION ALL SELECT event_id, sensor, matched FROM te")
def c11_match_detections(spark, d):
    return _matched(spark, d).select("event_id", "sensor", "matched")


_CELLM = f"""{_MATCH}, cm AS (SELECT coalesce(a.la, b.la) AS lat_bin, coalesce(a.lo, b.lo) AS lon_bin, coalesce(m, 0) AS tp, CAST(a.la IS NOT NULL AND m = 0 AS INT) AS fn, CAST(b.la IS NOT NULL AND coalesce(m, 0) = 0 AS INT) AS fp
FROM (SELECT la, lo, max(matched) AS m FROM tr GROUP BY ALL) a FULL JOIN (SELECT DISTINCT la, lo FROM te) b ON a.la = b.la AND a.lo = b.lo)"""


@query(f"WITH {_CELLM} SELECT * FROM cm")
def c12_match_cells(spark, d):
    return M.match_cells(_matched(spark, d), TRUTH)


_RATE = f"""{_MATCH}, er AS (SELECT a.year, a.gfed, tp, fn, fp, fn / nullif(tp + fn, 0) AS omission, fp / nullif(tp + fp, 0) AS commission FROM
(SELECT year, gfed, CAST(sum(matched) AS BIGINT) AS tp, count(*) FILTER (WHERE matched = 0) AS fn FROM tr GROUP BY ALL) a JOIN (SELECT year, gfed, count(*) FILTER (WHERE matched = 0) AS fp FROM te GROUP BY ALL) b ON a.year = b.year AND a.gfed = b.gfed)"""


@query(f"WITH {_RATE} SELECT year, gfed, tp, fn, fp, round(omission, 6) AS omission, round(commission, 6) AS commission FROM er")
def d32_g02_error_rates(spark, d):
    """Error rates of the years and regions that both sensors have."""
    return M.error_rates(_matched(spark, d), TRUTH, ["year", "gfed"]).withColumns({c: F.round(c, 6) for c in ("omission", "commission")})


@query(f"WITH {_RATE} SELECT gfed, round(avg(omission), 6) AS omission, round(avg(commission), 6) AS commission FROM er GROUP BY ALL")
def d35_mean_errors(spark, d):
    df = M.mean_errors(M.error_rates(_matched(spark, d), TRUTH, ["year", "gfed"]), ["gfed"])
    return df.withColumns({c: F.round(c, 6) for c in ("omission", "commission")})


def _polygons(spark, d):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    return V.countries(spark, d).select("admin", "adm0_a3", F.array(ring).alias("parts"))


_CTRY = f"{Q.CLEAN}, {Q.COUNTRIES}, hx AS (SELECT *, CASE WHEN lon360 >= 180 THEN lon360 - 360 ELSE lon360 END AS lon180 FROM hc), jc AS (SELECT hx.*, admin, adm0_a3 FROM hx LEFT JOIN ctry ON lon180 BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1)"


def _countries(spark, d):
    h = H.clean(V.hotspots(spark, d)).withColumn("lon180", X.lon360_to_180("lon360")).select("fn", "sat", "year", "lat", "lon180")
    return P.join_country(h, _polygons(spark, d), ["admin", "adm0_a3"])


@query(f"WITH {_CTRY} SELECT fn, lat, round(lon180, 6) AS lon180, admin, adm0_a3 FROM jc")
def c10_join_country(spark, d):
    """Detections with the country polygon that covers them."""
    return _countries(spark, d).select("fn", "lat", F.round("lon180", 6).alias("lon180"), "admin", "adm0_a3")


@query(f"""WITH {_CTRY}, n AS (SELECT admin, year, sat, count(*) AS count FROM jc WHERE admin IS NOT NULL GROUP BY ALL)
SELECT admin, year, sat, coalesce(count, 0) AS count FROM (SELECT * FROM (SELECT DISTINCT admin FROM n) a, (SELECT DISTINCT year, sat FROM n) b) k LEFT JOIN n USING (admin, year, sat)""")
def d24_country_counts(spark, d):
    return P.country_counts(_countries(spark, d).filter("admin IS NOT NULL"), ["admin"], [["year", "sat"]])


@query("SELECT year(o_orderdate) AS year, count(*) AS fires, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS size FROM orders WHERE o_totalprice >= 100000 GROUP BY ALL")
def d25_annual_records(spark, d):
    """Large records and their summed size by year."""
    o = spark.read.parquet(f"{d}/orders.parquet").filter("o_totalprice >= 100000")
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("fires"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("size"))


@query(f"WITH {Q.CLIMATE}, b AS (SELECT year(date) AS year, CAST((y * 6 + x) % 15 AS INT) AS region, sum(value) AS area FROM cl GROUP BY ALL) SELECT year, region, round(area, 4) AS area FROM b UNION ALL SELECT year, 99, round(sum(area), 4) FROM b GROUP BY ALL")
def d26_burned_area(spark, d):
    """Sums over months and cells by region and year, and the global row."""
    df = V.climate(spark, d).withColumn("year", F.year("date")).withColumn("region", ((F.col("y") * 6 + F.col("x")) % 15).cast("int"))
    b = df.groupBy("year", "region").agg(F.sum("value").alias("area"))
    return shape.with_global(b, ["year"], {"region": 99}, "area").withColumn("area", F.round("area", 4))


_JOIN = f"""{Q.VALID}, fi AS (SELECT year, count(*) AS fires FROM hv GROUP BY ALL), {Q.CLIMATE}, cy AS (SELECT year(date) AS year, round(avg(value), 6) AS weather FROM cl GROUP BY ALL)"""


@query(f"WITH {_JOIN} SELECT coalesce(fi.year, cy.year) AS year, fires, weather FROM fi FULL JOIN cy ON fi.year = cy.year")
def c07_c15_join_series(spark, d):
    """Full join of a fire and a climate series."""
    fires = valid(spark, d).groupBy("year").agg(F.count("*").alias("fires"))
    weather = V.climate(spark, d).groupBy(F.year("date").alias("year")).agg(F.round(F.avg("value"), 6).alias("weather"))
    return shape.assemble([fires, weather], ["year"])


@query(f"""WITH {Q.ANNUAL}, o AS (SELECT year(o_orderdate) AS year, count(*) AS records FROM orders GROUP BY ALL) SELECT gfed_name, ac.year, count, records, round(count / avg(count) OVER (PARTITION BY gfed_name), 6) AS share FROM ac JOIN o ON ac.year = o.year""")
def c08_c14_join_records(spark, d):
    """Fire counts with other records of the year, and each count against its group's mean."""
    records = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("records"))
    df = H.annual_counts(valid(spark, d)).join(records, "year").select("gfed_name", "year", "count", "records")
    return shape.normalise_to_mean(df, ["gfed_name"], "count").withColumn("share", F.round("count_norm", 6)).drop("count_norm")


@query(f"""WITH {Q.ANNUAL}, ov AS (SELECT sat, year, round(avg(hour), 6) AS overpass FROM hc GROUP BY ALL)
SELECT ac.sat, ac.year, ac.gfed_name, count, overpass FROM ac LEFT JOIN ov ON ac.sat = ov.sat AND ac.year = ov.year WHERE NOT (ac.sat = 'NN' AND ac.year BETWEEN 2010 AND 2012)""")
def c17_join_overpass(spark, d):
    """Counts with the mean hour of a platform's year, without a few satellite-years."""
    hours = H.clean(V.hotspots(spark, d)).groupBy("sat", "year").agg(F.round(F.avg("hour"), 6).alias("overpass"))
    counts = H.annual_counts(valid(spark, d)).filter("NOT (sat = 'NN' AND year BETWEEN 2010 AND 2012)")
    return counts.join(hours, ["sat", "year"], "left").select("sat", "year", "gfed_name", "count", "overpass")


@query("""WITH w AS (SELECT year(o_orderdate) AS year, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL) SELECT year, p AS country, n AS fires FROM w UNION ALL SELECT year, 'all', CAST(sum(n) AS BIGINT) FROM w GROUP BY ALL""")
def g01_g03_g04_unpivot(spark, d):
    """One column for each country made long, and the union with the totals."""
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("year", F.year("o_orderdate"))
    names = [r[0] for r in o.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    wide = o.groupBy("year").pivot("o_orderpriority", names).count()
    long = wide.unpivot("year", names, "country", "fires")
    total = o.groupBy("year").agg(F.count("*").alias("fires")).withColumn("country", F.lit("all"))
    return long.unionByName(total).dropna(subset=["fires"])


@query(f"WITH {GRID} SELECT year, y, x, value FROM gr")
def a06_grid_stack(spark, d):
    """A grid stack written by data set and year, and read back."""
    path = files.new_path(spark, "grid")
    files.write_grid(_grid(spark, d).withColumn("dataset", F.lit("hotspots")), path)
    return spark.read.parquet(path).select(F.col("year").cast("int").alias("year"), "y", "x", "value")


_RASTER = f"""{GRID}, r1 AS (SELECT year, CAST(floor(y / 10) AS INT) AS y, CAST((floor(x / 10) + 180) % 360 AS INT) AS x, sum(value) AS value FROM gr GROUP BY ALL)"""


@query(f"""WITH {_RASTER} SELECT year, y, x, value, 90 - (y + 0.5::DOUBLE) AS lat, x - 179.5::DOUBLE AS lon, CAST(round_even((90 - (y + 0.5::DOUBLE)) * 100, 0) AS INT) AS lat_ix, CAST(round_even((x - 179.5::DOUBLE) * 100, 0) AS INT) AS lon_ix FROM r1""")
def a04_raster_cells(spark, d):
    """Counts by year and degree written as arrays, and read back by strips as cells from 180 west."""
    path = files.new_path(spark, "rasters")
    counts = G.coarsen(_grid(spark, d), ["year"], 10, "sum").withColumn("name", F.concat(F.lit("counts-"), F.col("year").cast("string")))
    rasters.write_rasters(counts, path, 180, 360)
    cells = rasters.read_rasters(spark, path, roll=True, strip_bytes=1 << 17)
    year = F.regexp_extract("path", r"counts-(\d+)\.npy$", 1).cast("int")
    return cells.select(year.alias("year"), "y", "x", "value", "lat", "lon", "lat_ix", "lon_ix")


@query(f"WITH {Q.H} SELECT fn, lat, lon, year, month, day, hour, b1, b4, satza FROM h")
def a01_a05_hotspot_csv(spark, d):
    """Detections through gzip CSV files, picked by their names among others and read with a fixed schema."""
    path = files.new_path(spark, "csv")
    cols = ["fn", "lat", "lon", "year", "month", "day", "hour", "b1", "b2", "b3", "b4", "b5", "b34", "b45", "satza"]
    h = V.hotspots(spark, d).withColumns({"b34": F.lit(0.0), "b45": F.lit(0.0)}).select(cols)
    files.write_csv(h, f"{path}/pixels")
    files.write_table(V.points(spark, d), f"{path}/points")
    return files.read_hotspots(spark, path, "*.csv.gz").select("fn", "lat", "lon", "year", "month", "day", "hour", "b1", "b4", "satza")


@query(f"WITH {Q.H} SELECT substr(fn, 1, 2) AS platform, year, count(*) AS n FROM h GROUP BY ALL")
def a07_a08_compact_orbits(spark, d):
    """Many CSV files as one table by platform and year."""
    path = files.new_path(spark, "orbits")
    cols = ["fn", "lat", "lon", "year", "month", "day", "hour", "b1", "b2", "b3", "b4", "b5", "b34", "b45", "satza"]
    h = V.hotspots(spark, d).withColumns({"b34": F.lit(0.0), "b45": F.lit(0.0)}).select(cols)
    files.write_csv(h, path)
    return files.compact_orbits(spark, path, f"{path}-all").groupBy("platform", "year").agg(F.count("*").alias("n"))


@query(f"WITH {Q.POINTS} SELECT lat, lon180 FROM pts")
def a03_a10_point_list(spark, d):
    """A table written as one CSV file, read back as a point list."""
    path = files.new_path(spark, "points")
    files.write_table(V.points(spark, d).select(F.col("lat").alias("Latitude"), F.col("lon180").alias("Longitude"), "kind"), path)
    return files.read_points(spark, path, "Latitude", "Longitude")
