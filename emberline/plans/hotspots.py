"""Queries on detections: scalar functions, masks, regions, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import scalars as X
from emberline.operators import hotspots as H
from emberline.operators import shape
from emberline.plans import sql as Q
from emberline.plans.registry import query
from emberline.sources import standins as V


def solar(spark: SparkSession, d: str) -> DataFrame:
    return H.add_solar_time(H.clean(V.hotspots(spark, d)))


def masked(spark: SparkSession, d: str) -> DataFrame:
    return H.mask(V.hotspots(spark, d), V.points(spark, d), V.cells(spark, d))


def valid(spark: SparkSession, d: str) -> DataFrame:
    return H.valid_satellites(masked(spark, d))


def _seconds(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(f"WITH {Q.ANNUAL} SELECT * FROM ac")
def d01_annual_counts(spark, d):
    """Masked night hotspots by satellite-year and region, with the global row."""
    return H.annual_counts(valid(spark, d))


@query(f"WITH {Q.H} SELECT fn, year, month, day, hour, lat, lon, b1, b4, satza FROM h WHERE substr(fn, 1, 2) IN ('NF', 'NL', 'NP')")
def a02_filter_platforms(spark, d):
    from emberline.sources.files import filter_platforms

    df = V.hotspots(spark, d).withColumn("sat", F.substring("fn", 1, 2))
    return filter_platforms(df, ["NF", "NL", "NP"]).select("fn", "year", "month", "day", "hour", "lat", "lon", "b1", "b4", "satza")


@query(f"WITH {Q.CLEAN} SELECT * REPLACE (round(b34, 6) AS b34, round(b45, 6) AS b45) FROM hc")
def b01_b02_b03_clean(spark, d):
    """Bad values to null, b3 > 285, the public columns."""
    return H.clean(V.hotspots(spark, d)).withColumns({"b34": F.round("b34", 6), "b45": F.round("b45", 6)})


@query(f"""WITH {Q.SOLAR} SELECT fn, lat, lon360, round(lon180, 6) AS lon180, round(CASE WHEN lon180 < 0 THEN lon180 + 360 ELSE lon180 END, 6) AS back360,
  strftime(dt_utc, '%Y-%m-%d %H:%M:%S') AS dt_utc, strftime(dt_lst, '%Y-%m-%d %H:%M:%S') AS dt_lst FROM hl""")
def b04_b05_b07_solar_time(spark, d):
    """Both longitudes, UTC and local solar time."""
    return solar(spark, d).select(
        "fn", "lat", "lon360", F.round("lon180", 6).alias("lon180"), F.round(X.lon180_to_360("lon180"), 6).alias("back360"),
        _seconds("dt_utc").alias("dt_utc"), _seconds("dt_lst").alias("dt_lst"),
    )


@query(f"""WITH {Q.SENSOR} SELECT event_id, strftime(strptime(strftime(ts, '%Y-%m-%d') || ' ' || lpad(CAST(CAST(hour(ts) * 100 + minute(ts) AS INT) AS VARCHAR), 4, '0'), '%Y-%m-%d %H%M'), '%Y-%m-%d %H:%M:%S') AS dt_utc FROM sen""")
def b06_utc_from_acquisition(spark, d):
    df = V.sensor(spark, d).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("acq_date"), (F.hour("ts") * 100 + F.minute("ts")).alias("acq_time"))
    return df.select("event_id", _seconds_col(X.utc_from_acquisition("acq_date", "acq_time")).alias("dt_utc"))


def _seconds_col(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(f"""WITH {Q.KEYED} SELECT fn, lat, lon360, strftime(date_lst, '%Y-%m-%d') AS date_lst, CAST(year AS INT) AS year, CAST(month AS INT) AS month, CAST(doy AS INT) AS doy, CAST(hour_lst AS INT) AS hour_lst,
  lat_x10_int, lon180_x10_int, lat_ix, lon_ix FROM hk""")
def b08_b09_b11_b12_night_keys(spark, d):
    """Night detections with the parts of the solar date and both kinds of cell keys."""
    night = solar(spark, d).filter(X.is_night("dt_lst"))
    out = H.add_cell_keys(H.add_solar_parts(night)).withColumn("date_lst", F.date_format("date_lst", "yyyy-MM-dd"))
    return out.select("fn", "lat", "lon360", "date_lst", "year", "month", "doy", "hour_lst", "lat_x10_int", "lon180_x10_int", "lat_ix", "lon_ix")


@query(f"WITH {Q.VALID} SELECT sat_yr, sat, year, count(*) AS n FROM hv GROUP BY ALL")
def b10_satellite_years(spark, d):
    return valid(spark, d).groupBy("sat_yr", "sat", "year").agg(F.count("*").alias("n"))


@query(f"WITH {Q.POINTS} SELECT DISTINCT CAST(round_even(round_even(lat * 10, 0) / 10 * 10, 0) AS INT) AS lat_x10_int, CAST(round_even(round_even(lon180 * 10, 0) / 10 * 10, 0) AS INT) AS lon180_x10_int FROM pts")
def b13_point_keys(spark, d):
    return H.point_keys(V.points(spark, d))


@query(f"WITH {Q.CLEAN} SELECT fn, lat, lon360 FROM hc WHERE lat <= 55 AND lat > -20 AND year > 1995")
def b14_b28_record_filters(spark, d):
    return H.clean(V.hotspots(spark, d)).filter("lat <= 55 AND lat > -20 AND year > 1995").select("fn", "lat", "lon360")


@query(f"WITH {Q.H}, {Q.CELLS} SELECT lat_ix, lon_ix, gfed, lc FROM cells WHERE lc NOT IN (0, 13, 15, 16, 17)")
def b15_burnable(spark, d):
    return H.burnable(V.cells(spark, d)).select("lat_ix", "lon_ix", "gfed", "lc")


@query(f"WITH {Q.H}, {Q.CELLS}, c AS (SELECT DISTINCT gfed FROM cells) SELECT gfed, {Q.NAME} AS gfed_name, CASE WHEN {Q.NAME} = 'SOAS' THEN 'SOAS' ELSE {Q.NAME} END AS mended FROM c")
def b16_region_names(spark, d):
    df = V.cells(spark, d).select("gfed").distinct().withColumn("gfed_name", X.region_name("gfed"))
    spelt = F.when(F.col("gfed_name") == "SOAS", "SEAS").otherwise(F.col("gfed_name"))
    return df.withColumn("mended", X.mend_region_label(spelt))


@query(f"WITH {Q.CLEAN} SELECT CASE WHEN lat > -20 AND lat < 20 THEN 'Tropics' WHEN lat > 50 THEN 'Boreal' ELSE 'Temperate' END AS biome, CASE WHEN year < 2001 THEN 1 ELSE 2 END AS era, count(*) AS n FROM hc GROUP BY ALL")
def b17_b22_biome_era(spark, d):
    df = H.clean(V.hotspots(spark, d)).select(X.biome("lat").alias("biome"), X.era("year").alias("era"))
    return df.groupBy("biome", "era").agg(F.count("*").alias("n"))


@query(f"""WITH {Q.H} SELECT DISTINCT fn, split_part(fn, '.', 1) AS sat, split_part(fn, '.', 2) AS doy, split_part(fn, '.', 3) AS "start", split_part(fn, '.', 4) AS "end", split_part(fn, '.', 5) AS block,
  split_part(fn, '.', 6) AS source, CAST(right(split_part(fn, '.', 2), 3) AS INT) AS day_number,
  strftime(make_date(year, month, day), '%Y-%m-%d') || ' 00:00:00' AS first_time, strftime(make_date(year, month, day), '%Y-%m-%d') || ' 01:30:00' AS last_time FROM h""")
def b18_b19_orbit_names(spark, d):
    """Parts of a file name, and the time range that it states."""
    df = V.hotspots(spark, d).select("fn").distinct()
    times = X.orbit_time_range("fn")
    return df.select("fn", X.orbit_name("fn").alias("p"), _seconds_col(times["start"]).alias("first_time"), _seconds_col(times["end"]).alias("last_time")).select("fn", "p.*", "first_time", "last_time")


@query(f"WITH {Q.SENSOR} SELECT event_id, CASE WHEN hour(ts) < 6 THEN 'AM' ELSE 'PM' END AS period FROM sen WHERE sensor = 'test' AND event_id % 100 >= 30")
def b20_product_filters(spark, d):
    df = V.sensor(spark, d).filter("sensor = 'test' AND event_id % 100 >= 30")
    return df.select("event_id", F.when(F.hour("ts") < 6, "AM").otherwise("PM").alias("period"))


@query(f"WITH {Q.CLIMATE} SELECT dataset, strftime(date, '%Y-%m-%d') AS date, y, x, round_even(value * 10, 0) / 10 AS value, CASE WHEN dataset LIKE '%geff%' THEN 'ERA5' ELSE 'MERRA2' END AS reanalysis FROM cl")
def b21_b23_round_reanalysis(spark, d):
    return V.climate(spark, d).select("dataset", F.date_format("date", "yyyy-MM-dd").alias("date"), "y", "x", X.round_tenth("value").alias("value"), X.reanalysis("dataset").alias("reanalysis"))


@query(f"WITH {Q.SENSOR} SELECT event_id, floor(lat / 2) * 2 AS lat_bin, floor(lon180 / 2) * 2 AS lon_bin, round_even(lat / 2, 0) * 2 AS lat_near FROM sen")
def b24_grid_bins(spark, d):
    return V.sensor(spark, d).select(
        "event_id", X.grid_bin("lat", 2).alias("lat_bin"), X.grid_bin("lon180", 2).alias("lon_bin"), X.grid_bin("lat", 2, "round").alias("lat_near")
    )


@query("""SELECT o_orderkey, CAST(round_even(CAST(o_totalprice AS DOUBLE) * 0.404686::DOUBLE, 0) AS BIGINT) AS hectares, round(CAST(o_totalprice AS DOUBLE) * 1000, 3) AS pascal,
  round(CAST(o_totalprice AS DOUBLE) / 1e6 / 1e6, 9) AS mkm2, o_orderkey % 46 * 8 AS days FROM orders""")
def b25_units(spark, d):
    df = spark.read.parquet(f"{d}/orders.parquet").withColumn("v", F.col("o_totalprice").cast("double"))
    return df.select(
        "o_orderkey", X.acres_to_hectares("v").alias("hectares"), F.round(X.kpa_to_pa("v"), 3).alias("pascal"),
        F.round(X.square_metres_to_mkm2("v"), 9).alias("mkm2"), X.periods_to_days(F.col("o_orderkey") % 46).alias("days"),
    )


@query("""WITH t AS (SELECT o_orderkey, (o_orderkey * 7 % 2000 - 1000) / 1000.0::DOUBLE AS tau, (o_orderkey * 13 % 4001) / 20000.0::DOUBLE AS p FROM orders)
SELECT o_orderkey, CASE WHEN p < 0.1 THEN printf('%.2f', tau) || ' (' || CASE WHEN p < 0.001 THEN '< 0.001' ELSE printf('%.3f', p) END
  || CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END || ')' ELSE 'NS' END AS tau_cell FROM t WHERE o_orderkey * 7 % 2000 % 10 <> 5 AND o_orderkey * 13 % 4001 % 20 <> 10""")
def b26_format_trends(spark, d):
    """Text cells of a trend table; rows that would round on a tie are left out of the comparison."""
    o = spark.read.parquet(f"{d}/orders.parquet").filter("o_orderkey * 7 % 2000 % 10 <> 5 AND o_orderkey * 13 % 4001 % 20 <> 10")
    df = o.select("o_orderkey", F.expr("(o_orderkey * 7 % 2000 - 1000) / 1000.0D").alias("tau"), F.expr("(o_orderkey * 13 % 4001) / 20000.0D").alias("p"))
    return df.select("o_orderkey", X.tau_cell("tau", "p").alias("tau_cell"))


@query(f"WITH {Q.CLIMATE} SELECT dataset, strftime(date, '%Y-%m-%d') AS date, y, x, value FROM cl WHERE value IS NOT NULL")
def b27_drop_missing(spark, d):
    return V.climate(spark, d).na.drop(subset=["value"]).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


_OUT = "fn, lat, lon360, strftime(dt_utc, '%Y-%m-%d %H:%M:%S') AS dt_utc"


def _out(df: DataFrame) -> DataFrame:
    return df.select("fn", "lat", "lon360", _seconds("dt_utc").alias("dt_utc"))


def _keyed(spark, d):
    return H.add_cell_keys(H.add_solar_parts(solar(spark, d).filter(X.is_night("dt_lst"))))


@query(f"""WITH {Q.KEYED}, {Q.POINTS}, pk AS (SELECT DISTINCT CAST(round_even(round_even(lat * 10, 0) / 10 * 10, 0) AS INT) AS a, CAST(round_even(round_even(lon180 * 10, 0) / 10 * 10, 0) AS INT) AS b FROM pts)
SELECT {_OUT} FROM hk WHERE NOT EXISTS (SELECT 1 FROM pk WHERE a = lat_x10_int AND b = lon180_x10_int)""")
def c01_mask_points(spark, d):
    return _out(H.mask_points(_keyed(spark, d), V.points(spark, d)))


@query(f"WITH {Q.KEYED}, {Q.CELLS} SELECT {_OUT} FROM hk WHERE EXISTS (SELECT 1 FROM cells c WHERE c.lat_ix = hk.lat_ix AND c.lon_ix = hk.lon_ix AND lc NOT IN (0, 13, 15, 16, 17))")
def c02_mask_landcover(spark, d):
    return _out(H.mask_landcover(_keyed(spark, d), V.cells(spark, d)))


@query(f"WITH {Q.KEYED}, {Q.CELLS} SELECT {_OUT}, gfed, {Q.NAME} AS gfed_name FROM hk JOIN cells USING (lat_ix, lon_ix)")
def c03_assign_region(spark, d):
    df = H.assign_region(_keyed(spark, d), V.cells(spark, d))
    return df.select("fn", "lat", "lon360", _seconds("dt_utc").alias("dt_utc"), "gfed", "gfed_name")


@query(f"""WITH {Q.VALID}, b AS (SELECT sat_yr, sat, year, CASE WHEN lat > -20 AND lat < 20 THEN 'Tropics' WHEN lat > 50 THEN 'Boreal' ELSE 'Temperate' END AS biome, count(*) AS count FROM hv GROUP BY ALL),
g AS (SELECT * FROM b UNION ALL SELECT sat_yr, sat, year, 'Global', CAST(sum(count) AS BIGINT) FROM b GROUP BY ALL)
SELECT *, round(count / max(CASE WHEN year = 1986 THEN count END) OVER (PARTITION BY biome), 6) AS count_norm FROM g""")
def d02_biome_counts(spark, d):
    return H.biome_counts(valid(spark, d)).withColumn("count_norm", F.round("count_norm", 6))


@query(f"""WITH {Q.H}, hh AS (SELECT * FROM h UNION ALL SELECT * REPLACE (replace(fn, '.B1.', '.B2.') AS fn) FROM h WHERE day % 5 = 0)
SELECT * FROM hh QUALIFY row_number() OVER (PARTITION BY lat, lon, satza, year, month, day, hour ORDER BY fn, b1, b2, b3, b4, b5) = 1""")
def e09_dedup_orbits(spark, d):
    """Detections of overlapping orbits count once."""
    h = V.hotspots(spark, d)
    both = h.unionByName(h.filter("day % 5 = 0").withColumn("fn", F.replace("fn", F.lit(".B1."), F.lit(".B2."))))
    both = both.withColumnRenamed("lon", "lon360").withColumn("dt_utc", X.utc_from_parts("year", "month", "day", "hour"))
    return H.dedup(both).drop("dt_utc").withColumnRenamed("lon360", "lon")


@query(f"""WITH {Q.CLEAN} SELECT fn, lat, lon360, round(abs(lat - 10.05::DOUBLE), 6) AS away FROM hc WHERE lat BETWEEN -19.95 AND 40.05 AND lon360 BETWEEN 50 AND 170
QUALIFY rank() OVER (PARTITION BY fn ORDER BY abs(lat - 10.05::DOUBLE)) = 1""")
def e10_nearest_pixel(spark, d):
    from emberline.operators.scenes import nearest_pixel

    df = nearest_pixel(H.clean(V.hotspots(spark, d)), 10.05, 110.0, 30.0, 60.0)
    return df.select("fn", "lat", "lon360", F.round(F.abs(F.col("lat") - 10.05), 6).alias("away"))


@query(f"WITH {Q.VALID} SELECT DISTINCT sat, sat_yr, year FROM hv ORDER BY ALL")
def f03_distinct_satellite_years(spark, d):
    return valid(spark, d).select("sat", "sat_yr", "year").distinct().orderBy("sat", "sat_yr", "year")
