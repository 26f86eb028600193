"""Fire and climate tables derived from the general test tables, in SQL that Spark and DuckDB read alike.

The test tables hold no fire data; each view maps their keys to detections, points, cells, daily grids, a second
sensor, image pixels and country boxes by integer arithmetic, so its size follows the table it comes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HOTSPOTS = """
SELECT concat(sat, '.D', lpad(CAST(yr % 100 AS STRING), 2, '0'), lpad(CAST(doy AS STRING), 3, '0'), '.S0000.E0130.B1.GC') AS fn,
       yr AS year, mo AS month, dy AS day, hr AS hour, lat, lon360 AS lon,
       b1, b3 - 3e0 AS b2, CASE WHEN k % 211 = 0 THEN -1e30 ELSE b3 END AS b3, b4, b4 - (k % 30) / 1e1 AS b5, satza
FROM (SELECT *, CASE WHEN yr < 1989 THEN 'NF' WHEN yr < 1995 THEN 'NH' WHEN yr < 2001 THEN 'NJ'
                     WHEN yr < 2006 THEN 'NL' WHEN yr < 2013 THEN 'NN' ELSE 'NP' END AS sat
      FROM (SELECT k, year(d) AS yr, month(d) AS mo, day(d) AS dy, dayofyear(d) AS doy, (k * 5) % 24 AS hr, lat, lon360,
                   (k % 100) / 1e4 AS b1, 275e0 + ((k * 3) % 400) / 1e1 AS b3,
                   262e0 + ((k * 11) % 400) / 1e1 AS b4, ((k * 7) % 600) / 1e1 AS satza
            FROM (SELECT l_orderkey * 7 + l_partkey * 13 + l_linenumber * 31 AS k,
                         DATE '1986-01-01' + CAST(((l_orderkey * 7 + l_partkey * 13 + l_linenumber * 31) * 17) % 11323 AS INT) AS d,
                         ((l_suppkey * 37) % 111 - 50) + (((l_partkey * 101 + l_linenumber * 131) % 400) * 10 + 3) / 1e3 - 2e0 AS lat,
                         (l_suppkey * 53) % 356 + (((l_partkey * 17 + l_orderkey * 3) % 400) * 10 + 3) / 1e3 AS lon360
                  FROM {lineitem}) a) b) c
"""

POINTS = """
SELECT CASE s_suppkey % 3 WHEN 0 THEN 'volcano' WHEN 1 THEN 'persistent' ELSE 'industry' END AS kind,
       ((s_suppkey * 37) % 111 - 50) + ((s_suppkey * 7) % 20) / 1e1 - 1e0 AS lat,
       CASE WHEN lon360 >= 180 THEN lon360 - 360e0 ELSE lon360 END AS lon180
FROM (SELECT *, (s_suppkey * 53) % 356 + ((s_suppkey * 11) % 40) / 1e1 AS lon360 FROM {supplier}) s
"""

CELLS = """
SELECT lat_ix, lon_ix,
       CAST(floor((lat_ix + 9000) / 1e3) * 4 + floor(lon_ix / 9e3) AS INT) % 15 AS gfed,
       CAST(floor((lat_ix + 9000 + lon_ix) / 1e1) AS INT) % 18 AS lc
FROM (SELECT DISTINCT CAST({half_even}((lat + 5e-2) * 1e1, 0) AS INT) * 10 - 5 AS lat_ix,
                      CAST({half_even}((lon + 5e-2) * 1e1, 0) AS INT) * 10 - 5 AS lon_ix FROM {hotspots}) q
"""

CLIMATE = """
SELECT CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'gfwed_merra_fwi' WHEN '2' THEN 'gfwed_cpc_fwi'
            WHEN '3' THEN 'geff_fwi' WHEN '4' THEN 'geff_bi' ELSE 'geff_fdi' END AS dataset,
       CAST(o_orderdate AS DATE) AS date,
       CAST(floor((o_custkey % 24) / 6e0) AS INT) AS y, CAST(o_custkey % 6 AS INT) AS x,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE floor(o_totalprice / 1e3) / 1e1 + 3e-2 END AS value
FROM {orders}
"""

SENSOR = """
SELECT event_id, CASE WHEN event_type IN ('view','click','error') THEN 'truth' ELSE 'test' END AS sensor, ts,
       (user_id * 37) % 111 - 50 + ((event_id % 40) * 100 + 3) / 1e3 AS lat,
       (user_id * 53) % 356 - 178 + ((event_id % 30) * 100 + 3) / 1e3 AS lon180, user_id % 15 AS gfed
FROM {events}
"""

_PIXELS = """
SELECT CAST(floor(vec_id / 2.5e2) AS BIGINT) AS orbit, vec_id % 250 AS y, x,
       round(295e0 + 30e0 * CAST(e AS DOUBLE), 3) AS b3, round(290e0 + 20e0 * CAST(e2 AS DOUBLE), 3) AS b4
FROM ({inner}) t
"""
PIXELS_DUCK = _PIXELS.replace(
    "{inner}", "SELECT vec_id, i AS x, embedding[i + 1] AS e, embedding[(i * 7 + 3) % 64 + 1] AS e2 FROM {embeddings}, range(64) r(i)"
)
PIXELS_SPARK = _PIXELS.replace(
    "{inner}",
    "SELECT vec_id, i AS x, embedding[i] AS e, embedding[(i * 7 + 3) % 64] AS e2 FROM {embeddings} LATERAL VIEW explode(sequence(0, 63)) r AS i",
)

COUNTRIES = """
SELECT n_name AS admin, concat('C', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS adm0_a3,
       (n_nationkey % 5) * 72e0 - 180e0 AS x0, (n_nationkey % 5) * 72e0 - 108e0 AS x1,
       floor(n_nationkey / 5e0) * 24e0 - 60e0 AS y0, floor(n_nationkey / 5e0) * 24e0 - 36e0 AS y1
FROM {nation}
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HOTSPOTS, lineitem=_table(spark, sf_dir, "lineitem"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POINTS, supplier=_table(spark, sf_dir, "supplier"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CELLS.replace("{half_even}", "bround"), hotspots=hotspots(spark, sf_dir))


def climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CLIMATE, orders=_table(spark, sf_dir, "orders"))


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SENSOR, events=_table(spark, sf_dir, "events"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PIXELS_SPARK, embeddings=_table(spark, sf_dir, "embeddings"))


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(COUNTRIES, nation=_table(spark, sf_dir, "nation"))


def duck(sql: str) -> str:
    """The view as DuckDB reads it."""
    hot = HOTSPOTS.replace("{lineitem}", "lineitem")
    for name in ("lineitem", "supplier", "orders", "events", "embeddings", "nation"):
        sql = sql.replace("{" + name + "}", name)
    return sql.replace("{half_even}", "round_even").replace("{hotspots}", f"({hot}) h")
