"""Common table expressions of the oracle queries, in DuckDB's SQL."""

from __future__ import annotations

from emberline import schemas as S
from emberline.sources import standins as V

H = f"h AS ({V.duck(V.HOTSPOTS)})"
POINTS = f"pts AS ({V.duck(V.POINTS)})"
CELLS = f"cells AS ({V.duck(V.CELLS)})"
CLIMATE = f"cl AS ({V.duck(V.CLIMATE)})"
SENSOR = f"sen AS ({V.duck(V.SENSOR)})"
PIXELS = f"px AS ({V.duck(V.PIXELS_DUCK)})"
COUNTRIES = f"ctry AS ({V.duck(V.COUNTRIES)})"

CLEAN = f"""{H},
hc AS (SELECT fn, split_part(fn, '.', 1) AS sat, lat, lon AS lon360, year, month, day, hour, b1, b2, b3, b4, b5, b3 - b4 AS b34, b4 - b5 AS b45, satza
       FROM h WHERE b3 >= -1e10 AND b3 > 285)"""

SOLAR = f"""{CLEAN},
hg AS (SELECT *, CASE WHEN lon360 >= 180 THEN lon360 - 360 ELSE lon360 END AS lon180, make_timestamp(year, month, day, hour, 0, 0.0) AS dt_utc,
       2 * pi() / dayofyear(make_date(year, 12, 31)) * (dayofyear(make_date(year, month, day)) - 1 + (hour - 12) / 24.0::DOUBLE) AS g FROM hc),
hl AS (SELECT * EXCLUDE (g), date_trunc('day', dt_utc) + to_microseconds(CAST(round_even((hour * 60 + 229.18::DOUBLE * (0.000075::DOUBLE + 0.001868::DOUBLE * cos(g)
       - 0.032077::DOUBLE * sin(g) - 0.014615::DOUBLE * cos(2 * g) - 0.040849::DOUBLE * sin(2 * g)) + 4 * lon180) * 6e7, 0) AS BIGINT)) AS dt_lst FROM hg)"""

KEYED = f"""{SOLAR},
hk AS (SELECT * REPLACE (year(dt_lst) AS year, month(dt_lst) AS month), CAST(dt_lst AS DATE) AS date_lst, dayofyear(dt_lst) AS doy, hour(dt_lst) AS hour_lst,
       CAST(round_even(lat * 10, 0) AS INT) AS lat_x10_int, CAST(round_even(lon180 * 10, 0) AS INT) AS lon180_x10_int,
       CAST(round_even((lat + 0.05::DOUBLE) * 10, 0) * 10 - 5 AS INT) AS lat_ix, CAST(round_even((lon360 + 0.05::DOUBLE) * 10, 0) * 10 - 5 AS INT) AS lon_ix
       FROM hl WHERE hour(dt_lst) < 4)"""

_NAMES = " ".join(f"WHEN {k} THEN '{v[0]}'" for k, v in S.REGIONS.items())
NAME = f"CASE gfed {_NAMES} WHEN 99 THEN 'Global' END"

MASKED = f"""{KEYED}, {POINTS}, {CELLS},
pk AS (SELECT DISTINCT CAST(round_even(round_even(lat * 10, 0) / 10 * 10, 0) AS INT) AS lat_x10_int, CAST(round_even(round_even(lon180 * 10, 0) / 10 * 10, 0) AS INT) AS lon180_x10_int FROM pts),
hm AS (SELECT k.*, c.gfed, {NAME} AS gfed_name FROM hk k JOIN cells c ON k.lat_ix = c.lat_ix AND k.lon_ix = c.lon_ix AND c.lc NOT IN (0, 13, 15, 16, 17)
       WHERE k.year < 2018 AND k.lat <= 60 AND NOT EXISTS (SELECT 1 FROM pk WHERE pk.lat_x10_int = k.lat_x10_int AND pk.lon180_x10_int = k.lon180_x10_int)),
hd AS (SELECT * FROM hm QUALIFY row_number() OVER (PARTITION BY lat, lon360, satza, dt_utc ORDER BY fn, b1, b2, b3, b4, b5) = 1)"""

_VALID = ", ".join(f"'{s}{y}'" for s, (a, b) in S.SATELLITE_YEARS.items() for y in range(a, b + 1))
VALID = f"""{MASKED},
hv AS (SELECT *, sat || CAST(year AS VARCHAR) AS sat_yr FROM hd WHERE sat || CAST(year AS VARCHAR) IN ({_VALID}))"""

ANNUAL = f"""{VALID},
ac AS (SELECT sat_yr, sat, year, gfed, gfed_name, count(*) AS count FROM hv GROUP BY ALL
       UNION ALL SELECT sat_yr, sat, year, 99, 'Global', count(*) FROM hv GROUP BY ALL)"""
