"""Column types of the tables and the constants of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

HOTSPOTS_PUBLIC = T.StructType(
    [T.StructField("fn", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]
    + [T.StructField(c, T.IntegerType()) for c in ("year", "month", "day", "hour")]
    + [T.StructField(c, T.DoubleType()) for c in ("b1", "b2", "b3", "b4", "b5", "b34", "b45", "satza")]
)
POINTS = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon180", T.DoubleType())])
SENSOR = T.StructType(
    [T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("acq_date", T.StringType())]
    + [T.StructField("acq_time", T.IntegerType()), T.StructField("satellite", T.StringType()), T.StructField("confidence", T.IntegerType())]
)
DAILY_GRID = T.StructType(
    [T.StructField("dataset", T.StringType()), T.StructField("date", T.DateType()), T.StructField("y", T.IntegerType())]
    + [T.StructField("x", T.IntegerType()), T.StructField("value", T.DoubleType())]
)

# Fixed values of the domain.
PLATFORMS = ("NF", "NH", "NJ", "NL", "NN", "NP")
SATELLITE_YEARS = {"NF": (1986, 1986), "NH": (1989, 1991), "NJ": (1996, 1998), "NL": (2001, 2005), "NN": (2006, 2012), "NP": (2013, 2016)}
REGIONS = {
    0: ("Mask", "Mask"),
    1: ("BONA", "Boreal North America"),
    2: ("TENA", "Temperate North America"),
    3: ("CEAM", "Central America"),
    4: ("NHSA", "Northern Hemisphere South America"),
    5: ("SHSA", "Southern Hemisphere South America"),
    6: ("EURO", "Europe"),
    7: ("MIDE", "Middle East"),
    8: ("NHAF", "Northern Hemisphere Africa"),
    9: ("SHAF", "Southern Hemisphere Africa"),
    10: ("BOAS", "Boreal Asia"),
    11: ("CEAS", "Central Asia"),
    12: ("SOAS", "Southern Asia"),
    13: ("EQAS", "Equatorial Asia"),
    14: ("AUST", "Australia and New Zealand"),
}
GLOBAL_REGION = 99
UNBURNABLE = (0, 13, 15, 16, 17)
BAD_VALUE = -1e10
EARTH_RADIUS = 6367470.0
PERIODS, PERIOD_DAYS = 46, 8
SCENE = {
    "b1_max": 0.005, "lat_max": 70.0, "lat_min": -60.0, "satza_max": 35.0, "segments": 24, "min_valid": 0.01, "cold": 265.0,
    "min_b34": 3.0, "cloud_b34": 5.0, "cloud_b3": 285.0, "tiles": 10, "percentile": 0.9, "background": 0.65, "factor": 4.0,
}
