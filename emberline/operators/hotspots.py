"""From raw detections to masked, regional hotspots. Masks and regions are looked up in tiles of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline import schemas as S
from emberline.functions import scalars as X
from emberline.operators import cells as K
from emberline.operators.shape import normalise_to_year, with_global

def clean(raw: DataFrame, least_b3: float = 285.0) -> DataFrame:
    """Missing values as null, warm pixels only, the public columns, and the platform code."""
    bands = ("b1", "b2", "b3", "b4", "b5")
    df = raw.withColumns({b: X.missing_if_bad(b) for b in bands}).filter(F.col("b3") > least_b3)
    df = df.withColumn("b34", F.col("b3") - F.col("b4")).withColumn("b45", F.col("b4") - F.col("b5"))
    return df.select("fn", "lat", F.col("lon").alias("lon360"), "year", "month", "day", "hour", *bands, "b34", "b45", "satza", X.orbit_name("fn")["sat"].alias("sat"))


def add_solar_time(df: DataFrame) -> DataFrame:
    """lon180, dt_utc and dt_lst from the longitude and the parts of the time.

    Each is generated as a one-element array: the optimiser then computes the long series once for a row, where it
    would copy it into every later use of the solar time.
    """
    parts = F.struct(X.lon360_to_180("lon360").alias("lon180"), X.utc_from_parts("year", "month", "day", "hour").alias("dt_utc"))
    df = df.select("*", F.inline(F.array(parts)))
    return df.select("*", F.explode(F.array(X.local_solar_time("dt_utc", "lon180"))).alias("dt_lst"))


def add_solar_parts(df: DataFrame) -> DataFrame:
    """Date parts of the solar time; they replace the parts of the file's time."""
    at = F.col("dt_lst")
    return df.withColumns({"date_lst": F.to_date(at), "month": F.month(at), "year": F.year(at), "doy": F.dayofyear(at), "hour_lst": F.hour(at)})


def add_cell_keys(df: DataFrame) -> DataFrame:
    """Nearest-tenth keys for point masks and cell-centre keys for rasters."""
    return df.withColumns(
        {
            "lat_x10_int": X.cell_key_x10("lat"),
            "lon180_x10_int": X.cell_key_x10("lon180"),
            "lat_ix": X.cell_centre_key("lat"),
            "lon_ix": X.cell_centre_key("lon360"),
        }
    )


def point_keys(points: DataFrame) -> DataFrame:
    return points.select(X.cell_key_x10(X.round_tenth("lat")).alias("lat_x10_int"), X.cell_key_x10(X.round_tenth("lon180")).alias("lon180_x10_int")).distinct()


def mask_points(df: DataFrame, points: DataFrame) -> DataFrame:
    """Detections in no cell of a volcano, persistent source or industrial site."""
    at = K.by_tenths("lat_x10_int", "lon180_x10_int")
    keys = points.select(X.cell_key_x10(X.round_tenth("lat")).alias("lat_x10_int"), X.cell_key_x10(X.round_tenth("lon180")).alias("lon180_x10_int"))
    return K.where(df, at, keys, at, there=False)


def burnable(cells: DataFrame) -> DataFrame:
    return cells.filter(~F.col("lc").isin(*S.UNBURNABLE))


def mask_landcover(df: DataFrame, cells: DataFrame) -> DataFrame:
    at = K.by_centres("lat_ix", "lon_ix")
    return K.where(df, at, burnable(cells), at, there=True)


def assign_region(df: DataFrame, cells: DataFrame) -> DataFrame:
    at = K.by_centres("lat_ix", "lon_ix")
    return K.with_value(df, at, cells, at, "gfed").withColumn("gfed_name", X.region_name("gfed"))


def dedup(df: DataFrame) -> DataFrame:
    """One detection for each place, angle and time; the first file name stays."""
    keys = ["lat", "lon360", "satza", "dt_utc"]
    df = df.repartition(*keys)  # the shuffle that the window needs anyway, before its sort
    order = Window.partitionBy(*keys).orderBy("fn", *[c for c in df.columns if c not in (*keys, "fn")])
    return df.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def mask(raw: DataFrame, points: DataFrame, cells: DataFrame, max_lat: float = 60.0, before: int = 2018) -> DataFrame:
    """All steps: clean, solar night, cells, masks, regions, duplicates of overlapping orbits."""
    night = add_solar_time(clean(raw)).filter(X.is_night("dt_lst"))
    keyed = add_cell_keys(add_solar_parts(night)).filter((F.col("year") < before) & (F.col("lat") <= max_lat))
    kept = mask_points(keyed, points)
    # land cover and region come from the same cells, so one join gives both
    return dedup(assign_region(kept, burnable(cells)))


def valid_satellites(df: DataFrame) -> DataFrame:
    kept = df.filter(X.valid_satellite_year("sat", "year"))
    return kept.withColumn("sat_yr", F.concat("sat", F.col("year").cast("string")))


def annual_counts(df: DataFrame) -> DataFrame:
    """Hotspots by satellite-year and region, with the global row (region 99)."""
    keys = ["sat_yr", "sat", "year"]
    counts = df.groupBy(*keys, "gfed", "gfed_name").agg(F.count("*").alias("count"))
    return with_global(counts, keys, {"gfed": S.GLOBAL_REGION, "gfed_name": "Global"})


def biome_counts(df: DataFrame, base_year: int = 1986) -> DataFrame:
    """Hotspots by satellite-year and biome with the global row, and each relative to its own base year."""
    keys = ["sat_yr", "sat", "year"]
    counts = df.withColumn("biome", X.biome("lat")).groupBy(*keys, "biome").agg(F.count("*").alias("count"))
    return normalise_to_year(with_global(counts, keys, {"biome": "Global"}), ["biome"], "count", base_year)
