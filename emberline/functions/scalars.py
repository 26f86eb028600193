"""Column functions: positions, times, keys, labels, units. No Python runs on the executors."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline import schemas as S


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_if_bad(c: Column | str, least: float = S.BAD_VALUE) -> Column:
    """Null for NaN and for the large negative values that stand for "no data"."""
    return F.when(~F.isnan(_c(c)) & (_c(c) >= least), _c(c))


def lon360_to_180(lon: Column | str) -> Column:
    return F.when(_c(lon) >= 180, _c(lon) - 360.0).otherwise(_c(lon))


def lon180_to_360(lon: Column | str) -> Column:
    return F.when(_c(lon) < 0, _c(lon) + 360.0).otherwise(_c(lon))


def utc_from_parts(year, month, day, hour) -> Column:
    """A timestamp without zone, so no session setting can shift a date."""
    return F.make_timestamp_ntz(_c(year), _c(month), _c(day), _c(hour), F.lit(0), F.lit(0.0))


def utc_from_acquisition(date: Column | str, hhmm: Column | str) -> Column:
    """From a date text and a time as a number such as 45 for 00:45."""
    return F.to_timestamp_ntz(F.concat_ws(" ", _c(date), F.lpad(_c(hhmm).cast("string"), 4, "0")), F.lit("yyyy-MM-dd HHmm"))


def equation_of_time(ts: Column | str) -> Column:
    """Minutes that the sun is ahead of the clock, by the five-term series in the angle of the year."""
    ts = _c(ts)
    days = F.dayofyear(F.last_day(F.make_date(F.year(ts), F.lit(12), F.lit(1))))
    turn = F.lit(2.0) * F.pi() / days * (F.dayofyear(ts) - 1 + (F.hour(ts) - 12) / 24.0)
    series = 0.000075 + 0.001868 * F.cos(turn) - 0.032077 * F.sin(turn) - 0.014615 * F.cos(2.0 * turn) - 0.040849 * F.sin(2.0 * turn)
    return 229.18 * series


def local_solar_time(ts: Column | str, lon180: Column | str) -> Column:
    """Solar time at a longitude; it may fall on the day before or after."""
    ts = _c(ts)
    minutes = F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60.0 + equation_of_time(ts) + 4.0 * _c(lon180)
    midnight = F.to_date(ts).cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.rint(minutes * 6e7).cast("long"), midnight)


def is_night(solar: Column | str, first: int = 0, end: int = 4) -> Column:
    """Hour of solar time in [first, end), over midnight if first > end; by default before 4."""
    hour = F.hour(_c(solar))
    return (hour >= first) & (hour < end) if first <= end else (hour >= first) | (hour < end)


def cell_key_x10(v: Column | str) -> Column:
    """Nearest tenth of a degree times ten, halves to even."""
    return F.rint(_c(v) * 10).cast("int")


def cell_centre_key(v: Column | str) -> Column:
    """Centre of the tenth-of-a-degree cell in hundredths: the nearest number that ends in 5."""
    return (F.rint((_c(v) + 0.05) * 10) * 10 - 5).cast("int")


def grid_bin(v: Column | str, size: float, method: str = "floor") -> Column:
    """Lower edge of the bin of ``size``, or the nearest multiple of it."""
    scaled = _c(v) / size
    return (F.floor(scaled) if method == "floor" else F.rint(scaled)) * F.lit(float(size))


def biome(lat: Column | str) -> Column:
    return F.when((_c(lat) > -20) & (_c(lat) < 20), "Tropics").when(_c(lat) > 50, "Boreal").otherwise("Temperate")


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def region_name(gfed: Column | str) -> Column:
    names = {k: v[0] for k, v in S.REGIONS.items()} | {S.GLOBAL_REGION: "Global"}
    return F.try_element_at(_lookup(names), _c(gfed))


def region_full_name(gfed: Column | str) -> Column:
    names = {k: v[1] for k, v in S.REGIONS.items()} | {S.GLOBAL_REGION: "Global"}
    return F.try_element_at(_lookup(names), _c(gfed))


def mend_region_label(name: Column | str) -> Column:
    """Labels that tables spell differently."""
    return F.when(_c(name) == "SEAS", "SOAS").when(_c(name) == "global", "Global").otherwise(_c(name))


def era(year: Column | str, split: int = 2001) -> Column:
    return F.when(_c(year) < split, 1).otherwise(2)


def reanalysis(dataset: Column | str) -> Column:
    return F.when(F.contains(_c(dataset), F.lit("geff")), "ERA5").when(F.contains(_c(dataset), F.lit("gfwed")), "MERRA2")


def valid_satellite_year(sat: Column | str, year: Column | str) -> Column:
    years = [F.lit(f"{s}{y}") for s, (a, b) in S.SATELLITE_YEARS.items() for y in range(a, b + 1)]
    return F.concat(_c(sat), _c(year).cast("string")).isin(*years)


def orbit_name(fn: Column | str) -> Column:
    """sat, doy, start, end, block, source and the day number of a file name with dots."""
    parts = F.split(_c(fn), r"\.")
    named = [F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(("sat", "doy", "start", "end", "block", "source"))]
    return F.struct(*named, F.substring(F.try_element_at(parts, F.lit(2)), -3, 3).cast("int").alias("day_number"))


def orbit_time_range(fn: Column | str) -> Column:
    """start and end of an orbit from its name; an end before the start is on the next day."""
    digits = lambda group: F.regexp_extract(_c(fn), r"\.D(\d{2})(\d{3})\.S(\d{2})(\d{2})\.E(\d{2})(\d{2})", group).try_cast("int")
    year = F.when(digits(1) >= 70, 1900 + digits(1)).otherwise(2000 + digits(1))
    day = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), digits(2) - 1).cast("timestamp_ntz")
    first, last = digits(3) * 60 + digits(4), digits(5) * 60 + digits(6)
    at = lambda minutes: F.timestamp_add("MINUTE", minutes, day)
    return F.struct(at(first).alias("start"), at(F.when(last < first, last + 1440).otherwise(last)).alias("end"))


def round_tenth(v: Column | str) -> Column:
    """To one decimal, halves of the scaled value to even."""
    return F.rint(_c(v) * 10) / 10


def acres_to_hectares(v: Column | str) -> Column:
    return F.rint(_c(v) * 0.404686).cast("long")


def square_metres_to_mkm2(v: Column | str) -> Column:
    return _c(v) / 1e6 / 1e6


def kpa_to_pa(v: Column | str) -> Column:
    return _c(v) * 1000.0


def periods_to_days(v: Column | str) -> Column:
    return _c(v) * S.PERIOD_DAYS


def stars(p: Column | str) -> Column:
    return F.when(_c(p) < 0.001, "***").when(_c(p) < 0.01, "**").when(_c(p) < 0.05, "*").otherwise("")


def tau_cell(tau: Column | str, p: Column | str, cut: float = 0.1) -> Column:
    """``0.52 (0.013*)``, ``0.52 (< 0.001***)`` or ``NS``."""
    p = _c(p)
    shown = F.when(p < 0.001, "< 0.001").otherwise(F.format_string("%.3f", p))
    return F.when(p < cut, F.concat(F.format_string("%.2f", _c(tau)), F.lit(" ("), shown, stars(p), F.lit(")"))).otherwise("NS")


def slope_cell(slope: Column | str, lower: Column | str, upper: Column | str) -> Column:
    return F.format_string("%.2f [%.2f, %.2f]", _c(slope), _c(lower), _c(upper))


def cell_area(lat: Column | str, dlat: float, dlon: float) -> Column:
    """Area in square metres of a grid cell at a latitude."""
    import math

    equator = (2.0 * math.pi * S.EARTH_RADIUS / 360.0) ** 2 * abs(dlat) * abs(dlon)
    return equator * F.cos(_c(lat) * math.pi / 180.0)
