"""Seasonal profiles and fire seasons of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline import schemas as S
from emberline.operators.calendar import join_periods
from emberline.operators.shape import complete, with_global


def period_counts(df: DataFrame) -> DataFrame:
    """Hotspots by satellite-year, compositing period and region with the global rows; absent combinations count 0."""
    keys = ["sat_yr", "sat", "year", "comp_period"]
    counts = join_periods(df).groupBy(*keys, "gfed", "gfed_name").agg(F.count("*").alias("count"))
    full = with_global(counts, keys, {"gfed": S.GLOBAL_REGION, "gfed_name": "Global"})
    return complete(full, [["sat_yr", "sat", "year"], ["comp_period"], ["gfed", "gfed_name"]], {"count": 0})


def period_profile(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and median of each period over the years."""
    return counts.groupBy(*keys, "comp_period").agg(F.avg("count").alias("mean"), F.percentile("count", F.lit(0.5)).alias("median"))


def profile_by_era(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean, sample deviation and half the 95 % interval of each period."""
    out = counts.groupBy(*keys, "comp_period").agg(F.count("count").alias("n"), F.avg("count").alias("mean"), F.stddev_samp("count").alias("std"))
    return out.withColumn("ci95", 1.96 * F.col("std") / F.sqrt("n"))


def smooth_circular(profile: DataFrame, keys: list[str], cols: list[str], n: int = S.PERIODS) -> DataFrame:
    """Centred mean of three periods; the year is a circle."""
    pads = profile.filter(F.col("comp_period").isin(1, n)).withColumn("comp_period", F.when(F.col("comp_period") == 1, n + 1).otherwise(0))
    w = Window.partitionBy(*keys).orderBy("comp_period").rowsBetween(-1, 1)
    out = profile.unionByName(pads).withColumns({f"{c}_smooth": F.avg(c).over(w) for c in cols})
    return out.filter(F.col("comp_period").between(1, n))


def fire_year_order(profile: DataFrame, keys: list[str], value: str, override: dict | None = None, name: str = "gfed_name", n: int = S.PERIODS) -> DataFrame:
    """period_rank from 0 at the period with the least value (the first of them), around the year."""
    by = Window.partitionBy(*keys)
    first = F.min(F.struct(F.col(value), F.col("comp_period"))).over(by)["comp_period"]
    for label, period in (override or {}).items():
        first = F.when(F.col(name) == label, period).otherwise(first)
    return profile.withColumn("period_rank", (F.col("comp_period") - first + n) % n)


def fire_season(ordered: DataFrame, keys: list[str], value: str, lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """Cumulative share in fire-year order, and season 1 where it lies in [lo, hi]."""
    by = Window.partitionBy(*keys)
    running = F.sum(value).over(by.orderBy("period_rank").rowsBetween(Window.unboundedPreceding, 0))
    out = ordered.withColumn("prop", F.try_divide(running, F.sum(value).over(by)))
    return out.withColumn("season", F.coalesce(F.col("prop").between(lo, hi).cast("int"), F.lit(0)))


def season_summary(season: DataFrame, keys: list[str], value: str) -> DataFrame:
    """First and last period of the season, periods of least and most activity, and length; -9999 without a season."""
    inside = F.col("season") == 1
    period = F.when(inside, F.col("comp_period"))
    return season.groupBy(*keys).agg(
        F.coalesce(F.min_by(period, F.when(inside, F.col("period_rank"))), F.lit(-9999)).alias("season_start"),
        F.coalesce(F.max_by(period, F.when(inside, F.col("period_rank"))), F.lit(-9999)).alias("season_end"),
        F.min(F.struct(value, "period_rank", "comp_period"))["comp_period"].alias("year_min"),
        F.min(F.struct(-F.col(value), "period_rank", "comp_period"))["comp_period"].alias("year_max"),
        F.count_if(inside).alias("season_len"),
    )


def peak_activity(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys, "year").agg(F.max("count").alias("peak"))


def season_length(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Days in periods above the all-year mean of the key, and above its median."""
    by = counts.groupBy(*keys).agg(F.avg("count").alias("__mean"), F.percentile("count", F.lit(0.5)).alias("__median"))
    above = lambda c: (F.count_if(F.col("count") > F.col(c)) * S.PERIOD_DAYS)
    joined = counts.join(by, keys)  # one row for each region
    return joined.groupBy(*keys, "year").agg(above("__mean").alias("days_mean"), above("__median").alias("days_median"))


def describe_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles (interpolated) and most."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), q.alias("q"), F.max(value).alias("most"))
    return out.select(*keys, "n", "mean", "std", "least", *[F.col("q")[i].alias(c) for i, c in enumerate(("q25", "q50", "q75"))], "most")


def era_change(described: DataFrame, keys: list[str]) -> DataFrame:
    """Change in percent of median and interquartile range from era 1 to era 2."""
    wide = described.withColumn("iqr", F.col("q75") - F.col("q25")).groupBy(*keys).pivot("era", [1, 2]).agg(F.first("q50").alias("median"), F.first("iqr").alias("iqr"))
    change = lambda c: F.rint(F.try_divide(F.col(f"2_{c}") - F.col(f"1_{c}"), F.col(f"1_{c}")) * 100)
    return wide.select(*keys, change("median").alias("median_change"), change("iqr").alias("iqr_change"))


def lat_month_counts(df: DataFrame) -> DataFrame:
    """Hotspots by degree of latitude (halves to even), year and month, absent combinations 0."""
    counts = df.withColumn("lat_bin", F.rint("lat").cast("int")).groupBy("lat_bin", "year", "month").agg(F.count("*").alias("count"))
    return complete(counts, [["lat_bin"], ["year"], ["month"]], {"count": 0})


def lat_month_anomaly(counts: DataFrame, after: int = 2000) -> DataFrame:
    """Deviation from the mean of a latitude and month in the years after ``after``, in sample deviations."""
    by = Window.partitionBy("lat_bin", "month")
    base = F.when(F.col("year") > after, F.col("count"))
    return counts.withColumn("z", (F.col("count") - F.avg(base).over(by)) / F.nullif(F.stddev_samp(base).over(by), F.lit(0.0)))
