"""Daily fire-weather and vapour-pressure grids: ranges, season lengths, annual statistics, ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalars import round_tenth
from emberline.operators.shape import at_year

CELL = ["dataset", "y", "x"]


def daily(df: DataFrame, last_year: dict[str, int] | None = None) -> DataFrame:
    """Values to one decimal and the year; ``last_year`` ends single data sets."""
    out = df.withColumn("value", round_tenth("value")).withColumn("year", F.year("date"))
    for name, year in (last_year or {}).items():
        out = out.filter((F.col("dataset") != name) | (F.col("year") <= year))
    return out


def fire_weather_range(days: DataFrame) -> DataFrame:
    """Least, most and middle value of each cell over all days."""
    out = days.groupBy(*CELL).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return out.withColumn("middle", (F.col("low") + F.col("high")) / 2)


def season_days(days: DataFrame) -> DataFrame:
    """Days of a year above the middle of the cell's range: 0 if there are none, no row where a cell never has data.

    Both passes group by cell first, so a table clustered by cell needs one shuffle; days are summed before it.
    """
    middle = fire_weather_range(days).filter("middle IS NOT NULL").select(*CELL, "middle")
    return days.join(middle, CELL).groupBy(*CELL, "year").agg(F.count_if(F.col("value") > F.col("middle")).cast("double").alias("value"))


def annual_stats(days: DataFrame) -> DataFrame:
    """Mean, median, most and least of a year; null where a day is missing."""
    full = F.count("value") == F.count("*")
    stats = {"mean": F.avg("value"), "median": F.percentile("value", F.lit(0.5)), "most": F.max("value"), "least": F.min("value")}
    return days.groupBy(*CELL, "year").agg(*[F.when(full, c).alias(n) for n, c in stats.items()])


def ensemble_mean(stacks: DataFrame, members: list[str], name: str) -> DataFrame:
    """Mean of the members of a year and cell, null if any of them is missing."""
    held = stacks.filter(F.col("dataset").isin(*members)).groupBy("year", "y", "x")
    out = held.agg(F.when(F.count("value") == len(members), F.avg("value")).alias("value"))
    return out.select(F.lit(name).alias("dataset"), "year", "y", "x", "value")


def ensemble_stats(series: DataFrame, keys: list[str], value: str, base_year: int = 1986) -> DataFrame:
    """Count, mean, sample deviation, range and half the 95 % interval over members, and mean and interval relative to the base year's mean."""
    out = series.groupBy(*keys, "year").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most")
    )
    out = out.withColumn("ci95", 1.96 * F.col("std") / F.sqrt("n"))
    base = at_year(out, keys, "mean", base_year)
    return out.withColumns({f"{c}_norm": F.col(c) / base for c in ("mean", "std", "least", "most", "ci95")})


def relative_to_first_year(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    first = F.min_by(value, "year").over(Window.partitionBy(*keys))
    return series.withColumn(f"{value}_norm", F.col(value) / first)
