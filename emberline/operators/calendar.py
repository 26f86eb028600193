"""Compositing periods of eight days and month indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import schemas as S


def period_calendar(spark: SparkSession, first: int = 1979, last: int = 2018) -> DataFrame:
    """(date, comp_period): 46 periods of 8 days from 1 January of each year.

    They cover 368 days, so the first days of January belong to period 1 and to period 46 of the year before.
    """
    starts = spark.range(first, last + 1).select(F.make_date(F.col("id").cast("int"), F.lit(1), F.lit(1)).alias("d"))
    days = starts.select("d", F.explode(F.sequence(F.lit(0), F.lit(S.PERIODS * S.PERIOD_DAYS - 1))).alias("n"))
    return days.select(F.date_add("d", F.col("n")).alias("date"), (F.floor(F.col("n") / S.PERIOD_DAYS) + 1).cast("int").alias("comp_period"))


def join_periods(df: DataFrame, date: str = "date_lst", first: int = 1979, last: int = 2018) -> DataFrame:
    """``df`` with comp_period; rows of early January appear twice. The calendar has a few thousand rows."""
    calendar = period_calendar(df.sparkSession, first, last).withColumnRenamed("date", "__date")
    return df.join(F.broadcast(calendar), F.col(date) == F.col("__date")).drop("__date")


def month_index(year: Column | str, month: Column | str, first_year: int = 1986) -> Column:
    """Months since January of ``first_year``."""
    year, month = (F.col(c) if isinstance(c, str) else c for c in (year, month))
    return (year - first_year) * 12 + month - 1
