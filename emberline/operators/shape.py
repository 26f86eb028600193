"""Shaping of series: dense key grids, global rows, normalisation, differences, ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete(df: DataFrame, key_sets: list[list[str]], fill: dict) -> DataFrame:
    """A row for every combination of the distinct ``key_sets`` of ``df``; new rows get the ``fill`` values.

    Key sets are lists of years, regions, periods: small products, not rows against rows.
    """
    grids = [df.select(*keys).distinct() for keys in key_sets]
    dense = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), grids)
    out = dense.join(df, [k for keys in key_sets for k in keys], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()}).select(df.columns)


def with_global(counts: DataFrame, keys: list[str], region: dict, value: str = "count") -> DataFrame:
    """``counts`` and the sums over regions, under the values of ``region``; rolled up from the counts, not the rows."""
    total = counts.groupBy(*keys).agg(F.sum(value).alias(value))
    return counts.unionByName(total.withColumns({c: F.lit(v) for c, v in region.items()}).select(counts.columns))


def at_year(df: DataFrame, keys: list[str], value: str, year: int, year_col: str = "year") -> Column:
    """The value of a key in one year, on each of its rows."""
    return F.max(F.when(F.col(year_col) == year, F.col(value))).over(Window.partitionBy(*keys))


def normalise_to_year(df: DataFrame, keys: list[str], value: str, year: int) -> DataFrame:
    return df.withColumn(f"{value}_norm", F.col(value) / at_year(df, keys, value, year))


def normalise_to_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.withColumn(f"{value}_norm", F.col(value) / F.avg(value).over(Window.partitionBy(*keys)))


def norm_to_first(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    first = F.first(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(f"{value}_norm", F.col(value) / first)


def first_diff(df: DataFrame, keys: list[str], order: str, value: str, gap_aware: bool = False) -> DataFrame:
    """Difference from the row before; with ``gap_aware`` only where that row is the year before."""
    w = Window.partitionBy(*keys).orderBy(order)
    diff = F.col(value) - F.lag(value).over(w)
    if gap_aware:
        diff = F.when(F.col(order) - F.lag(order).over(w) == 1, diff)
    return df.withColumn(f"{value}_diff", diff)


def add_rank(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def assemble(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full joins of small tables on their keys."""
    return reduce(lambda a, b: a.join(b, keys, "full"), tables)
