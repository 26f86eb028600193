"""Sparse grids: cell (y, x), row 0 in the north. Latitude and longitude are computed from the cell, never keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalars import cell_area


def grid_counts(df: DataFrame, per_degree: int = 10, lat: str = "lat", lon: str = "lon360") -> DataFrame:
    """Points by year and cell; bins are half open, the last one is closed."""
    rows, cols = 180 * per_degree, 360 * per_degree
    y = rows - 1 - F.least(F.floor((F.col(lat) + 90) * per_degree), F.lit(rows - 1))
    x = F.least(F.floor(F.col(lon) * per_degree), F.lit(cols - 1))
    return df.groupBy("year", y.cast("int").alias("y"), x.cast("int").alias("x")).agg(F.count("*").cast("double").alias("value"))


def grid_totals(grid: DataFrame) -> DataFrame:
    return grid.groupBy("year").agg(F.sum("value").alias("total"))


def roll(grid: DataFrame, width: int) -> DataFrame:
    """From 0..360 to -180..180 degrees: columns turn by half the width; rows stay."""
    return grid.withColumn("x", ((F.col("x") + width // 2) % width).cast("int"))


def latitude(y, cell: float):
    """Centre of a row."""
    return 90.0 - (F.col(y) + 0.5) * cell


def coarsen(grid: DataFrame, keys: list[str], factor: int, algo: str, cell: float = 0.1) -> DataFrame:
    """Blocks of ``factor`` x ``factor`` cells: sum, mean (absent cells count as 0), or area_mean; one aggregation."""
    value = F.col("value") * cell_area(latitude("y", cell), cell, cell) if algo == "area_mean" else F.col("value")
    block = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("y", "x")]
    out = grid.withColumn("value", value).groupBy(*keys, *block).agg(F.sum("value").alias("value"))
    if algo == "mean":
        return out.withColumn("value", F.col("value") / factor**2)
    if algo == "area_mean":
        return out.withColumn("value", F.col("value") / cell_area(latitude("y", cell * factor), cell * factor, cell * factor))
    return out


def coarsen_mean_valid(grid: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """Mean over the cells that have a value."""
    block = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("y", "x")]
    return grid.groupBy(*keys, *block).agg(F.avg("value").alias("value"))


def coarsen_mode(classes: DataFrame, factor: int, min_share: float = 0.1, centred: bool = False) -> DataFrame:
    """The most frequent class of a block, if classes cover ``min_share`` of it.

    Ties go to the smallest class, or with ``centred`` to the class nearest to the centre of the block (then first in scan order).
    """
    block = {f"__{c}": F.floor(F.col(c) / factor).cast("int") for c in ("y", "x")}
    away = sum((F.col(c) % factor - factor // 2) * (F.col(c) % factor - factor // 2) for c in ("y", "x"))
    counts = classes.withColumns(block).groupBy("__y", "__x", "class").agg(F.count("*").alias("n"), F.min(F.struct(away.alias("d"), "y", "x")).alias("near"))
    order = F.struct(-F.col("n"), "near", "class") if centred else F.struct(-F.col("n"), "class")
    out = counts.groupBy(F.col("__y").alias("y"), F.col("__x").alias("x")).agg(F.min_by("class", order).alias("class"), F.sum("n").alias("__n"))
    return out.filter(F.col("__n") / factor**2 >= min_share).drop("__n")


def mean_activity(grid: DataFrame, years: int, least: float = 1.0) -> DataFrame:
    """Mean over the years with data and whether fires are frequent; cells without fire have no row."""
    out = grid.groupBy("y", "x").agg((F.sum("value") / years).alias("mean")).filter("mean <> 0")
    return out.withColumn("frequent", (F.col("mean") >= least).cast("int"))


def blank_boxes(grid: DataFrame, boxes: list[tuple[int, int, int, int]], value: float | None) -> DataFrame:
    """Cells in any of the boxes (y0, y1, x0, x1), ends included, get ``value``."""
    inside = F.lit(False)
    for y0, y1, x0, x1 in boxes:
        inside = inside | (F.col("y").between(y0, y1) & F.col("x").between(x0, x1))
    return grid.withColumn("value", F.when(inside, F.lit(value).cast("double")).otherwise(F.col("value")))


def resample_nearest(grid: DataFrame, keys: list[str], source_cell: float, target_cell: float, width: float, height: float, turn: bool = False) -> DataFrame:
    """Each target cell takes the source cell that its centre lies in; made after the yearly reduction, as it multiplies rows.

    ``turn`` moves columns from 0..360 to -180..180 degrees.
    """
    span = lambda c, size: F.sequence(  # noqa: E731  # targets whose centre lies in the source cell
        F.ceil(F.col(c) * source_cell / target_cell - 0.5).cast("int"),
        F.least(F.ceil((F.col(c) + 1) * source_cell / target_cell - 0.5) - 1, F.lit(round(size / target_cell) - 1)).cast("int"),
    )
    out = grid.withColumn("ys", F.explode(span("y", height))).withColumn("xs", F.explode(span("x", width)))
    out = out.select(*keys, F.col("ys").alias("y"), F.col("xs").alias("x"), "value")
    return roll(out, round(width / target_cell)) if turn else out


def common_mask(ensemble: DataFrame, year_col: str = "year") -> DataFrame:
    """Cells that have a value in the first year."""
    held = ensemble.filter(F.col("value").isNotNull())
    first = held.agg(F.min(year_col).alias("__first"))  # one row
    return held.join(F.broadcast(first), F.col(year_col) == F.col("__first")).select("y", "x").distinct()


def apply_mask(grid: DataFrame, mask: DataFrame) -> DataFrame:
    return grid.join(mask.select("y", "x"), ["y", "x"], "left_semi").select(grid.columns)


def weighted_mean(grid: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Area-weighted mean over the cells with a value; y counts rows of ``cell`` degrees."""
    w = F.when(F.col("value").isNotNull(), cell_area(latitude("y", cell), cell, cell))
    return grid.groupBy(*keys).agg((F.sum(w * F.col("value")) / F.sum(w)).alias("wmean"))
