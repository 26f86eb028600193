"""Agreement of fire and climate trends, and areas by sign and class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quadrant(fire: DataFrame, climate: DataFrame, keys: list[str], cut: float = 0.1) -> DataFrame:
    """Class of each cell: 1 both down, 2 both up, 3 fire up and climate down, 4 fire down and climate up, 5 a fire trend alone.

    Fire trends that are not significant are missing; climate trends that are not count as 0.
    """
    f = fire.select(*keys, F.when(F.col("p") < cut, F.col("tau")).alias("f"))
    c = climate.select(*keys, F.when(F.col("p") < cut, F.col("tau")).otherwise(F.when(F.col("tau").isNotNull(), 0.0)).alias("c"))
    fire_up, climate_up = F.col("f") > 0, F.col("c") > 0
    fire_down, climate_down = F.col("f") < 0, F.col("c") < 0
    label = (
        F.when(fire_down & climate_down, 1).when(fire_up & climate_up, 2).when(fire_up & climate_down, 3).when(fire_down & climate_up, 4)
        .when((fire_up | fire_down) & (F.col("c") == 0), 5)
    )
    return f.join(c, keys).select(*keys, label.alias("class"))


def matching_corr(corr: DataFrame, classes: DataFrame, keys: list[str], cut: float = 0.1) -> DataFrame:
    """Significant correlations of cells whose trends point the same way."""
    return corr.filter(F.col("p") < cut).join(classes.filter("class <= 2").select(*keys), keys, "left_semi")


def quadrant_counts(classes: DataFrame) -> DataFrame:
    held = classes.filter("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("n"))
    return held.withColumn("percent", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))  # five rows


def analysis_cells(cells: DataFrame, frequent: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """Frequent-fire cells that have a region, in rows ``first`` to ``last``; a climate trend of 0 is missing."""
    held = cells.filter(F.col("gfed").isNotNull() & (F.col("gfed") > 0) & F.col("y").between(first, last))
    return held.join(frequent.select(*keys), keys, "left_semi").withColumn("tau", F.nullif("tau", F.lit(0.0)))


def with_whole(df: DataFrame, keys: list[str], sums: list[str], region: str = "gfed", whole: int = 15) -> DataFrame:
    total = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).withColumn(region, F.lit(whole))
    return df.unionByName(total)


def signed_area(cells: DataFrame, variables: list[str]) -> DataFrame:
    """Area with positive, negative and no trend by region and variable, and in percent; region 15 is the globe."""
    long = cells.unpivot(["gfed", "area"], variables, "variable", "tau")
    part = lambda c: F.sum(F.when(c, F.col("area")).otherwise(0.0))
    sums = {"total": F.sum("area"), "positive": part(F.col("tau") > 0), "negative": part(F.col("tau") < 0), "none": part(F.col("tau").isNull() | (F.col("tau") == 0))}
    out = long.groupBy("variable", "gfed").agg(*[c.alias(n) for n, c in sums.items()])
    out = with_whole(out, ["variable"], list(sums))
    return out.withColumns({f"{n}_pct": F.round(F.try_divide(n, "total") * 100, 1) for n in ("positive", "negative", "none")})


def class_area(cells: DataFrame, variable: Column | str = "variable") -> DataFrame:
    """Area of each class by variable and region, in percent of all and of valid area; classes that a region lacks have 0.

    Cells without a class are the class 'no_data', which has no share of the valid area.
    """
    named = cells.withColumn("class", F.coalesce(F.col("class").cast("string"), F.lit("no_data")))
    sums = named.groupBy("variable", "gfed", "class").agg(F.sum("area").alias("area"))
    grid = sums.select("variable", "gfed").distinct().crossJoin(F.broadcast(sums.select("class").distinct()))
    full = grid.join(sums, ["variable", "gfed", "class"], "left").withColumn("area", F.coalesce("area", F.lit(0.0)))
    by = Window.partitionBy("variable", "gfed")
    valid = F.when(F.col("class") != "no_data", F.col("area"))
    return full.withColumns(
        {
            "pct_total": F.round(F.try_divide(F.col("area"), F.sum("area").over(by)) * 100, 2),
            "pct_valid": F.round(F.try_divide(valid, F.sum(valid).over(by)) * 100, 2),
        }
    )
