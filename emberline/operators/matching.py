"""Detections of two sensors matched in place and time, and error rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalars import grid_bin


def with_cells(df: DataFrame, size: float) -> DataFrame:
    """lat_bin, lon_bin, and seconds of the time."""
    return df.withColumns({"lat_bin": grid_bin("lat", size), "lon_bin": grid_bin("lon180", size), "sec": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6})


def match_sensors(rows: DataFrame, truth: str, hours: float = 6.0, keys: list[str] | None = None) -> DataFrame:
    """``rows`` of both sensors with ``matched`` (0 or 1): whether the other one has a row in the same cell and within ``hours``.

    ``truth`` is the SQL condition of a row of the first sensor. Rows first become the distinct times of each cell, with what is there at a time, so that a
    time that many rows share is one. These are put in order within chunks of ``hours``; the last time of each sensor up to
    a time and the first from it on are carried along the order, and over the edges of a chunk from
    the nearest one with any. A match is then a difference of two columns; nothing is joined by a range, and each row meets
    its own cell and time once. Rows without a cell or a time match nothing.
    """
    keys, truth = ["lat_bin", "lon_bin", *(keys or [])], F.coalesce(F.expr(truth), F.lit(False))
    width = hours * 3600
    known = [F.col(k).isNotNull() for k in (*keys, "sec")]
    times = rows.filter(reduce(lambda a, b: a & b, known)).groupBy(*keys, "sec").agg(F.max(truth).alias("__t"), F.max(~truth).alias("__s"))
    times = times.withColumn("__chunk", F.floor(F.col("sec") / width))
    inside = Window.partitionBy(*keys, "__chunk").orderBy("sec")
    cell = Window.partitionBy(*keys).orderBy("__chunk")
    before, after = (Window.unboundedPreceding, Window.currentRow), (Window.currentRow, Window.unboundedFollowing)
    at = {c: F.when(F.col(c), F.col("sec")) for c in ("__t", "__s")}
    edges = times.groupBy(*keys, "__chunk").agg(*[f(at[c]).alias(f"{c}{n}") for c in at for f, n in ((F.max, "_last"), (F.min, "_first"))])
    carried = {f"{c}_before": F.last(f"{c}_last", True).over(cell.rowsBetween(Window.unboundedPreceding, -1)) for c in at}
    carried |= {f"{c}_after": F.first(f"{c}_first", True).over(cell.rowsBetween(1, Window.unboundedFollowing)) for c in at}
    edges = edges.select(*keys, "__chunk", *[v.alias(k) for k, v in carried.items()])
    near = {f"{c}_near": F.least(
        F.col("sec") - F.coalesce(F.last(at[c], True).over(inside.rowsBetween(*before)), F.col(f"{c}_before")),
        F.coalesce(F.first(at[c], True).over(inside.rowsBetween(*after)), F.col(f"{c}_after")) - F.col("sec"),
    ) for c in at}
    flags = times.join(edges, [*keys, "__chunk"]).select(*keys, "sec", *[(v <= width).cast("int").alias(k) for k, v in near.items()])
    joined = rows.join(flags, [*keys, "sec"], "left")
    return joined.select(*rows.columns, F.coalesce(F.when(truth, F.col("__s_near")).otherwise(F.col("__t_near")), F.lit(0)).alias("matched"))


def match_detections(truth: DataFrame, test: DataFrame, hours: float = 6.0, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``matched`` (0 or 1), as :func:`match_sensors` finds it."""
    of = ["lat_bin", "lon_bin", *(keys or []), "sec"]
    both = [df.select(*of, F.lit(side).alias("__truth"), F.struct(*df.columns).alias(name)) for df, side, name in ((truth, True, "__a"), (test, False, "__b"))]
    done = match_sensors(both[0].unionByName(both[1], allowMissingColumns=True), "__truth", hours, keys)
    return done.filter("__truth").select("__a.*", "matched"), done.filter("NOT __truth").select("__b.*", "matched")


def error_rates(matched: DataFrame, truth: str, keys: list[str]) -> DataFrame:
    """TP, FN, FP and both error rates by ``keys`` that both sensors have; null where nothing could be wrong."""
    truth, hit = F.expr(truth), F.col("matched") == 1
    sums = matched.groupBy(*keys).agg(
        F.count_if(truth & hit).alias("tp"), F.count_if(truth & ~hit).alias("fn"), F.count_if(~truth & ~hit).alias("fp"),
        F.count_if(truth).alias("__a"), F.count_if(~truth).alias("__b"),
    )
    return _rates(sums.filter("__a > 0 AND __b > 0").drop("__a", "__b"))


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns({"omission": F.try_divide("fn", F.col("tp") + F.col("fn")), "commission": F.try_divide("fp", F.col("tp") + F.col("fp"))})


def match_cells(matched: DataFrame, truth: str) -> DataFrame:
    """Flags of each cell: tp if any of its detections match, else fn and fp for what is there unmatched."""
    truth = F.expr(truth)
    sums = matched.groupBy("lat_bin", "lon_bin").agg(F.max(F.when(truth, F.col("matched"))).alias("hit"), F.max((~truth).cast("int")).alias("there"))
    hit = F.coalesce(F.col("hit") == 1, F.lit(False))
    return sums.select("lat_bin", "lon_bin", hit.cast("int").alias("tp"), (F.col("hit").isNotNull() & ~hit).cast("int").alias("fn"), ((F.col("there") == 1) & ~hit).cast("int").alias("fp"))


def mean_errors(rates: DataFrame, keys: list[str]) -> DataFrame:
    return rates.groupBy(*keys).agg(F.avg("omission").alias("omission"), F.avg("commission").alias("commission"))
