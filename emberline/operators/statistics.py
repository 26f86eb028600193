"""Trends, correlations, tests and change points of many series.

Series are dealt to tasks by their keys and put in order there; a task takes them from the stream in blocks of bounded
rows, whatever its share is, and works on the series of a block as matrices of like lengths. Only a series itself has to fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions import series_stats as N


#: Rows of a block, unless one series has more.
BLOCK_ROWS = 100_000


def _blocks(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole series, in blocks of about BLOCK_ROWS rows, from batches in which the rows of a series follow each other."""
    held, rows = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows < BLOCK_ROWS:
            continue
        last = batch[keys].iloc[[-1]]
        ends = [pd.concat([held[0][keys].iloc[[0]], last]), pd.concat([batch[keys].iloc[[0]], last])]
        if len(ends[0].drop_duplicates()) == 1:
            continue  # one series so far
        whole = pd.concat(held, ignore_index=True)
        number = whole.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        cut = int(np.argmax(number == number[-1]))
        yield whole.iloc[:cut]
        held, rows = [whole.iloc[cut:]], len(whole) - cut
    if held:
        yield pd.concat(held, ignore_index=True)


def _matrices(pdf: pd.DataFrame, keys: list[str], cols: list[str]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """The distinct keys, and for each column a matrix of one row a key, filled with NaN at the end. Series are together with those of like length."""
    groups = pdf.groupby(keys, sort=False, dropna=False)
    row, slot = groups.ngroup().to_numpy(), groups.cumcount().to_numpy()
    sizes = np.bincount(row)
    kind = np.ceil(np.log2(sizes)).astype(int)
    first = np.flatnonzero(slot == 0)
    for k in np.unique(kind):
        mine = np.flatnonzero(kind == k)
        place = np.full(len(sizes), -1)
        place[mine] = np.arange(len(mine))
        at = np.flatnonzero(place[row] >= 0)
        out = []
        for c in cols:
            m = np.full((len(mine), sizes[mine].max()), np.nan)
            m[place[row[at]], slot[at]] = pdf[c].to_numpy(float)[at]
            out.append(m)
        yield pdf[keys].iloc[first[mine]].reset_index(drop=True), out


def by_series(df: DataFrame, keys: list[str], cols: list[str], names: list[str], f: Callable[..., np.ndarray]) -> DataFrame:
    """``keys`` and what ``f(matrix of each column)`` gives for each series, as doubles ``names``; NaN becomes null.

    Rows with a missing value are left out, and series without any row are absent. A series is in the order of the first of ``cols``.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches, keys):
            for held, matrices in _matrices(block, keys, cols):
                yield pd.concat([held, pd.DataFrame(f(*matrices), columns=names)], axis=1)

    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=cols)
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *cols)
    return ordered.mapInPandas(run, schema).withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def kendall_theilsen(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """tau, p, slope, intercept, lower and upper of each series."""
    names = ["tau", "p", "slope", "intercept", "lower", "upper"]
    return by_series(df, keys, [x, y], names, lambda a, b: np.column_stack([*N.kendall(a, b), N.theil_sen(a, b)]))


def grid_trend(df: DataFrame, keys: list[str], norm: bool = True, thresh: float = 0.6, year: str = "year", value: str = "value") -> DataFrame:
    """tau, p and slope of each cell; cells whose share of values 0 or 1 reaches ``thresh`` are left out.

    ``norm``: relative to the first value, or plus 1 where that is 0.
    """
    by = Window.partitionBy(*keys)
    held = df.filter(F.col(value).isNotNull())
    held = held.withColumn("__few", F.avg(F.col(value).isin(0, 1).cast("double")).over(by)).filter(F.col("__few") < thresh)
    if norm:
        first = F.first(value).over(by.orderBy(year))
        held = held.withColumn(value, F.when(first == 0, F.col(value) + 1).otherwise(F.col(value) / first))
    return kendall_theilsen(held, keys, year, value).select(*keys, "tau", "p", "slope")


def grid_corr(a: DataFrame, b: DataFrame, keys: list[str], stat: str = "pearson", diff: bool = False, year: str = "year") -> DataFrame:
    """Correlation of two stacks on their common years, optionally of the differences from year to year: stat and p."""
    both = a.select(*keys, year, F.col("value").alias("a")).join(b.select(*keys, year, F.col("value").alias("b")), [*keys, year]).dropna(subset=["a", "b"])
    if diff:
        w = Window.partitionBy(*keys).orderBy(year)
        both = both.withColumns({c: F.col(c) - F.lag(c).over(w) for c in ("a", "b")}).dropna(subset=["a", "b"])

    def pearson(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.array([N.linear_fit(p[~np.isnan(p)], q[~np.isnan(q)])[2:] for p, q in zip(x, y)])

    return by_series(both, keys, ["a", "b"], ["stat", "p"], pearson if stat == "pearson" else lambda x, y: np.column_stack(N.kendall(x, y)))


def pair_stats(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank trend and straight line of each panel."""

    def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fit = np.array([N.linear_fit(p[~np.isnan(p)], q[~np.isnan(q)]) for p, q in zip(a, b)])
        return np.column_stack([*N.kendall(a, b), N.theil_sen(a, b), fit])

    names = ["tau", "p", "slope", "intercept", "lower", "upper", "fit_slope", "fit_intercept", "fit_r", "fit_p"]
    return by_series(df, keys, [x, y], names, both).withColumns({n: F.round(n, 5) for n in names})


def segments(df: DataFrame, keys: list[str], change_points: DataFrame, year: str = "year") -> DataFrame:
    """Every row under segment ``all``, and under ``before`` (up to the change point) or ``after`` where its key has one."""
    both = df.join(change_points.select(*keys, "cp"), keys, "left")
    label = F.when(F.col(year) <= F.col("cp"), "before").when(F.col(year) > F.col("cp"), "after")
    return both.withColumn("segment", F.explode(F.array_compact(F.array(F.lit("all"), label)))).drop("cp")


def trend_table(df: DataFrame, keys: list[str], metrics: list[str], change_points: DataFrame, year: str = "year") -> DataFrame:
    """Trends of each metric and key, for all years and before and after its change point, to 6 decimals."""
    long = df.unpivot([*keys, year], metrics, "metric", "value")
    out = kendall_theilsen(segments(long, keys, change_points, year), [*keys, "metric", "segment"], year, "value")
    span = segments(long.dropna(subset=["value"]), keys, change_points, year).groupBy(*keys, "metric", "segment").agg(F.min(year).alias("year_start"), F.max(year).alias("year_end"))
    return out.join(span, [*keys, "metric", "segment"]).withColumns({n: F.round(n, 6) for n in ("tau", "p", "slope", "intercept", "lower", "upper")})


def split_trend(cells: DataFrame, keys: list[str], change_points: DataFrame) -> DataFrame:
    """Cell trends before and after the change point, each relative to its first value."""
    parts = segments(cells, keys, change_points).filter("segment <> 'all'")
    return grid_trend(parts, [*keys, "segment"], norm=True, thresh=1.01)


def change_points(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Break year with the least squared error of all, its 95 % limits and the rounded width of them; null where there is none."""

    def find(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.array([N.segmented(p[~np.isnan(p)], q[~np.isnan(q)]) for p, q in zip(a, b)])

    out = by_series(df, keys, [x, y], ["cp", "cp_lower", "cp_upper"], find)
    return out.withColumn("width", F.rint(F.col("cp_upper") - F.col("cp_lower")))


def valid_change_points(cps: DataFrame, first: int, last: int, width: float, whole: tuple[int, int] = (1986, 2016), strict: bool = True) -> DataFrame:
    """Change points in [first, last] whose limits lie in the whole period and are narrow enough (below ``width``, or up to it)."""
    narrow = F.col("cp_upper") - F.col("cp_lower")
    return cps.filter(
        F.col("cp").between(first, last) & (F.col("cp_lower") >= whole[0]) & (F.col("cp_upper") <= whole[1]) & ((narrow < width) if strict else (narrow <= width))
    )


def cp_overlap(cps: DataFrame, trends: DataFrame, keys: list[str], cut: float = 0.1) -> DataFrame:
    """Cells with a change point, with a trend, with both, and the shares in percent of the former."""
    t = trends.filter(F.col("p") < cut).select(*keys, F.lit(1).alias("t"))
    both = cps.select(*keys, F.lit(1).alias("c")).join(t, keys, "full")
    out = both.agg(F.count("c").alias("n_cp"), F.count("t").alias("n_trend"), F.count_if(F.col("c").isNotNull() & F.col("t").isNotNull()).alias("n_both"))
    return out.withColumn("percent", F.round(F.try_divide("n_both", "n_cp") * 100, 2))


def era_tests(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """For each key and metric: U of era 1 against era 2, its p, and p of equal spread."""
    long = df.unpivot([*keys, "era"], metrics, "metric", "value")

    def test(e: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = []
        for p, q in zip(e, v):
            a, b = q[p == 1], q[p == 2]
            out.append([*N.mann_whitney(a, b), N.levene(a, b)[1] if len(a) and len(b) else np.nan])
        return np.array(out)

    return by_series(long, [*keys, "metric"], ["era", "value"], ["u", "u_p", "levene_p"], test)
