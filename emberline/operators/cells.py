"""Lookups in tables of 0.1 degree cells, held as tiles of packed words.

A table of cells, whatever its number of rows, says one thing about each cell of a grid of a fixed size. It is packed into
words of 64 bits, a bit or a byte a cell, and the words into tiles of TILE cells: 0.8 MB of bits or 6.5 MB of bytes for
the whole globe, which is the bound of what is broadcast. Detections find their cell by its tile and position; they are
not shuffled, and a cell with many of them is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells from south to north and from west to east, both ends included, and cells of a tile.
ROWS, COLUMNS, TILE = 1801, 3601, 4096
TILES = -(-ROWS * COLUMNS // TILE)
MOST = 254


def by_tenths(lat: str, lon: str) -> Column:
    """The number of the cell of keys in tenths of a degree, north and east; null outside the grid."""
    return _number(F.col(lat) + 900, F.col(lon) + 1800)


def by_centres(lat: str, lon: str) -> Column:
    """The number of the cell of centre keys in hundredths of a degree (ending in 5), longitudes from 0; null outside the grid."""
    y, x = F.col(lat) + 9005, F.col(lon) + 5
    return F.when((y % 10 == 0) & (x % 10 == 0), _number(F.floor(y / 10), F.floor(x / 10)))


def _number(y: Column, x: Column) -> Column:
    return F.when(y.between(0, ROWS - 1) & x.between(0, COLUMNS - 1), y.cast("long") * COLUMNS + x)


def _tiles(packed: DataFrame, bits: int) -> DataFrame:
    """(__at, __words) from (cell, value) with values of ``bits`` bits. Blank words make every tile dense."""
    words = TILE * bits // 64
    place = packed.select(F.expr(f"cell * {bits} DIV 64").alias("word"), F.expr(f"shiftleft(CAST(value AS BIGINT), CAST(cell * {bits} % 64 AS INT))").alias("held"))
    blank = packed.sparkSession.range(TILES * words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("held"))
    dense = place.unionByName(blank).groupBy("word").agg(F.bit_or("held").alias("held"))
    tile = F.expr(f"word DIV {words}").alias("__at")
    return dense.groupBy(tile).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "held"))), lambda w: w["held"]).alias("__words"))


def _held(bits: int) -> str:
    """SQL for the value of ``__cell`` in ``__words``."""
    at = f"__cell % {TILE} * {bits}"
    return f"shiftrightunsigned(__words[CAST({at} DIV 64 AS INT)], CAST({at} % 64 AS INT)) & {(1 << bits) - 1}"


def _placed(df: DataFrame, cell: Column) -> DataFrame:
    """``df`` with the cell, generated as a one-element array: a plain column would be copied, through all that it is made of, into every use and pushed filter."""
    return df.select("*", F.explode(F.array(cell)).alias("__cell"))


def _tiled(df: DataFrame, cell: Column) -> DataFrame:
    return _placed(df, cell).withColumn("__tile", F.expr(f"__cell DIV {TILE}"))


def _known(cells: DataFrame, number: Column, value: Column) -> DataFrame:
    """(cell, value) of the cells that are on the grid."""
    return _placed(cells.withColumn("__held", value), number).select(F.col("__cell").alias("cell"), F.col("__held").alias("value")).filter("cell IS NOT NULL")


def where(df: DataFrame, cell: Column, cells: DataFrame, number: Column, there: bool) -> DataFrame:
    """The rows of ``df`` whose ``cell`` is (or, without ``there``, is not) the ``number`` of one of ``cells``. A null cell is none of them."""
    marked = _tiles(_known(cells, number, F.lit(1)), 1)
    match = (F.col("__tile") == F.col("__at")) & F.expr(f"{_held(1)} = 1")
    return _tiled(df, cell).join(F.broadcast(marked), match, "left_semi" if there else "left_anti").drop("__cell", "__tile")


def with_value(df: DataFrame, cell: Column, cells: DataFrame, number: Column, value: str) -> DataFrame:
    """The rows of ``df`` whose ``cell`` has a ``value`` in ``cells``, with it.

    Values are whole numbers from 0 to MOST, anything else is an error; a cell with several has the smallest, null ones are none.
    """
    fits = F.col(value).between(0, MOST)
    checked = F.when(fits, F.col(value)).otherwise(F.raise_error(F.concat(F.lit(f"{value} of a cell beyond 0 to {MOST}: "), F.col(value).cast("string"))).cast("int"))
    known = _known(cells.filter(F.col(value).isNotNull()).withColumn("__value", checked), number, F.col("__value"))
    one = known.groupBy("cell").agg((F.min("value") + 1).alias("value"))
    joined = _tiled(df, cell).join(F.broadcast(_tiles(one, 8)), F.col("__tile") == F.col("__at"))
    kind = cells.schema[value].dataType
    return joined.withColumn(value, (F.expr(_held(8)) - 1).cast(kind)).filter(F.col(value) >= 0).drop("__cell", "__tile", "__at", "__words")
