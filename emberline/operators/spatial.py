"""Points in polygons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators import quadtree as Q
from emberline.operators.shape import complete
from emberline.sources import files

#: A cover up to this size is sent to every task; points meet a larger one by tile.
COVER_BYTES = 64 << 20
#: Points of a tile that one task holds at most, about, where they meet by tile.
TILE_POINTS = 200_000
_COVER = "polygon long, level int, x long, y long, inside boolean, corner boolean, edges array<double>"


def cover(polygons: DataFrame) -> DataFrame:
    """The cells of the quadtree of each polygon of ``polygons(polygon, parts)``, with the edges that its border cells hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("polygon")[i].as_py()
                cells = Q.cover(batch.column("parts")[i].as_py())
                for lo in range(0, len(cells), 10_000):
                    some = cells[lo : lo + 10_000]
                    level, x, y, inside, corner, edges = zip(*some)
                    flat = pa.ListArray.from_arrays(np.cumsum([0, *(4 * len(e) for e in edges)], dtype=np.int32), np.concatenate(edges).ravel())
                    columns = [pa.array([number] * len(some), pa.int64()), pa.array(level, pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(inside), pa.array(corner), flat]
                    yield pa.RecordBatch.from_arrays(columns, names=["polygon", "level", "x", "y", "inside", "corner", "edges"])

    return polygons.select("polygon", "parts").mapInArrow(run, _COVER)


def _lookup(cells: pa.Table) -> Q.Lookup:
    get = lambda c: cells.column(c).to_numpy()
    edges = cells.column("edges").combine_chunks()
    edges = edges if isinstance(edges, pa.Array) else pa.concat_arrays(edges.chunks)
    sizes = np.diff(edges.offsets.to_numpy()) // 4
    values = edges.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
    return Q.Lookup(*(get(c) for c in ("polygon", "level", "x", "y")), *(get(c).astype(bool) for c in ("inside", "corner")), sizes.astype(np.int64), values)


def _by_broadcast(points: DataFrame, cells: DataFrame) -> DataFrame:
    """A row for each point and polygon that holds it; the cells, of a checked size, go to every task once."""
    sent = points.sparkSession.sparkContext.broadcast(_lookup(cells.toArrow()))

    @F.arrow_udf("array<bigint>")
    def holding(x: pa.Array, y: pa.Array) -> pa.Array:
        at, polygon = sent.value.find(*(v.cast(pa.float64()).to_numpy(zero_copy_only=False) for v in (x, y)))
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(x)))]).astype(np.int32), polygon)

    return points.withColumn("__hits", holding("lon180", "lat")).select(*points.columns, F.explode_outer("__hits").alias("__polygon"))


def _by_tile(points: DataFrame, cells: DataFrame) -> DataFrame:
    """The same rows where points and cells meet by tile. A tile of many points is dealt to several groups, each with the tile's cells."""
    there = ~(F.isnan("lon180") | F.isnan("lat") | F.isnull("lon180") | F.isnull("lat"))
    tile = lambda c: F.floor(F.col(c).cast("double") / Q.TILE)
    keyed = points.filter(there).withColumns({"__tx": tile("lon180"), "__ty": tile("lat")})
    parts = files.stored(keyed.groupBy("__tx", "__ty").agg(F.ceil(F.count("*") / TILE_POINTS).cast("int").alias("__n")), "tiles")
    # a row for each tile with points: as many as the plane has tiles, 1035 on the globe
    keyed = keyed.join(parts, ["__tx", "__ty"]).withColumn("__part", F.pmod(F.xxhash64(*[c for c, kind in points.dtypes if "map<" not in kind]), F.col("__n")).cast("int"))
    keyed = keyed.select(*points.columns, "__tx", "__ty", "__part")
    in_tile = lambda c: F.expr(f"shiftright({c}, level)")
    dealt = cells.withColumns({"__tx": in_tile("x"), "__ty": in_tile("y")}).join(parts, ["__tx", "__ty"])
    dealt = dealt.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    width = len(points.columns)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = (left.column(c).cast(pa.float64()).to_numpy() for c in ("lon180", "lat"))
        at, polygon = _lookup(right).find(x, y) if right.num_rows else (np.zeros(0, np.int64),) * 2
        missed = np.setdiff1d(np.arange(left.num_rows), at)
        rows = left.take(pa.array(np.concatenate([at, missed]))).select(range(width))
        return rows.append_column("__polygon", pa.array([*polygon.tolist(), *[None] * len(missed)], pa.int64()))

    keys = ["__tx", "__ty", "__part"]
    schema = points.withColumn("__polygon", F.lit(None).cast("long")).schema
    met = keyed.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(meet, schema)
    return met.unionByName(points.filter(~there).withColumn("__polygon", F.lit(None).cast("long")))


def join_country(points: DataFrame, polygons: DataFrame, keep: list[str]) -> DataFrame:
    """``points(lat, lon180)`` with the columns ``keep`` of each polygon that covers them, null where none does.

    ``polygons`` has parts(array of rings of (x, y)). Each is covered by quadtree cells in the tasks that hold it; a point finds its cells by
    number and is tested against the few edges of border cells alone. Points on a common border belong to both polygons. A point
    without coordinates is in none; rings without a point, and null parts, cover nothing.
    """
    numbered = files.stored(polygons.select(F.monotonically_increasing_id().alias("polygon"), F.struct(*keep).alias("__keep"), "parts"), "polygons")
    cells = files.stored(cover(numbered), "cover")
    size = cells.agg(F.coalesce(F.sum(F.size("edges") * 8 + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    found = _by_broadcast(points, cells) if size <= COVER_BYTES else _by_tile(points, cells)
    # points in no polygon have negative numbers, so that they do not meet in one task
    named = found.withColumn("__polygon", F.coalesce("__polygon", -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))))
    return named.join(numbered.select(F.col("polygon").alias("__polygon"), "__keep"), "__polygon", "left").select(*points.columns, "__keep.*")


def country_counts(joined: DataFrame, keys: list[str], extra: list[list[str]]) -> DataFrame:
    """Annual totals by country, absent combinations 0, largest first."""
    flat = [c for k in extra for c in k]
    counts = joined.groupBy(*keys, *flat).agg(F.count("*").alias("count"))
    return complete(counts, [keys, *extra], {"count": 0}).orderBy(F.desc("count"), *keys, *flat)
