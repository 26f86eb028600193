"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring; a row hashes to a place and belongs to the next point
clockwise. No shard takes more rows than its capacity: rows over it continue clockwise to the next points
until a shard has room. With ``slack`` 0 the capacities add up to the number of rows, so all shards end
full and their counts differ by one at most; a larger ``slack`` leaves room and moves fewer rows when a
shard is added.

The ring is cut into CELLS cells. Only the count of rows in each cell reaches the driver (CELLS numbers at
most, whatever the input); it walks the ring once and returns, for each cell, ranges of ranks and the shard
that takes them. Rows then need their rank within their cell: a cell of many rows is split by a row id into parts, a few
for each task, so that one doc_id on a third of all rows does not meet in one task.

Null doc_ids share one place of the ring; null texts have size 1 and the checksum of the empty text;
repeated rows are placed one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm import scratch

CELLS = 1 << 16
#: Rows of a cell that are ranked together at least, and parts for each shuffle partition.
PART, PARTS = 256, 4


def ring(shards: int, vnodes: int) -> list[int]:
    """For each cell of the ring, in clockwise order, the index of the point that it belongs to; and the points' shards."""
    points = sorted(
        (int.from_bytes(hashlib.sha256(f"shard {s} point {v}".encode()).digest()[:8], "big") % CELLS, s)
        for s in range(shards)
        for v in range(vnodes)
    )
    return points


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """``slack`` 0: shares of ``rows`` that differ by one at most; else the same bound for all."""
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [math.ceil((1 + slack) * rows / shards)] * shards


def plan(counts: dict[int, int], shards: int, vnodes: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first) for the rows of each cell.

    A range is cut only where a shard becomes full, so there are at most CELLS + shards of them.
    """
    points = ring(shards, vnodes)
    places = [p for p, _ in points]
    room = capacities(sum(counts.values()), shards, slack)
    used = [0] * shards
    todo = [(cell, 0, n, bisect.bisect_left(places, cell) % len(points)) for cell, n in sorted(counts.items())]
    out = []
    while todo:
        over = []
        for cell, lo, hi, at in todo:
            shard = points[at][1]
            take = min(hi - lo, room[shard] - used[shard])
            if take:
                out.append((cell, lo, lo + take, shard, used[shard]))
                used[shard] += take
            if lo + take < hi:
                over.append((cell, lo + take, hi, (at + 1) % len(points)))
        todo = over
    return out


def assign(docs: DataFrame, shards: int = 16, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) for every row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64("doc_id"), 48).cast("int").alias("cell"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "sharding",
    )
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    # parts of the few cells that are too large for one task
    part = max(PART, sum(counts.values()) // (PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    large = {c: -(-n // part) for c, n in counts.items() if n > part}
    parts = F.broadcast(spark.createDataFrame([*large.items()], "cell int, parts int"))
    rows = rows.join(parts, "cell", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("uid"), F.col("parts")), F.lit(0)).cast("int")
    )
    before = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        rows.filter("parts IS NOT NULL")
        .groupBy("cell", "part")
        .agg(F.count("*").alias("n"))
        .select("cell", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    order = Window.partitionBy("cell", "part").orderBy("doc_id", "text_crc32", "size", "uid")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.join(F.broadcast(bases), ["cell", "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("base", F.lit(0)))
    ranges = spark.createDataFrame(
        plan(counts, shards, vnodes, slack), "cell int, lo long, hi long, shard int, start long"
    )
    return ranked.join(F.broadcast(ranges), "cell").filter("rank >= lo AND rank < hi").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - F.col("lo")).alias("slot")
    )
