"""Tiles of cells against plain sets and maps of keys."""

import pytest
from emberline.operators import cells as K
from emberline.operators import hotspots as H
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

TENTHS = "lat_x10_int int, lon180_x10_int int"
CENTRES = "lat_ix int, lon_ix int"


def test_numbers_fill_the_grid(spark):
    rows = [(-900, -1800), (-900, 1800), (900, -1800), (900, 1800), (901, 0), (0, -1801), (None, 0)]
    got = [r[0] for r in spark.createDataFrame(rows, TENTHS).select(K.by_tenths("lat_x10_int", "lon180_x10_int")).collect()]
    assert got == [0, 3600, 1800 * 3601, 1801 * 3601 - 1, None, None, None] and got[3] < K.TILES * K.TILE
    rows = [(-9005, -5), (8995, 35995), (-8995, 5), (-8990, 5), (9005, 5), (5, None)]
    got = [r[0] for r in spark.createDataFrame(rows, CENTRES).select(K.by_centres("lat_ix", "lon_ix")).collect()]
    assert got == [0, 1801 * 3601 - 1, 3602, None, None, None]


@pytest.fixture(scope="module")
def detections(spark):
    # one cell holds a third of the rows; neighbours share its word and its tile
    return spark.sql(
        """SELECT id, IF(id % 3 = 0, 17, CAST(id % 1801 - 900 AS INT)) AS lat_x10_int, IF(id % 3 = 0, -63, CAST(id * 7 % 3601 - 1800 AS INT)) AS lon180_x10_int, 'x' AS words, 1 AS cell
        FROM range(6000) UNION ALL SELECT -1, NULL, 3, 'x', 1 UNION ALL SELECT -2, 2000, 3, 'x', 1"""
    )


def test_where_is_a_set(spark, detections):
    keys = [(17, -63), (17, -63), (-900, 1800), (-900, -1800), *((i % 1801 - 900, i * 7 % 3601 - 1800) for i in range(0, 6000, 7))]
    side = spark.createDataFrame([*keys, (None, 3), (2000, 3)], TENTHS)
    at = K.by_tenths("lat_x10_int", "lon180_x10_int")
    rows, there = detections.collect(), set(keys)
    for keep in (True, False):
        got = K.where(detections, at, side, at, keep)
        assert got.columns == detections.columns
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in rows if ((r["lat_x10_int"], r["lon180_x10_int"]) in there) == keep)
    assert K.where(detections, at, side.limit(0), at, False).count() == len(rows)
    assert K.where(detections, at, side.limit(0), at, True).count() == 0


def test_value_is_a_map(spark, detections):
    pairs = {(17, -63): 0, **{(i % 1801 - 900, i * 7 % 3601 - 1800): i % 255 for i in range(0, 6000, 7)}}
    side = spark.createDataFrame([(*k, v) for k, v in pairs.items()] + [(17, -63, 9), (5, 5, None)], TENTHS + ", gfed int")
    at = K.by_tenths("lat_x10_int", "lon180_x10_int")
    got = K.with_value(detections, at, side, at, "gfed")
    assert got.columns == [*detections.columns, "gfed"] and dict(got.dtypes)["gfed"] == "int"
    want = {r["id"]: pairs.get((r["lat_x10_int"], r["lon180_x10_int"])) for r in detections.collect()}
    assert {r["id"]: r["gfed"] for r in got.collect()} == {k: v for k, v in want.items() if v is not None}
    bad = spark.createDataFrame([(1, 1, 300)], TENTHS + ", gfed int")
    with pytest.raises(SparkRuntimeException, match="beyond 0 to 254"):
        K.with_value(detections, at, bad, at, "gfed").count()


def test_detections_are_not_shuffled(spark, detections):
    side = spark.createDataFrame([(5, 5, 3)], CENTRES + ", gfed int")
    points = spark.createDataFrame([(0.5, 0.5)], "lat double, lon180 double")
    keyed = detections.withColumns({"lat_ix": F.lit(5), "lon_ix": F.lit(5)}).select("id", "lat_x10_int", "lon180_x10_int", "lat_ix", "lon_ix")
    out = H.assign_region(H.mask_points(keyed, points), side)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    of_rows = [line for line in plan.splitlines() if "Exchange" in line and "id#" in line]
    assert not of_rows and out.count() == 6002
