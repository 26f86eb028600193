import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from emberline import schemas as S
from emberline.functions import scalars as X
from emberline.operators import agreement, calendar, climate, grid, matching, scenes, season, shape, spatial, statistics
from emberline.sources import files
from pyspark.sql import functions as F


def solar(dt, lon):
    days = 366 if dt.year % 4 == 0 and (dt.year % 100 or dt.year % 400 == 0) else 365
    g = 2 * math.pi / days * (dt.timetuple().tm_yday - 1 + (dt.hour - 12) / 24)
    eq = 229.18 * (0.000075 + 0.001868 * math.cos(g) - 0.032077 * math.sin(g) - 0.014615 * math.cos(2 * g) - 0.040849 * math.sin(2 * g))
    return datetime(dt.year, dt.month, dt.day) + timedelta(minutes=dt.hour * 60 + dt.minute + dt.second / 60 + eq + 4 * lon)


def test_solar_time_at_edges(spark):
    rows = [(datetime(2000, 2, 29, 12), 0.0), (datetime(1999, 12, 31, 23, 59, 30), 179.95), (datetime(2001, 1, 1, 0), -180.0), (datetime(1900, 3, 1, 5), 10.5)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, lon double").withColumn("s", X.local_solar_time("t", "lon"))
    for r in df.collect():
        assert abs(r.s - solar(r.t, r.lon)) < timedelta(microseconds=2)


def test_keys_and_longitudes(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (-0.25,), (179.95,), (180.0,), (359.95,), (0.0,), (89.99,)], "v double")
    got = df.select("v", X.cell_key_x10("v").alias("k"), X.cell_centre_key("v").alias("c"), X.lon360_to_180("v").alias("l")).collect()
    for r in got:
        assert r.k == int(np.round(r.v * 10)) and r.c == int(round(float(np.round(r.v + 0.05, 1) - 0.05) * 100))
        assert r.l == (r.v - 360 if r.v >= 180 else r.v)
    bad = spark.createDataFrame([(float("nan"),), (-1e30,), (2.0,), (None,)], "v double")
    assert [r[0] for r in bad.select(X.missing_if_bad("v")).collect()] == [None, None, 2.0, None]


def test_names(spark):
    df = spark.createDataFrame([("NL.D01365.S2310.E0050.B1.GC",), ("odd",)], "fn string")
    a, b = df.select(X.orbit_name("fn").alias("n"), X.orbit_time_range("fn").alias("t")).collect()
    assert a.n.sat == "NL" and a.n.day_number == 365
    assert a.t.start == datetime(2001, 12, 31, 23, 10) and a.t.end == datetime(2002, 1, 1, 0, 50)
    assert b.t.start is None and b.n.start is None


def test_early_january_counts_twice(spark):
    df = spark.createDataFrame([("2001-01-02",), ("2001-01-04",), ("2000-12-31",)], "d string").select(F.to_date("d").alias("date_lst"))
    got = sorted((str(r.date_lst), r.comp_period) for r in calendar.join_periods(df).collect())
    assert got == [("2000-12-31", 46), ("2001-01-02", 1), ("2001-01-02", 46), ("2001-01-04", 1)]


def test_complete_has_the_product_of_keys(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 7)], "y int, r string, count long")
    full = shape.complete(df, [["y"], ["r"]], {"count": 0})
    assert full.count() == 4 and full.agg(F.sum("count")).first()[0] == 12


def test_season_of_a_circular_year(spark):
    rows = [("A", p, float(10 if p in (45, 46, 1, 2) else 0)) for p in range(1, 47)] + [("B", p, 0.0) for p in range(1, 47)]
    df = spark.createDataFrame(rows, "gfed_name string, comp_period int, mean double")
    keys = ["gfed_name"]
    s = season.fire_season(season.fire_year_order(df, keys, "mean"), keys, "mean")
    got = {r.gfed_name: r for r in season.season_summary(s, keys, "mean").collect()}
    a = got["A"]
    assert (a.season_start, a.year_min, a.year_max, a.season_len) == (45, 3, 45, 3) and a.season_end == 1
    assert (got["B"].season_start, got["B"].season_end, got["B"].season_len) == (-9999, -9999, 0)
    smooth = {(r.gfed_name, r.comp_period): r.mean_smooth for r in season.smooth_circular(df, keys, ["mean"]).collect()}
    assert smooth["A", 1] == 10 and smooth["A", 46] == 10 and smooth["A", 3] == pytest.approx(10 / 3) and len(smooth) == 92


def test_grid_edges_and_totals(spark):
    df = spark.createDataFrame([(2000, 90.0, 359.99), (2000, -90.0, 0.0), (2000, 89.95, 359.95)], "year int, lat double, lon360 double")
    g = grid.grid_counts(df)
    assert {(r.y, r.x): r.value for r in g.collect()} == {(0, 3599): 2.0, (1799, 0): 1.0}
    assert grid.grid_totals(g).first().total == 3
    assert {(r.y, r.x) for r in grid.roll(g, 3600).collect()} == {(0, 1799), (1799, 1800)}


def test_resampling_gives_each_target_its_centre(spark):
    g = spark.createDataFrame([(y, x, float(10 * y + x)) for y in range(4) for x in range(6)], "y int, x int, value double")
    got = {(r.y, r.x): r.value for r in grid.resample_nearest(g, [], 0.5, 0.2, 3.0, 2.0).collect()}
    assert len(got) == 10 * 15
    for (y, x), v in got.items():
        assert v == 10 * math.floor((y + 0.5) * 0.2 / 0.5 + 1e-12) + math.floor((x + 0.5) * 0.2 / 0.5 + 1e-12)


def test_modes_agree_unless_tied(spark):
    df = spark.createDataFrame([(0, 0, 5), (0, 1, 5), (0, 2, 3), (1, 1, 3), (4, 4, 1)], "y int, x int, class int")
    plain = {(r.y, r.x): r["class"] for r in grid.coarsen_mode(df, 3, 0.1).collect()}
    centred = {(r.y, r.x): r["class"] for r in grid.coarsen_mode(df, 3, 0.1, centred=True).collect()}
    assert plain == {(0, 0): 3, (1, 1): 1} and centred[0, 0] == 3  # pixel (1, 1) is the centre and of class 3


def test_season_days_without_data(spark):
    df = spark.createDataFrame([("d", 0, 0, 2000, 1.0), ("d", 0, 0, 2000, 3.0), ("d", 0, 0, 2001, None), ("d", 0, 1, 2000, None)], "dataset string, y int, x int, year int, value double")
    assert {(r.x, r.year): r.value for r in climate.season_days(df).collect()} == {(0, 2000): 1.0, (0, 2001): 0.0}
    assert [r.mean for r in climate.annual_stats(df).orderBy("x", "year").collect()] == [2.0, None, None]
    e = climate.ensemble_mean(spark.createDataFrame([("a", 1, 0, 0, 1.0), ("b", 1, 0, 0, 3.0), ("a", 1, 0, 1, 1.0)], "dataset string, year int, y int, x int, value double"), ["a", "b"], "m")
    assert {r.x: r.value for r in e.collect()} == {0: 2.0, 1: None}


def all_pairs(rows, hours=6):
    """Whether each row has one of the other sensor in its cell of 2 degrees and within the time, pair by pair."""
    return {r[0]: int(r[2] is not None and any(q[1] != r[1] and q[2] is not None and abs(q[2] - r[2]) <= timedelta(hours=hours) and q[3] // 2 == r[3] // 2 and q[4] // 2 == r[4] // 2 for q in rows)) for r in rows}


@pytest.mark.parametrize("minutes", [4000, 40_000])
def test_matching_by_all_pairs(spark, minutes):
    rng = np.random.default_rng(4)
    t0 = datetime(2005, 6, 1)
    rows = [(i, "truth" if i % 2 else "test", t0 + timedelta(minutes=int(rng.integers(0, minutes))), float(rng.integers(0, 4)), float(rng.integers(0, 4))) for i in range(400)]
    rows += [(1000, "truth", t0, 50.0, 50.0), (1001, "test", t0 + timedelta(hours=6), 50.0, 50.0), (1002, "truth", t0 + timedelta(hours=12, microseconds=1), 50.0, 50.0), (1003, "test", None, 50.0, 50.0)]
    df = matching.with_cells(spark.createDataFrame(rows, "event_id long, sensor string, ts timestamp_ntz, lat double, lon180 double"), 2)
    a, b = matching.match_detections(df.filter("sensor = 'truth'"), df.filter("sensor = 'test'").withColumn("more", F.lit(1)))
    assert b.columns == [*df.columns, "more", "matched"]
    want = all_pairs(rows)
    assert {r.event_id: r.matched for r in a.collect() + b.collect()} == want and want[1001] == 1 and want[1002] == 0
    truth = "sensor = 'truth'"
    both = matching.match_sensors(df, truth)
    assert {r.event_id: r.matched for r in both.collect()} == want
    assert all(r.tp + max(r.fn, r.fp) == 1 for r in matching.match_cells(both, truth).collect())
    rates = matching.error_rates(both, truth, ["lat_bin"]).collect()
    assert sum(r.tp + r.fn for r in rates) + sum(r.fp for r in rates) <= len(rows)


def test_matching_with_a_third_of_the_rows_in_one_cell(spark):
    """A cell with a third of all rows, most of them at a few times, does not meet in one task."""
    rows = spark.sql(
        """SELECT id AS event_id, id % 2 = 0 AS truth, IF(id % 3 = 0, 1, id % 50) AS lat_bin, IF(id % 3 = 0, 1, id % 7) AS lon_bin,
        CAST(IF(id % 3 = 0, id % 12 * 7200, id * 997 % 9000000) AS DOUBLE) AS sec FROM range(60000)"""
    )
    out = matching.match_sensors(rows, "truth")
    assert out.count() == 60000 and out.filter("lat_bin = 1 AND lon_bin = 1 AND event_id % 3 = 0 AND matched = 0").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    windows = [line for line in plan.splitlines() if "Window " in line or "Window [" in line]
    assert windows and all("event_id" not in line for line in windows)  # windows run over distinct times, not rows


def test_polygon_with_a_hole(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    parts = [ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((4, 4), (6, 4), (6, 6), (4, 6))]
    polys = spark.createDataFrame([("P", parts)], "admin string, parts array<array<struct<x:double,y:double>>>")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 20.0, 5.0), (4, 0.0, 5.0), (5, 3.0, 9.5), (6, None, 1.0)], "id int, lon180 double, lat double")
    got = {r.id: r.admin for r in spatial.join_country(pts, polys, ["admin"]).collect()}
    assert got == {1: "P", 2: None, 3: None, 4: "P", 5: "P", 6: None}


def scene(n=20):
    rng = np.random.default_rng(1)
    b3, b4 = 290 + rng.random((n, n)), 288 + rng.random((n, n))
    b3[10, 10] = 330.0  # fire
    b3[0, 0] = 329.0  # fire at the edge
    b4[15:18, 2:6] = 250.0  # cloud
    return b3, b4


def test_detection_on_a_small_scene(spark):
    b3, b4 = scene()
    rows = [("f", y, x, float(b3[y, x]), float(b4[y, x]), float(b3[y, x] - b4[y, x])) for y in range(20) for x in range(20)]
    px = spark.createDataFrame(rows, "fn string, y int, x int, b3 double, b4 double, b34 double")
    found = scenes.detect(px, segments=1, tiles=2).cache()
    fires = {(r.y, r.x) for r in found.filter("status = 'fire'").collect()}
    assert {(10, 10), (0, 0)} <= fires
    assert found.filter("cloud = 1").count() == 12 and found.filter("cloud_buffered = 1").count() == 30
    s = scenes.segment_summary(found).first()
    assert s.total_pxl == 400 and s.candidates == s.fires + s.not_fires + s.undetermined
    lines = spark.createDataFrame([("f", y, y / 2) for y in range(20)], "fn string, y int, line_time double")
    assert {r.line_time for r in scenes.extract_fires(found, lines).filter("x = 10 AND y = 10").collect()} == {5.0}


def plain_context(b3, b34, candidate, cloud, conf):
    """The contextual test one candidate, window and pixel at a time."""
    out = {}
    for y, x in zip(*np.nonzero(candidate == 1)):
        out[int(y), int(x)] = "undetermined"
        for reach in range(2, 8):
            around = [(i, j) for i in range(max(0, y - reach), min(b3.shape[0], y + reach + 1)) for j in range(max(0, x - reach), min(b3.shape[1], x + reach + 1)) if max(abs(i - y), abs(j - x)) > 1 and b3[i, j] == b3[i, j]]
            good = [p for p in around if candidate[p] == 0 and cloud[p] == 0]
            if around and len(good) / len(around) > conf["background"]:
                passed = True
                for band in (b34, b3):
                    v = np.array([band[p] for p in good])
                    spread = np.abs(v - v.mean()).mean()
                    passed &= bool(band[y, x] >= v.mean() + (conf["factor"] + spread if spread < 1 else conf["factor"] * spread))
                out[int(y), int(x)] = "fire" if passed else "not fire"
                break
    return out


@pytest.mark.parametrize("seed", range(6))
def test_contextual_test_by_pixels(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    shape = int(rng.integers(5, 60)), int(rng.integers(5, 40))
    b3, b34 = rng.normal(300, 2 if seed % 2 else 0.5, shape), rng.normal(8, 1.5, shape)
    candidate, cloud = (rng.random(shape) < 0.08).astype(float), (rng.random(shape) < seed / 8).astype(float)
    hot = (candidate == 1) & (rng.random(shape) < 0.5)
    b3[hot] += 20
    b34[hot] += 15
    b3[rng.random(shape) < 0.1] = np.nan
    want = plain_context(b3, b34, candidate, cloud, S.SCENE)
    monkeypatch.setattr(scenes, "CANDIDATES", 5)
    assert {(y, x): s for y, x, s in scenes.contextual_test(b3, b34, candidate, cloud)} == want
    monkeypatch.setattr(scenes, "CONTEXT_ROWS", 9)
    rows = [("f", 0, y, x, None if np.isnan(b3[y, x]) else float(b3[y, x]), float(b34[y, x]), int(candidate[y, x]), int(cloud[y, x])) for y in range(shape[0]) for x in range(shape[1])]
    px = spark.createDataFrame(rows, "fn string, subset_no int, y int, x int, b3 double, b34 double, candidate int, cloud_buffered int")
    got = scenes.contextual_fires(px).collect()
    assert len(got) == len(want) and {(r.y, r.x): r.status for r in got} == want
    assert seed or {"fire", "not fire"} <= set(want.values())


def test_contextual_window_without_background():
    n = 9
    cloud = np.ones((n, n))
    cloud[4, 4] = 0
    candidate = np.zeros((n, n))
    candidate[4, 4] = 1
    assert scenes.contextual_test(np.full((n, n), 300.0), np.full((n, n), 9.0), candidate, cloud) == [(4, 4, "undetermined")]


def test_stitching(spark):
    rows = [("N", "a", i, float(i), i != 8, float(i)) for i in range(10)] + [("N", "b", i, i + 6.2, True, 100.0 + i) for i in range(10)]
    df = spark.createDataFrame(rows, "platform string, fn string, y int, t double, ok boolean, value double")
    got = scenes.stitch_orbits(df).orderBy("t").collect()
    times = [r.t for r in got]
    assert times == sorted(times) and len(got) == 10 + 7
    mended = next(r for r in got if r.fn == "a" and r.y == 8)
    assert mended.ok and mended.used_fn == "b" and mended.value == 102.0


@pytest.mark.parametrize("seed", range(3))
def test_stitching_by_all_pairs(spark, seed):
    """Two long files that overlap, with many bad lines, equal times and lines on the edges of stretches of time."""
    rng = np.random.default_rng(seed)
    lines = [("N", "a", i, float(t), bool(rng.random() < 0.5), float(i)) for i, t in enumerate(np.sort(rng.integers(0, 800, 300)) / 2)]
    lines += [("N", "b", 1000 + i, 200 + float(t), bool(rng.random() < 0.4), 1000.0 + i) for i, t in enumerate(np.sort(rng.integers(0, 900, 300)) / 4)]
    lines += [("N", "b", 2000, 255.75, True, 2000.0), ("N", "b", 2001, 256.25, True, 2001.0), ("N", "a", 2002, 256.0, False, 2002.0)]
    got = {(r.fn, r.y): (r.ok, r.used_fn, r.value) for r in scenes.stitch_orbits(spark.createDataFrame(lines, "platform string, fn string, y int, t double, ok boolean, value double")).collect()}
    end, start = max(r[3] for r in lines if r[1] == "a"), min(r[3] for r in lines if r[1] == "b")
    want = {}
    for _, fn, y, t, ok, value in lines:
        if fn == "b" and t <= end:
            continue
        near = [(abs(t - r[3]), r[3], r[5]) for r in lines if r[1] == "b" and r[4] and abs(t - r[3]) <= 0.5] if fn == "a" and not ok and t >= start else []
        want[fn, y] = (True, "b", min(near)[2]) if near else (ok, fn, value)
    assert got == want and want["a", 2002] == (True, "b", min((abs(256.0 - r[3]), r[3], r[5]) for r in lines if r[1] == "b" and r[4])[2])
    assert sum(v[1] == "b" and k[0] == "a" for k, v in want.items()) > 20


def test_each_orbit_is_worked_on_once(spark, tmp_path):
    px = spark.createDataFrame([(i % 6, float(i)) for i in range(60)], "fn long, v double")
    folder = str(tmp_path)

    def one(pdf):
        with open(f"{folder}/{pdf['fn'].iloc[0]}", "a") as f:
            f.write("x")
        if pdf["fn"].iloc[0] == 5:
            raise KeyError("no band")
        return pdf.head(0 if pdf["fn"].iloc[0] == 4 else 2)

    good, failed = scenes.process_orbits(px, one, "fn long, v double")
    assert good.count() == 8 and failed.count() == 1 and good.unionByName(failed, allowMissingColumns=True).count() == 9
    assert [(r.fn, r.error) for r in failed.collect()] == [(5, "KeyError: 'no band'")]
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {str(i): "x" for i in range(6)}


def test_failed_orbits_are_logged(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "fn string, v double")

    def one(pdf):
        if (pdf.v < 0).any():
            raise ValueError("negative")
        return pdf

    good, failed = scenes.process_orbits(df, one, "fn string, v double")
    assert [r.fn for r in good.collect()] == ["a"] and [(r.fn, r.error) for r in failed.collect()] == [("b", "ValueError: negative")]


def test_trend_table_and_change_points(spark):
    rows = [("r", y, float(y if y < 2003 else 2003 - 3 * (y - 2003)) + 0.01 * (y % 3)) for y in range(1986, 2017)]
    df = spark.createDataFrame(rows, "gfed string, year int, v double")
    cps = statistics.change_points(df, ["gfed"], "year", "v")
    assert abs(cps.first().cp - 2003) < 0.5
    t = {r.segment: r for r in statistics.trend_table(df, ["gfed"], ["v"], cps).collect()}
    assert t["before"].tau > 0.9 and t["after"].tau < -0.9 and (t["all"].year_start, t["all"].year_end) == (1986, 2016)
    assert statistics.valid_change_points(cps, 1993, 2009, 10).count() == 1


def test_areas_add_up(spark):
    df = spark.createDataFrame([(1, 2.0, 0.3, 1), (1, 1.0, -0.1, None), (2, 4.0, None, 2)], "gfed int, area double, tau double, class int")
    for r in agreement.signed_area(df, ["tau"]).collect():
        assert r.positive + r.negative + r.none == pytest.approx(r.total)
    c = agreement.class_area(df.withColumn("variable", F.lit("v")))
    assert c.agg(F.sum("area")).first()[0] == 7.0 and c.count() == 2 * 3


def test_platform_years():
    assert sum(b - a + 1 for a, b in S.SATELLITE_YEARS.values()) == 23
