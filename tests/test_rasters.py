"""Arrays read by strips and written in order."""

import numpy as np
import pytest
from emberline.sources import rasters


@pytest.fixture
def arrays(tmp_path):
    rng = np.random.default_rng(3)
    made = {"plain": rng.random((40, 60)), "columns": np.asfortranarray(rng.random((40, 60))), "small": rng.integers(-5, 5, (3, 4)).astype("<i2"), "swapped": rng.random((7, 5)).astype(">f4"), "none": np.zeros((0, 9))}
    made["plain"][3:30, 2] = np.nan
    for k, a in made.items():
        np.save(tmp_path / f"{k}.npy", a)
    (tmp_path / "notes.txt").write_text("not an array")
    return tmp_path, made


def cells_of(a):
    return {(y, x): float(a[y, x]) for y in range(a.shape[0]) for x in range(a.shape[1]) if a[y, x] == a[y, x]}


@pytest.mark.parametrize("size", [1, 1000, 1 << 24])
def test_strips_cover_every_cell_once(arrays, size):
    folder, made = arrays
    tasks = rasters.plan([rasters.header(str(p)) for p in sorted(folder.glob("*.npy"))], size)
    got = {k: {} for k in made}
    for task in tasks:
        for s in task:
            assert len(task) == 1 or sum(t.count for t in task) * 8 <= 60 * 8 * size
            for b in rasters.decode(s):
                for r in b.to_pylist():
                    name = r["path"].rsplit("/", 1)[1][:-4]
                    assert (r["y"], r["x"]) not in got[name] and (r["height"], r["width"]) == made[name].shape
                    got[name][r["y"], r["x"]] = r["value"]
    assert got == {k: cells_of(a) for k, a in made.items()}
    assert len(tasks) == 1 if size > 1 << 20 else len(tasks) > 20


def test_read_with_coordinates(spark, arrays):
    folder, made = arrays
    df = rasters.read_rasters(spark, str(folder), strip_bytes=500)
    assert df.rdd.getNumPartitions() > 50
    rows = df.filter("path LIKE '%plain.npy'").collect()
    assert {(r.y, r.x): r.value for r in rows} == cells_of(made["plain"])
    assert all(r.lat == 90 - (r.y + 0.5) * 4.5 and r.lon == (r.x + 0.5) * 6 and r.lat_ix == round(r.lat * 100) and r.lon_ix == round(r.lon * 100) for r in rows)
    rolled = {(r.y, r.x): (r.value, r.lon) for r in rasters.read_rasters(spark, f"file://{folder}/plain.npy", roll=True).collect()}
    assert rolled == {(y, (x + 30) % 60): (v, ((x + 30) % 60 + 0.5) * 6 - 180) for (y, x), v in cells_of(made["plain"]).items()}
    with pytest.raises(ValueError):
        np.save(folder / "cube.npy", np.zeros((2, 2, 2)))
        rasters.header(str(folder / "cube.npy"))


@pytest.mark.parametrize("strip", [100, 1 << 24])
def test_write_and_read_back(spark, tmp_path, monkeypatch, strip):
    monkeypatch.setattr(rasters, "STRIP_BYTES", strip)
    rows = [("a", 0, 0, 1.0), ("a", 39, 7, 2.0), ("b", 20, 3, -1.0), ("b", 20, 4, 5.0), ("c", 5, 5, None), ("a", 0, 0, 0.5)]
    df = spark.createDataFrame(rows, "name string, y int, x int, value double").repartition(4)
    path = f"file://{tmp_path}/out"
    assert rasters.write_rasters(df, path, 40, 8) == 3
    a = np.load(tmp_path / "out" / "a.npy")
    assert a.shape == (40, 8) and cells_of(a) == {(0, 0): 1.0, (39, 7): 2.0}
    got = {(r.path[-5], r.y, r.x): r.value for r in rasters.read_rasters(spark, path, strip_bytes=100).collect()}
    assert got == {("a", 0, 0): 1.0, ("a", 39, 7): 2.0, ("b", 20, 3): -1.0, ("b", 20, 4): 5.0}
    assert rasters.write_rasters(df.limit(0), f"file://{tmp_path}/empty", 4, 4) == 0
