"""Saved two-dimensional arrays as tables of cells, and back.

The reader plans from the header of each file: its shape, type and order say where every row of the array lies, so a
task is given strips of rows and reads their bytes alone; no task holds a whole file. Small files share a task. The writer
takes cells in order and holds one strip of the array that it is writing.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, height int, width int, y int, x int, value double"
#: Bytes of arrays for a task, and cells of a batch of rows.
STRIP_BYTES, BATCH = 16 << 20, 1 << 16
#: Bytes of a file that hold its header, and files whose headers are read at one time.
HEADER, AT_ONCE = 1 << 12, 16


@dataclass
class Strip:
    """``count`` lines of an array from ``first`` on; lines are rows, or columns where the array is stored by columns."""

    path: str
    shape: tuple[int, int]
    kind: str
    by_columns: bool
    offset: int
    first: int
    count: int


@dataclass
class Strips(InputPartition):
    strips: list[Strip]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def header(path: str) -> Strip:
    """The whole array of a file as one strip, from the file's first bytes."""
    system, at = _open(path)
    with system.open_input_file(at) as f:
        head = io.BytesIO(f.read(HEADER))
    version = np.lib.format.read_magic(head)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_columns, kind = read(head)
    if len(shape) != 2 or kind.hasobject:
        raise ValueError(f"not a two-dimensional array of numbers: {path}")
    return Strip(path, shape, kind.str, by_columns, head.tell(), 0, shape[1] if by_columns else shape[0])


def plan(files: list[Strip], size: int) -> list[list[Strip]]:
    """Strips of about ``size`` bytes (at least one line), several to a task while they are smaller."""
    tasks, room = [], 0
    for f in files:
        line = max(1, f.shape[f.by_columns ^ 1] * np.dtype(f.kind).itemsize)
        step = max(1, size // line)
        for first in range(0, f.count, step):
            strip = Strip(f.path, f.shape, f.kind, f.by_columns, f.offset + first * line, first, min(step, f.count - first))
            if room < strip.count * line:
                tasks.append([])
                room = size
            tasks[-1].append(strip)
            room -= strip.count * line
    return tasks


def decode(strip: Strip) -> Iterator[pa.RecordBatch]:
    """The cells of a strip that are there."""
    system, at = _open(strip.path)
    other = strip.shape[strip.by_columns ^ 1]
    with system.open_input_file(at) as f:
        f.seek(strip.offset)
        lines = np.frombuffer(f.read(strip.count * other * np.dtype(strip.kind).itemsize), strip.kind).reshape(strip.count, other)
    step = max(1, BATCH // max(1, other))
    for lo in range(0, strip.count, step):
        part = lines[lo : lo + step].astype(float)
        line, place = np.nonzero(~np.isnan(part))
        y, x = (place, line + strip.first + lo) if strip.by_columns else (line + strip.first + lo, place)
        n = len(y)
        columns = [pa.array([strip.path] * n, pa.string()), *(pa.array(np.full(n, s), pa.int32()) for s in strip.shape), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(part[line, place])]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "height", "width", "y", "x", "value"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("stripbytes", STRIP_BYTES))

    def partitions(self) -> list[InputPartition]:
        system, at = _open(self.path)
        scheme = self.path[: -len(at)] if self.path.endswith(at) else ""
        found = system.get_file_info(fs.FileSelector(at, recursive=True)) if system.get_file_info(at).type == fs.FileType.Directory else [system.get_file_info(at)]
        paths = sorted(scheme + f.path for f in found if f.path.endswith(".npy") and not f.base_name.startswith((".", "_")))
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return [Strips(s) for s in plan([*pool.map(header, paths)], self.size)] or [Strips([])]

    def read(self, partition: Strips) -> Iterator[pa.RecordBatch]:
        for strip in partition.strips:
            yield from decode(strip)


class Rasters(DataSource):
    """``spark.read.format("rasters")``: arrays under a path (local, or in any store that Arrow opens), as SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "rasters"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_rasters(spark: SparkSession, path: str, roll: bool = False, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """Cells of all arrays under ``path``: path, y, x, value, lat and lon of the centre, and its keys lat_ix and lon_ix in hundredths of a degree.

    Row 0 is north. Missing cells (NaN) are left out. ``roll`` turns the columns by half the width, from 0..360 to -180..180 degrees.
    """
    spark.dataSource.register(Rasters)
    df = spark.read.format("rasters").option("stripBytes", strip_bytes).load(path)
    if roll:
        df = df.withColumn("x", ((F.col("x") + F.floor(F.col("width") / 2)) % F.col("width")).cast("int"))
    lat = F.lit(90.0) - (F.col("y") + 0.5) * 180 / F.col("height")
    lon = (F.col("x") + 0.5) * 360 / F.col("width") - (180.0 if roll else 0.0)
    keyed = df.withColumns({"lat": lat, "lon": lon})
    key = lambda c: F.rint(F.col(c) * 100).cast("int")
    return keyed.select("path", "y", "x", "value", "lat", "lon", key("lat").alias("lat_ix"), key("lon").alias("lon_ix"))


def write_rasters(cells: DataFrame, path: str, height: int, width: int) -> int:
    """Write ``cells(name, y, x, value)`` as one array of doubles for each name, and return how many there are.

    Cells that are not given are NaN; of repeated ones the last value in order stays, and cells outside the shape are an error. A file appears under its name when it is whole.
    """
    step = max(1, (STRIP_BYTES // 8) // max(1, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _open(path)
        system.create_dir(at, recursive=True)
        name, out, top, strip = None, None, 0, None

        def to(y: int) -> None:
            """Write strips until row ``y`` is in the one that is held."""
            nonlocal top, strip
            while y >= top + len(strip):
                out.write(strip.tobytes())
                top += len(strip)
                strip = np.full((max(1, min(step, height - top)), width), np.nan)

        def close() -> None:
            if out is not None:
                to(height)
                out.close()
                system.move(f"{at}/.{name}.{own}", f"{at}/{name}.npy")

        own = uuid.uuid4().hex
        for b in batches:
            names, ys, xs, values = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if len(ys) and not (ys.min() >= 0 and ys.max() < height and xs.min() >= 0 and xs.max() < width):
                raise ValueError(f"a cell outside {height} x {width}")
            starts = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (ys[1:] != ys[:-1])])) if len(ys) else []
            for lo, hi in zip(starts, [*starts[1:], len(ys)]):  # a row of one array
                if names[lo] != name:
                    if name is not None:
                        yield from done(close, name)
                    name, top, strip = names[lo], 0, np.full((min(step, height), width), np.nan)
                    out = system.open_output_stream(f"{at}/.{name}.{own}")
                    head = io.BytesIO()
                    np.lib.format.write_array_header_1_0(head, {"descr": "<f8", "fortran_order": False, "shape": (height, width)})
                    out.write(head.getvalue())
                to(int(ys[lo]))
                strip[ys[lo] - top, xs[lo:hi]] = values[lo:hi]
        if name is not None:
            yield from done(close, name)

    def done(close, name: str) -> Iterator[pa.RecordBatch]:
        close()
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    ordered = cells.select(F.col("name").cast("string"), F.col("y").cast("int"), F.col("x").cast("int"), F.col("value").cast("double")).repartition("name").sortWithinPartitions("name", "y", "x", "value")
    return ordered.mapInArrow(run, "name string").count()
