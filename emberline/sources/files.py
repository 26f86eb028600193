"""Reading and writing of detection files, point lists, grids and tables; arrays are in :mod:`emberline.sources.rasters`."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline import schemas as S


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where none is set (tests) a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder, as read from there: later uses neither run it again nor depend on an executor."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_hotspots(spark: SparkSession, path: str, pattern: str = "*", schema: T.StructType = S.HOTSPOTS_PUBLIC) -> DataFrame:
    """All CSV files (also gzip) under ``path`` whose names match; the schema is given, never guessed."""
    return spark.read.schema(schema).option("header", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).csv(path)


def filter_platforms(df: DataFrame, codes: list[str]) -> DataFrame:
    return df.filter(F.col("sat").isin(*codes))


def read_points(spark: SparkSession, path: str, lat: str, lon: str) -> DataFrame:
    """A point list: two of its columns, as lat and lon180."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon180"))


def write_csv(df: DataFrame, path: str) -> bool:
    """Gzip CSV with a header; nothing is written for an empty result."""
    if df.isEmpty():
        return False
    df.write.option("header", True).option("compression", "gzip").csv(path)
    return True


def write_grid(df: DataFrame, path: str) -> None:
    """A grid stack (dataset, year, y, x, value), one folder for each data set and year."""
    df.repartition("dataset", "year").write.partitionBy("dataset", "year").parquet(path)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    df.repartition(*by).write.partitionBy(*by).parquet(path)


def compact_orbits(spark: SparkSession, path: str, out: str, schema: T.StructType = S.HOTSPOTS_PUBLIC) -> DataFrame:
    """Many small orbit files as one table by platform and year; the platform is the start of the file's name."""
    raw = read_hotspots(spark, path, schema=schema).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    df = raw.withColumn("platform", F.substring(F.coalesce("fn", "source_file"), 1, 2)).drop("source_file")
    write_partitioned(df, out, "platform", "year")
    return spark.read.parquet(out)


def write_table(df: DataFrame, path: str) -> None:
    """A small summary table as one CSV file."""
    df.coalesce(1).write.option("header", True).csv(path)
