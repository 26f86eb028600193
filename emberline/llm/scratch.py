"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``; only where it is unset (tests) a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


_open = threading.local()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return it as read from there.

    Later reads do not depend on any executor, so a lost one costs nothing but its running tasks.
    """
    path = f"{folder(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    for scope in getattr(_open, "scopes", [])[-1:]:
        scope.paths.append(path)
    return out


def release(spark: SparkSession) -> None:
    """Shuffle files and broadcasts of plans that are done go.

    Spark drops them when the driver collects its garbage; until then they fill disks, and the driver's heap grows.
    """
    spark.sparkContext._jvm.System.gc()


class Scope:
    """``with Scope(spark) as scope``: tables written inside are removed at its end, but for those given to ``keep``.

    What leaves the block may depend on kept tables alone; they belong to the block around it, if there is one.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], []

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.append(table._scratch_path)
        return table

    def __enter__(self) -> Scope:
        _open.scopes = [*getattr(_open, "scopes", []), self]
        return self

    def __exit__(self, *_) -> None:
        _open.scopes = _open.scopes[:-1]
        for scope in _open.scopes[-1:]:
            scope.paths += self.kept
        sc = self.spark.sparkContext
        for path in set(self.paths) - set(self.kept):
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        release(self.spark)
