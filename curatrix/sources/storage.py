"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATHS: set[str] = set()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and driver and executors are one process (tests).

    On a cluster executors would write to their own disks there, so an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="curatrix-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: writes df as a Parquet table in the shared folder and reads it back.

    The table outlives lost executors, and the plan runs once. It is removed by dropped(), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # the shuffle files of a finished write are of no more use
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before else spark.conf.unset(_CLEAN)
    _PATHS.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(table: DataFrame) -> None:
    """Removes what written() wrote, once nothing will read it any more."""
    path = getattr(table, "_written", None)
    if path in _PATHS:
        _PATHS.discard(path)
        _remove(table.sparkSession, path)


@atexit.register
def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in sorted(_PATHS) if spark else ():
        _remove(spark, path)
