"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_FOLDERS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and Spark runs on one machine, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="tidepool-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(given)
    return given


def _delete(jvm, conf, path: str) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def _handles(spark: SparkSession) -> tuple:
    return spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which goes when the driver's process ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/tidepool-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, *_handles(spark), folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read back: written as Parquet in the shared folder.

    A lost executor loses none of it, and columns that a reader does not need are not read.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`cut` that nothing reads any more."""
    for table in tables:
        if (path := _WRITTEN.pop(table, None)) is not None:
            _delete(*_handles(table.sparkSession), path)
