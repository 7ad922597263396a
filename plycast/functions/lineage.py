"""Cutting lineage where a table is used many times over."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``, else one in the warehouse, which on
    a cluster must not be a folder of one machine."""
    if known := spark.conf.get("spark.checkpoint.dir", None):
        return known.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/plycast-shared"


def settle(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's ``spark.checkpoint.dir``, which all executors share, or in the warehouse if none is set."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared(spark))
    return df.checkpoint(eager=True)


_CLEANUP, _SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", threading.Lock()


def once(df: DataFrame) -> DataFrame:
    """The same rows, to be executed once: the shuffle files go when that is done, and do not wait on the executors' disks
    until the driver happens to collect its garbage. A second execution would have to make them again."""
    conf = df.sparkSession.conf
    with _SETTING:
        before = conf.get(_CLEANUP)
        conf.set(_CLEANUP, "true")
        try:
            return df.select("*")  # a frame keeps the setting it is made with
        finally:
            conf.set(_CLEANUP, before)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """The rows as a Parquet table in the shared folder, which goes at the scope's end; what reads it must have run by then."""
    spark = df.sparkSession
    path = f"{shared(spark)}/table-{uuid.uuid4().hex}"
    try:
        once(df).write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
