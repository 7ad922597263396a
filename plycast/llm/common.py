"""Helpers that the training-data operators share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``, else one in the warehouse, which on
    a cluster must not be a folder of one machine."""
    if known := spark.conf.get("spark.checkpoint.dir", None):
        return known.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/plycast-shared"


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


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder, so that a lost executor costs no more than the step at hand. Its shuffle files go."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared(spark))
    return once(df).checkpoint(eager=True)


_TABLES: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def tables() -> Iterator[list[str]]:
    """Names the tables that ``written`` stores inside, by this call alone: other threads and queries of the session have
    scopes of their own, or none. The list is for ``discard``, when what reads the tables has been stored."""
    mine: list[str] = []
    before = _TABLES.set(mine)
    try:
        yield mine
    finally:
        _TABLES.reset(before)


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table in the shared folder: for larger tables, as it is compressed. A scope of ``tables`` names it."""
    path = f"{shared(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (scope := _TABLES.get()) is not None:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes tables: for when results that read them have been stored."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def map_batches(df: DataFrame, schema: str | StructType, batches: Callable[[Iterator[pa.RecordBatch]], Iterable[Iterable[tuple]]]) -> DataFrame:
    """mapInArrow whose function gives lists of tuples of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches(it):
            cols = list(zip(*found, strict=True))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(out, schema)


def map_rows(df: DataFrame, schema: str | StructType, rows: Callable[[list[list]], Iterable[tuple]]) -> DataFrame:
    """mapInArrow: ``rows`` gets a batch's columns as Python lists and gives tuples of ``schema``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[Iterable[tuple]]:
        for batch in it:
            # pieces of a batch, so that very long texts are not all held as Python objects at once
            for at in range(0, batch.num_rows, 1000):
                yield rows([c.to_pylist() for c in batch.slice(at, 1000).columns])

    return map_batches(df, schema, batches)


def blank_null(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """Each row whole as ``row``, so that no column of its own can clash with ours; __id and __key, never null, that are
    equal for rows of the same doc_id and text only; and its text."""
    d = docs.select(F.struct("*").alias("row"))
    row, text = F.col("row.doc_id"), F.col("row.text")
    key = F.xxhash64(row.isNull(), text.isNull(), F.coalesce(text, F.lit("")))
    return d.select("row", F.coalesce(row.cast("long"), F.lit(-(1 << 63))).alias("__id"), key.alias("__key"), text.alias("text"))


def unpacked(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` out of ``row``, those named with new values of the same type."""
    return [(changed[f.name].cast(f.dataType) if f.name in changed else F.col(f"row.`{f.name}`")).alias(f.name) for f in docs.schema]


def heat(right: DataFrame, n: str) -> tuple[int, int]:
    """The most rows of a key, and those of all."""
    return tuple(x or 0 for x in once(right.agg(F.max(n), F.sum(n))).collect()[0])


def spread_join(left: DataFrame, right: DataFrame, on: list[str], n: str, known: tuple[int, int] | None = None) -> DataFrame:
    """Inner equality join with a ``right`` of one row per key that knows how many rows (``n``) of ``left`` have it; its
    ``heat`` may be ``known``.

    Keys of more than a thousandth of these rows, fewer than a thousand keys at any size, are sent to the tasks, so the
    rows of a hot key stay where they are; the others meet by a shuffle. ``left`` and ``right`` should be stored.
    """
    most, total = known or heat(right, n)
    if most < 1000 or most * 1000 <= total:
        return left.join(right.drop(n), on)
    hot, cold = right.filter(F.col(n) * 1000 > total), right.filter(F.col(n) * 1000 <= total)
    met = left.join(F.broadcast(hot.drop(n)), on)
    return met.unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold.drop(n), on))


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) from edges a, b, by alternating large and small stars."""
    e = cut(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = e.union(e.select("b", "a"))
        # the centre of a large cluster has its rows
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"), F.count("*").alias("n")))
        # done when each node but the centres has one edge: the node at its other end is then the smallest of all it has
        most, total, left = (x or 0 for x in once(least.agg(F.max("n"), F.sum("n"), F.count_if(F.expr("m < a and n > 1")))).collect()[0])
        if not left:
            return e.toDF("node", "root")
        large = spread_join(both, least, ["a"], "n", (most, total)).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").union(least.select("a", "m")).toDF("a", "b").filter("a <> b").distinct()
        e = cut(small)
