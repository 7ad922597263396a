"""Files in and out. Schemas are declared, never inferred."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plycast.functions.lineage import shared

#: Header of a puzzle dump, in order (fixed values).
PUZZLE_HEADER = ("PuzzleId", "FEN", "Moves", "Rating", "RatingDeviation", "Popularity", "NbPlays", "Themes", "GameUrl", "OpeningTags")
PUZZLE_CSV = T.StructType([T.StructField(c, T.StringType()) for c in PUZZLE_HEADER])
PUZZLE_NAMES = dict(zip(PUZZLE_HEADER, ("puzzle_id", "csv_fen", "moves", "rating", "rating_deviation", "popularity", "nb_plays", "themes", "game_url", "opening_tags"), strict=True))
LINE = "struct<multipv:int,depth:int,cp:double,mate:double,pv:array<string>>"
REQUEST = f"event_id long, ts timestamp, mode string, fen string, lines array<{LINE}>, verdict struct<moveUci:string,moveClass:string,winPctBefore:double,winPctAfter:double>, playedLine {LINE}, bestLine {LINE}"

_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    if (scope := _SCRATCH.get()) is not None:
        scope.append(path)
    return path


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch folders that were handed out inside, to this call alone, at its end: what was read from them must
    have been stored by then."""
    mine: list[str] = []
    before = _SCRATCH.set(mine)
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        for path in mine:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_puzzles(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A puzzle CSV, plain or compressed; a header other than the declared one is an error. In files of zstd frames (.zst, or
    a folder of such) each frame is a split and a record is a line; another compressed file is one split, so ``partitions``
    spreads its rows after the read."""
    zst = path.endswith(".zst")
    d = _read_zst(spark, path) if zst else spark.read.csv(path, header=True, schema=PUZZLE_CSV, enforceSchema=False, mode="FAILFAST", escape='"')
    d = d.select(*(F.col(a).alias(b) for a, b in PUZZLE_NAMES.items()))
    return d.repartition(partitions) if partitions else d


def _read_zst(spark: SparkSession, path: str) -> DataFrame:
    from plycast.sources import zst

    wrong = F.raise_error("header of a puzzle file is not the declared one").cast("boolean")
    rows = zst.read_lines(spark, path).filter(F.when(~F.col("first"), True).when(F.col("line") == ",".join(PUZZLE_HEADER), False).otherwise(wrong)).filter("line <> ''")
    return rows.select(F.from_csv("line", PUZZLE_CSV.simpleString()[7:-1].replace(":", " "), {"mode": "FAILFAST", "escape": '"'}).alias("r")).select("r.*")


def write_puzzles_zst(df: DataFrame, path: str, frame: int = 1 << 27) -> None:
    """A folder (its name ends with .zst) of zstd files that begin with the header, a frame for each ``frame`` bytes."""
    from plycast.sources import zst

    line = F.to_csv(F.struct(*(F.col(b).alias(a) for a, b in PUZZLE_NAMES.items())), {"escape": '"'})
    zst.append_lines(df.select(line.alias("line")), path, frame, ",".join(PUZZLE_HEADER))


def write_puzzles(df: DataFrame, path: str, compression: str = "none") -> None:
    df.select(*(F.col(b).alias(a) for a, b in PUZZLE_NAMES.items())).write.csv(path, header=True, compression=compression, escape='"')


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An absent file is an empty table."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_required(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return read_jsonl(spark, path, schema)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_shards(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; only its folders are listed and read."""
    return spark.read.parquet(path).filter(F.col("split") == split)


def write_sorted_jsonl(df: DataFrame, path: str, *order: str) -> None:
    df.orderBy(*order).write.mode("overwrite").json(path)


def append(df: DataFrame, path: str) -> None:
    """Rows of one batch more; which items are still to do comes from an anti join with what is there."""
    df.write.mode("append").json(path)


def append_once(df: DataFrame, path: str, run: str, batch: int) -> bool:
    """Appends a batch of a run as a whole or not at all, and once: it is written to a folder that readers pass over, and
    renamed when all tasks are done. False if the batch is there already; what a crash left is written anew."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    top, aside, place = (jvm.org.apache.hadoop.fs.Path(f"{path}{x}") for x in ("", f"/_staged/{run}-{batch}", f"/run={run}/batch={batch}"))
    fs = top.getFileSystem(conf)
    if fs.exists(place):
        return False
    df.write.mode("overwrite").json(aside.toString())
    fs.mkdirs(place.getParent())
    if not fs.rename(aside, place):
        raise OSError(f"cannot rename {aside.toString()}")
    return True


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that were finished, with run and batch."""
    return spark.read.schema(f"{schema}, run string, batch int").json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Queries and the ids that were picked for them by hand."""
    return read_required(spark, path, "query_id long, ids array<long>")


def write_shards(df: DataFrame, path: str, per_shard: int, split: str, order: str) -> None:
    from plycast.operators.sampling import shards

    shards(df, per_shard, split, order).repartition(split, "shard").write.partitionBy(split, "shard").parquet(path)


def split_manifest(df: DataFrame, split: str, board: str, seed: int, held: list[str]) -> DataFrame:
    return df.groupBy(split).agg(F.count_distinct(board).alias("boards"), F.count("*").alias("squares"), (F.max("shard") + 1).alias("shards")).withColumns({"seed": F.lit(seed), "held_out": F.lit(",".join(sorted(held)))})


def split_failures(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())


def percent(share: Column) -> Column:
    return F.when(share.isNull(), "-").otherwise(F.concat(F.format_number(share * 100, 1), F.lit("%")))


def table_rows(df: DataFrame, *cols: str) -> DataFrame:
    """A report table's rows as text."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols)), F.lit(" |")).alias("line"))
