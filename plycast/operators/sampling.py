"""Samples whose members do not depend on partitioning: every draw ranks rows by md5(seed, key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plycast.functions.lineage import settle


def draw(seed: int, *keys: str | Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def uniform(seed: int, *keys: str | Column) -> Column:
    """In [0, 1), from the first 32 bits of the draw."""
    return F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("double") / 4294967296.0


def stratified(df: DataFrame, k: int, seed: int, id: str = "puzzle_id", cell: tuple = ("theme", "rating_band")) -> DataFrame:
    """k rows of each cell; a row may stand in many. A limit per group runs before and after the shuffle."""
    w = Window.partitionBy(*cell).orderBy(draw(seed, cell[0], id), id)
    return df.filter(F.col(cell[-1]).isNotNull()).withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= k)


def flatten(df: DataFrame, id: str = "puzzle_id") -> DataFrame:
    return df.dropDuplicates([id])


def cells(themes: DataFrame, bands: DataFrame) -> DataFrame:
    """All requested cells; both sides are short lists."""
    return themes.crossJoin(F.broadcast(bands))


def coverage(requested: DataFrame, picked: DataFrame, cell: tuple = ("theme", "rating_band")) -> DataFrame:
    """Rows per requested cell, 0 for empty ones."""
    n = picked.groupBy(*cell).agg(F.count("*").alias("n"))
    return requested.join(n, list(cell), "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def subsample(df: DataFrame, size: int, seed: int, id: str = "puzzle_id") -> DataFrame:
    """The first ``size`` rows of one seeded order, so that a larger sample holds a smaller one."""
    return df.orderBy(draw(seed, id), id).limit(size)


def worklist(todo: DataFrame, done: DataFrame, skipped: DataFrame, target: int, seed: int, key: tuple = ("puzzle_id", "arm")) -> DataFrame:
    """Items neither done nor skipped, in seeded order, up to what is missing to ``target``."""
    rest = todo.join(done.select(*key).distinct(), list(key), "left_anti").join(skipped.select(*key).distinct(), list(key), "left_anti")
    missing = F.greatest(F.lit(target) - F.col("n_done"), F.lit(0))
    n = done.select(*key).distinct().agg(F.count("*").alias("n_done"))
    first = rest.withColumn("turn", draw(seed, *key)).orderBy("turn", *key).limit(target)
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("turn", *key)))  # target rows at most
    return ranked.crossJoin(F.broadcast(n)).filter(F.col("place") <= missing).drop("n_done", "turn")


def adjacent(df: DataFrame, group: str, seed: int, *keys: str) -> DataFrame:
    """Adds ``before``, the first key of the row before in the seeded order of its group. The order is cut into ranges by
    its first digits; a range's first row looks at the last one of the ranges before it, so no task holds a group."""
    d = df.withColumn("__turn", draw(seed, *keys)).withColumn("__range", F.substring("__turn", 1, 4))
    order = ["__turn", *keys]
    last = d.groupBy(group, "__range").agg(F.max_by(keys[0], F.struct(*order)).alias("__last"))
    last = last.withColumn("__last", F.lag("__last").over(Window.partitionBy(group).orderBy("__range")))  # 65,536 rows a group
    inside = F.lag(keys[0]).over(Window.partitionBy(group, "__range").orderBy(*order))
    first = F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order)) == 1
    j = d.withColumns({"__inside": inside, "__first": first}).join(last, [group, "__range"])
    return j.select(*df.columns, F.when(F.col("__first"), F.col("__last")).otherwise(F.col("__inside")).alias("before"))


def shards(df: DataFrame, per_shard: int, split: str, order: str) -> DataFrame:
    """Shard number of each row within its split. Counts per range partition give each range its offset."""
    from pyspark.sql import types as T

    ranged = df.repartitionByRange(split, order).sortWithinPartitions(split, order).withColumn("__p", F.spark_partition_id())
    ranged = settle(ranged)  # both branches below must see the same partitions
    ranged = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__p", split).orderBy(order)))
    counts = ranged.groupBy("__p", split).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(split).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = counts.withColumn("__s", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("__p", split, "__s")
    index = F.col("__i") + F.col("__s") - 1
    out = ranged.join(starts, ["__p", split]).withColumn("shard", F.floor(index / per_shard).cast(T.IntegerType()))
    return out.select(*df.columns, "shard")


def mix(first: DataFrame, second: DataFrame, size: int, seed: int, id: str) -> DataFrame:
    """At most half from ``first``, the rest from ``second``, by seeded order."""
    half = size // 2
    a = first.orderBy(draw(seed, id), id).limit(half).withColumn("part", F.lit("first"))
    n = a.count()  # half at most
    return a.unionByName(second.orderBy(draw(seed, id), id).limit(size - n).withColumn("part", F.lit("second")))


def crc_share(*keys: str) -> Column:
    """crc32 of the keys joined by a bar, over 2^32."""
    return F.crc32(F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).cast("binary")) / F.lit(4294967296.0)


def tune_or_holdout(df: DataFrame, fraction: float, id: str = "puzzle_id", arm: str = "arm") -> DataFrame:
    return df.withColumn("split", F.when(crc_share(id, arm) < fraction, "tune").otherwise("holdout"))


def verdict_rows(df: DataFrame, config: str = "config") -> DataFrame:
    """Holdout rows, or all rows of a config that has none."""
    held = F.max((F.col("split") == "holdout").cast("int")).over(Window.partitionBy(config))
    return df.withColumn("__h", held).filter((F.col("__h") == 0) | (F.col("split") == "holdout")).drop("__h")


def style_split(df: DataFrame, held: dict[str, list[str]], seed: int, id: str) -> DataFrame:
    """Rows with any held-out style are held out; the rest are train or val by hash (one in ten is val)."""
    out = reduce(lambda a, b: a | b, (F.col(c).isin(*v) for c, v in held.items()))
    return df.withColumn("split", F.when(out, "heldout").when(uniform(seed, id) < 0.1, "val").otherwise("train"))
