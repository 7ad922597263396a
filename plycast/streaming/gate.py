"""The gates on streams: counts per client and window, a daily budget with its state table, deepening searches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plycast.sources.files import exists, scratch


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream. Its time column has no zone, which watermarks refuse; it is UTC."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, each=None) -> DataFrame:
    """Runs a stream over what there is, and gives what its last batches wrote."""
    spark = stream.sparkSession
    top = scratch(spark, "stream")

    def write(batch: DataFrame, k: int) -> None:
        (each(batch, k) if each else batch).write.mode("overwrite").parquet(f"{top}/out/batch={k}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/log").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{top}/out")
    if mode == "complete":  # each batch has the whole table; the last one counts
        last = out.agg(F.max("batch")).first()[0]
        out = out.filter(F.col("batch") == last)
    return out.drop("batch")


def rate_counts(stream: DataFrame, limit: int, window: str, late: str = "10 minutes", client: str = "client") -> DataFrame:
    """Requests and admitted ones of each client and window. Rows later than the watermark are dropped in append mode."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", window), client).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), client, "n", F.least("n", F.lit(limit)).alias("admitted"))


def _versions(spark: SparkSession, state: str) -> list[int]:
    """Batches whose state is stored, ascending; half-written ones have another name."""
    top = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def _replaced(df: DataFrame, path: str, aside: str) -> None:
    """Writes a table beside its place and renames it, so that readers find it whole or not at all."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(aside)
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (aside, path))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"cannot rename {aside}")


def _state(spark: SparkSession, top: str, before: int | None = None) -> DataFrame:
    known = [v for v in _versions(spark, f"{top}/state") if before is None or v < before]
    schema = "utc_day date, used long"
    return spark.read.schema(schema).parquet(f"{top}/state/version={known[-1]}") if known else spark.createDataFrame([], schema)


def budget_batch(top: str, cap: int, keep: int = 3):
    """A foreachBatch step that admits the first ``cap`` requests of each UTC day. The state after each batch is a table of a
    row per day, stored under the batch's number: a batch that runs again starts from the state before it and writes the same.
    The last ``keep`` states stay. A day's count stops one past the cap."""
    from plycast.operators.requests import daily_budget

    def step(batch: DataFrame, k: int) -> DataFrame:
        spark, day = batch.sparkSession, F.to_date("ts").alias("utc_day")
        used = _state(spark, top, k)
        fresh = batch.groupBy(day).agg(F.count("*").alias("used"))
        now = used.unionByName(fresh).groupBy("utc_day").agg(F.least(F.sum("used"), F.lit(cap + 1)).alias("used"))
        _replaced(now.coalesce(1), f"{top}/state/version={k}", f"{top}/state/_new-{k}")
        for v in [v for v in _versions(spark, f"{top}/state") if v <= k][:-keep]:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/state/version={v}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        d = batch.withColumn("utc_day", F.to_date("ts")).join(used, "utc_day", "left").withColumn("used", F.coalesce("used", F.lit(0)))
        return daily_budget(d, F.lit(cap) - F.col("used")).drop("used", "utc_day")

    return step


def budget_used(spark: SparkSession, top: str) -> DataFrame:
    """utc_day and used, as a budget's last batch left them, for monitoring: nothing is counted or changed by reading."""
    return _state(spark, top)


def deepening(stream: DataFrame, key: str = "position_id") -> DataFrame:
    """Rows (key, seq, depth) deeper than all before them in their search; the deepest so far is the state. A batch's rows of a
    search come in parts and in any order: of each part what could still be deepest at its place stays, a row per depth at
    most, and goes out when all parts have been seen. Rows of one seq go by depth; a row without a depth is none."""

    def rising(pdf: pd.DataFrame, deepest: int) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "depth"])
        so_far = pdf["depth"].cummax().shift(fill_value=deepest).clip(lower=deepest)
        return pdf.loc[pdf["depth"] > so_far, [key, "seq", "depth"]]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        deepest = state.get[0] if state.exists else -(2**31)
        steps = None
        for pdf in frames:
            pdf = pdf.dropna(subset=["depth"])
            steps = rising(pdf if steps is None else pd.concat([steps, pdf]), deepest)
        if steps is not None and len(steps):
            yield steps
            deepest = max(deepest, int(steps["depth"].max()))
        state.update((deepest,))

    from pyspark.sql.streaming.state import GroupStateTimeout

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, seq long, depth int", "deepest int", "append", GroupStateTimeout.NoTimeout)
