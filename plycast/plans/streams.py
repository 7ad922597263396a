"""Queries over streams with state of their own. Events stand in for requests, turns of conversations for chunks of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from plycast.operators import requests as rq
from plycast.plans import logs
from plycast.plans import standins as st
from plycast.plans.registry import query
from plycast.sources import files
from plycast.streaming import gate, stateful


def _requests(spark, sf_dir):
    return gate.events(spark, sf_dir).select("event_id", "ts", F.col("event_type").alias("client"))


@query("stream_rate_limit", logs.EV + " SELECT event_id, row_number() OVER (PARTITION BY client, date_trunc('hour', ts) ORDER BY ts, event_id) <= 3 AS admitted FROM e")
def stream_rate_limit(spark, sf_dir):
    """Each request with its decision; the events come in order of time, so the stream decides as the batch query does."""
    with stateful.rocks(spark):
        return gate.drained(stateful.limited(_requests(spark, sf_dir), 3, 3_600_000), "append").select("event_id", "admitted")


@query("stream_budget_usage", logs.EV + " SELECT ts::DATE AS utc_day, least(count(*), 301) AS used FROM e GROUP BY 1")
def stream_budget_usage(spark, sf_dir):
    """What a budget's state says after its stream has stopped."""
    top = files.scratch(spark, "budget")
    gate.drained(gate.events(spark, sf_dir).select("event_id", "ts"), "append", gate.budget_batch(top, 300))
    return gate.budget_used(spark, top)


@query("stream_debounced", logs.EV + ", g AS (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY client ORDER BY ts, event_id)) - epoch_us(ts) AS gap, (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM e) AS seen FROM e) SELECT client, event_id FROM g WHERE (gap IS NULL OR gap >= 250000000) AND epoch_us(ts) + 249999999 <= seen")
def stream_debounced(spark, sf_dir):
    """What the batch query keeps, but for bursts that the watermark (10 minutes behind the last event) has not passed."""
    return gate.drained(stateful.bursts(_requests(spark, sf_dir), 250_000, "client"), "append").select("client", "event_id")


ARRIVALS = 4


@query("stream_reassembled_text", """WITH t AS (SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS seq, coalesce(text, '') AS text FROM conversations),
s AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM t)
SELECT conv_id, seq, place, md5(text) AS text_md5, FALSE AS aborted FROM s
UNION ALL SELECT conv_id, max(seq) + 1, sum(length(text))::BIGINT, md5(chr(10) || '[aborted]'), TRUE FROM t GROUP BY 1 HAVING max(seq) >= 3""")
def stream_reassembled_text(spark, sf_dir):
    """Turns come in four arrivals, dealt by hash, and go out in order with their places. Conversations of four turns and more
    have no last chunk here, so they end with the marker, when an arrival a day later has moved the clock."""
    t = st.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    ends = t.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("final"))
    arrival = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(ARRIVALS))
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    d = t.join(ends, "conv_id").select(F.col("conv_id").alias("key"), (F.col("turn") - F.col("first")).alias("seq"), "text", ((F.col("turn") == F.col("final")) & (F.col("turn") - F.col("first") < 3)).alias("last"), F.timestamp_seconds(start + arrival).alias("ts"), arrival.alias("arrival"))
    top = files.scratch(spark, "chunks")
    for k in range(ARRIVALS):
        d.filter(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(top)
    clock = spark.range(1).select(F.lit(-1).cast("long").alias("key"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("text"), F.lit(True).alias("last"), F.timestamp_seconds(start + 86_400).alias("ts"))
    clock.write.mode("append").parquet(top)
    s = spark.readStream.schema(clock.schema).option("maxFilesPerTrigger", 16).parquet(top)
    with stateful.rocks(spark):
        out = gate.drained(stateful.in_order(s, 3_600_000), "append")
    return out.filter("key >= 0").select(F.col("key").alias("conv_id"), "seq", F.col("at").alias("place"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "aborted")


@query("stream_request_log", logs.VALID + " SELECT 'request' AS kind, event_id, mode, reason FROM checked WHERE event_id % 101 <> 7 UNION ALL SELECT 'broken', event_id, NULL, NULL FROM checked WHERE event_id % 101 = 7")
def stream_request_log(spark, sf_dir):
    """The log as a stream of JSON lines, some of them cut off: those are in quarantine, the others validated as in batch."""
    top = files.scratch(spark, "landing")
    cut_off = F.concat(F.lit('{"event_id": "'), F.col("event_id").cast("string"))
    line = F.when(F.col("event_id") % 101 == 7, cut_off).otherwise(F.to_json(F.struct("*")))
    logs.requests(spark, sf_dir).drop("client").select(line.alias("value")).write.text(f"{top}/log")
    stateful.landed(stateful.request_stream(spark, f"{top}/log"), f"{top}/good", f"{top}/quarantine", f"{top}/checkpoint")
    good = rq.validate(spark.read.parquet(f"{top}/good").drop("batch")).select(F.lit("request").alias("kind"), "event_id", "mode", "reason")
    broken = spark.read.parquet(f"{top}/quarantine").select(F.lit("broken").alias("kind"), F.regexp_extract("broken", "([0-9]+)", 1).cast("long").alias("event_id"), F.lit(None).cast("string").alias("mode"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(broken)
