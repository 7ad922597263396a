"""Request logs: validation with the first reason for a refusal, and the gates in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plycast.functions.lineage import settle

UCI = "^[a-h][1-8][a-h][1-8][qrbn]?$"
#: Caps (fixed values).
MAX_LINES, MAX_PV, MAX_FEN, EXPLAIN_BYTES, SCAN_BYTES = 5, 12, 100, 16_384, 2_000_000
MOVE_CLASSES = ("best", "good", "inaccuracy", "mistake", "blunder")
DATA_URL = "^data:(image/(?:png|jpeg|webp));base64,([A-Za-z0-9+/=]+)$"


def engine_log(df: DataFrame, line: str = "line") -> DataFrame:
    """Adds multipv, depth, cp, mate and pv of ``info`` lines; other lines, bounds and lines without a depth go.
    Tokens are matched whole, so seldepth is not depth."""
    at = lambda t, k: F.array_position(t, F.lit(k)).cast("int")
    num = lambda t, k: F.when(at(t, k) > 0, F.get(t, at(t, k)).try_cast("int"))
    scored = lambda t, k: F.when(F.get(t, at(t, "score")) == k, num(t, k))
    whole = lambda t: ~F.array_contains(t, "lowerbound") & ~F.array_contains(t, "upperbound") & num(t, "depth").isNotNull() & (at(t, "pv") < F.size(t))
    read = lambda t: F.struct(F.coalesce(num(t, "multipv"), F.lit(1)).alias("multipv"), num(t, "depth").alias("depth"), scored(t, "cp").alias("cp"), scored(t, "mate").alias("mate"), F.slice(t, at(t, "pv") + 1, F.size(t)).alias("pv"))
    # a line is split once, behind a generator, so that no filter splits it again
    d = df.filter(F.startswith(line, F.lit("info ")) & F.contains(line, F.lit(" pv ")))
    return d.select(*df.columns, F.inline(F.transform(F.filter(F.array(F.split(line, r"\s+")), whole), read)))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def clean_line(x: Column) -> Column:
    """The line with its caps applied, or null if it is malformed. Centipawns round halves up."""
    pv = F.slice(x["pv"], 1, MAX_PV)
    cp = F.when(~F.isnan(x["cp"]) & (F.abs(x["cp"]) != float("inf")), clamp(F.floor(x["cp"] + 0.5).cast("int"), -9999, 9999))
    mate = F.when(x["mate"] == F.floor(x["mate"]), clamp(x["mate"].cast("int"), -64, 64))
    good = x["multipv"].isNotNull() & x["depth"].isNotNull() & (F.size(x["pv"]) > 0) & F.forall(pv, lambda m: m.isNotNull() & m.rlike(UCI)) & (cp.isNotNull() | mate.isNotNull())
    return F.when(good, F.struct(clamp(x["multipv"], 1, MAX_LINES).alias("multipv"), clamp(x["depth"], 1, 99).alias("depth"), cp.alias("cp"), mate.alias("mate"), pv.alias("pv")))


def validate(df: DataFrame) -> DataFrame:
    """Adds ``reason``, null for good requests, and the cleaned lines and verdict. The reasons are fixed texts."""
    v = F.col("verdict")
    clean = F.struct(F.transform("lines", clean_line).alias("clean_lines"), clean_line(F.col("playedLine")).alias("clean_played"), clean_line(F.col("bestLine")).alias("clean_best"))
    d = df.select("*", F.inline(F.array(clean)))  # behind a generator, so that lines are cleaned once
    fen = F.when(F.col("fen").isNull() | (F.length("fen") == 0) | (F.length("fen") > MAX_FEN), "fen must be a non-empty string")
    n = F.coalesce(F.size("lines"), F.lit(0))
    cand = F.when(n <= 0, "lines must be a non-empty array").when(n > MAX_LINES, f"at most {MAX_LINES} lines allowed").when(F.exists("clean_lines", lambda x: x.isNull()), "malformed engine line")
    grade = F.when(v.isNull(), "verdict must be an object").when(v["moveUci"].isNull() | ~v["moveUci"].rlike(UCI), "verdict.moveUci must be a UCI move").when(v["moveClass"].isNull() | ~v["moveClass"].isin(*MOVE_CLASSES), "verdict.moveClass is invalid")
    grade = grade.when(v["winPctBefore"].isNull() | v["winPctAfter"].isNull(), "verdict win percentages must be numbers").when(F.col("clean_played").isNull() | F.col("clean_best").isNull(), "malformed engine line").when(F.col("clean_played.pv")[0] != v["moveUci"], "playedLine must start with the played move")
    reason = F.coalesce(fen, F.when(F.col("mode") == "candidates", cand).when(F.col("mode") == "grade", grade).otherwise("mode must be 'candidates' or 'grade'"))
    return d.withColumns({"reason": reason, "win_before": clamp(v["winPctBefore"], 0.0, 100.0), "win_after": clamp(v["winPctAfter"], 0.0, 100.0)})


def within_bytes(body: Column, cap: int = EXPLAIN_BYTES) -> Column:
    return F.octet_length(body) <= cap


def data_url(image: Column) -> dict[str, Column]:
    ok = image.rlike(DATA_URL)
    return {"media_type": F.when(ok, F.regexp_extract(image, DATA_URL, 1)), "n_base64": F.when(ok, F.length(F.regexp_extract(image, DATA_URL, 2)))}


def board_field(raw: Column) -> dict[str, Column]:
    """A transcribed board: the reason why it can't be one, else a FEN with placeholders. Each side needs one king."""
    b = F.trim(raw)
    kings = (F.length(F.regexp_replace(b, "[^K]", "")) == 1) & (F.length(F.regexp_replace(b, "[^k]", "")) == 1)
    error = F.when(b == "NOT_A_BOARD", "no board").when(~b.rlike("^[pnbrqkPNBRQK1-8/]{15,80}$") | (F.size(F.split(b, "/")) != 8), "unreadable").when(~kings, "illegal")
    return {"error": error, "fen": F.when(error.isNull(), F.concat(b, F.lit(" w - - 0 1")))}


def rate_limit(df: DataFrame, limit: int, window: str, client: str = "client", ts: str = "ts", id: str = "event_id") -> DataFrame:
    """Adds admitted: the first ``limit`` of a client in each window of time."""
    w = Window.partitionBy(client, F.window(ts, window)).orderBy(ts, id)
    return df.withColumn("admitted", F.row_number().over(w) <= limit)


def cap_of(text: Column) -> Column:
    """A cap from configuration text; missing, malformed or not positive means none."""
    n = text.try_cast("long")
    return F.when(n > 0, n)


def daily_budget(df: DataFrame, cap: Column, ts: str = "ts", id: str = "event_id") -> DataFrame:
    """Adds within: the first ``cap`` of each UTC day (all, without a cap). A day's minutes are counted first; rows of
    minutes before or behind the cap are settled by the counts, and only those of the minute in which it falls are ranked."""
    d = df.withColumns({"__minute": F.date_trunc("minute", ts), "__cap": cap})
    n = d.groupBy("__minute").agg(F.count("*").alias("__n"))
    day = Window.partitionBy(F.to_date("__minute")).orderBy("__minute").rowsBetween(Window.unboundedPreceding, -1)  # 1,440 rows a day
    j = d.join(n.withColumn("__before", F.coalesce(F.sum("__n").over(day), F.lit(0))), "__minute")
    torn = F.coalesce((F.col("__before") < F.col("__cap")) & (F.col("__before") + F.col("__n") > F.col("__cap")), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("__minute").orderBy(ts, id)) + F.col("__before")
    settled = j.filter(~torn).withColumn("within", F.coalesce(F.col("__before") < F.col("__cap"), F.lit(True)))
    return settled.unionByName(j.filter(torn).withColumn("within", rank <= F.col("__cap"))).select(*df.columns, "within")


def budget_usage(df: DataFrame, cap: int, ts: str = "ts") -> DataFrame:
    """What is stored for each day: the count stops one past the cap."""
    return df.groupBy(F.to_date(ts).alias("utc_day")).agg(F.least(F.count("*"), F.lit(cap + 1)).alias("used"))


def gates(df: DataFrame, limit: int, window: str, cap: int) -> DataFrame:
    """Adds stage: the first gate that stops a request (rate, size, schema, legality, budget) or passed. ``fits``, ``reason``
    and ``legal`` are columns of the log; a null ``legal`` is no. Only requests that pass the others use up the budget."""
    d = rate_limit(df, limit, window)
    early = F.when(~F.col("admitted"), "rate").when(~F.col("fits"), "size").when(F.col("reason").isNotNull(), "schema").when(~F.coalesce("legal", F.lit(False)), "legality")
    known = settle(d.select(*df.columns, early.alias("early")))  # validated and counted once, read by each part of the budget
    ok = daily_budget(known.filter("early is null").select("event_id", "ts"), F.lit(cap)).select("event_id", "within")
    stage = F.coalesce("early", F.when(F.col("within"), "passed").otherwise("budget"))
    return known.join(ok, "event_id", "left").select(*df.columns, stage.alias("stage"))


def debounced(df: DataFrame, millis: int, key: str, ts: str = "ts", id: str = "event_id") -> DataFrame:
    """Work that no other of the same key superseded within ``millis``. A key's time is cut into slots of ``millis`` or an
    hour, if that is more; what supersedes a slot's last row is the next slot's first one, so no task holds a whole key."""
    slot, at = max(millis * 1000, 3_600_000_000), F.unix_micros(F.col(ts).cast("timestamp"))
    d = df.withColumns({"__at": at, "__slot": F.floor(at / slot)})
    first = d.groupBy(key, (F.col("__slot") - 1).alias("__slot")).agg(F.min("__at").alias("__first"))
    after = F.lead("__at").over(Window.partitionBy(key, "__slot").orderBy("__at", id))
    gap = F.coalesce("__after", "__first") - F.col("__at")
    j = d.withColumn("__after", after).join(first, [key, "__slot"], "left").withColumn("__gap", gap)
    return j.filter(F.col("__gap").isNull() | (F.col("__gap") >= millis * 1000)).select(*df.columns)


def reassemble(chunks: DataFrame, key: str, seq: str, text: str, failed: str, marker: str = "\n[aborted]") -> DataFrame:
    """Chunks in order, with a marker at the end of a text that failed."""
    g = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(seq, text))).alias("x"), F.bool_or(failed).alias("bad"))
    return g.select(key, F.concat(F.array_join(F.col(f"x.{text}"), ""), F.when(F.col("bad"), marker).otherwise("")).alias("text"))
