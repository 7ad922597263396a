"""Engine lines: win chances, move grades, phrases, move match, line reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logistic constant, grade drops and the equivalence margin (fixed values).
SLOPE = 0.00368208
DROPS = ((30.0, "blunder"), (20.0, "mistake"), (10.0, "inaccuracy"))
EQUIVALENT = 3.0
DEPTH_CAP = 30
#: Phrases of move classes (fixed values).
CLASS_PHRASES = {"best": "the best move", "good": "a good move", "inaccuracy": "an inaccuracy", "mistake": "a mistake", "blunder": "a blunder"}


def win_of_cp(cp: Column) -> Column:
    return 50 + 50 * (2 / (1 + F.exp(-SLOPE * cp)) - 1)


def win_pct(cp: Column, mate: Column) -> Column:
    """A mate score wins over centipawns; no score at all is even."""
    return F.when(mate > 0, 100.0).when(mate.isNotNull(), 0.0).when(cp.isNotNull(), win_of_cp(cp)).otherwise(50.0)


def grade(before: Column, played: Column, same: Column) -> dict[str, Column]:
    """Chances after the move, their drop, and the class. A played line better than the best one drops nothing."""
    after = F.least(before, played)
    drop = before - after
    cls = F.when(same, "best")
    for least, name in DROPS:
        cls = cls.when(drop >= least, name)
    return {"win_pct_after": after, "win_pct_drop": drop, "move_class": cls.otherwise("good")}


def tenths(cp: Column) -> Column:
    """Pawns with one decimal, halves away from zero, from integer centipawns (the sign is the caller's)."""
    t = F.floor((F.abs(cp) + 5) / 10).cast("long")
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def eval_phrase(cp: Column, mate: Column, side: Column) -> Column:
    sign = F.when(side == "w", 1).otherwise(-1)
    m, c = mate * sign, F.coalesce(cp, F.lit(0)) * sign
    who = F.when(c >= 0, "White").otherwise("Black")
    signed = F.concat(F.when(c > 0, "+").when(c < 0, "-").otherwise(""), tenths(c))
    level = F.when(F.abs(c) < 90, "slightly better for ").when(F.abs(c) < 200, "clearly better for ").otherwise("winning for ")
    by_mate = F.concat(F.when(m > 0, "White").otherwise("Black"), F.lit(" mates in "), F.abs(m).cast("string"))
    return F.when(mate.isNotNull(), by_mate).when(F.abs(c) < 30, "roughly equal").otherwise(F.concat(level, who, F.lit(" ("), signed, F.lit(")")))


def display_score(cp: Column, mate: Column, side: Column) -> Column:
    """+1.25, #-3 or ?, seen from White."""
    sign = F.when(side == "w", 1).otherwise(-1)
    c = cp * sign
    whole = F.concat(F.floor(F.abs(c) / 100).cast("string"), F.lit("."), F.lpad((F.abs(c) % 100).cast("string"), 2, "0"))
    return F.when(mate.isNotNull(), F.concat(F.lit("#"), (mate * sign).cast("string"))).when(cp.isNotNull(), F.concat(F.when(c > 0, "+").when(c < 0, "-").otherwise(""), whole)).otherwise("?")


def white_share(win: Column, side: Column, stale: Column) -> Column:
    p = F.when(side == "w", win).otherwise(100 - win)
    return F.when(~stale, F.greatest(F.lit(0.0), F.least(F.lit(100.0), p)))


def move_match(positions: DataFrame, top: DataFrame, own: DataFrame, id: str = "position_id") -> DataFrame:
    """``top``: id, move, win; ``own``: id and win of the solution's own line. Only other moves need the own line."""
    t = positions.join(top.select(id, F.col("move").alias("engine_move"), F.col("win").alias("engine_win_pct")), id)
    exact = F.col("engine_move") == F.col("solution_move")
    joined = t.withColumn("exact", exact).join(own.select(id, F.col("win").alias("own_win")), id, "left")
    sol = F.when(F.col("exact"), F.col("engine_win_pct")).otherwise(F.col("own_win"))
    near = F.abs(F.col("engine_win_pct") - sol) <= EQUIVALENT
    return joined.withColumn("solution_win_pct", sol).withColumn("matched", F.col("exact") | F.coalesce(near, F.lit(False))).drop("own_win")


def reuse_line(baseline: DataFrame, known: DataFrame, forced: DataFrame, id: str = "position_id") -> DataFrame:
    """The known line if it was searched as deep as the baseline, else the forced one at the capped depth; no baseline, no row."""
    b = baseline.select(id, F.col("depth").alias("base_depth"))
    k = known.select(id, F.col("depth").alias("k_depth"), F.col("cp").alias("k_cp"))
    f = forced.select(id, F.col("depth").alias("f_depth"), F.col("cp").alias("f_cp"))
    j = b.join(k, id, "left").join(f, id, "left")
    same = F.col("k_depth") == F.col("base_depth")
    asked = F.least("base_depth", F.lit(DEPTH_CAP))
    return j.select(id, "base_depth", F.when(same, "known").when(F.col("f_depth") >= asked, "forced").otherwise("none").alias("line_from"), F.when(same, F.col("k_cp")).when(F.col("f_depth") >= asked, F.col("f_cp")).alias("cp"))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def cost(usage: DataFrame, prices: DataFrame, config: str = "config") -> DataFrame:
    """Mean cost of a judgment, from token sums and prices per million tokens."""
    n = usage.groupBy(config).agg(F.count("*").alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    each = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / F.col("n") / 1e6
    return n.join(F.broadcast(prices), config).select(config, "n", each.alias("cost"))
