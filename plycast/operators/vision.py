"""Square classifier scores: best class, the king rule, accuracies, class weights; boxes and plans for crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITE_KING, BLACK_KING, CLASSES = 6, 12, 13


def argmax(scores: Column) -> Column:
    """The first class with the greatest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _next_best(scores: Column, without: int) -> Column:
    return argmax(F.transform(scores, lambda x, i: F.when(i == without, F.lit(float("-inf"))).otherwise(x)))


def enforce_kings(df: DataFrame, board: str = "board_id", square: str = "square", scores: str = "scores") -> DataFrame:
    """One king of each colour per board: the surest claimant keeps it, others take their next best class; without a
    claimant the surest square that is not the other king's gets it. White first, then Black on what that gave."""
    d = df.withColumn("pred", argmax(F.col(scores)))
    for king, other in ((WHITE_KING, BLACK_KING), (BLACK_KING, WHITE_KING)):
        claims = F.col("pred") == king
        n = F.count_if(claims).over(Window.partitionBy(board))
        # claimants stand first; where there are none, squares of the other king stand last
        rank = F.row_number().over(Window.partitionBy(board).orderBy(F.desc(claims), F.col("pred") == other, F.desc(F.col(scores)[king]), square))
        d = d.withColumns({"__n": n, "__r": rank})
        new = F.when((F.col("__n") > 1) & claims & (F.col("__r") > 1), _next_best(F.col(scores), king)).when((F.col("__n") == 0) & (F.col("__r") == 1) & (F.col("pred") != other), king).otherwise(F.col("pred"))
        d = d.withColumn("pred", new).drop("__n", "__r")
    return d


def accuracy(df: DataFrame) -> DataFrame:
    """Per class, absent classes as null, and the whole as class -1."""
    classes = df.sparkSession.range(CLASSES).select(F.col("id").cast("int").alias("label"))
    each = df.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 6).alias("accuracy"))
    every = df.agg(F.lit(-1).alias("label"), F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 6).alias("accuracy"))
    return F.broadcast(classes).join(each, "label", "left").withColumn("n", F.coalesce("n", F.lit(0))).unionByName(every)


def class_weights(df: DataFrame) -> DataFrame:
    """Total over 13 times the class's count (1 at least)."""
    classes = df.sparkSession.range(CLASSES).select(F.col("id").cast("int").alias("label"))
    n = classes.join(df.groupBy("label").agg(F.count("*").alias("n")), "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # 13 rows
    return n.withColumn("weight", total / (CLASSES * F.greatest("n", F.lit(1))))


def misses(df: DataFrame) -> DataFrame:
    return df.filter("pred <> label").groupBy("label", "pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "pred")


def boards_right(df: DataFrame, board: str = "board_id") -> DataFrame:
    """Share of squares and of whole boards that are right, before and after the king rule (raw, pred)."""
    b = df.groupBy(board).agg(F.avg((F.col("raw") == F.col("label")).cast("double")).alias("r"), F.avg((F.col("pred") == F.col("label")).cast("double")).alias("p"), F.count("*").alias("n"))
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 6)
    return b.agg(F.count("*").alias("n_boards"), mean("r").alias("raw_squares"), mean("p").alias("squares"), F.round(F.avg((F.col("r") == 1).cast("double")), 6).alias("raw_boards"), F.round(F.avg((F.col("p") == 1).cast("double")), 6).alias("boards"))


def parity(a: DataFrame, b: DataFrame, keys: tuple = ("board_id", "square")) -> DataFrame:
    j = a.select(*keys, F.col("pred").alias("x")).join(b.select(*keys, F.col("pred").alias("y")), list(keys))
    return j.agg(F.count("*").alias("n"), F.round(F.avg((F.col("x") == F.col("y")).cast("double")), 6).alias("same"))


def best_epoch(log: DataFrame, run: str = "run") -> DataFrame:
    return log.groupBy(run).agg(F.max_by("epoch", F.struct("accuracy", -F.col("epoch"))).alias("epoch"), F.max("accuracy").alias("accuracy"))


def crop_boxes(images: DataFrame, side: str = "side", jitter_x: str = "jx", jitter_y: str = "jy") -> DataFrame:
    """64 boxes per image, moved by a jitter and kept inside it. Halves round to even."""
    s = F.col(side) / 8
    row, col = F.floor(F.col("square") / 8), F.col("square") % 8
    inside = lambda v: F.greatest(F.lit(0), F.least(F.col(side), F.bround(v).cast("int")))
    boxes = images.withColumn("square", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return boxes.withColumns({"x0": inside(col * s + F.col(jitter_x)), "y0": inside(row * s + F.col(jitter_y)), "x1": inside((col + 1) * s + F.col(jitter_x)), "y1": inside((row + 1) * s + F.col(jitter_y))})


def crop_region(w: Column, h: Column, x: Column, y: Column, size: Column) -> dict[str, Column]:
    """The asked square, its size kept within [64, shorter side] and its place inside the image; none asked: the largest, centred."""
    short = F.least(w, h)
    s = F.coalesce(F.least(F.greatest(size, F.lit(64)), short), short)
    at = lambda v, whole: F.coalesce(F.greatest(F.lit(0), F.least(v, whole - s)), F.floor((whole - s) / 2).cast("int"))
    return {"crop_size": s, "crop_x": at(x, w), "crop_y": at(y, h)}
