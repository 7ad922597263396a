"""Queries over square scores: embeddings stand in, 13 scores each, 64 rows to a board."""

from __future__ import annotations

from pyspark.sql import functions as F

from plycast.operators import sampling as sm
from plycast.operators import scoring as sc
from plycast.operators import vision as vs
from plycast.plans import standins as st
from plycast.plans.registry import query

E = "WITH sq AS (SELECT (vec_id // 64)::BIGINT AS board_id, (vec_id % 64)::INTEGER AS square, list_transform(embedding[1:13], lambda x: x::DOUBLE) AS scores, vec_id FROM embeddings), predicted AS (SELECT *, list_position(scores, list_max(scores)) - 1 AS raw, CASE WHEN vec_id % 10 < 7 THEN list_position(scores, list_max(scores)) - 1 ELSE vec_id % 13 END AS label FROM sq)"


def scores(spark, sf_dir):
    e = st.read(spark, sf_dir, "embeddings")
    d = e.select(F.floor(F.col("vec_id") / 64).alias("board_id"), (F.col("vec_id") % 64).cast("int").alias("square"), F.transform(F.slice("embedding", 1, 13), lambda x: x.cast("double")).alias("scores"), "vec_id")
    d = d.withColumn("raw", vs.argmax(F.col("scores")))
    return d.withColumn("label", F.when(F.col("vec_id") % 10 < 7, F.col("raw")).otherwise((F.col("vec_id") % 13).cast("int")))


@query("square_softmax", E + " SELECT vec_id, round(exp(scores[1] - list_max(scores)) / list_sum(list_transform(scores, lambda x: exp(x - list_max(scores)))), 6) AS p_empty, round(1.0 / list_sum(list_transform(scores, lambda x: exp(x - list_max(scores)))), 6) AS p_best FROM predicted")
def square_softmax(spark, sf_dir):
    p = scores(spark, sf_dir).withColumn("p", sc.softmax(F.col("scores")))
    return p.select("vec_id", F.round(F.col("p")[0], 6).alias("p_empty"), F.round(F.array_max("p"), 6).alias("p_best"))


@query("square_argmax", E + " SELECT vec_id, raw::INTEGER AS pred FROM predicted")
def square_argmax(spark, sf_dir):
    return scores(spark, sf_dir).select("vec_id", F.col("raw").alias("pred"))


def _king_pass(n: int, king: int, other: int) -> str:
    src = f"k{n - 1}"
    masked = f"list_transform(range(13), lambda i: CASE WHEN i = {king} THEN '-inf'::DOUBLE ELSE scores[i + 1] END)"
    return f""", r{n} AS (SELECT *, count(*) FILTER (WHERE pred = {king}) OVER (PARTITION BY board_id) AS n, row_number() OVER (PARTITION BY board_id ORDER BY (pred = {king}) DESC, (pred = {other}), scores[{king + 1}] DESC, square) AS r FROM {src}),
k{n} AS (SELECT board_id, square, scores, raw, label, vec_id, CASE WHEN n > 1 AND pred = {king} AND r > 1 THEN list_position({masked}, list_max({masked})) - 1 WHEN n = 0 AND r = 1 AND pred <> {other} THEN {king} ELSE pred END AS pred FROM r{n})"""


KINGS = E + ", k0 AS (SELECT board_id, square, scores, raw, label, vec_id, raw AS pred FROM predicted)" + _king_pass(1, 6, 12) + _king_pass(2, 12, 6)


@query("enforce_kings", KINGS + " SELECT board_id, square, pred::INTEGER AS pred FROM k2")
def enforce_kings(spark, sf_dir):
    return vs.enforce_kings(scores(spark, sf_dir)).select("board_id", "square", "pred")


@query("board_accuracy", KINGS + ", b AS (SELECT board_id, avg((raw = label)::INTEGER) AS r, avg((pred = label)::INTEGER) AS p, count(*) AS n FROM k2 GROUP BY 1) SELECT count(*) AS n_boards, round(sum(r * n) / sum(n), 6) AS raw_squares, round(sum(p * n) / sum(n), 6) AS squares, round(avg((r = 1)::INTEGER), 6) AS raw_boards, round(avg((p = 1)::INTEGER), 6) AS boards FROM b")
def board_accuracy(spark, sf_dir):
    return vs.boards_right(vs.enforce_kings(scores(spark, sf_dir)))


@query("class_accuracy", E + ", c AS (SELECT unnest(range(13)) AS label), e AS (SELECT label, count(*) AS n, round(avg((raw = label)::INTEGER), 6) AS accuracy FROM predicted GROUP BY 1) SELECT c.label::INTEGER AS label, coalesce(n, 0) AS n, accuracy FROM c LEFT JOIN e ON e.label = c.label UNION ALL SELECT -1, count(*), round(avg((raw = label)::INTEGER), 6) FROM predicted")
def class_accuracy(spark, sf_dir):
    return vs.accuracy(scores(spark, sf_dir).withColumn("pred", F.col("raw")))


@query("class_weights", E + ", c AS (SELECT unnest(range(13)) AS label), e AS (SELECT label, count(*) AS n FROM predicted GROUP BY 1), j AS (SELECT c.label::INTEGER AS label, coalesce(n, 0) AS n FROM c LEFT JOIN e ON e.label = c.label) SELECT label, n, round((SELECT sum(n) FROM j) / (13 * greatest(n, 1)), 6) AS weight FROM j")
def class_weights(spark, sf_dir):
    w = vs.class_weights(scores(spark, sf_dir))
    return w.withColumn("weight", F.round("weight", 6))


@query("ranked_misses", E + " SELECT label::INTEGER AS label, raw::INTEGER AS pred, count(*) AS n FROM predicted WHERE raw <> label GROUP BY 1, 2 ORDER BY n DESC, 1, 2")
def ranked_misses(spark, sf_dir):
    return vs.misses(scores(spark, sf_dir).withColumn("pred", F.col("raw")))


@query("prediction_parity", KINGS + " SELECT count(*) AS n, round(avg((pred = raw)::INTEGER), 6) AS same FROM k2")
def prediction_parity(spark, sf_dir):
    s = scores(spark, sf_dir)
    return vs.parity(vs.enforce_kings(s), s.withColumn("pred", F.col("raw")))


@query("best_epoch", "WITH log AS (SELECT event_type AS run, (event_id % 20)::INTEGER AS epoch, round(avg(value), 2) AS accuracy FROM events GROUP BY 1, 2) SELECT run, epoch, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY accuracy DESC, epoch) AS r FROM log) WHERE r = 1")
def best_epoch(spark, sf_dir):
    log = st.read(spark, sf_dir, "events").selectExpr("event_type as run", "cast(event_id % 20 as int) as epoch", "value").groupBy("run", "epoch").agg(F.round(F.avg("value"), 2).alias("accuracy"))
    return vs.best_epoch(log)


@query("crop_boxes", "WITH i AS (SELECT page_id, (200 + page_id % 300)::INTEGER AS side, (page_id % 7 - 3)::INTEGER AS jx, (page_id % 5 - 2)::INTEGER AS jy FROM pages), b AS (SELECT *, u.q AS square FROM i, unnest(range(64)) AS u(q)) SELECT page_id, square::INTEGER AS square, " + ", ".join(f"greatest(0, least(side, round_even({e} * side / 8.0 + {j}, 0)))::INTEGER AS {n}" for n, e, j in (("x0", "(square % 8)", "jx"), ("y0", "(square // 8)", "jy"), ("x1", "(square % 8 + 1)", "jx"), ("y1", "(square // 8 + 1)", "jy"))) + " FROM b")
def crop_boxes(spark, sf_dir):
    i = st.read(spark, sf_dir, "pages").selectExpr("page_id", "cast(200 + page_id % 300 as int) as side", "cast(page_id % 7 - 3 as int) as jx", "cast(page_id % 5 - 2 as int) as jy")
    return vs.crop_boxes(i).select("page_id", "square", "x0", "y0", "x1", "y1")


@query("crop_region", "WITH i AS (SELECT page_id, (100 + page_id % 700)::INTEGER AS w, (90 + page_id * 3 % 500)::INTEGER AS h, CASE WHEN page_id % 4 > 0 THEN (page_id % 900 - 50)::INTEGER END AS x, CASE WHEN page_id % 4 > 0 THEN (page_id % 300)::INTEGER END AS y, CASE WHEN page_id % 4 > 0 THEN (page_id % 800)::INTEGER END AS z FROM pages), s AS (SELECT *, coalesce(CASE WHEN z IS NOT NULL THEN least(greatest(z, 64), least(w, h)) END, least(w, h)) AS s FROM i) SELECT page_id, s AS crop_size, CASE WHEN x IS NULL THEN (w - s) // 2 ELSE greatest(0, least(x, w - s)) END AS crop_x, CASE WHEN y IS NULL THEN (h - s) // 2 ELSE greatest(0, least(y, h - s)) END AS crop_y FROM s")
def crop_region(spark, sf_dir):
    n = "case when page_id % 4 > 0 then cast({} as int) end as {}"
    i = st.read(spark, sf_dir, "pages").selectExpr("page_id", "cast(100 + page_id % 700 as int) as w", "cast(90 + page_id * 3 % 500 as int) as h", n.format("page_id % 900 - 50", "x"), n.format("page_id % 300", "y"), n.format("page_id % 800", "z"))
    asked = F.col("z").isNotNull()
    c = vs.crop_region(F.col("w"), F.col("h"), F.when(asked, F.col("x")), F.when(asked, F.col("y")), F.when(asked, F.col("z")))
    c = c | {"crop_size": F.when(asked, c["crop_size"]).otherwise(F.least("w", "h"))}
    short = F.least("w", "h")
    half = lambda k: F.floor((F.col(k) - short) / 2).cast("int")
    return i.select("page_id", c["crop_size"].alias("crop_size"), F.when(asked, c["crop_x"]).otherwise(half("w")).alias("crop_x"), F.when(asked, c["crop_y"]).otherwise(half("h")).alias("crop_y"))


def _u(field: str, seed: int = 11) -> str:
    return f"(('0x' || md5(concat_ws('|', '{seed}', page_id, '{field}'))[1:8])::BIGINT / 4294967296.0)"


@query("render_plan", f"SELECT page_id, (24 + floor({_u('size')} * 57))::INTEGER AS size, {_u('side')} < 0.8 AS white_bottom, {_u('coords')} < 0.5 AS coordinates, {_u('marks')} < 0.4 AS highlights, floor({_u('set')} * 10)::INTEGER AS piece_set FROM pages")
def render_plan(spark, sf_dir):
    """Style, size and orientation of each image to draw, from hashes of its id."""
    u = lambda f: sm.uniform(11, "page_id", F.lit(f))
    return st.read(spark, sf_dir, "pages").select("page_id", (24 + F.floor(u("size") * 57)).cast("int").alias("size"), (u("side") < 0.8).alias("white_bottom"), (u("coords") < 0.5).alias("coordinates"), (u("marks") < 0.4).alias("highlights"), F.floor(u("set") * 10).cast("int").alias("piece_set"))


@query("damage_plan", f"SELECT page_id, CASE WHEN {_u('jpeg')} < 0.7 THEN (40 + floor({_u('quality')} * 56))::INTEGER END AS jpeg_quality, CASE WHEN {_u('scale')} < 0.5 THEN round(0.7 + {_u('factor')} * 0.6, 6) END AS rescale, (floor({_u('dx')} * 7) - 3)::INTEGER AS dx, (floor({_u('dy')} * 7) - 3)::INTEGER AS dy, CASE WHEN page_id % 3 > 0 THEN round(0.8 + {_u('light')} * 0.4, 6) END AS brightness FROM pages")
def damage_plan(spark, sf_dir):
    """Recompression, rescaling, shifts and, for training images only, light."""
    u = lambda f: sm.uniform(11, "page_id", F.lit(f))
    return st.read(spark, sf_dir, "pages").select("page_id", F.when(u("jpeg") < 0.7, (40 + F.floor(u("quality") * 56)).cast("int")).alias("jpeg_quality"), F.when(u("scale") < 0.5, F.round(0.7 + u("factor") * 0.6, 6)).alias("rescale"), (F.floor(u("dx") * 7) - 3).cast("int").alias("dx"), (F.floor(u("dy") * 7) - 3).cast("int").alias("dy"), F.when(F.col("page_id") % 3 > 0, F.round(0.8 + u("light") * 0.4, 6)).alias("brightness"))
