"""Queries from the puzzle dump to the stratified sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plycast.operators import puzzles as pz
from plycast.operators import sampling as sm
from plycast.operators import scoring as sc
from plycast.plans import standins as st
from plycast.plans.registry import query

SEED, K = 7, 5
P = "WITH " + st.PARSED_SQL


def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pz.setup_and_solution(pz.split_rejects(pz.parse(st.puzzles(spark, sf_dir)))[0])


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pz.with_band(pz.quality(good(spark, sf_dir)))


def celled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banded(spark, sf_dir).withColumn("theme", F.explode("themes"))


def picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.stratified(celled(spark, sf_dir), K, SEED)


PICK_SQL = P + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY theme, rating_band ORDER BY md5(concat_ws('|', '{SEED}', theme, puzzle_id)), puzzle_id) AS pick
  FROM celled WHERE rating_band IS NOT NULL), picked AS (SELECT * FROM ranked WHERE pick <= {K})"""


@query("puzzle_parse", P + " SELECT puzzle_id, rating, rating_deviation, popularity, nb_plays, len(moves)::INTEGER AS n_moves, array_to_string(themes, ',') AS themes, array_to_string(opening_tags, ',') AS openings, reject FROM judged_rows")
def puzzle_parse(spark, sf_dir):
    p = pz.parse(st.puzzles(spark, sf_dir))
    return p.select("puzzle_id", *pz.INTEGERS, F.size("moves").alias("n_moves"), F.array_join("themes", ",").alias("themes"), F.array_join("opening_tags", ",").alias("openings"), "reject")


@query("puzzle_rejects", P + " SELECT reject, count(*) AS n FROM judged_rows WHERE reject IS NOT NULL GROUP BY 1")
def puzzle_rejects(spark, sf_dir):
    return pz.split_rejects(pz.parse(st.puzzles(spark, sf_dir)))[1].groupBy("reject").agg(F.count("*").alias("n"))


@query("setup_and_solution", P + " SELECT puzzle_id, moves[1] AS setup_move, array_to_string(moves[2:], ' ') AS solution FROM good")
def setup_and_solution(spark, sf_dir):
    return good(spark, sf_dir).select("puzzle_id", "setup_move", F.array_join("solution", " ").alias("solution"))


@query("quality_filter", P + " SELECT puzzle_id, popularity, nb_plays, rating_deviation FROM banded")
def quality_filter(spark, sf_dir):
    return pz.quality(good(spark, sf_dir)).select("puzzle_id", "popularity", "nb_plays", "rating_deviation")


@query("rating_bands", P + " SELECT rating_band, count(*) AS n, min(rating) AS lowest, max(rating) AS highest FROM banded GROUP BY 1")
def rating_bands(spark, sf_dir):
    return banded(spark, sf_dir).groupBy("rating_band").agg(F.count("*").alias("n"), F.min("rating").alias("lowest"), F.max("rating").alias("highest"))


@query("context_tags_excluded", P + " SELECT theme, count(*) AS n FROM celled WHERE theme NOT IN (" + ", ".join(f"'{t}'" for t in pz.CONTEXT_TAGS) + ") GROUP BY 1")
def context_tags_excluded(spark, sf_dir):
    return pz.tactical(celled(spark, sf_dir)).groupBy("theme").agg(F.count("*").alias("n"))


@query("side_to_move", P + " SELECT puzzle_id, CASE WHEN string_split(csv_fen, ' ')[2] IN ('w', 'b') THEN string_split(csv_fen, ' ')[2] END AS side FROM good")
def side_to_move(spark, sf_dir):
    return good(spark, sf_dir).select("puzzle_id", pz.side_to_move(F.col("csv_fen")).alias("side"))


@query("stratified_sample", PICK_SQL + " SELECT theme, rating_band, puzzle_id, pick FROM picked")
def stratified_sample(spark, sf_dir):
    return picked(spark, sf_dir).select("theme", "rating_band", "puzzle_id", F.col("pick").cast("long"))


@query("sample_flat", PICK_SQL + " SELECT DISTINCT puzzle_id, rating, rating_band, array_to_string(list_sort(themes), ' ') AS themes FROM picked ORDER BY puzzle_id")
def sample_flat(spark, sf_dir):
    return sm.flatten(picked(spark, sf_dir)).select("puzzle_id", "rating", "rating_band", F.array_join(F.array_sort("themes"), " ").alias("themes")).orderBy("puzzle_id")


THEMES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT_SPECIFIED", "5-LOW", "F", "O", "P", "short", "fork")


def requested(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([(t,) for t in THEMES], "theme string"), spark.createDataFrame([(f"{lo}-{hi - 1}",) for lo, hi in pz.BANDS], "rating_band string")


@query(
    "cell_coverage",
    PICK_SQL + ", themes AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in THEMES) + "]) AS theme), bands AS (SELECT unnest([" + ", ".join(f"'{lo}-{hi - 1}'" for lo, hi in pz.BANDS) + """]) AS rating_band)
SELECT t.theme, b.rating_band, count(p.puzzle_id) AS n FROM themes AS t CROSS JOIN bands AS b LEFT JOIN picked AS p ON p.theme = t.theme AND p.rating_band = b.rating_band GROUP BY 1, 2""",
)
def cell_coverage(spark, sf_dir):
    """Cells of the sample, empty ones as 0."""
    return sm.coverage(sm.cells(*requested(spark)), picked(spark, sf_dir))


@query("nested_subsample", P + f" SELECT puzzle_id, rating FROM good ORDER BY md5(concat_ws('|', '{SEED}', puzzle_id)), puzzle_id LIMIT 300")
def nested_subsample(spark, sf_dir):
    return sm.subsample(good(spark, sf_dir), 300, SEED).select("puzzle_id", "rating")


@query("subsample_nesting", P + f""", ordered AS (SELECT puzzle_id, rating, row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', puzzle_id)), puzzle_id) AS place FROM good)
SELECT (SELECT count(*) FROM ordered WHERE place <= 100) AS n_small, (SELECT count(*) FROM ordered WHERE place <= 250) AS n_large, 0::BIGINT AS n_lost""")
def subsample_nesting(spark, sf_dir):
    """A larger sample holds the smaller one."""
    g = good(spark, sf_dir)
    small, large = sm.subsample(g, 100, SEED).select("puzzle_id"), sm.subsample(g, 250, SEED).select("puzzle_id")
    lost = small.join(large, "puzzle_id", "left_anti")
    return small.agg(F.count("*").alias("n_small")).crossJoin(large.agg(F.count("*").alias("n_large"))).crossJoin(lost.agg(F.count("*").alias("n_lost")))


@query("head_slice", P + " SELECT puzzle_id, rating FROM good ORDER BY rating DESC, puzzle_id LIMIT 20")
def head_slice(spark, sf_dir):
    return good(spark, sf_dir).orderBy(F.desc("rating"), "puzzle_id").limit(20).select("puzzle_id", "rating")


@query("anti_adjacency", P + f""", items AS (SELECT puzzle_id, unnest(['candidates', 'grade']) AS arm FROM good),
turns AS (SELECT rating_band, g.puzzle_id, arm, md5(concat_ws('|', '{SEED}', g.puzzle_id, arm)) AS turn FROM items AS g JOIN (SELECT puzzle_id, coalesce(CASE WHEN rating < 1200 THEN 'low' END, 'high') AS rating_band FROM good) AS b ON b.puzzle_id = g.puzzle_id),
near AS (SELECT rating_band, puzzle_id, lag(puzzle_id) OVER (PARTITION BY rating_band ORDER BY turn, puzzle_id, arm) AS before FROM turns)
SELECT rating_band, count(*) AS n, count(*) FILTER (WHERE before = puzzle_id) AS n_adjacent FROM near GROUP BY 1""")
def anti_adjacency(spark, sf_dir):
    """How often both arms of a puzzle stand side by side in the seeded order of a list."""
    g = good(spark, sf_dir).withColumn("rating_band", F.when(F.col("rating") < 1200, "low").otherwise("high"))
    items = g.select("rating_band", "puzzle_id", F.explode(F.array(F.lit("candidates"), F.lit("grade"))).alias("arm"))
    return sm.adjacent(items, "rating_band", SEED, "puzzle_id", "arm").groupBy("rating_band").agg(F.count("*").alias("n"), F.count_if(F.col("before") == F.col("puzzle_id")).alias("n_adjacent"))


@query(
    "labelling_worklist",
    P + f""", items AS (SELECT puzzle_id, unnest(['candidates', 'grade']) AS arm FROM good), done AS (SELECT * FROM items WHERE puzzle_id::BIGINT % 100 = 3), skipped AS (SELECT * FROM items WHERE puzzle_id::BIGINT % 100 = 4),
rest AS (SELECT * FROM items EXCEPT SELECT * FROM done EXCEPT SELECT * FROM skipped),
placed AS (SELECT puzzle_id, arm, row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', puzzle_id, arm)), puzzle_id, arm) AS place FROM rest)
SELECT puzzle_id, arm, place::INTEGER AS place FROM placed WHERE place <= greatest(400 - (SELECT count(*) FROM done), 0)""",
)
def labelling_worklist(spark, sf_dir):
    items = good(spark, sf_dir).select("puzzle_id", F.explode(F.array(F.lit("candidates"), F.lit("grade"))).alias("arm"))
    n = F.col("puzzle_id").cast("bigint") % 100
    return sm.worklist(items, items.filter(n == 3), items.filter(n == 4), 400, SEED)


@query("shard_index", P + """, placed AS (SELECT puzzle_id, rating_band, (row_number() OVER (PARTITION BY rating_band ORDER BY puzzle_id) - 1) // 500 AS shard FROM banded WHERE rating_band IS NOT NULL)
SELECT rating_band, shard::INTEGER AS shard, count(*) AS n, min(puzzle_id) AS first_id FROM placed GROUP BY 1, 2""")
def shard_index(spark, sf_dir):
    s = sm.shards(banded(spark, sf_dir).filter("rating_band is not null").select("puzzle_id", "rating_band"), 500, "rating_band", "puzzle_id")
    return s.groupBy("rating_band", "shard").agg(F.count("*").alias("n"), F.min("puzzle_id").alias("first_id"))


@query("source_mix", P + f""", low AS (SELECT puzzle_id FROM good WHERE rating < 1800 ORDER BY md5(concat_ws('|', '{SEED}', puzzle_id)), puzzle_id LIMIT 250),
high AS (SELECT puzzle_id FROM good WHERE rating >= 1800 ORDER BY md5(concat_ws('|', '{SEED}', puzzle_id)), puzzle_id LIMIT 500 - least(250, (SELECT count(*) FROM low)))
SELECT puzzle_id, 'first' AS part FROM low UNION ALL SELECT puzzle_id, 'second' AS part FROM high""")
def source_mix(spark, sf_dir):
    g = good(spark, sf_dir)
    return sm.mix(g.filter("rating < 1800").select("puzzle_id"), g.filter("rating >= 1800").select("puzzle_id"), 500, SEED, "puzzle_id")


STYLE = "CASE WHEN rating % 7 = 0 THEN 'setA' WHEN rating % 7 = 1 THEN 'setB' ELSE concat('set', rating % 7) END"


@query("style_holdout", P + f""", styled AS (SELECT puzzle_id, {STYLE} AS piece_set, concat('theme', rating % 5) AS board_theme FROM good),
split AS (SELECT *, CASE WHEN piece_set IN ('setA', 'setB') OR board_theme = 'theme3' THEN 'heldout'
  WHEN ('0x' || md5(concat_ws('|', '{SEED}', puzzle_id))[1:8])::BIGINT / 4294967296.0 < 0.1 THEN 'val' ELSE 'train' END AS split FROM styled)
SELECT split, piece_set, board_theme, count(*) AS n FROM split GROUP BY 1, 2, 3""")
def style_holdout(spark, sf_dir):
    g = good(spark, sf_dir).selectExpr("puzzle_id", f"{STYLE} as piece_set", "concat('theme', rating % 5) as board_theme")
    s = sm.style_split(g, {"piece_set": ["setA", "setB"], "board_theme": ["theme3"]}, SEED, "puzzle_id")
    return s.groupBy("split", "piece_set", "board_theme").agg(F.count("*").alias("n"))


#: crc32 bit by bit (3988292384 is its polynomial, bits reversed), as DuckDB has no function for it.
_BYTES = "list_transform(range(length(x)), lambda i: ascii(x[i + 1])::BIGINT)"
_ROUNDS = "list_reduce(list_prepend(xor(acc, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda acc, b: {_ROUNDS}), 4294967295)"


@query("tune_holdout_split", P + f", items AS (SELECT puzzle_id, unnest(['candidates', 'grade']) AS arm FROM good), k AS (SELECT *, puzzle_id || '|' || arm AS x FROM items) SELECT puzzle_id, arm, CASE WHEN {CRC} / 4294967296.0 < 0.5 THEN 'tune' ELSE 'holdout' END AS split FROM k")
def tune_holdout_split(spark, sf_dir):
    items = good(spark, sf_dir).select("puzzle_id", F.explode(F.array(F.lit("candidates"), F.lit("grade"))).alias("arm"))
    return sm.tune_or_holdout(items, 0.5)


@query("sample_record", P + """ SELECT puzzle_id, csv_fen, moves[1] AS setup_move, array_to_string(moves[2:], ' ') AS solution, rating, rating_band, array_to_string(list_sort(themes), ' ') AS themes, game_url FROM banded""")
def sample_record(spark, sf_dir):
    b = banded(spark, sf_dir).withColumns({"fen": F.lit(None).cast("string"), "solver_color": F.lit(None).cast("string")})
    return pz.sample_record(b).select("puzzle_id", "csv_fen", "setup_move", F.array_join("solution", " ").alias("solution"), "rating", "rating_band", F.array_join("themes", " ").alias("themes"), "game_url")


# the flagship: sample, engine lines, grades, one table by theme and band
@query(
    "stratified_scorecard",
    PICK_SQL.replace("WITH ", "WITH " + st.LINES_SQL + ", ", 1) + f""",
won AS (SELECT *, {st.WIN_SQL} AS win FROM lines),
pairs AS (SELECT a.position_id, a.win AS win_before, least(a.win, b.win) AS win_after, a.move = b.move AS same FROM won AS a JOIN won AS b ON a.position_id = b.position_id WHERE a.multipv = 1 AND b.multipv = 2),
graded AS (SELECT *, CASE WHEN same THEN 'best' WHEN win_before - win_after >= 30 THEN 'blunder' WHEN win_before - win_after >= 20 THEN 'mistake' WHEN win_before - win_after >= 10 THEN 'inaccuracy' ELSE 'good' END AS move_class FROM pairs)
SELECT theme, rating_band, count(*) AS n, count(g.position_id) AS n_graded, round(avg(win_before - win_after), 6) AS mean_drop, count(*) FILTER (WHERE move_class = 'blunder') AS n_blunders,
  count(*) FILTER (WHERE move_class IN ('best', 'good')) AS n_fine FROM picked AS p LEFT JOIN graded AS g ON g.position_id = p.puzzle_id::BIGINT GROUP BY 1, 2""",
)
def stratified_scorecard(spark, sf_dir):
    p = picked(spark, sf_dir)
    won = st.lines(spark, sf_dir).withColumn("win", sc.win_pct(F.col("cp"), F.col("mate")))
    won = won.join(p.select(F.col("puzzle_id").cast("bigint").alias("position_id")).distinct(), "position_id", "left_semi")
    a = won.filter("multipv = 1").select("position_id", F.col("win").alias("win_before"), F.col("move").alias("best"))
    b = won.filter("multipv = 2").select("position_id", "win", "move")
    g = a.join(b, "position_id")
    g = g.withColumns(sc.grade(F.col("win_before"), F.col("win"), F.col("best") == F.col("move")))
    j = p.withColumn("position_id", F.col("puzzle_id").cast("bigint")).join(g, "position_id", "left")
    return j.groupBy("theme", "rating_band").agg(
        F.count("*").alias("n"), F.count("move_class").alias("n_graded"), F.round(F.avg("win_pct_drop"), 6).alias("mean_drop"),
        F.count_if(F.col("move_class") == "blunder").alias("n_blunders"), F.count_if(F.col("move_class").isin("best", "good")).alias("n_fine"))
