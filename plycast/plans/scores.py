"""Queries over engine lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plycast.operators import scoring as sc
from plycast.plans import standins as st
from plycast.plans.registry import query

L = "WITH " + st.LINES_SQL
WON = L + f", won AS (SELECT *, {st.WIN_SQL} AS win FROM lines)"
SIDE = "CASE WHEN position_id % 2 = 0 THEN 'w' ELSE 'b' END"


def won(spark, sf_dir):
    return st.lines(spark, sf_dir).withColumn("win", sc.win_pct(F.col("cp"), F.col("mate")))


@query("win_percent", WON + " SELECT position_id, multipv, round(win, 6) AS win FROM won")
def win_percent(spark, sf_dir):
    return won(spark, sf_dir).select("position_id", "multipv", F.round("win", 6).alias("win"))


PAIRS = WON + """, pairs AS (SELECT a.position_id, a.win AS win_before, least(a.win, b.win) AS win_after, a.move = b.move AS same FROM won AS a JOIN won AS b ON a.position_id = b.position_id WHERE a.multipv = 1 AND b.multipv = 2),
graded AS (SELECT *, CASE WHEN same THEN 'best' WHEN win_before - win_after >= 30 THEN 'blunder' WHEN win_before - win_after >= 20 THEN 'mistake' WHEN win_before - win_after >= 10 THEN 'inaccuracy' ELSE 'good' END AS move_class FROM pairs)"""


def graded(spark, sf_dir):
    w = won(spark, sf_dir)
    a = w.filter("multipv = 1").select("position_id", F.col("win").alias("win_before"), F.col("move").alias("best"))
    b = w.filter("multipv = 2").select("position_id", "win", "move")
    j = a.join(b, "position_id")
    return j.withColumns(sc.grade(F.col("win_before"), F.col("win"), F.col("best") == F.col("move")))


@query("move_grades", PAIRS + " SELECT position_id, round(win_before, 6) AS win_before, round(win_after, 6) AS win_after, round(win_before - win_after, 6) AS win_drop, move_class FROM graded")
def move_grades(spark, sf_dir):
    return graded(spark, sf_dir).select("position_id", F.round("win_before", 6).alias("win_before"), F.round("win_pct_after", 6).alias("win_after"), F.round("win_pct_drop", 6).alias("win_drop"), "move_class")


@query("grade_arm_applies", PAIRS + " SELECT move_class, count(*) AS n FROM graded WHERE move_class IN ('inaccuracy', 'mistake', 'blunder') GROUP BY 1")
def grade_arm_applies(spark, sf_dir):
    return graded(spark, sf_dir).filter(F.col("move_class").isin("inaccuracy", "mistake", "blunder")).groupBy("move_class").agg(F.count("*").alias("n"))


@query("eval_phrase", L + f""", s AS (SELECT *, {SIDE} AS side, CASE WHEN position_id % 2 = 0 THEN 1 ELSE -1 END AS sgn FROM lines), v AS (SELECT *, coalesce(cp, 0) * sgn AS c, mate * sgn AS m, (abs(coalesce(cp, 0)) + 5) // 10 AS t FROM s)
SELECT position_id, multipv, CASE WHEN m IS NOT NULL THEN CASE WHEN m > 0 THEN 'White' ELSE 'Black' END || ' mates in ' || abs(m) WHEN abs(c) < 30 THEN 'roughly equal'
  ELSE CASE WHEN abs(c) < 90 THEN 'slightly better for ' WHEN abs(c) < 200 THEN 'clearly better for ' ELSE 'winning for ' END || CASE WHEN c >= 0 THEN 'White' ELSE 'Black' END || ' (' || CASE WHEN c > 0 THEN '+' ELSE '-' END || (t // 10) || '.' || (t % 10) || ')' END AS phrase FROM v""")
def eval_phrase(spark, sf_dir):
    lines = st.lines(spark, sf_dir).withColumn("side", F.when(F.col("position_id") % 2 == 0, "w").otherwise("b"))
    return lines.select("position_id", "multipv", sc.eval_phrase(F.col("cp"), F.col("mate"), F.col("side")).alias("phrase"))


@query("display_score", L + f""", s AS (SELECT *, CASE WHEN position_id % 2 = 0 THEN 1 ELSE -1 END AS sgn FROM lines)
SELECT position_id, multipv, CASE WHEN mate IS NOT NULL THEN '#' || (mate * sgn) WHEN cp IS NOT NULL THEN CASE WHEN cp * sgn > 0 THEN '+' WHEN cp * sgn < 0 THEN '-' ELSE '' END || (abs(cp) // 100) || '.' || lpad((abs(cp) % 100)::VARCHAR, 2, '0') ELSE '?' END AS score FROM s""")
def display_score(spark, sf_dir):
    lines = st.lines(spark, sf_dir).withColumn("side", F.when(F.col("position_id") % 2 == 0, "w").otherwise("b"))
    return lines.select("position_id", "multipv", sc.display_score(F.col("cp"), F.col("mate"), F.col("side")).alias("score"))


@query("white_win_share", WON + " SELECT position_id, CASE WHEN position_id % 11 <> 0 THEN round(CASE WHEN position_id % 2 = 0 THEN win ELSE 100 - win END, 6) END AS share FROM won WHERE multipv = 1")
def white_win_share(spark, sf_dir):
    top = won(spark, sf_dir).filter("multipv = 1").withColumn("side", F.when(F.col("position_id") % 2 == 0, "w").otherwise("b"))
    return top.select("position_id", F.round(sc.white_share(F.col("win"), F.col("side"), F.col("position_id") % 11 == 0), 6).alias("share"))


@query("move_match", WON + """, sol AS (SELECT position_id, move AS solution_move, win FROM won WHERE multipv = CASE WHEN position_id % 3 = 0 THEN 1 ELSE 2 END),
j AS (SELECT t.position_id, t.move = s.solution_move AS exact, t.win AS engine_win, CASE WHEN t.move = s.solution_move THEN t.win ELSE s.win END AS solution_win FROM won AS t JOIN sol AS s ON s.position_id = t.position_id WHERE t.multipv = 1)
SELECT position_id, exact, round(engine_win, 6) AS engine_win_pct, round(solution_win, 6) AS solution_win_pct, exact OR abs(engine_win - solution_win) <= 3.0 AS matched FROM j""")
def move_match(spark, sf_dir):
    w = won(spark, sf_dir)
    own = w.filter(F.col("multipv") == F.when(F.col("position_id") % 3 == 0, 1).otherwise(2))
    m = sc.move_match(own.select("position_id", F.col("move").alias("solution_move")), w.filter("multipv = 1"), own)
    return m.select("position_id", "exact", F.round("engine_win_pct", 6).alias("engine_win_pct"), F.round("solution_win_pct", 6).alias("solution_win_pct"), "matched")


@query("line_reuse", L + """, b AS (SELECT * FROM lines WHERE multipv = 1), k AS (SELECT * FROM lines WHERE multipv = 2), f AS (SELECT * FROM lines WHERE multipv = 3)
SELECT b.position_id, b.depth AS base_depth, CASE WHEN k.depth = b.depth THEN 'known' WHEN f.depth >= least(b.depth, 30) THEN 'forced' ELSE 'none' END AS line_from,
  CASE WHEN k.depth = b.depth THEN k.cp WHEN f.depth >= least(b.depth, 30) THEN f.cp END AS cp FROM b LEFT JOIN k ON k.position_id = b.position_id LEFT JOIN f ON f.position_id = b.position_id""")
def line_reuse(spark, sf_dir):
    x = st.lines(spark, sf_dir)
    return sc.reuse_line(*(x.filter(F.col("multipv") == k) for k in (1, 2, 3)))


@query("judgment_cost", """WITH u AS (SELECT l_shipmode.mode AS config, l_quantity::BIGINT * 40 AS tokens_in, (l_linenumber * 100)::BIGINT AS tokens_out FROM (SELECT *, {'mode': CASE l_returnflag WHEN 'A' THEN 'low' WHEN 'N' THEN 'mid' ELSE 'high' END} AS l_shipmode FROM lineitem)),
p AS (SELECT * FROM (VALUES ('low', 1.0, 5.0), ('mid', 3.0, 15.0), ('high', 5.0, 25.0)) AS t(config, price_in, price_out))
SELECT u.config, count(*) AS n, round((sum(tokens_in) * any_value(price_in) + sum(tokens_out) * any_value(price_out)) / count(*) / 1e6, 9) AS cost FROM u JOIN p ON p.config = u.config GROUP BY 1""")
def judgment_cost(spark, sf_dir):
    u = st.read(spark, sf_dir, "lineitem").selectExpr("case l_returnflag when 'A' then 'low' when 'N' then 'mid' else 'high' end as config", "cast(l_quantity as bigint) * 40 as tokens_in", "cast(l_linenumber * 100 as bigint) as tokens_out")
    prices = spark.createDataFrame([("low", 1.0, 5.0), ("mid", 3.0, 15.0), ("high", 5.0, 25.0)], "config string, price_in double, price_out double")
    return sc.cost(u, prices).withColumn("cost", F.round("cost", 9))


@query("max_depth", L + " SELECT position_id, max(depth) AS max_depth, count(*) AS n_lines FROM lines GROUP BY 1")
def max_depth(spark, sf_dir):
    return st.lines(spark, sf_dir).groupBy("position_id").agg(F.max("depth").alias("max_depth"), F.count("*").alias("n_lines"))


@query("lines_in_order", L + " SELECT position_id, string_agg(move, ' ' ORDER BY multipv) AS moves FROM lines WHERE multipv <= 5 GROUP BY 1")
def lines_in_order(spark, sf_dir):
    x = st.lines(spark, sf_dir).filter("multipv <= 5").groupBy("position_id").agg(F.array_sort(F.collect_list(F.struct("multipv", "move"))).alias("l"))
    return x.select("position_id", F.array_join(F.col("l.move"), " ").alias("moves"))


@query("latest_line", """WITH s AS (SELECT l_orderkey AS position_id, (l_partkey % 3 + 1)::INTEGER AS multipv, l_quantity::INTEGER AS depth, l_shipdate, l_suppkey, l_partkey, l_extendedprice FROM lineitem)
SELECT position_id, multipv, depth FROM (SELECT *, row_number() OVER (PARTITION BY position_id, multipv ORDER BY l_shipdate DESC, l_suppkey DESC, l_partkey DESC, l_extendedprice DESC) AS r FROM s) WHERE r = 1""")
def latest_line(spark, sf_dir):
    """Of lines with one number in one search, the last one reported."""
    s = st.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as position_id", "cast(l_partkey % 3 + 1 as int) as multipv", "cast(l_quantity as int) as depth", "struct(l_shipdate, l_suppkey, l_partkey, l_extendedprice) as seq")
    return s.groupBy("position_id", "multipv").agg(F.max_by("depth", "seq").alias("depth"))


@query("deepening_only", """WITH e AS (SELECT l_orderkey AS position_id, l_shipdate AS ts, l_quantity::INTEGER AS depth, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem),
r AS (SELECT *, max(depth) OVER (PARTITION BY position_id ORDER BY ts, l_partkey, l_suppkey, l_linenumber, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT position_id, ts, depth FROM r WHERE before IS NULL OR depth > before""")
def deepening_only(spark, sf_dir):
    """A result is published only if it is deeper than all before it."""
    e = st.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as position_id", "l_shipdate as ts", "cast(l_quantity as int) as depth", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    w = Window.partitionBy("position_id").orderBy("ts", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("before", F.max("depth").over(w)).filter("before is null or depth > before").select("position_id", "ts", "depth")
