"""Queries that write prompts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plycast.operators import agreement as ag
from plycast.operators import boards as bd
from plycast.operators import prompts as pr
from plycast.operators import scorecard as sd
from plycast.plans import dump, logs, positions, texts
from plycast.plans import standins as st
from plycast.plans.registry import query
from plycast.sources import files

KEYS = {"cp": "cast(k % 700 - 350 as int)", "cp2": "cast(k % 450 - 225 as int)", "depth": "cast(8 + k % 20 as int)", "win_before": "50.0 + k % 40 + 0.5", "win_after": "20.0 + k % 30 + 0.5"}


def _phrase(cp: str) -> str:
    return f"(CASE WHEN abs({cp}) < 30 THEN 'roughly equal' ELSE CASE WHEN abs({cp}) < 90 THEN 'slightly better for ' WHEN abs({cp}) < 200 THEN 'clearly better for ' ELSE 'winning for ' END || CASE WHEN {cp} * s >= 0 THEN 'White' ELSE 'Black' END || ' (' || CASE WHEN {cp} * s > 0 THEN '+' ELSE '-' END || ((abs({cp}) + 5) // 10) // 10 || '.' || ((abs({cp}) + 5) // 10) % 10 || ')' END)"


SQL = positions.B.replace("flat[1:(k * 7) % 64] || '" + positions.MEN + "'[k % 13 + 1] || flat[(k * 7) % 64 + 2:64] AS board", "flat AS board") + """, squares AS (SELECT puzzle_id, u.i AS index, board[u.i + 1] AS piece FROM boards, unnest(range(64)) AS u(i)),
men AS (SELECT puzzle_id, piece = upper(piece) AS white, strpos('kqrbnp', lower(piece)) AS kind, chr((97 + index % 8)::INTEGER) || (8 - index // 8) AS sq FROM squares WHERE piece <> '.'),
sides AS (SELECT puzzle_id, white, concat_ws(', ', string_agg('KQRBN'[kind] || sq, ', ' ORDER BY kind, sq) FILTER (WHERE kind < 6), 'pawns ' || string_agg(sq, ' ' ORDER BY sq) FILTER (WHERE kind = 6)) AS t FROM men GROUP BY 1, 2),
facts AS (SELECT b.puzzle_id, b.csv_fen AS fen, b.k, b.k % 6 AS f, CASE WHEN turn = 'w' THEN 1 ELSE -1 END AS s, CASE WHEN turn = 'w' THEN 'White' ELSE 'Black' END AS side, 'White: ' || w.t || chr(10) || 'Black: ' || n.t AS pieces, """ + ", ".join(f"{e.replace('k %', 'b.k %')} AS {c}" for c, e in KEYS.items()) + f""" FROM boards AS b JOIN sides AS w ON w.puzzle_id = b.puzzle_id AND w.white JOIN sides AS n ON n.puzzle_id = b.puzzle_id AND NOT n.white WHERE b.k % 50 <> 49 AND b.k % 97 <> 5),
named AS (SELECT *, {st.SAN} AS san FROM facts)"""


def facts(spark, sf_dir):
    """Positions with their pieces and the notation that is stored with their line."""
    d = bd.with_board(dump.good(spark, sf_dir).withColumns({"fen": F.col("csv_fen"), "san": F.expr(st.SAN)}))
    out = d.select("puzzle_id", "fen", "turn", "san", bd.pieces(F.col("board")).alias("pieces"), F.col("puzzle_id").cast("bigint").alias("k"))
    return out.withColumns({c: F.expr(e) for c, e in KEYS.items()})


@query("candidates_prompt", SQL + f" SELECT puzzle_id, md5('FEN: ' || fen || chr(10) || side || ' is to move.' || chr(10) || pieces || chr(10) || 'Lines to depth ' || depth || ':' || chr(10) || '1. ' || san || ' — ' || {_phrase('cp')} || chr(10) || '2. ' || san || ' — ' || {_phrase('cp2')} || chr(10) || chr(10) || 'What should ' || side || ' play, and why?') AS prompt_md5 FROM named")
def candidates_prompt(spark, sf_dir):
    d = facts(spark, sf_dir)
    lines = F.array(*(F.struct(F.lit(n).alias("multipv"), "san", F.col(c).alias("cp"), F.lit(None).cast("int").alias("mate")) for n, c in ((1, "cp"), (2, "cp2"))))
    p = pr.candidates_prompt(d.withColumn("candidates", pr.candidate_text(lines, F.col("turn"))), None, "puzzle_id")
    return p.select("puzzle_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


CLASS = "case k % 3 when 0 then 'inaccuracy' when 1 then 'mistake' else 'blunder' end"


@query("grade_prompt", SQL + f", g AS (SELECT *, {CLASS} AS c, CASE k % 3 WHEN 0 THEN 'an inaccuracy' WHEN 1 THEN 'a mistake' ELSE 'a blunder' END AS phrase, string_split(san, ' ') AS t, round_even(win_before, 0)::INTEGER AS wb, round_even(win_after, 0)::INTEGER AS wa FROM named) SELECT puzzle_id, md5('FEN: ' || fen || chr(10) || side || ' is to move.' || chr(10) || pieces || chr(10) || side || ' played ' || t[1] || ' ' || t[2] || ', ' || phrase || ': ' || wb || '% became ' || wa || '%.' || chr(10) || 'Played: ' || san || ' — ' || {_phrase('cp')} || chr(10) || 'Best: ' || san || ' — ' || {_phrase('cp2')} || chr(10) || chr(10) || 'Why?') AS prompt_md5, md5('Played move: ' || t[1] || ' ' || t[2] || ' (graded ' || c || '; winning chances went from ' || wb || '% to ' || wa || '%)' || chr(10) || 'Line after the played move: ' || san || chr(10) || 'Engine''s preferred line: ' || san) AS facts_md5 FROM g")
def grade_prompt(spark, sf_dir):
    none = F.lit(None).cast("int")
    d = facts(spark, sf_dir).withColumns({
        "move_class": F.expr(CLASS), "played_move": F.array_join(F.slice(F.split("san", " "), 1, 2), " "), "played_san": F.col("san"), "best_san": F.col("san"),
        "played_line": pr.line_text(F.col("san"), F.col("cp"), none, F.col("turn")), "best_line": pr.line_text(F.col("san"), F.col("cp2"), none, F.col("turn"))})
    p = pr.grade_prompt(d, "puzzle_id").join(pr.grade_facts(d, "puzzle_id"), "puzzle_id")
    return p.select("puzzle_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), F.md5(F.col("facts").cast("binary")).alias("facts_md5"))


@query("editor_fen", positions.B + f", can AS (SELECT *, {positions.CAN} AS possible, {positions.CHOSEN} AS chosen FROM boards), kept AS (SELECT *, concat(" + ", ".join(f"CASE WHEN contains(possible, '{c}') AND contains(chosen, '{c}') THEN '{c}' ELSE '' END" for c in "KQkq") + ") AS r, array_to_string(list_transform(range(8), lambda i: board[i * 8 + 1:i * 8 + 8]), '/') AS rows FROM can) SELECT puzzle_id, concat_ws(' ', " + "".join("replace(" for _ in range(8)) + "rows" + "".join(f", '{'.' * n}', '{n}')" for n in range(8, 0, -1)) + ", turn, CASE WHEN r = '' THEN '-' ELSE r END, '-', '0', '1') AS fen FROM kept")
def editor_fen(spark, sf_dir):
    b = positions.boards(spark, sf_dir)
    return b.select("puzzle_id", bd.editor_fen(F.col("board"), F.col("turn"), F.expr(positions.CHOSEN)).alias("fen"))


@query("request_log_json", logs.VALID + " SELECT event_id, mode, reason FROM checked")
def request_log_json(spark, sf_dir):
    """The log as JSON lines of the declared shape, validated after the read."""
    from plycast.operators import requests as rq

    path = files.scratch(spark, "requests")
    logs.requests(spark, sf_dir).drop("client").write.json(path)
    return rq.validate(files.read_jsonl(spark, path, files.REQUEST)).select("event_id", "mode", "reason")


def _percent(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE printf('%.1f%%', 100 * {x}) END"


@query("scorecard_report", texts.R + f", b AS (SELECT rating_band, {texts.RATES} FROM scored GROUP BY 1) SELECT '| ' || coalesce(rating_band, '-') || ' | ' || n || ' | ' || {_percent('matched')} || ' | ' || {_percent('grounded')} || ' | ' || n_judged || ' | ' || coalesce(round(mean_score, 2)::VARCHAR, '-') || ' |' AS line FROM b")
def scorecard_report(spark, sf_dir):
    """The per-band table as report lines."""
    b = sd.per_band(texts.scored(spark, sf_dir))
    shown = b.select("rating_band", "n", files.percent(F.col("matched")).alias("matched"), files.percent(F.col("grounded")).alias("grounded"), "n_judged", F.round("mean_score", 2).alias("mean"))
    return files.table_rows(shown.orderBy("rating_band"), "rating_band", "n", "matched", "grounded", "n_judged", "mean")


@query("gate_report", texts.STATS + f" SELECT '| ' || config || ' | ' || n || ' | ' || {_percent('exact')} || ' | ' || coalesce(round(kappa, 2)::VARCHAR, '-') || ' | ' || {_percent('low')} || ' | ' || verdict || ' |' AS line FROM v")
def gate_report(spark, sf_dir):
    s = ag.with_verdict(ag.statistics(texts.pairs(spark, sf_dir), "config"))
    shown = s.select("config", "n", files.percent(F.col("exact")).alias("exact"), F.round("kappa", 2).alias("kappa"), files.percent(F.col("low")).alias("low"), "verdict")
    return files.table_rows(shown.orderBy("config"), "config", "n", "exact", "kappa", "low", "verdict")
