"""Prompts for explanations and the facts that a judge is shown. Templates are the caller's; these are short defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plycast.operators.claims import fill
from plycast.operators.puzzles import side_to_move
from plycast.operators.scoring import CLASS_PHRASES, eval_phrase

CANDIDATES = "FEN: {{fen}}\n{{side_to_move}} is to move.\n{{pieces}}\nLines to depth {{depth}}:\n{{candidates}}\n{{retrieval}}\nWhat should {{side_to_move}} play, and why?"
GRADE = "FEN: {{fen}}\n{{side_to_move}} is to move.\n{{pieces}}\n{{side_to_move}} played {{played_move}}, {{move_class_phrase}}: {{win_before}}% became {{win_after}}%.\nPlayed: {{played_line}}\nBest: {{best_line}}\n{{retrieval}}\nWhy?"


def side_name(fen: Column) -> Column:
    """White or Black; any other side field stops the query."""
    side = side_to_move(fen)
    return F.when(side == "w", "White").when(side == "b", "Black").otherwise(F.raise_error(F.concat(F.lit("invalid side to move: "), fen)))


def whole(percent: Column) -> Column:
    return F.bround(percent, 0).cast("int").cast("string")


def line_text(san: Column, cp: Column, mate: Column, side: Column) -> Column:
    return F.concat(san, F.lit(" — "), eval_phrase(cp, mate, side))


def candidate_rows(lines: DataFrame, key: str) -> DataFrame:
    """``lines``: key, multipv, depth, san, cp, mate, side. Numbered rows in order, and the greatest depth."""
    row = F.concat(F.col("multipv").cast("string"), F.lit(". "), line_text(F.col("san"), F.col("cp"), F.col("mate"), F.col("side")))
    g = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("multipv", row.alias("row")))).alias("x"), F.max("depth").alias("depth"))
    return g.select(key, "depth", F.array_join("x.row", "\n").alias("candidates"))


def candidate_text(lines: Column, side: Column) -> Column:
    """The numbered rows of lines that a position carries itself, as an array of multipv, san, cp and mate: no row moves."""
    row = lambda x: F.concat(x["multipv"].cast("string"), F.lit(". "), line_text(x["san"], x["cp"], x["mate"], side))
    return F.array_join(F.transform(F.array_sort(lines), row), "\n")


def candidates_prompt(positions: DataFrame, rows: DataFrame | None, key: str, template: str = CANDIDATES, retrieval: str = "") -> DataFrame:
    """Positions with fen and pieces, and ``rows`` with their depth and candidates, if positions have not got these."""
    d = positions if rows is None else positions.join(rows, key)
    values = {"fen": F.col("fen"), "side_to_move": side_name(F.col("fen")), "pieces": F.col("pieces"), "depth": F.col("depth").cast("string"), "candidates": F.col("candidates"), "retrieval": retrieval}
    return d.select(key, fill(template, values).alias("prompt"))


def class_phrase(move_class: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in CLASS_PHRASES.items() for x in kv))[move_class]


def grade_prompt(df: DataFrame, key: str, template: str = GRADE, retrieval: str = "") -> DataFrame:
    """``df``: key, fen, pieces, played_move, move_class, win_before, win_after, played_line and best_line (texts)."""
    values = {c: F.col(c) for c in ("fen", "pieces", "played_move", "played_line", "best_line")}
    values |= {"side_to_move": side_name(F.col("fen")), "move_class_phrase": class_phrase(F.col("move_class")), "win_before": whole(F.col("win_before")), "win_after": whole(F.col("win_after")), "retrieval": retrieval}
    return df.select(key, fill(template, values).alias("prompt"))


def grade_facts(df: DataFrame, key: str) -> DataFrame:
    """What the explainer of a played move was told, for the judge."""
    text = F.concat(
        F.lit("Played move: "), "played_move", F.lit(" (graded "), "move_class", F.lit("; winning chances went from "), whole(F.col("win_before")), F.lit("% to "), whole(F.col("win_after")), F.lit("%)\nLine after the played move: "), "played_san",
        F.lit("\nEngine's preferred line: "), "best_san")
    return df.select(key, text.alias("facts"))
