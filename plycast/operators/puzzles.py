"""Rows of a puzzle dump: typed parse, rejects, quality filter, rating bands, sample records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rating bands, lower bound inclusive, upper exclusive (fixed values).
BANDS = ((0, 1200), (1200, 1800), (1800, 2400), (2400, 4000))
MIN_POPULARITY, MIN_PLAYS, MAX_DEVIATION = 50, 100, 110
#: Tags that describe a puzzle's setting and are left out of per-theme tables (fixed values).
CONTEXT_TAGS = ("short", "long", "veryLong", "oneMove", "middlegame", "endgame", "opening", "master", "masterVsMaster", "superGM", "crushing", "advantage", "equality", "mate")
INTEGERS = ("rating", "rating_deviation", "popularity", "nb_plays")


def words(text: Column) -> Column:
    """Split at white space; empty text gives an empty array."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def parse(raw: DataFrame) -> DataFrame:
    """Text columns become integers and arrays; ``reject`` names the first thing that is wrong with a row, or is null."""
    ints = {c: F.expr(f"try_cast(trim({c}) as int)") for c in INTEGERS}
    lists = {c: words(F.col(c)) for c in ("moves", "themes", "opening_tags")}
    bad = F.coalesce(*(F.when(ints[c].isNull(), F.lit(c)) for c in INTEGERS), F.when(F.size(lists["moves"]) < 2, F.lit("moves")))
    return raw.withColumns({**ints, **lists, "reject": bad})


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.filter("reject is null").drop("reject"), parsed.filter("reject is not null")


def setup_and_solution(df: DataFrame) -> DataFrame:
    """The first move is the setup, the rest the solution."""
    return df.withColumns({"setup_move": F.col("moves")[0], "solution": F.expr("slice(moves, 2, greatest(size(moves) - 1, 0))")})


def quality(df: DataFrame, popularity: int = MIN_POPULARITY, plays: int = MIN_PLAYS, deviation: int = MAX_DEVIATION) -> DataFrame:
    return df.filter((F.col("popularity") >= popularity) & (F.col("nb_plays") >= plays) & (F.col("rating_deviation") <= deviation))


def band_of(rating: Column, bands: tuple = BANDS) -> Column:
    out = None
    for lo, hi in bands:
        here, label = (rating >= lo) & (rating < hi), F.lit(f"{lo}-{hi - 1}")
        out = F.when(here, label) if out is None else out.when(here, label)
    return out


def with_band(df: DataFrame) -> DataFrame:
    return df.withColumn("rating_band", band_of(F.col("rating")))


def tactical(df: DataFrame, theme: str = "theme", context: tuple = CONTEXT_TAGS) -> DataFrame:
    return df.filter(~F.col(theme).isin(*context))


def side_to_move(fen: Column) -> Column:
    """w or b; anything else is null, and an error where a prompt needs it (see ``prompts``)."""
    side = F.get(F.split(fen, " "), F.lit(1))
    return F.when(side.isin("w", "b"), side)


def sample_record(df: DataFrame) -> DataFrame:
    """Columns of a sample record; ``fen`` is the position after the setup move, ``csv_fen`` the one before."""
    return df.select("puzzle_id", "fen", "csv_fen", "setup_move", "solution", "solver_color", "rating", "rating_band", F.array_sort("themes").alias("themes"), "game_url")
