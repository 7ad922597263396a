"""The driver's tables in the roles of puzzles, engine lines and so on. The expressions are valid in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Six puzzles: position before the setup move, and moves (fixed values).
FIXTURES: tuple[tuple[str, ...], ...] = (
    ("r1bqkbnr/pppp1ppp/2n5/4p2Q/2B1P3/8/PPPP1PPP/RNB1K1NR b KQkq - 3 3", "g8f6 h5f7"),
    ("6k1/5ppp/8/r7/8/8/5PPP/4R1K1 b - - 0 30", "a5a2 e1e8"),
    ("3qk3/pp3p1p/8/8/4N3/8/PP3PPP/6K1 b - - 0 25", "d8d5 e4f6 e8e7 f6d5"),
    ("3k4/pp6/8/8/5q2/8/5PPP/2B3K1 b - - 0 30", "f4f6 c1g5"),
    ("rnbqkbnr/pppp1ppp/8/4p3/8/5P2/PPPPP1PP/RNBQKBNR w KQkq - 0 2", "g2g4 d8h4"),
    ("4q3/1pp5/4k3/8/8/8/1PP3K1/R7 b - - 0 30", "e6e5 a1e1 e5f4 e1e8"),
)
#: The notation that is stored with their lines.
NOTATION = ("3... Nf6 4. Qxf7#", "30... Ra2 31. Re8#", "25... Qd5 26. Nf6+ Ke7 27. Nxd5+", "30... Qf6 31. Bg5", "2. g4 Qh4#", "30... Ke5 31. Re1+ Kf4 32. Rxe8")


def _pick(key: str, column: int) -> str:
    return f"case {key} % 6 " + " ".join(f"when {i} then '{x[column]}'" for i, x in enumerate(FIXTURES)) + " end"


SAN = "case cast(puzzle_id as bigint) % 6 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(NOTATION)) + " end"
PUZZLES = {
    "puzzle_id": "cast(o_orderkey as string)",
    "csv_fen": _pick("o_orderkey", 0),
    "moves": f"case when o_orderkey % 50 = 49 then 'e2e4' else {_pick('o_orderkey', 1)} end",
    "rating": "cast(cast(floor(o_totalprice / 100) as int) % 4200 as string)",
    "rating_deviation": "cast(60 + o_custkey % 80 as string)",
    "popularity": "case when o_orderkey % 97 = 5 then 'many' else cast((o_custkey * 7) % 120 - 10 as string) end",
    "nb_plays": "concat(' ', cast((o_custkey * 13) % 1000 as string))",
    "themes": "concat(replace(o_orderpriority, ' ', '_'), '  ', o_orderstatus, case when o_orderkey % 3 = 0 then ' short' else '' end)",
    "game_url": "concat('https://games.example.org/', cast(o_orderkey as string))",
    "opening_tags": "case when o_orderkey % 5 = 0 then '' else concat('Opening_', cast(o_custkey % 7 as string)) end",
}
#: The same rows, typed, as SQL for DuckDB.
PUZZLES_SQL = "raw AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in PUZZLES.items()) + " FROM orders)"
PARSED_SQL = PUZZLES_SQL + """,
parsed AS (SELECT puzzle_id, csv_fen, game_url, TRY_CAST(trim(rating) AS INTEGER) AS rating, TRY_CAST(trim(rating_deviation) AS INTEGER) AS rating_deviation,
  TRY_CAST(trim(popularity) AS INTEGER) AS popularity, TRY_CAST(trim(nb_plays) AS INTEGER) AS nb_plays,
  list_filter(regexp_split_to_array(moves, '\\s+'), lambda x: x <> '') AS moves, list_filter(regexp_split_to_array(themes, '\\s+'), lambda x: x <> '') AS themes,
  list_filter(regexp_split_to_array(opening_tags, '\\s+'), lambda x: x <> '') AS opening_tags FROM raw),
judged_rows AS (SELECT *, coalesce(CASE WHEN rating IS NULL THEN 'rating' END, CASE WHEN rating_deviation IS NULL THEN 'rating_deviation' END,
  CASE WHEN popularity IS NULL THEN 'popularity' END, CASE WHEN nb_plays IS NULL THEN 'nb_plays' END, CASE WHEN len(moves) < 2 THEN 'moves' END) AS reject FROM parsed),
good AS (SELECT * FROM judged_rows WHERE reject IS NULL),
banded AS (SELECT *, CASE WHEN rating >= 0 AND rating < 1200 THEN '0-1199' WHEN rating >= 1200 AND rating < 1800 THEN '1200-1799'
  WHEN rating >= 1800 AND rating < 2400 THEN '1800-2399' WHEN rating >= 2400 AND rating < 4000 THEN '2400-3999' END AS rating_band
  FROM good WHERE popularity >= 50 AND nb_plays >= 100 AND rating_deviation <= 110),
celled AS (SELECT b.*, u.theme FROM banded AS b, unnest(b.themes) AS u(theme))"""

_LINE = "partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate"
LINES = {
    "position_id": "l_orderkey",
    "multipv": f"cast(row_number() over ({_LINE}) as int)",
    "depth": "cast(l_quantity as int)",
    "cp": "case when l_linenumber = 7 then null else cast(cast(floor(l_extendedprice) as bigint) % 2001 - 1000 as int) end",
    "mate": "case when l_linenumber = 7 then cast(l_partkey % 9 - 4 as int) end",
    "move": "concat(chr(cast(97 + l_partkey % 8 as int)), cast(1 + l_suppkey % 8 as string), chr(cast(97 + l_suppkey % 8 as int)), cast(1 + l_partkey % 8 as string))",
}
LINES_SQL = "lines AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in LINES.items()) + " FROM lineitem)"
WIN_SQL = "CASE WHEN mate > 0 THEN 100.0 WHEN mate IS NOT NULL THEN 0.0 WHEN cp IS NOT NULL THEN 50 + 50 * (2 / (1 + exp(-0.00368208 * cp)) - 1) ELSE 50.0 END"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*(f"{e} as {c}" for c, e in exprs.items()))


def puzzles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(read(spark, sf_dir, "orders"), PUZZLES)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(read(spark, sf_dir, "lineitem"), LINES)
