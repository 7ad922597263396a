"""Queries over positions. Orders stand in for puzzles; boards vary by putting a man on a square that the key names."""

from __future__ import annotations

from pyspark.sql import functions as F

from plycast.operators import boards as bd
from plycast.plans import standins as st
from plycast.plans.registry import query

MEN = "QRBNPqrbnp.Kk"


def _dots(expr: str) -> str:
    for n in range(1, 9):
        expr = f"replace({expr}, '{n}', '{'.' * n}')"
    return expr


#: Boards with one square changed, as SQL valid in DuckDB.
B = "WITH " + st.PUZZLES_SQL + f""", based AS (SELECT puzzle_id, csv_fen, puzzle_id::BIGINT AS k, {_dots("replace(string_split(csv_fen, ' ')[1], '/', '')")} AS flat, string_split(csv_fen, ' ')[2] AS turn FROM raw),
boards AS (SELECT *, flat[1:(k * 7) % 64] || '{MEN}'[k % 13 + 1] || flat[(k * 7) % 64 + 2:64] AS board FROM based)"""


def boards(spark, sf_dir):
    d = bd.with_board(st.puzzles(spark, sf_dir), "csv_fen").withColumn("k", F.col("puzzle_id").cast("bigint"))
    man = F.substring(F.lit(MEN), (F.col("k") % 13 + 1).cast("int"), F.lit(1))
    return d.withColumn("flat", F.col("board")).withColumn("board", F.overlay("flat", man, (F.col("k") * 7 % 64 + 1).cast("int"), F.lit(1)))


SQUARES = B + ", squares AS (SELECT puzzle_id, u.i AS index, board[u.i + 1] AS piece, strpos('.PNBRQKpnbrqk', board[u.i + 1]) - 1 AS label FROM boards, unnest(range(64)) AS u(i))"


@query("board_squares", SQUARES + " SELECT puzzle_id, sum(label * (index + 1))::BIGINT AS checksum, count(*) FILTER (WHERE label > 0) AS n_men FROM squares GROUP BY 1")
def board_squares(spark, sf_dir):
    s = bd.squares(boards(spark, sf_dir), "puzzle_id", empty=True)
    return s.groupBy("puzzle_id").agg(F.sum(F.col("label") * (F.col("index") + 1)).cast("bigint").alias("checksum"), F.count_if(F.col("label") > 0).alias("n_men"))


@query("board_squares_rotated", SQUARES + " SELECT (63 - index)::INTEGER AS index, piece, label::INTEGER AS label, count(*) AS n FROM squares WHERE piece <> '.' GROUP BY 1, 2, 3")
def board_squares_rotated(spark, sf_dir):
    return bd.squares(boards(spark, sf_dir), "puzzle_id", white_bottom=False).groupBy("index", "piece", "label").agg(F.count("*").alias("n"))


@query("grid_to_placement", "WITH " + st.PUZZLES_SQL + " SELECT puzzle_id, string_split(csv_fen, ' ')[1] AS placement FROM raw")
def grid_to_placement(spark, sf_dir):
    """Squares and back: the placement field as it was."""
    d = bd.with_board(st.puzzles(spark, sf_dir), "csv_fen")
    return bd.grid_to_placement(bd.squares(d, "puzzle_id", empty=True), "puzzle_id")


@query("piece_list", SQUARES + """, men AS (SELECT puzzle_id, piece = upper(piece) AS white, strpos('kqrbnp', lower(piece)) AS kind, chr((97 + index % 8)::INTEGER) || (8 - index // 8) AS sq FROM squares WHERE piece <> '.'),
sides AS (SELECT puzzle_id, white, concat_ws(', ', string_agg('KQRBN'[kind] || sq, ', ' ORDER BY kind, sq) FILTER (WHERE kind < 6), 'pawns ' || string_agg(sq, ' ' ORDER BY sq) FILTER (WHERE kind = 6)) AS t FROM men GROUP BY 1, 2)
SELECT b.puzzle_id, 'White: ' || coalesce(w.t, '(none)') || chr(10) || 'Black: ' || coalesce(n.t, '(none)') AS pieces FROM boards AS b LEFT JOIN sides AS w ON w.puzzle_id = b.puzzle_id AND w.white LEFT JOIN sides AS n ON n.puzzle_id = b.puzzle_id AND NOT n.white""")
def piece_list(spark, sf_dir):
    return bd.piece_list(boards(spark, sf_dir), "puzzle_id")


@query("rotate_board", B + " SELECT puzzle_id, reverse(board) AS rotated, regexp_replace(board, '[^Kk]', '.', 'g') AS kings FROM boards")
def rotate_board(spark, sf_dir):
    return boards(spark, sf_dir).select("puzzle_id", bd.rotate(F.col("board")).alias("rotated"), bd.kings_only(F.col("board")).alias("kings"))


CAN = "concat(CASE WHEN board[61] = 'K' AND board[64] = 'R' THEN 'K' ELSE '' END, CASE WHEN board[61] = 'K' AND board[57] = 'R' THEN 'Q' ELSE '' END, CASE WHEN board[5] = 'k' AND board[8] = 'r' THEN 'k' ELSE '' END, CASE WHEN board[5] = 'k' AND board[1] = 'r' THEN 'q' ELSE '' END)"
CHOSEN = "case k % 4 when 0 then 'KQkq' when 1 then 'Kq' when 2 then 'Q' else '-' end"


@query("castling_rights", B + f", can AS (SELECT puzzle_id, k, {CAN} AS possible, {CHOSEN} AS chosen FROM boards), kept AS (SELECT *, concat(" + ", ".join(f"CASE WHEN contains(possible, '{c}') AND contains(chosen, '{c}') THEN '{c}' ELSE '' END" for c in "KQkq") + ") AS r FROM can) SELECT puzzle_id, possible, CASE WHEN r = '' THEN '-' ELSE r END AS castling FROM kept")
def castling_rights(spark, sf_dir):
    b = boards(spark, sf_dir)
    return b.select("puzzle_id", bd.possible_castling(F.col("board")).alias("possible"), bd.castling_field(F.col("board"), F.expr(CHOSEN)).alias("castling"))


# heaps of one man on the empty squares, so that the audit has something to reject
HEAP = "case k % 9 when 0 then 'Q' when 1 then 'P' when 2 then 'b' when 3 then 'n' when 4 then 'r' when 5 then 'p' when 6 then 'q' else '.' end"
HEAPED = B + f", heaped AS (SELECT puzzle_id, k, turn, board[1:40] || replace(board[41:44], '.', {HEAP}) || board[45:64] AS board FROM boards)"
MATERIAL = HEAPED + """, sq AS (SELECT puzzle_id, u.i AS i, board[u.i + 1] AS p FROM heaped, unnest(range(64)) AS u(i) WHERE board[u.i + 1] <> '.'),
n AS (SELECT puzzle_id, CASE WHEN p = upper(p) THEN 'White' ELSE 'Black' END AS color, count(*) FILTER (WHERE lower(p) = 'p') AS pawns, count(*) FILTER (WHERE lower(p) = 'q') AS q, count(*) FILTER (WHERE lower(p) = 'r') AS r, count(*) FILTER (WHERE lower(p) = 'n') AS kn,
  count(*) FILTER (WHERE lower(p) = 'b' AND (i // 8 + i % 8) % 2 = 0) AS lb, count(*) FILTER (WHERE lower(p) = 'b' AND (i // 8 + i % 8) % 2 = 1) AS db FROM sq GROUP BY 1, 2),
m AS (SELECT *, greatest(lb - 1, 0) + greatest(db - 1, 0) AS bx, greatest(q - 1, 0) + greatest(r - 2, 0) + greatest(kn - 2, 0) + greatest(lb - 1, 0) + greatest(db - 1, 0) AS extras, 8 - pawns AS promotions FROM n),
e AS (SELECT *, CASE WHEN pawns > 8 THEN color || ' has ' || pawns || ' pawns — 8 is the maximum.' WHEN extras > promotions THEN color || ' has ' || extras || ' more piece' || CASE WHEN extras = 1 THEN '' ELSE 's' END || ' than the starting set but only ' || promotions || ' missing pawn' || CASE WHEN promotions = 1 THEN '' ELSE 's' END || ' to promote — impossible' || CASE WHEN bx > 0 THEN ' (a second bishop on the same square color counts as promoted)' ELSE '' END || '.' END AS error FROM m)"""


def heaped(spark, sf_dir):
    b = boards(spark, sf_dir)
    return b.withColumn("board", F.concat(F.substring("board", 1, 40), F.replace(F.substring("board", 41, 4), F.lit("."), F.expr(HEAP)), F.substring("board", 45, 20)))


@query("material_audit", MATERIAL + " SELECT puzzle_id, color, pawns, extras, promotions, error FROM e")
def material_audit(spark, sf_dir):
    return bd.material(heaped(spark, sf_dir), "puzzle_id")


@query("editor_positions", MATERIAL + f""", first AS (SELECT puzzle_id, coalesce(max(error) FILTER (WHERE color = 'White'), max(error) FILTER (WHERE color = 'Black')) AS error FROM e GROUP BY 1)
SELECT h.puzzle_id, coalesce(f.error, CASE WHEN length(regexp_replace(board, '[^K]', '', 'g')) <> 1 THEN 'White needs exactly one king.' WHEN length(regexp_replace(board, '[^k]', '', 'g')) <> 1 THEN 'Black needs exactly one king.' WHEN regexp_matches(board[1:8] || board[57:64], '[Pp]') THEN 'Pawns cannot stand on the first or last rank.' WHEN k % 17 = 0 THEN 'The side that is not to move is in check.' END) AS error FROM heaped AS h LEFT JOIN first AS f ON f.puzzle_id = h.puzzle_id""")
def editor_positions(spark, sf_dir):
    h = heaped(spark, sf_dir).withColumn("waiting_in_check", F.col("k") % 17 == 0)
    return bd.editor_error(h, "puzzle_id").select("puzzle_id", "error")


@query("flip_side", "WITH " + st.PUZZLES_SQL + ", s AS (SELECT puzzle_id, string_split(csv_fen, ' ') AS f FROM raw) SELECT puzzle_id, CASE WHEN puzzle_id::BIGINT % 5 > 0 THEN concat_ws(' ', f[1], CASE WHEN f[2] = 'w' THEN 'b' ELSE 'w' END, f[3], '-', '0', f[6]) END AS flipped FROM s")
def flip_side(spark, sf_dir):
    p = st.puzzles(spark, sf_dir).withColumn("in_check", F.col("puzzle_id").cast("bigint") % 5 == 0)
    return bd.flip_side(p, fen="csv_fen").select("puzzle_id", "flipped")
