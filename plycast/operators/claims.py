"""Claims that a text makes, checked against what is known: moves, themes, placements, mates; judge replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns. (?U) makes \d, \s and \b follow Unicode.
DEFINITE = r"(?U)\b(O-O(?:-O)?|[KQRBN][a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?|[a-h]x[a-h][1-8](?:=[QRBN])?|[a-h][18]=[QRBN])[+#]?(?!-[a-h][1-8])"
NUMBERED_PAWN = r"(?U)\b\d+\.(?:\.\.)?\s*([a-h][1-8])(?!\s*=)\b"
PLACEMENT = r"(?Ui)\b(king|queen|rook|bishop|knight|pawn)s?\s+(?:on|at)\s+([a-h][1-8])\b"
MATE = r"(?Ui)\b(checkmate|mate in \w+|mated|#)\b"

# Words by which a text names a theme (fixed values).
THEME_WORDS = {
    "fork": ("fork", "forks", "forking", "double attack", "two pieces at once"),
    "pin": ("pin", "pins", "pinned", "pinning"),
    "skewer": ("skewer", "skewers", "skewered", "x-ray", "through the"),
    "discoveredAttack": ("discover", "discovered attack", "unleash", "battery"),
    "discoveredCheck": ("discovered check", "discover", "unleash"),
    "doubleCheck": ("double check", "both pieces check", "two checks"),
    "backRankMate": ("back rank", "back-rank", "backrank", "first rank", "eighth rank"),
    "hangingPiece": ("hanging", "undefended", "unprotected", "loose piece", "en prise"),
    "trappedPiece": ("trapped", "no escape squares", "nowhere to go", "cornered"),
    "deflection": ("deflect", "deflection", "lure away", "drag away", "overloaded"),
    "attraction": ("attract", "lure", "draw the king", "decoy", "force the king"),
    "clearance": ("clear", "clearance", "vacate", "get out of the way", "open the line"),
    "interference": ("interference", "block the", "cut the", "interpose"),
    "sacrifice": ("sacrifice", "sacrifices", "sacrificing", "sac", "give up the", "offer"),
    "exposedKing": ("exposed king", "king is exposed", "airy", "no shelter", "vulnerable king"),
    "advancedPawn": ("advanced pawn", "passed pawn", "far advanced", "close to promoting"),
    "promotion": ("promot", "queening", "new queen"),
    "zugzwang": ("zugzwang", "must move", "any move loses", "running out of moves"),
    "xRayAttack": ("x-ray", "xray", "through the", "behind the"),
    "quietMove": ("quiet move", "quiet", "no check", "unhurried", "subtle"),
    "defensiveMove": ("defen", "hold", "resource", "save"),
    "capturingDefender": ("defender", "remove the guard", "removing the defender", "eliminat"),
    "kingsideAttack": ("kingside", "king side"),
    "queensideAttack": ("queenside", "queen side"),
    "attackingF2F7": ("f2", "f7", "weakest square", "weak square"),
    "operaMate": ("opera mate", "back rank", "mate with the rook"),
    "pillsburysMate": ("pillsbury", "mate with the rook"),
}
# Themes that have no words of their own (fixed values).
UNSCORED = ("middlegame", "endgame", "opening", "short", "long", "veryLong", "oneMove", "master", "masterVsMaster", "superGM", "crushing", "advantage", "equality", "mate", "mateIn1", "mateIn2", "mateIn3", "mateIn4", "mateIn5", "rookEndgame", "queenEndgame", "pawnEndgame", "bishopEndgame", "knightEndgame", "underPromotion", "intermezzo", "skewer2")
CATEGORIES = ("ok", "wrong_theme", "wrong_mechanism", "hallucinated_line")


def move_claims(text: Column) -> Column:
    """Definite tokens, then numbered pawn pushes, without + and #; duplicates stay."""
    found = F.concat(F.regexp_extract_all(text, F.lit(DEFINITE), F.lit(1)), F.regexp_extract_all(text, F.lit(NUMBERED_PAWN), F.lit(1)))
    return F.transform(found, lambda x: F.regexp_replace(x, "[+#]+$", ""))


def allowed_moves(san_text: Column) -> Column:
    """The set of moves in a line's notation, without numbers and suffixes."""
    tokens = F.filter(F.split(san_text, r"\s+"), lambda x: ~x.rlike(r"^\d+\.") & (x != ""))
    return F.array_distinct(F.transform(tokens, lambda x: F.regexp_replace(x, "[+#]+$", "")))


def violations(claims: Column, allowed: Column) -> Column:
    return F.filter(claims, lambda c: ~F.array_contains(allowed, c))


def lexicon(spark) -> DataFrame:
    return spark.createDataFrame([(t, list(w)) for t, w in THEME_WORDS.items()], "theme string, vocabulary array<string>")


def theme_coverage(df: DataFrame, lex: DataFrame, id: str = "id", text: str = "text", themes: str = "themes") -> DataFrame:
    """Scorable tags, those whose words the text holds, and their share (null if none can be scored)."""
    tags = df.select(id, F.lower(text).alias("__t"), F.explode(themes).alias("theme")).join(F.broadcast(lex), "theme")
    hit = tags.select(id, "theme", F.exists("vocabulary", lambda w: F.contains("__t", w)).alias("hit"))
    sums = hit.groupBy(id).agg(F.array_sort(F.collect_list("theme")).alias("theme_scored"), F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("theme")))).alias("theme_named"))
    out = df.select(id).join(sums, id, "left")
    empty = F.array().cast("array<string>")
    rate = F.size("theme_named") / F.size("theme_scored")
    return out.select(id, F.coalesce("theme_scored", empty).alias("theme_scored"), F.coalesce("theme_named", empty).alias("theme_named"), F.when(F.col("theme_scored").isNotNull(), rate).alias("theme_rate"))


def placement_claims(df: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """A row for each claim that a piece stands on a square."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(PLACEMENT), F.lit(1)).alias("piece"), F.regexp_extract_all(text, F.lit(PLACEMENT), F.lit(2)).alias("square"))
    return df.select("*", F.posexplode(pairs).alias("claim", "c")).select(*df.columns, "claim", F.lower("c.piece").alias("piece"), F.lower("c.square").alias("square"))


def placement_errors(claims: DataFrame, real: DataFrame, key: str) -> DataFrame:
    """Claims for which ``real`` (key, piece, square) has no row; colour is not looked at."""
    return claims.join(real.select(key, "piece", "square").distinct(), [key, "piece", "square"], "left_anti")


def mate_consistency(text: Column, mates: Column, pattern: str = MATE) -> dict[str, Column]:
    claimed, actual = text.rlike(pattern), F.exists(mates, lambda m: m.isNotNull())
    return {"mate_claimed": claimed, "mate_actual": actual, "mate_consistent": claimed == actual}


def fill(template: str, values: dict[str, Column | str]) -> Column:
    """{{name}} becomes the value of ``name``; an unknown name is an error when the query is built. Values are not filled again."""
    import re

    parts = []
    for k, piece in enumerate(re.split(r"\{\{(\w+)\}\}", template)):
        if k % 2 and piece not in values:
            raise KeyError(f"missing template variable: {piece}")
        parts.append((values[piece] if isinstance(values[piece], Column) else F.lit(values[piece])) if k % 2 else F.lit(piece))
    return F.concat(*parts)


def engine_rows(prompt: Column) -> Column:
    """The prompt's numbered lines."""
    return F.array_join(F.filter(F.split(prompt, "\n"), lambda x: x.rlike("^[0-9]") & F.contains(x, F.lit(". "))), "\n")


def stand_in_completion(prompt: Column) -> Column:
    """A fixed answer for dry runs: the first numbered line and 8 hex digits of the prompt's SHA-256."""
    first = F.coalesce(F.get(F.filter(F.split(prompt, "\n"), lambda x: x.rlike("^[0-9]") & F.contains(x, F.lit(". "))), F.lit(0)), F.lit(""))
    return F.concat(first, F.lit(" ["), F.substring(F.sha2(prompt.cast("binary"), 256), 1, 8), F.lit("]"))


def parse_reply(reply: Column) -> dict[str, Column]:
    """Fields of a judge's reply, or the first reason why it can't be read."""
    clean = F.trim(F.regexp_replace(F.trim(reply), r"(?m)^```(?:json)?|```$", ""))
    body = F.regexp_extract(clean, r"(?s)\{.*\}", 0)
    get = lambda k: F.get_json_object(body, f"$.{k}")
    score = get("score").try_cast("int")
    flags = {k: get(k).try_cast("boolean") for k in ("idea", "mechanism", "hallucination")}
    error = F.when(body == "", "no JSON object").when(F.get_json_object(body, "$").isNull(), "unparseable JSON")
    for k in ("score", "category", "idea", "mechanism", "hallucination"):
        error = error.when(get(k).isNull(), f"missing field {k}")
    error = error.when(~score.isin(0, 1, 2) | score.isNull(), "score out of range").when(~get("category").isin(*CATEGORIES), "unknown category")
    good = error.isNull()
    fields = {"score": score, "category": get("category"), **flags, "reason": F.coalesce(get("reason"), F.lit(""))}
    return {**{k: F.when(good, v) for k, v in fields.items()}, "error": error}
