"""Queries over explanations, judge replies and scores. Documents stand in for explanations, with claims planted by doc_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from plycast.operators import agreement as ag
from plycast.operators import claims as cl
from plycast.operators import puzzles as pz
from plycast.operators import scorecard as sd
from plycast.plans import standins as st
from plycast.plans.registry import query

PLANTS = (
    "After 24. Qxc8+ Bxc8 25. Rf8# it is mate in 2.",
    "The rook on a8 is pinned; 12... e5 opens the line.",
    "Castling O-O-O then exd5 and e8=Q+ comes.",
    "Knight at f6 forks the king on g8. 43. g8=Q+ follows.",
    "Qb7-c8 is long notation and no claim.",
    "It is checkmate with Rf8#.",
    "A quiet move: 3. Nf3 with a double attack; queens on h5 and pawns on f7.",
    "Nothing is said here.",
)
ALLOWED = ("24. Qxc8+ Bxc8 25. Rf8#", "12... e5 13. Nf3", "1. O-O-O exd5 2. e8=Q+", "")
TAGS = ("fork mate", "pin short", "skewer backRankMate", "quietMove fork", "mateIn1 endgame")
REPLIES = (
    '{"idea": true, "mechanism": true, "hallucination": false, "score": 2, "category": "ok", "reason": "fine"}',
    '```json\\n{"idea": true, "mechanism": false, "hallucination": false, "score": "1", "category": "wrong_mechanism"}\\n```',
    'Here it is: {"idea": false, "mechanism": false, "hallucination": true, "score": 0, "category": "hallucinated_line", "reason": "b3"} Done.',
    '{"idea": true, "mechanism": true, "hallucination": false, "score": 5, "category": "ok"}',
    '{"idea": true, "mechanism": true, "hallucination": false, "score": 1, "category": "excellent"}',
    '{"mechanism": true, "hallucination": false, "score": 1, "category": "ok"}',
    "I would rather not say.",
)


def _case(values: tuple, key: str = "doc_id") -> str:
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


EXPRS = {
    "doc_id": "doc_id",
    "text": f"concat({_case(PLANTS)}, ' ', coalesce(text, ''))",
    "line": _case(ALLOWED),
    "tags": _case(TAGS),
    "fixture": "cast(doc_id % 6 as int)",
    "mate": "case when doc_id % 3 = 0 then 2 end",
}
T = "WITH explained AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in EXPRS.items()) + " FROM documents)"
# patterns below are fixed values
CLAIMS = T + """, blanked AS (SELECT *, regexp_replace(text, '[KQRBN]?[a-h][1-8]-[a-h][1-8]', ' ', 'g') AS plain FROM explained),
claimed AS (SELECT *, list_concat(regexp_extract_all(plain, '\\b(O-O(?:-O)?|[KQRBN][a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?|[a-h]x[a-h][1-8](?:=[QRBN])?|[a-h][18]=[QRBN])[+#]?', 1),
  regexp_extract_all(regexp_replace(plain, '[a-h][1-8]\\s*=', ' ', 'g'), '\\b\\d+\\.(?:\\.\\.)?\\s*([a-h][1-8])\\b', 1)) AS claims,
  list_distinct(list_transform(list_filter(string_split(line, ' '), lambda x: x <> '' AND NOT regexp_matches(x, '^\\d+\\.')), lambda x: regexp_replace(x, '[+#]+$', ''))) AS allowed FROM blanked)"""


def explained(spark, sf_dir):
    return st.read(spark, sf_dir, "documents").selectExpr(*(f"{e} as {c}" for c, e in EXPRS.items()))


@query("move_claims", CLAIMS + " SELECT doc_id, array_to_string(claims, ' ') AS claims FROM claimed")
def move_claims(spark, sf_dir):
    return explained(spark, sf_dir).select("doc_id", F.array_join(cl.move_claims(F.col("text")), " ").alias("claims"))


#: A line's notation out of an engine line's squares.
ALLOWED = "concat(cast(multipv as string), '. N', substr(move, 1, 2), '+ Q', substr(move, 3, 2), ' ', cast(multipv + 1 as string), '. N', substr(move, 1, 2), ' R', substr(move, 3, 2), '#')"


@query("allowed_moves", f"WITH {st.LINES_SQL}, t AS (SELECT position_id, multipv, string_split({ALLOWED}, ' ') AS x FROM lines) SELECT position_id, multipv, array_to_string(list_sort(list_distinct(list_transform(list_filter(x, lambda y: NOT regexp_matches(y, '^\\d+\\.')), lambda y: regexp_replace(y, '[+#]+$', '')))), ' ') AS allowed FROM t")
def allowed_moves(spark, sf_dir):
    d = st.lines(spark, sf_dir).withColumn("line", F.expr(ALLOWED))
    return d.select("position_id", "multipv", F.array_join(F.array_sort(cl.allowed_moves(F.col("line"))), " ").alias("allowed"))


@query("groundedness", CLAIMS + ", v AS (SELECT doc_id, claims, list_filter(claims, lambda x: NOT list_contains(allowed, x)) AS wrong FROM claimed) SELECT doc_id, len(claims)::INTEGER AS n_claims, array_to_string(wrong, ' ') AS violations, len(wrong) = 0 AS grounded FROM v")
def groundedness(spark, sf_dir):
    e = explained(spark, sf_dir).withColumn("claims", cl.move_claims(F.col("text")))
    wrong = cl.violations(F.col("claims"), cl.allowed_moves(F.col("line")))
    return e.select("doc_id", F.size("claims").alias("n_claims"), F.array_join(wrong, " ").alias("violations"), (F.size(wrong) == 0).alias("grounded"))


LEX = ", lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', [{', '.join(chr(39) + w + chr(39) for w in ws)}])" for t, ws in cl.THEME_WORDS.items()) + ") AS t(theme, vocabulary))"
COVER = T + LEX + """, tagged AS (SELECT doc_id, lower(text) AS t, unnest(string_split(tags, ' ')) AS theme FROM explained),
hits AS (SELECT doc_id, tagged.theme, len(list_filter(vocabulary, lambda w: contains(t, w))) > 0 AS hit FROM tagged JOIN lex ON lex.theme = tagged.theme),
sums AS (SELECT doc_id, string_agg(theme, ' ' ORDER BY theme) AS scored, coalesce(string_agg(theme, ' ' ORDER BY theme) FILTER (WHERE hit), '') AS named, avg(hit::INTEGER) AS rate FROM hits GROUP BY 1)"""


def covered(spark, sf_dir):
    e = explained(spark, sf_dir).withColumn("themes", F.split("tags", " "))
    return cl.theme_coverage(e, cl.lexicon(spark), id="doc_id")


@query("theme_coverage", COVER + " SELECT e.doc_id, coalesce(scored, '') AS theme_scored, coalesce(named, '') AS theme_named, round(rate, 6) AS theme_rate FROM explained AS e LEFT JOIN sums AS s ON s.doc_id = e.doc_id")
def theme_coverage(spark, sf_dir):
    return covered(spark, sf_dir).select("doc_id", F.array_join("theme_scored", " ").alias("theme_scored"), F.array_join("theme_named", " ").alias("theme_named"), F.round("theme_rate", 6).alias("theme_rate"))


PLACED = """, boards AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{x[0]}')" for i, x in enumerate(st.FIXTURES)) + """) AS t(fixture, fen)),
flat AS (SELECT fixture, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(string_split(fen, ' ')[1], '/', ''), '1', '.', 'g'), '2', '..', 'g'), '3', '...', 'g'), '4', '....', 'g'), '5', '.....', 'g'), '6', '......', 'g'), '7', '.......', 'g'), '8', '........', 'g') AS board FROM boards),
squares AS (SELECT fixture, CASE lower(board[i + 1]) WHEN 'k' THEN 'king' WHEN 'q' THEN 'queen' WHEN 'r' THEN 'rook' WHEN 'b' THEN 'bishop' WHEN 'n' THEN 'knight' WHEN 'p' THEN 'pawn' END AS piece, chr((97 + i % 8)::INTEGER) || (8 - i // 8) AS square FROM flat, unnest(range(64)) AS u(i) WHERE board[i + 1] <> '.'),
claims AS (SELECT doc_id, fixture, unnest(regexp_extract_all(text, '(?i)\\b(king|queen|rook|bishop|knight|pawn)s?\\s+(?:on|at)\\s+([a-h][1-8])\\b', 1)) AS p, unnest(regexp_extract_all(text, '(?i)\\b(king|queen|rook|bishop|knight|pawn)s?\\s+(?:on|at)\\s+([a-h][1-8])\\b', 2)) AS s, unnest(range(len(regexp_extract_all(text, '(?i)\\b(king|queen|rook|bishop|knight|pawn)s?\\s+(?:on|at)\\s+([a-h][1-8])\\b')))) AS claim FROM explained)"""


def real_squares(spark):
    from plycast.operators import boards as bd

    fens = spark.createDataFrame([(i, x[0]) for i, x in enumerate(st.FIXTURES)], "fixture int, fen string")
    return bd.squares(bd.with_board(fens), "fixture").withColumn("piece", bd.piece_name(F.col("piece")))


@query("placement_errors", T + PLACED + " SELECT c.doc_id, claim::INTEGER AS claim, lower(p) AS piece, lower(s) AS square FROM claims AS c ANTI JOIN squares AS q ON q.fixture = c.fixture AND q.piece = lower(c.p) AND q.square = lower(c.s)")
def placement_errors(spark, sf_dir):
    claims = cl.placement_claims(explained(spark, sf_dir), "doc_id")
    return cl.placement_errors(claims, F.broadcast(real_squares(spark)), "fixture").select("doc_id", "claim", "piece", "square")


@query("mate_consistency", T + " SELECT doc_id, regexp_matches(text, '(?i)\\b(checkmate|mate in \\w+|mated|#)\\b') AS mate_claimed, mate IS NOT NULL AS mate_actual, regexp_matches(text, '(?i)\\b(checkmate|mate in \\w+|mated|#)\\b') = (mate IS NOT NULL) AS mate_consistent FROM explained")
def mate_consistency(spark, sf_dir):
    c = cl.mate_consistency(F.col("text"), F.array("mate"))
    return explained(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in c.items()))


JUDGE_PROMPT = "Position (FEN): {{fen}}\n{{side_to_move}} to move.\n\nTheme tags: {{themes}}\n\nExplanation to grade:\n---\n{{explanation}}\n---\n1. {{move}} first\n2. other"
PROMPT_SQL = T + ", prompts AS (SELECT doc_id, " + "concat('Position (FEN): ', fixture::VARCHAR, chr(10), CASE WHEN doc_id % 2 = 0 THEN 'White' ELSE 'Black' END, ' to move.', chr(10), chr(10), 'Theme tags: ', array_to_string(list_sort(string_split(tags, ' ')), ' '), chr(10), chr(10), 'Explanation to grade:', chr(10), '---', chr(10), text, chr(10), '---', chr(10), '1. ', line, ' first', chr(10), '2. other') AS prompt FROM explained)"


def prompts(spark, sf_dir):
    values = {"fen": F.col("fixture").cast("string"), "side_to_move": F.when(F.col("doc_id") % 2 == 0, "White").otherwise("Black"), "themes": F.array_join(F.array_sort(F.split("tags", " ")), " "), "explanation": F.col("text"), "move": F.col("line")}
    return explained(spark, sf_dir).select("doc_id", cl.fill(JUDGE_PROMPT, values).alias("prompt"))


@query("judge_prompt", PROMPT_SQL + " SELECT doc_id, md5(prompt) AS prompt_md5, length(prompt)::INTEGER AS n_chars FROM prompts")
def judge_prompt(spark, sf_dir):
    return prompts(spark, sf_dir).select("doc_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), F.length("prompt").alias("n_chars"))


NUMBERED = "list_filter(string_split(prompt, chr(10)), lambda x: regexp_matches(x, '^[0-9]') AND contains(x, '. '))"


@query("engine_rows", PROMPT_SQL + f" SELECT doc_id, array_to_string({NUMBERED}, chr(10)) AS engine_rows FROM prompts")
def engine_rows(spark, sf_dir):
    return prompts(spark, sf_dir).select("doc_id", cl.engine_rows(F.col("prompt")).alias("engine_rows"))


@query("stand_in_completion", PROMPT_SQL + f" SELECT doc_id, concat(coalesce({NUMBERED}[1], ''), ' [', sha256(prompt)[1:8], ']') AS completion FROM prompts")
def stand_in_completion(spark, sf_dir):
    return prompts(spark, sf_dir).select("doc_id", cl.stand_in_completion(F.col("prompt")).alias("completion"))


REPLY = "replace(" + _case(REPLIES) + ", '\\\\n', chr(10))"
FIELDS = ("score", "category", "idea", "mechanism", "hallucination")
PARSED = "WITH r AS (SELECT doc_id, regexp_extract(regexp_replace(trim(" + REPLY.replace("'\\\\n'", "'\\n'") + """), '(?m)^```(?:json)?|```$', '', 'g'), '(?s)\\{.*\\}', 0) AS body FROM documents),
f AS (SELECT *, """ + ", ".join(f"CASE WHEN body <> '' THEN json_extract_string(body, '$.{k}') END AS {k}" for k in FIELDS) + """, CASE WHEN body <> '' THEN json_extract_string(body, '$.reason') END AS reason FROM r),
e AS (SELECT *, CASE WHEN body = '' THEN 'no JSON object' """ + " ".join(f"WHEN {k} IS NULL THEN 'missing field {k}'" for k in FIELDS) + """ WHEN TRY_CAST(score AS INTEGER) NOT IN (0, 1, 2) THEN 'score out of range' WHEN category NOT IN ('ok', 'wrong_theme', 'wrong_mechanism', 'hallucinated_line') THEN 'unknown category' END AS error FROM f)"""


def judgments(spark, sf_dir):
    d = st.read(spark, sf_dir, "documents").selectExpr("doc_id", "case when doc_id % 2 = 0 then 'candidates' else 'grade' end as arm", f"{_case(REPLIES)} as raw")
    return d.withColumn("reply", F.replace("raw", F.lit("\\n"), F.lit("\n"))).withColumns(cl.parse_reply(F.col("reply")))


@query("judge_replies", PARSED + " SELECT doc_id, CASE WHEN error IS NULL THEN score::INTEGER END AS score, CASE WHEN error IS NULL THEN category END AS category, CASE WHEN error IS NULL THEN idea::BOOLEAN END AS idea, CASE WHEN error IS NULL THEN coalesce(reason, '') END AS reason, error FROM e")
def judge_replies(spark, sf_dir):
    return judgments(spark, sf_dir).select("doc_id", "score", "category", "idea", "reason", "error")


@query("judge_failures", PARSED + " SELECT coalesce(error, 'ok') AS outcome, count(*) AS n FROM e GROUP BY 1")
def judge_failures(spark, sf_dir):
    return judgments(spark, sf_dir).groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


PAIRS = "WITH pairs AS (SELECT d.doc_id, d.lang AS config, (l.quality + l.toxic)::INTEGER AS human, (CASE WHEN d.n_chars % 7 < 5 THEN l.quality + l.toxic ELSE d.n_chars % 3 END)::INTEGER AS judge, concat('c', d.doc_id % 4) AS category FROM labels AS l JOIN documents AS d ON d.doc_id = l.doc_id)"


def pairs(spark, sf_dir):
    """Labels paired with the judge's score; only labelled items take part."""
    j = st.read(spark, sf_dir, "labels").join(st.read(spark, sf_dir, "documents"), "doc_id")
    return j.selectExpr("doc_id", "lang as config", "cast(quality + toxic as int) as human", "cast(case when n_chars % 7 < 5 then quality + toxic else n_chars % 3 end as int) as judge", "concat('c', doc_id % 4) as category")


STATS = PAIRS + """, c AS (SELECT config, count(*) AS n, count(*) FILTER (WHERE human = judge) AS same, count(*) FILTER (WHERE abs(human - judge) <= 1) AS near, count(*) FILTER (WHERE (human > 0) = (judge > 0)) AS same_idea, count(*) FILTER (WHERE (human = 2) = (judge = 2)) AS same_sound, """ + ", ".join(f"count(*) FILTER (WHERE human = {s}) AS h{s}, count(*) FILTER (WHERE judge = {s}) AS j{s}" for s in (0, 1, 2)) + """ FROM pairs GROUP BY 1),
k AS (SELECT *, same / n AS exact, (h0 / n) * (j0 / n) + (h1 / n) * (j1 / n) + (h2 / n) * (j2 / n) AS expected, 1.96 * 1.96 AS zz FROM c),
s AS (SELECT *, CASE WHEN expected = 1 THEN 1.0 ELSE (exact - expected) / (1 - expected) END AS kappa, greatest(0, ((exact + zz / (2 * n)) - 1.96 * sqrt(exact * (1 - exact) / n + zz / (4 * n * n))) / (1 + zz / n)) AS low, least(1, ((exact + zz / (2 * n)) + 1.96 * sqrt(exact * (1 - exact) / n + zz / (4 * n * n))) / (1 + zz / n)) AS high FROM k),
v AS (SELECT *, CASE WHEN kappa < 0.60 THEN 'fail (kappa)' WHEN exact < 0.80 THEN 'fail' WHEN low < 0.75 THEN 'inconclusive' ELSE 'pass' END AS verdict FROM s)"""


@query("judge_agreement", STATS + " SELECT config, n, round(exact, 6) AS exact, round(near / n, 6) AS within_one, round(same_idea / n, 6) AS idea, round(same_sound / n, 6) AS sound, round(kappa, 6) AS kappa, round(low, 6) AS low, round(high, 6) AS high, verdict FROM v")
def judge_agreement(spark, sf_dir):
    s = ag.with_verdict(ag.statistics(pairs(spark, sf_dir), "config"))
    return s.select("config", "n", *(F.round(c, 6).alias(c) for c in ("exact", "within_one", "idea", "sound", "kappa", "low", "high")), "verdict")


@query("judge_recommendation", STATS + """, priced AS (SELECT *, length(config) + CASE config WHEN 'en' THEN 0.5 ELSE 0.1 END AS cost FROM v)
SELECT coalesce('use ' || (SELECT min_by(config, {'c': cost, 'n': config}) FROM priced WHERE verdict = 'pass'), 'label more: ' || (SELECT string_agg(config, ', ' ORDER BY config) FROM priced WHERE verdict = 'inconclusive'), 'none') AS recommendation""")
def judge_recommendation(spark, sf_dir):
    s = ag.with_verdict(ag.statistics(pairs(spark, sf_dir), "config")).withColumn("cost", F.length("config") + F.when(F.col("config") == "en", 0.5).otherwise(0.1))
    return ag.recommendation(s)


@query("agreement_by_category", PAIRS + " SELECT config, " + ", ".join(f"nullif(count(*) FILTER (WHERE category = 'c{k}'), 0) AS c{k}_n, round(avg((human = judge)::INTEGER) FILTER (WHERE category = 'c{k}'), 6) AS c{k}_exact" for k in range(4)) + " FROM pairs GROUP BY 1")
def agreement_by_category(spark, sf_dir):
    return ag.by_category(pairs(spark, sf_dir), [f"c{k}" for k in range(4)])


@query("verdict_rows", PAIRS + ", split AS (SELECT *, CASE WHEN doc_id % 5 = 0 AND config <> 'en' THEN 'holdout' ELSE 'tune' END AS split FROM pairs), held AS (SELECT *, max((split = 'holdout')::INTEGER) OVER (PARTITION BY config) AS h FROM split) SELECT config, split, count(*) AS n FROM held WHERE h = 0 OR split = 'holdout' GROUP BY 1, 2")
def verdict_rows(spark, sf_dir):
    from plycast.operators import sampling as sm

    p = pairs(spark, sf_dir).withColumn("split", F.when((F.col("doc_id") % 5 == 0) & (F.col("config") != "en"), "holdout").otherwise("tune"))
    return sm.verdict_rows(p).groupBy("config", "split").agg(F.count("*").alias("n"))


@query("label_distribution", "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE quality + toxic = {k}) AS n{k}" for k in (0, 1, 2)) + ", count(*) FILTER (WHERE quality + toxic < 2) AS n_minority, count(*) FILTER (WHERE quality + toxic < 2) < 30 AS too_few FROM labels")
def label_distribution(spark, sf_dir):
    return sd.label_distribution(st.read(spark, sf_dir, "labels").selectExpr("quality + toxic as score"))


@query("every_config_every_item", "WITH c AS (SELECT unnest(['high', 'low', 'mid']) AS config) SELECT config, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM c CROSS JOIN labels GROUP BY 1")
def every_config_every_item(spark, sf_dir):
    configs = spark.createDataFrame([("high",), ("mid",), ("low",)], "config string")
    items = st.read(spark, sf_dir, "labels").crossJoin(F.broadcast(configs))  # a short, fixed list
    return items.groupBy("config").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


# records: puzzles with flags from their lines, judged by labels
RECORDS = st.PARSED_SQL + """, records AS (SELECT puzzle_id, rating_band, themes, list_filter(themes, lambda t: t <> 'short') AS theme_scored, list_filter(themes, lambda t: t = 'F' OR starts_with(t, '1')) AS theme_named,
  rating % 10 < 8 AS matched, rating % 10 < 6 AS exact, nb_plays % 20 > 0 AS grounded, rating % 3 = 0 AS explained, nb_plays % 9 > 0 AS grade_grounded, CASE WHEN popularity % 4 > 0 THEN (popularity % 5) / 4.0 END AS theme_rate,
  (nb_plays % 13 = 0)::INTEGER AS n_placement_errors, rating % 4 = 0 AS mate_claimed, rating % 5 = 0 AS mate_actual FROM banded WHERE rating_band IS NOT NULL),
judged AS (SELECT puzzle_id, u.arm, ((rating + u.n) % 3)::INTEGER AS score, (['ok', 'wrong_theme', 'wrong_mechanism'])[(rating + u.n) % 3 + 1] AS category, u.n AS seq, CASE WHEN (nb_plays + u.n) % 5 = 0 THEN 'unparseable' END AS error FROM banded, (VALUES ('candidates', 1), ('candidates', 2), ('grade', 3)) AS u(arm, n) WHERE rating_band IS NOT NULL),
scores AS (SELECT puzzle_id, arm, max_by(score, seq) AS score, max_by(category, seq) AS category FROM judged WHERE error IS NULL GROUP BY 1, 2),
scored AS (SELECT r.*, s.score AS judged_score FROM records AS r LEFT JOIN scores AS s ON s.puzzle_id = r.puzzle_id AND s.arm = 'candidates')"""
R = "WITH " + RECORDS


def _banded(spark, sf_dir):
    from plycast.plans.dump import banded

    return banded(spark, sf_dir).filter("rating_band is not null")


def records(spark, sf_dir):
    return _banded(spark, sf_dir).selectExpr(
        "puzzle_id", "rating_band", "themes", "filter(themes, t -> t <> 'short') as theme_scored", "filter(themes, t -> t = 'F' or startswith(t, '1')) as theme_named", "rating % 10 < 8 as matched",
        "rating % 10 < 6 as exact", "nb_plays % 20 > 0 as grounded", "rating % 3 = 0 as explained", "nb_plays % 9 > 0 as grade_grounded", "case when popularity % 4 > 0 then (popularity % 5) / 4.0D end as theme_rate",
        "cast(nb_plays % 13 = 0 as int) as n_placement_errors", "rating % 4 = 0 as mate_claimed", "rating % 5 = 0 as mate_actual")


def judged(spark, sf_dir):
    u = F.explode(F.expr("array(struct('candidates' as arm, 1 as n), struct('candidates' as arm, 2 as n), struct('grade' as arm, 3 as n))"))
    b = _banded(spark, sf_dir).select("puzzle_id", "rating", "nb_plays", u.alias("u"))
    return b.selectExpr("puzzle_id", "u.arm", "cast((rating + u.n) % 3 as int) as score", "array('ok', 'wrong_theme', 'wrong_mechanism')[(rating + u.n) % 3] as category", "u.n as seq", "case when (nb_plays + u.n) % 5 = 0 then 'unparseable' end as error")


def scored(spark, sf_dir):
    return sd.attach_scores(records(spark, sf_dir), sd.last_judgments(judged(spark, sf_dir)))


def _r(c: str) -> str:
    return f"round(avg({c}::INTEGER), 6)"


@query("plumbing_rates", R + f" SELECT count(*) AS n, {_r('matched')} AS matched, {_r('exact')} AS exact, {_r('grounded')} AS grounded, count(*) FILTER (WHERE explained) AS n_graded, round(avg(grade_grounded::INTEGER) FILTER (WHERE explained), 6) AS grade_grounded FROM records")
def plumbing_rates(spark, sf_dir):
    return sd.plumbing(records(spark, sf_dir))


@query("proxy_rates", R + f" SELECT count(theme_rate) AS n_scorable, round(avg(theme_rate), 6) AS theme_rate, {_r('(n_placement_errors = 0)')} AS placements_real, {_r('(mate_claimed = mate_actual)')} AS mate_consistent, count(*) FILTER (WHERE mate_claimed AND NOT mate_actual) AS invented, count(*) FILTER (WHERE mate_actual AND NOT mate_claimed) AS missed FROM records")
def proxy_rates(spark, sf_dir):
    return sd.proxies(records(spark, sf_dir))


@query("last_judgments", R + " SELECT * FROM scores")
def last_judgments(spark, sf_dir):
    return sd.last_judgments(judged(spark, sf_dir)).select("puzzle_id", "arm", "score", "category")


@query("scores_per_arm", R + " SELECT arm, count(*) AS n, round(avg(score), 6) AS mean, " + ", ".join(f"count(*) FILTER (WHERE score = {k}) AS n{k}" for k in (0, 1, 2)) + " FROM scores GROUP BY 1")
def scores_per_arm(spark, sf_dir):
    return sd.per_arm(sd.last_judgments(judged(spark, sf_dir)))


@query("categories_per_arm", R + " SELECT arm, category, count(*) AS n FROM scores GROUP BY 1, 2")
def categories_per_arm(spark, sf_dir):
    return sd.categories(sd.last_judgments(judged(spark, sf_dir)))


RATES = f"count(*) AS n, {_r('matched')} AS matched, {_r('grounded')} AS grounded, count(judged_score) AS n_judged, round(avg(judged_score), 6) AS mean_score"


@query("per_theme", R + f" SELECT u.theme, {RATES}, round(avg(CASE WHEN list_contains(theme_scored, u.theme) THEN list_contains(theme_named, u.theme)::INTEGER END), 6) AS named, round(avg((judged_score = 2)::INTEGER), 6) AS sound FROM scored, unnest(themes) AS u(theme) WHERE u.theme NOT IN (" + ", ".join(f"'{t}'" for t in pz.CONTEXT_TAGS) + ") GROUP BY 1 ORDER BY n DESC, u.theme")
def per_theme(spark, sf_dir):
    return sd.per_theme(scored(spark, sf_dir), pz.CONTEXT_TAGS)


@query("per_band", R + f" SELECT rating_band, {RATES} FROM scored GROUP BY 1 ORDER BY 1")
def per_band(spark, sf_dir):
    return sd.per_band(scored(spark, sf_dir))


@query("errors_and_scored", R + " SELECT count(*) FILTER (WHERE error IS NOT NULL) AS n_errors, count(*) FILTER (WHERE error IS NULL) AS n_scored FROM judged")
def errors_and_scored(spark, sf_dir):
    return judged(spark, sf_dir).agg(F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.count_if(F.col("error").isNull()).alias("n_scored"))


@query("paired_sweeps", R + " SELECT count(*) AS n, count(*) FILTER (WHERE a.grounded) AS n_a, count(*) FILTER (WHERE b.matched) AS n_b, count(*) FILTER (WHERE a.grounded AND NOT b.matched) AS a_only, count(*) FILTER (WHERE b.matched AND NOT a.grounded) AS b_only FROM records AS a JOIN records AS b ON a.puzzle_id = b.puzzle_id")
def paired_sweeps(spark, sf_dir):
    r = records(spark, sf_dir)
    return sd.paired(r.withColumn("ok", F.col("grounded")), r.withColumn("ok", F.col("matched")))


@query("resume_sweep", R + " SELECT puzzle_id FROM records WHERE puzzle_id NOT IN (SELECT puzzle_id FROM judged WHERE arm = 'grade' AND error IS NULL)")
def resume_sweep(spark, sf_dir):
    done = judged(spark, sf_dir).filter("arm = 'grade' and error is null")
    return sd.todo(records(spark, sf_dir), done, ("puzzle_id",)).select("puzzle_id")


@query("resume_judging", R + ", jobs AS (SELECT puzzle_id, 'candidates' AS arm FROM records UNION ALL SELECT puzzle_id, 'grade' FROM records WHERE explained), bad AS (SELECT DISTINCT puzzle_id, arm FROM judged WHERE error IS NULL) SELECT j.puzzle_id, j.arm FROM jobs AS j ANTI JOIN bad AS b ON b.puzzle_id = j.puzzle_id AND b.arm = j.arm")
def resume_judging(spark, sf_dir):
    """Both arms as jobs; those whose replies could not be read are tried again."""
    r = records(spark, sf_dir).withColumns({c: F.lit("") for c in ("fen", "csv_fen", "explanation", "grade_explanation")})
    return sd.todo(sd.jobs(r), judged(spark, sf_dir), ("puzzle_id", "arm"), retry_errors=True).select("puzzle_id", "arm")


@query("explained_positions", "WITH " + st.PARSED_SQL + " SELECT puzzle_id, 'candidates' AS arm, 'after' AS fen FROM banded UNION ALL SELECT puzzle_id, 'grade' AS arm, csv_fen AS fen FROM banded WHERE rating % 3 = 0")
def explained_positions(spark, sf_dir):
    """The grade arm explains the position before the setup move."""
    from plycast.plans.dump import banded

    b = banded(spark, sf_dir).withColumns({"fen": F.lit("after"), "explained": F.col("rating") % 3 == 0, "explanation": F.lit(""), "grade_explanation": F.lit("")})
    return sd.jobs(b).select("puzzle_id", "arm", "fen")


@query("settings_compatible", R + ", a AS (SELECT max(rating_band) AS sample, min(rating_band) AS engine, NULL AS model FROM records), b AS (SELECT max(rating_band) AS sample, max(rating_band) AS engine, NULL AS model FROM records) SELECT unnest(['sample', 'engine', 'model']) AS setting, unnest([a.sample IS NOT DISTINCT FROM b.sample, a.engine IS NOT DISTINCT FROM b.engine, true]) AS equal FROM a, b")
def settings_compatible(spark, sf_dir):
    r = records(spark, sf_dir)
    a = r.agg(F.max("rating_band").alias("sample"), F.min("rating_band").alias("engine"), F.max(F.lit(None).cast("string")).alias("model"))
    b = r.agg(F.max("rating_band").alias("sample"), F.max("rating_band").alias("engine"), F.max(F.lit(None).cast("string")).alias("model"))
    return sd.check_settings(a, b, ("sample", "engine", "model"))
