"""Values worked out by hand."""

import zlib

import pytest
from pyspark.sql import functions as F

from plycast.operators import agreement, boards, claims, completion, puzzles, requests, retrieval, sampling, scorecard, scoring, vision
from plycast.sources import files


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_bands_include_their_lower_bound(spark):
    d = spark.createDataFrame([(r,) for r in (0, 1199, 1200, 2399, 2400, 4000)], "rating int")
    assert [r.rating_band for r in puzzles.with_band(d).orderBy("rating").collect()] == ["0-1199", "0-1199", "1200-1799", "1800-2399", "2400-3999", None]


def test_quality_bounds_are_inclusive(spark):
    rows = [(1, 50, 100, 110), (2, 49, 100, 110), (3, 50, 99, 110), (4, 50, 100, 111)]
    d = spark.createDataFrame(rows, "id int, popularity int, nb_plays int, rating_deviation int")
    assert [r.id for r in puzzles.quality(d).collect()] == [1]


def test_sample_does_not_depend_on_partitions(spark):
    d = spark.range(500).selectExpr("cast(id as string) as puzzle_id", "concat('t', id % 3) as theme", "concat('b', id % 2) as rating_band")
    a, b = (sorted(map(tuple, sampling.stratified(x, 5, 1).collect())) for x in (d, d.repartition(17)))
    assert a == b and len(a) == 30


def test_subsamples_nest(spark):
    d = spark.range(200).selectExpr("cast(id as string) as puzzle_id")
    small, large = ({r[0] for r in sampling.subsample(d, n, 3).collect()} for n in (20, 60))
    assert small < large and len(small) == 20
    assert sampling.subsample(d, 999, 3).count() == 200


def test_shards_are_full_but_for_the_last(spark):
    d = spark.range(1030).selectExpr("id", "if(id < 1000, 'a', 'b') as split")
    n = {(r.split, r.shard): r["count"] for r in sampling.shards(d, 300, "split", "id").groupBy("split", "shard").count().collect()}
    assert n == {("a", 0): 300, ("a", 1): 300, ("a", 2): 300, ("a", 3): 100, ("b", 0): 30}


def test_crc_split_is_zlibs(spark):
    d = spark.createDataFrame([("p1", "grade"), ("x", "candidates")], "puzzle_id string, arm string").withColumn("share", sampling.crc_share("puzzle_id", "arm"))
    for r in d.collect():
        assert r.share == zlib.crc32(f"{r.puzzle_id}|{r.arm}".encode()) / 2**32


def test_styles_do_not_leak(spark):
    d = spark.range(300).selectExpr("id", "concat('s', id % 5) as piece_set")
    s = sampling.style_split(d, {"piece_set": ["s1"]}, 2, "id")
    assert s.filter("piece_set = 's1' and split <> 'heldout'").count() == 0 == s.filter("piece_set <> 's1' and split = 'heldout'").count()


@pytest.mark.parametrize(("cp", "mate", "win"), [(0, None, 50), (None, 3, 100), (None, -1, 0), (None, 0, 0), (None, None, 50)])
def test_win_percent(spark, cp, mate, win):
    assert one(spark, scoring.win_pct(F.lit(cp).cast("int"), F.lit(mate).cast("int"))) == win


@pytest.mark.parametrize(("played", "cls"), [(250, "good"), (60, "inaccuracy"), (30, "mistake"), (-100, "blunder"), (400, "good")])
def test_grades(spark, played, cls):
    g = scoring.grade(scoring.win_of_cp(F.lit(300)), scoring.win_of_cp(F.lit(played)), F.lit(False))
    assert one(spark, g["move_class"]) == cls
    assert one(spark, scoring.grade(F.lit(60.0), F.lit(10.0), F.lit(True))["move_class"]) == "best"


@pytest.mark.parametrize(("cp", "side", "text"), [(20, "w", "roughly equal"), (250, "w", "winning for White (+2.5)"), (250, "b", "winning for Black (-2.5)"), (-50, "w", "slightly better for Black (-0.5)")])
def test_phrases(spark, cp, side, text):
    assert one(spark, scoring.eval_phrase(F.lit(cp), F.lit(None).cast("int"), F.lit(side))) == text


def test_move_claims(spark):
    get = lambda t: one(spark, claims.move_claims(F.lit(t)))
    assert get("Qxc8+ Bxc8 then Rf8#, O-O-O, exd5 and e8=Q+") == ["Qxc8", "Bxc8", "Rf8", "O-O-O", "exd5", "e8=Q"]
    assert get("the pawn on e4; 1. e4 and 3... d5") == ["e4", "d5"]
    assert get("43. g8=Q+ wins") == ["g8=Q"]
    assert get("Qb7-c8 it goes") == []


def test_theme_coverage_is_null_without_scorable_tags(spark):
    d = spark.createDataFrame([(1, "a fork wins", ["fork", "short"]), (2, "nothing", ["pin"]), (3, "x", ["mate"])], "id int, text string, themes array<string>")
    got = {r.id: r.theme_rate for r in claims.theme_coverage(d, claims.lexicon(spark)).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: None}


def test_template_needs_all_names(spark):
    assert one(spark, claims.fill("a {{x}} {{y}}", {"x": "{{y}}", "y": "1"})) == "a {{y}} 1"
    with pytest.raises(KeyError):
        claims.fill("{{z}}", {})


@pytest.mark.parametrize(
    ("reply", "score", "error"),
    [
        ('{"idea": true, "mechanism": true, "hallucination": false, "score": 2, "category": "ok"}', 2, None),
        ('```json\n{"idea": true, "mechanism": true, "hallucination": false, "score": "1", "category": "ok"}\n```', 1, None),
        ('Sure: {"idea": false, "mechanism": true, "hallucination": false, "score": 0, "category": "wrong_theme"} ok?', 0, None),
        ('{"idea": true, "mechanism": true, "hallucination": false, "score": 5, "category": "ok"}', None, "score out of range"),
        ('{"idea": true, "mechanism": true, "hallucination": false, "score": 1, "category": "excellent"}', None, "unknown category"),
        ("no", None, "no JSON object"),
        ('{"score": 1', None, "no JSON object"),
        ("{nonsense}", None, "unparseable JSON"),
    ],
)
def test_judge_replies(spark, reply, score, error):
    p = claims.parse_reply(F.lit(reply))
    assert (one(spark, p["score"]), one(spark, p["error"])) == (score, error)


def test_agreement_statistics(spark):
    pairs = [(0, 0)] * 10 + [(1, 1)] * 25 + [(2, 2)] * 50 + [(2, 1)] * 15
    d = spark.createDataFrame([("a", h, j) for h, j in pairs], "config string, human int, judge int")
    r = agreement.with_verdict(agreement.statistics(d, "config")).first()
    assert r.exact == 0.85 and round(r.low, 3) == 0.767 and r.verdict == "pass" and r.within_one == 1
    same = spark.createDataFrame([("a", 2, 2)] * 5, "config string, human int, judge int")
    assert agreement.statistics(same, "config").first().kappa == 1
    flat = spark.createDataFrame([("a", h, 2) for h in (0, 1, 2, 2)], "config string, human int, judge int")
    assert agreement.with_verdict(agreement.statistics(flat, "config")).first().verdict == "fail (kappa)"
    assert agreement.statistics(same.filter("human > 9")).first().n == 0


def test_settings_must_match(spark):
    a, b = (spark.createDataFrame([(x, None)], "model string, sample string") for x in "xy")
    scorecard.require_same_settings(a, a, ("model", "sample"))
    with pytest.raises(ValueError, match="model"):
        scorecard.require_same_settings(a, b, ("model", "sample"))


def test_piece_list_and_rotation(spark):
    d = boards.with_board(spark.createDataFrame([("a", "8/8/8/8/8/8/P6k/K7 w - - 0 1")], "id string, fen string"))
    assert boards.piece_list(d, "id").first().pieces == "White: Ka1, pawns a2\nBlack: Kh2"
    assert d.select(boards.rotate(boards.rotate(F.col("board"))) == F.col("board")).first()[0]


@pytest.mark.parametrize(
    ("fen", "bad"),
    [("4k3/8/8/8/8/P7/PPPPPPPP/4K3", True), ("4k3/8/8/8/8/Q7/PPPPPPPP/3QK3", True), ("4k3/8/8/8/8/Q7/PPPPPPP1/3QK3", False), ("QQQQk3/QQQQ4/8/8/8/8/8/4K2Q", False), ("QQQQk3/QQQQ4/8/8/8/8/8/Q3K2Q", True)],
)
def test_material(spark, fen, bad):
    d = boards.with_board(spark.createDataFrame([("a", fen + " w - - 0 1")], "id string, fen string"))
    assert (boards.material_error(d, "id").first().error is not None) == bad


def scores(**at):
    """64 rows that say empty, but for squares with classes and weights."""
    rows = []
    for sq in range(64):
        s = [0.0] * 13
        s[0] = 0.5
        for k, v in at.get(f"s{sq}", {}).items():
            s[k] = v
        rows.append((1, sq, s))
    return rows


def kings(spark, rows):
    d = vision.enforce_kings(spark.createDataFrame(rows, "board_id int, square int, scores array<double>"))
    return {r.square: r.pred for r in d.collect() if r.pred}


def test_king_rule(spark):
    fine = scores(s4={6: 0.9}, s60={12: 0.9})
    assert kings(spark, fine) == {4: 6, 60: 12}
    double = scores(s4={6: 0.9}, s10={6: 0.8, 5: 0.7}, s60={12: 0.9})
    assert kings(spark, double) == {4: 6, 10: 5, 60: 12}
    missing = scores(s20={6: 0.4}, s60={12: 0.9})
    assert kings(spark, missing) == {20: 6, 60: 12}
    never_steals = scores(s60={12: 0.9, 6: 0.8}, s20={6: 0.1})
    assert kings(spark, never_steals) == {20: 6, 60: 12}


def test_engine_log_rejects_what_is_no_line(spark):
    rows = ["info depth 12 multipv 2 score cp 31 pv e2e4 e7e5", "info depth 9 score mate -3 pv e2e4", "info depth 9 score cp 1 lowerbound pv e2e4", "info seldepth 30 score cp 1 pv e2e4", "bestmove e2e4", "info string x", ""]
    got = [(r.multipv, r.depth, r.cp, r.mate, r.pv) for r in requests.engine_log(spark.createDataFrame([(x,) for x in rows], "line string")).collect()]
    assert got == [(2, 12, 31, None, ["e2e4", "e7e5"]), (1, 9, None, -3, ["e2e4"])]


def test_budget_without_a_cap_lets_all_in(spark):
    d = spark.range(50).selectExpr("id as event_id", "timestamp_seconds(id * 60) as ts")
    assert requests.daily_budget(d, F.lit(None).cast("long")).filter("within").count() == 50
    assert sorted(r.event_id for r in requests.daily_budget(d, F.lit(3)).filter("within").collect()) == [0, 1, 2]
    assert [one(spark, requests.cap_of(F.lit(x))) for x in ("", "x", "-1", "0", "7")] == [None, None, None, None, 7]


def test_cosine_and_features(spark):
    assert round(one(spark, retrieval.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0)))), 6) == 0.96
    d = boards.with_board(spark.createDataFrame([("6k1/5ppp/8/8/8/8/5PPP/6K1 w - - 0 1",)], "fen string"))
    r = d.select(retrieval.open_files(F.col("board")).alias("o"), retrieval.back_rank(F.col("board")).alias("b")).first()
    assert (r.o, r.b) == ("abcde", True)


def test_puzzle_header_is_a_contract(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("PuzzleId,Fen\n1,2\n")
    with pytest.raises(Exception, match="header"):
        files.read_puzzles(spark, str(tmp_path / "bad.csv")).collect()
    with pytest.raises(FileNotFoundError):
        files.read_required(spark, str(tmp_path / "none.json"), "a int")
    assert files.read_optional(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "m.json").write_text('{\n "author": "x",\n "n": 3\n}')
    assert files.read_manifest(spark, str(tmp_path / "m.json"), "author string, n int").first().n == 3


def test_completions_keep_failures_apart(spark):
    def client():
        def ask(p):
            if "bad" in p:
                raise ValueError("refused")
            return p.upper(), len(p.split()), 1

        return ask

    d = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, None)], "id int, prompt string")
    got = {r.id: (r.text, r.input_tokens, r.output_tokens, r.error) for r in completion.completed(d, client).collect()}
    assert got == {1: ("A B", 2, 1, None), 2: (None, None, None, "ValueError: refused"), 3: (None, None, None, "no prompt")}


def test_gates_in_order(spark):
    rows = [(k, "c", k != 1, "bad" if k == 2 else None, None if k == 3 else k != 4) for k in range(9)]
    d = spark.createDataFrame(rows, "event_id int, client string, fits boolean, reason string, legal boolean").selectExpr("*", "timestamp_seconds(event_id) as ts")
    got = {r.event_id: r.stage for r in requests.gates(d, 8, "1 hour", 3).collect()}
    assert got == {0: "passed", 1: "size", 2: "schema", 3: "legality", 4: "legality", 5: "passed", 6: "passed", 7: "budget", 8: "rate"}


def test_what_supersedes_may_stand_in_the_next_slot(spark):
    at = [3599.9, 3600.0, 7200.0, 7200.0, 90000.0]
    d = spark.createDataFrame(list(enumerate(at)), "event_id int, t double").selectExpr("event_id", "'c' as client", "timestamp_micros(cast(t * 1e6 as bigint)) as ts")
    assert sorted(r.event_id for r in requests.debounced(d, 250, "client").collect()) == [1, 3, 4]


def test_a_budget_is_exact_within_its_minute(spark):
    d = spark.range(400).selectExpr("id as event_id", "timestamp_seconds(id div 7 * 13) as ts")
    for cap in (0, 1, 100, 399, 1000):
        assert sorted(r.event_id for r in requests.daily_budget(d, F.lit(cap)).filter("within").collect()) == list(range(min(cap, 400)))


def test_neighbours_in_a_seeded_order(spark):
    d = spark.range(300).selectExpr("concat('g', id % 2) as g", "cast(id as string) as k")
    got = {r.k: r.before for r in sampling.adjacent(d, "g", 5, "k").collect()}
    by = {r.k: (r.g, r.turn) for r in d.withColumn("turn", sampling.draw(5, "k")).collect()}
    for g in ("g0", "g1"):
        order = sorted((k for k in by if by[k][0] == g), key=lambda k: by[k][1])
        assert all(got[k] == b for b, k in zip([None, *order], order))


def test_features_of_the_vocabulary(spark):
    d = boards.with_board(spark.createDataFrame([("r3k3/2N5/8/8/8/8/5PPP/6K1 w - - 0 1",), ("4k3/8/8/8/8/3n4/8/1K3R2 w - - 0 1",), ("6k1/5ppp/8/8/8/8/8/R3K2n w - - 0 1",)], "fen string"))
    got = {}
    for r in retrieval.features(d, "fen").collect():
        got.setdefault(r.fen[:2], set()).add(r.feature)
    rest = lambda k: {x for x in got[k] if not x.startswith("open")}
    assert rest("r3") == {"white knight fork", "weak white back rank", "exposed black king"}
    assert rest("4k") == {"exposed white king", "exposed black king"}
    assert rest("6k") == {"exposed white king"}


def test_a_zst_dump_is_read_as_a_plain_one(spark, tmp_path):
    import zstandard

    rows = [",".join(files.PUZZLE_HEADER), 'p1,fen w - - 0 1,e2e4 e7e5,1500,75,95,800,"fork, short",https://x,', "p2,fen,a2a3,,75,95,800,pin,https://y,Open_Game"]
    text = ("\n".join(rows) + "\n").encode()
    (tmp_path / "a.csv").write_bytes(text)
    (tmp_path / "a.csv.zst").write_bytes(zstandard.ZstdCompressor().compress(text[:150]) + zstandard.ZstdCompressor().compress(text[150:]))
    plain, packed = (sorted(map(tuple, files.read_puzzles(spark, str(tmp_path / x)).collect())) for x in ("a.csv", "a.csv.zst"))
    assert plain == packed and len(packed) == 2 and packed[0][7] == "fork, short"
    (tmp_path / "b.csv.zst").write_bytes(zstandard.ZstdCompressor().compress(b"PuzzleId,Fen\n1,2\n"))
    with pytest.raises(Exception, match="header"):
        files.read_puzzles(spark, str(tmp_path / "b.csv.zst")).collect()


def test_candidates_in_place_and_from_a_table(spark):
    from plycast.operators import prompts

    rows = [("a", 2, 9, "e4", 35, None, "w"), ("a", 1, 11, "d4", -120, None, "w"), ("b", 1, 7, "Nf6", None, 3, "b")]
    lines = spark.createDataFrame(rows, "id string, multipv int, depth int, san string, cp int, mate int, side string")
    one = {r.id: r.candidates for r in prompts.candidate_rows(lines, "id").collect()}
    held = lines.groupBy("id", "side").agg(F.collect_list(F.struct("multipv", "san", "cp", "mate")).alias("x"))
    assert one == {r.id: r.t for r in held.select("id", prompts.candidate_text(F.col("x"), F.col("side")).alias("t")).collect()}
    assert one["a"].splitlines()[0].startswith("1. d4 — ") and len(one["a"].splitlines()) == 2


def test_squares_of_a_board_are_summed_up_before_they_are_sent(spark):
    fens = ["rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w - - 0 1", "8/8/8/8/8/8/8/8 w - - 0 1", "k7/8/1q6/7P/8/p6p/8/K6R w - - 0 1", "qqqqqqqq/KkKkKkKk/p1p1p1p1/1P1P1P1P/8/7k/K7/rrrrrrrr w - - 0 1"]
    d = boards.with_board(spark.createDataFrame(list(enumerate(fens)), "id long, fen string"))
    back = boards.grid_to_placement(boards.squares(d, "id", empty=True).orderBy(F.rand(1)).repartition(3), "id")
    assert {r.id: r.placement for r in back.collect()} == {i: f.split(" ")[0] for i, f in enumerate(fens)}
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "partial_bit_or" in plan  # a board's rows are no list


def test_gates_read_their_requests_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def legal(i):
        seen.add(1)
        return i % 2 == 0

    d = spark.range(20).selectExpr("id as event_id", "timestamp_seconds(id * 60) as ts", "'c' as client", "cast(null as string) as reason", "true as fits").withColumn("legal", legal("event_id"))
    got = {r.event_id: (r.stage, r.legal) for r in requests.gates(d, 12, "1 hour", 4).collect()}
    assert {i: s for i, (s, _) in got.items()} == {i: "rate" if i >= 12 else "legality" if i % 2 else "passed" if i < 8 else "budget" for i in range(20)}
    assert seen.value == 20
