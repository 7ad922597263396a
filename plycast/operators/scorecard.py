"""Records with their judged scores, by arm, theme and rating band; last judgment wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_judgments(judged: DataFrame, key: tuple = ("puzzle_id", "arm"), seq: str = "seq") -> DataFrame:
    """The last row without an error for each key."""
    ok = judged.filter("error is null")
    rest = [c for c in judged.columns if c not in (*key, "error")]
    return ok.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("j")).select(*key, "j.*")


def attach_scores(records: DataFrame, scores: DataFrame, arm: str = "candidates", id: str = "puzzle_id") -> DataFrame:
    own = scores.filter(F.col("arm") == arm).select(id, F.col("score").alias("judged_score"))
    return records.join(own, id, "left")


def plumbing(records: DataFrame) -> DataFrame:
    avg = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    graded = F.when(F.col("explained"), F.col("grade_grounded"))
    return records.agg(F.count("*").alias("n"), avg("matched").alias("matched"), avg("exact").alias("exact"), avg("grounded").alias("grounded"), F.count_if("explained").alias("n_graded"), F.round(F.avg(graded.cast("double")), 6).alias("grade_grounded"))


def proxies(records: DataFrame) -> DataFrame:
    claimed, actual = F.col("mate_claimed"), F.col("mate_actual")
    return records.agg(
        F.count("theme_rate").alias("n_scorable"), F.round(F.avg("theme_rate"), 6).alias("theme_rate"), F.round(F.avg((F.col("n_placement_errors") == 0).cast("double")), 6).alias("placements_real"),
        F.round(F.avg((claimed == actual).cast("double")), 6).alias("mate_consistent"), F.count_if(claimed & ~actual).alias("invented"), F.count_if(actual & ~claimed).alias("missed"))


def per_arm(scores: DataFrame) -> DataFrame:
    s = F.col("score")
    return scores.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), *(F.count_if(s == k).alias(f"n{k}") for k in (0, 1, 2)))


def categories(scores: DataFrame) -> DataFrame:
    return scores.groupBy("arm", "category").agg(F.count("*").alias("n"))


def _rates() -> list:
    s = F.col("judged_score")
    avg = lambda c: F.round(F.avg(c.cast("double")), 6)
    return [F.count("*").alias("n"), avg(F.col("matched")).alias("matched"), avg(F.col("grounded")).alias("grounded"), F.count(s).alias("n_judged"), F.round(F.avg(s), 6).alias("mean_score")]


def per_theme(scored: DataFrame, context: tuple) -> DataFrame:
    """``scored`` has themes, theme_scored and theme_named arrays; ``named`` has its own denominator."""
    t = scored.withColumn("theme", F.explode("themes")).filter(~F.col("theme").isin(*context))
    asked, named = F.array_contains("theme_scored", F.col("theme")), F.array_contains("theme_named", F.col("theme"))
    return t.groupBy("theme").agg(*_rates(), F.round(F.avg(F.when(asked, named.cast("double"))), 6).alias("named"), F.round(F.avg((F.col("judged_score") == 2).cast("double")), 6).alias("sound")).orderBy(F.desc("n"), "theme")


def per_band(scored: DataFrame) -> DataFrame:
    return scored.groupBy("rating_band").agg(*_rates()).orderBy("rating_band")


def label_distribution(labels: DataFrame, least: int = 30) -> DataFrame:
    """Scores of labels, and whether too few are 0 or 1 for an agreement figure to mean much."""
    low = F.count_if(F.col("score") < 2)
    return labels.agg(F.count("*").alias("n"), *(F.count_if(F.col("score") == k).alias(f"n{k}") for k in (0, 1, 2)), low.alias("n_minority"), (low < least).alias("too_few"))


def paired(a: DataFrame, b: DataFrame, id: str = "puzzle_id", flag: str = "ok") -> DataFrame:
    """Two sweeps over the same items: rates on both, and the discordant counts."""
    j = a.select(id, F.col(flag).alias("a")).join(b.select(id, F.col(flag).alias("b")), id)
    return j.agg(F.count("*").alias("n"), F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"), F.count_if(F.col("a") & ~F.col("b")).alias("a_only"), F.count_if(F.col("b") & ~F.col("a")).alias("b_only"))


def jobs(records: DataFrame) -> DataFrame:
    """One row per arm: the candidates arm always, the grade arm where it was explained. Each carries the position that it explains."""
    cand = F.struct(F.lit("candidates").alias("arm"), F.col("fen").alias("fen"), F.col("explanation").alias("explanation"))
    grade = F.when(F.col("explained"), F.struct(F.lit("grade").alias("arm"), F.col("csv_fen").alias("fen"), F.col("grade_explanation").alias("explanation")))
    arms = F.explode(F.filter(F.array(cand, grade), lambda x: x.isNotNull()))
    return records.select("puzzle_id", arms.alias("a")).select("puzzle_id", "a.*")


def todo(items: DataFrame, done: DataFrame, key: tuple, retry_errors: bool = False) -> DataFrame:
    """Items with no row in the output yet; error rows count as done unless they are to be tried again."""
    seen = done.filter("error is null") if retry_errors and "error" in done.columns else done
    return items.join(seen.select(*key).distinct(), list(key), "left_anti")


def check_settings(one: DataFrame, other: DataFrame, keys: tuple) -> DataFrame:
    """One row per setting: equal or not (nulls are equal)."""
    a, b = one.select(*keys).alias("a"), other.select(*keys).alias("b")
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("setting"), F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")).alias("equal")) for k in keys)))
    return a.crossJoin(F.broadcast(b)).select(pairs.alias("p")).select("p.*")  # one row each


def require_same_settings(one: DataFrame, other: DataFrame, keys: tuple) -> None:
    bad = [r.setting for r in check_settings(one, other, keys).filter("not equal").collect()]  # a row per setting
    if bad:
        raise ValueError(f"settings differ: {', '.join(bad)}")
