"""Do a judge's scores follow the human ones: agreement, kappa, Wilson interval, verdict, recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bars of the gate (fixed values).
BAR, KAPPA_BAR, FLOOR, Z = 0.80, 0.60, 0.75, 1.96
SCORES = (0, 1, 2)


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    p = successes / n
    denominator = 1 + z * z / n
    center = (p + z * z / (2 * n)) / denominator
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), center - half)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), center + half))


def statistics(pairs: DataFrame, *by: str, human: str = "human", judge: str = "judge") -> DataFrame:
    """One pass: counts per score of each side, and all that follows from them."""
    h, j = F.col(human), F.col(judge)
    counts = [F.count_if(h == s).alias(f"h{s}") for s in SCORES] + [F.count_if(j == s).alias(f"j{s}") for s in SCORES]
    d = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(h == j).alias("same"), F.count_if(F.abs(h - j) <= 1).alias("near"),
        F.count_if((h > 0) == (j > 0)).alias("same_idea"), F.count_if((h == 2) == (j == 2)).alias("same_sound"), *counts)
    n = F.col("n")
    share = lambda c: F.when(n == 0, 0.0).otherwise(F.col(c) / n)
    observed = share("same")
    expected = sum((F.col(f"h{s}") / n * (F.col(f"j{s}") / n) for s in SCORES), F.lit(0.0))
    kappa = F.when(n == 0, 0.0).when(expected == 1, 1.0).otherwise((observed - expected) / (1 - expected))
    low, high = wilson(F.col("same"), n)
    return d.select(*by, "n", observed.alias("exact"), share("near").alias("within_one"), share("same_idea").alias("idea"), share("same_sound").alias("sound"), kappa.alias("kappa"), low.alias("low"), high.alias("high"))


def with_verdict(stats: DataFrame) -> DataFrame:
    v = F.when(F.col("n") == 0, "no data").when(F.col("kappa") < KAPPA_BAR, "fail (kappa)").when(F.col("exact") < BAR, "fail").when(F.col("low") < FLOOR, "inconclusive").otherwise("pass")
    return stats.withColumn("verdict", v)


def recommendation(verdicts: DataFrame, config: str = "config", cost: str = "cost") -> DataFrame:
    """The cheapest config that passes; else the names of inconclusive ones; else none."""
    passed = F.col("verdict") == "pass"
    best = F.min(F.when(passed, F.struct(F.col(cost).alias("c"), F.col(config).alias("n"))))["n"]
    open_ = F.array_join(F.array_sort(F.collect_list(F.when(F.col("verdict") == "inconclusive", F.col(config)))), ", ")
    d = verdicts.agg(best.alias("best"), open_.alias("open"))
    return d.select(F.when(F.col("best").isNotNull(), F.concat(F.lit("use "), "best")).when(F.col("open") != "", F.concat(F.lit("label more: "), "open")).otherwise("none").alias("recommendation"))


def by_category(pairs: DataFrame, categories: list[str], config: str = "config") -> DataFrame:
    exact = F.avg((F.col("human") == F.col("judge")).cast("double"))
    return pairs.groupBy(config).pivot("category", categories).agg(F.count(F.lit(1)).alias("n"), F.round(exact, 6).alias("exact"))
