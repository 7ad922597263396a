"""A corpus cleaned in five stages: quality rules, line dedup, SimHash near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of ``docs``, whatever their names; an empty table gives an empty one in each. ``run`` writes each stage's rows
and reads them again, so that no stage is computed twice, and removes what is no longer read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plycast.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from plycast.llm.common import discard, shared, table, tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the log-likelihood ratio; null and empty texts fail; repeated rows share a fate."""
    trusted = table(spark, sf_dir, "labels").filter(F.col("quality") == 1)
    return quality_rules.keep_good(docs, trusted)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, later copies of line runs cut out of ``text``; n_chars follows. Null texts stay null; repeated rows are one
    document and get the same text; of equal runs the one of the smallest doc_id stays."""
    return line_dedup.clean_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, that of the smallest doc_id; texts without words are one component."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no benchmark item; null and empty texts leak none and stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its place in a sequence of 2048 tokens at most."""
    return packing.best_fit_packing(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("decontamination", benchmark), ("best_fit_packing", pack)]
#: Hashing and tokenizing stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with tables() as mine:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        discard(spark, *mine, *([before] if before else []))
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
