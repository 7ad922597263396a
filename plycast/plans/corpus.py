"""Queries over the corpus index: sets of tags, recall against a golden table, near copies. Vectors stand in for chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plycast.functions.lineage import settle
from plycast.operators import index as ix
from plycast.operators import neardup as nd
from plycast.plans import standins as st
from plycast.plans.registry import query
from plycast.sources import files

TAGS = "array(concat('l', label), concat('m', vec_id % 3), concat('w', vec_id % 7))"
WANTED = "case when id % 100 = 0 then array() when id % 40 = 0 then array(tags[2]) else array(tags[0], tags[1]) end"
TAGS_SQL = "['l' || label, 'm' || vec_id % 3, 'w' || vec_id % 7]"


def _indexed(spark, sf_dir):
    c = st.read(spark, sf_dir, "embeddings").selectExpr("vec_id as id", f"{TAGS} as tags", "embedding as vector").filter("vector is not null")
    middle = ix.centres(c)
    return settle(ix.build(c, middle)), c.filter("id % 20 = 0").withColumn("tags", F.expr(WANTED)), middle


def _search(spark, sf_dir, probes):
    index, q, middle = _indexed(spark, sf_dir)
    return ix.search(index, q, middle, 5, probes)


FOUND = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, {TAGS_SQL} AS tags FROM embeddings WHERE embedding IS NOT NULL),
q AS (SELECT vec_id AS query_id, e AS qe, CASE WHEN vec_id % 100 = 0 THEN [] WHEN vec_id % 40 = 0 THEN [tags[3]] ELSE [tags[1], tags[2]] END AS wanted FROM v WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS id, list_dot_product(qe, e) / sqrt(list_dot_product(qe, qe) * list_dot_product(e, e)) AS score FROM q JOIN v ON vec_id <> query_id AND list_has_all(tags, wanted)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s QUALIFY place <= 5)"""


@query("tag_set_top_k", FOUND + " SELECT query_id, id, round(score, 6) AS score, place FROM top")
def tag_set_top_k(spark, sf_dir):
    """The nearest five that hold all tags of a query: two, one or none. All cells are searched, so this is exact."""
    return _search(spark, sf_dir, None).select("query_id", "id", F.round("score", 6).alias("score"), F.col("place").cast("long"))


@query("index_recall", FOUND + " SELECT count(DISTINCT query_id) AS n, TRUE AS passed FROM top")
def index_recall(spark, sf_dir):
    """Recall of ``PROBES`` of the cells against the exact result, as golden table; the bar is 0.9."""
    path = files.scratch(spark, "golden")
    index, q, middle = _indexed(spark, sf_dir)
    exact = ix.search(index, q, middle, 5).groupBy("query_id").agg(F.collect_list("id").alias("ids"))
    exact.write.json(path)
    return ix.recall_gate(ix.search(index, q, middle, 5, ix.PROBES), files.read_golden(spark, path), 0.9).select("n", "passed")


@query("retrieval_gate", FOUND + ", g AS (SELECT query_id, id FROM top WHERE place % 2 = 1 UNION SELECT query_id, query_id + 1 FROM q), r AS (SELECT g.query_id, count(t.id) / count(*) AS r FROM g LEFT JOIN top AS t ON t.query_id = g.query_id AND t.id = g.id GROUP BY 1) SELECT count(*) AS n, round(avg(r), 6) AS recall, avg(r) >= 0.6 AS passed FROM r")
def retrieval_gate(spark, sf_dir):
    """A golden table in a file: picks that the search finds, and one for each query that it may not find."""
    path = files.scratch(spark, "golden")
    found = settle(_search(spark, sf_dir, None))
    asked = st.read(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("id"))
    picks = found.filter("place % 2 = 1").select("query_id", "id").unionByName(asked)
    picks.groupBy("query_id").agg(F.collect_set("id").alias("ids")).write.json(path)
    return ix.recall_gate(found, files.read_golden(spark, path), 0.6).withColumn("recall", F.round("recall", 6))


@query("near_copies")
def near_copies(spark, sf_dir):
    """Each document's leader among its near copies; tested against all pairs."""
    return nd.near_copies(st.read(spark, sf_dir, "documents"), "doc_id", "text")


@query("chunk_filter", "WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS chunk FROM documents), s AS (SELECT *, regexp_matches(body, '(?i)\\b(?:[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?[+#]?|O-O(?:-O)?)(?:[^A-Za-z0-9_-]|$)') AND regexp_matches(body, '(?i)\\b(?:plan|idea|threat|weak[A-Za-z0-9_]*|attack[A-Za-z0-9_]*|defen[cs][A-Za-z0-9_]*|better|worse|because|instead|should|control[A-Za-z0-9_]*|develop[A-Za-z0-9_]*|pressure|initiative)\\b') AS kept FROM c) SELECT kept, count(*) AS n FROM s GROUP BY 1")
def chunk_filter(spark, sf_dir):
    """How many lines speak of positions, and how many do not."""
    c = st.read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("body"))
    return c.withColumn("kept", nd.speaks_of_positions(F.col("body"))).groupBy("kept").agg(F.count("*").alias("n"))


@query("appended_batches", "SELECT doc_id, 'sweep' AS run, (doc_id % 3)::INTEGER AS batch, count(*) AS n FROM labels GROUP BY ALL")
def appended_batches(spark, sf_dir):
    """Three batches of a run, the last of them twice."""
    path, rows = files.scratch(spark, "batches"), st.read(spark, sf_dir, "labels").select("doc_id")
    for k in (0, 1, 2, 2):
        files.append_once(rows.filter(F.col("doc_id") % 3 == k), path, "sweep", k)
    return files.read_appended(spark, path, "doc_id long").groupBy("doc_id", "run", "batch").agg(F.count("*").alias("n"))
