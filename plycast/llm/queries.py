"""The queries of this folder, with production parameters, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plycast.llm import decontaminate, fingerprints, gnat, html_extraction, line_dedup, merkle, packing, pii, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts
from plycast.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", "n_runs", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter(F.col("quality") == 1)
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_array_dedup(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_dedup(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gnat.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_decontamination, op3_quality_rules, op4_suffix_array_dedup, op5_html_extraction, op6_best_fit_packing,
        op7_token_counts, op8_simhash_near_dedup, op9_quality_classifier, op10_pii, op11_merkle_manifest,
        op12_vector_codes, op13_document_fingerprints,
    )
}

#: One round of the codebooks, from book{k} to book{n}.
_ROUND = """
near{k} AS MATERIALIZED (SELECT r, p, min((x2 + c2 - 2 * list_inner_product(x, c))::BIGINT * 256 + e) AS best FROM parts JOIN book{k} USING (p) GROUP BY r, p),
sums{k} AS (SELECT p, e, i, floor(sum(y) / count(*)) AS m FROM (SELECT p, best % 256 AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM near{k} JOIN parts USING (r, p)) GROUP BY p, e, i),
book{n} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c, list_inner_product(coalesce(m.c, b.c), coalesce(m.c, b.c)) AS c2
                         FROM book{k} AS b LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS c FROM sums{k} GROUP BY p, e) AS m USING (p, e)),"""
_VECTOR_CODES = (
    """
WITH whole AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q, row_number() OVER (ORDER BY vec_id) - 1 AS r
               FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT r, p, list_slice(q, p * (len(q) // 4) + 1, (p + 1) * (len(q) // 4)) AS x FROM whole, (SELECT unnest(range(4)) AS p)),
parts AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS x2 FROM cut),
book0 AS MATERIALIZED (SELECT p, r AS e, x AS c, x2 AS c2 FROM parts WHERE r < 256),"""
    + "".join(_ROUND.format(k=k, n=k + 1) for k in range(4))
    + """
ends AS (SELECT r, p, min((x2 + c2 - 2 * list_inner_product(x, c))::BIGINT * 256 + e) AS best FROM parts JOIN book4 USING (p) GROUP BY r, p),
codes AS (SELECT r, string_agg(lpad(lower(to_hex(best % 256)), 2, '0'), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM ends GROUP BY r),
digest AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS d FROM (SELECT p, e, unnest(c) AS y, unnest(range(len(c))) AS i FROM book4))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, d AS codebooks_sha256 FROM whole JOIN codes USING (r), digest
"""
)

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": """
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
     every AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split WHERE text IS NOT NULL),
     held AS (SELECT doc_id, pos, line, length(line) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
              FROM every WHERE regexp_matches(line, '[^ \\t\\x0b\\f\\r]')),
     pairs AS (SELECT b.doc_id, b.i, b.size, a.doc_id AS other, b.i - a.i AS away FROM held AS a JOIN held AS b ON a.line = b.line AND (a.doc_id, a.i) < (b.doc_id, b.i)),
     islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, away ORDER BY i) AS island FROM pairs),
     summed AS (SELECT doc_id, i, sum(size) OVER (PARTITION BY doc_id, other, away, island) AS chars FROM islands),
     gone AS (SELECT DISTINCT doc_id, i FROM summed WHERE chars >= 40),
     runs AS (SELECT doc_id, i, (lag(i) OVER (PARTITION BY doc_id ORDER BY i)) IS DISTINCT FROM i - 1 AS first FROM gone),
     counted AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE first) AS n_runs FROM runs GROUP BY 1),
     kept AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS text
              FROM every AS e LEFT JOIN held AS h ON e.doc_id = h.doc_id AND e.pos = h.pos LEFT JOIN gone AS g ON h.doc_id = g.doc_id AND h.i = g.i
              WHERE g.i IS NULL GROUP BY 1)
SELECT s.doc_id, coalesce(len(s.ls), 0)::BIGINT AS n_lines, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_runs, 0)::BIGINT AS n_runs,
       length(CASE WHEN s.text IS NOT NULL THEN coalesce(k.text, '') END)::BIGINT AS n_chars,
       md5(CASE WHEN s.text IS NOT NULL THEN coalesce(k.text, '') END) AS kept_md5
FROM split AS s LEFT JOIN counted AS c ON s.doc_id = c.doc_id LEFT JOIN kept AS k ON s.doc_id = k.doc_id
""",
    "op5_html_extraction": """
WITH body AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS a FROM pages),
     parts AS (SELECT page_id, url, list_transform(string_split(regexp_replace(a, '</?(p|h[1-6])>', chr(1), 'g'), chr(1)),
                      lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(
                          regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
                          '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g'))) AS blocks FROM body),
     joined AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM parts)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM joined
""",
    "op11_merkle_manifest": """
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text, list_prepend(4294967295::BIGINT, flatten(list_transform(range(length(doc_id::VARCHAR)), lambda i: list_transform(range(8), lambda k: ascii(substr(doc_id::VARCHAR, i::INT + 1, 1)) >> k & 1)))) AS bits,
         concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN (4294967295 - list_reduce(bits, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)))) % 5 = 0
              THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other
  FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
low(source, depth, i, digest, kids) AS (
  SELECT source, 0, i, leaf, CAST(NULL AS VARCHAR[]) FROM placed
  UNION ALL
  SELECT source, depth + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), list(digest ORDER BY i) FROM low GROUP BY source, depth, i // 16 HAVING i // 16 > 0 OR count(*) > 1),
subroots AS (SELECT source, arg_max(digest, depth) AS subroot, max(depth) AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM low WHERE i = 0 GROUP BY source),
high(depth, i, digest, kids) AS (
  SELECT 0, s, subroot, CAST(NULL AS VARCHAR[]) FROM subroots
  UNION ALL
  SELECT depth + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), list(digest ORDER BY i) FROM high GROUP BY depth, i // 16 HAVING i // 16 > 0 OR count(*) > 1),
nodes AS (SELECT source, depth, i, kids FROM low WHERE depth > 0
          UNION ALL SELECT s.source, s.depth + h.depth, h.i, h.kids FROM high AS h, subroots AS s WHERE h.depth > 0),
root AS (SELECT arg_max(digest, depth) AS root FROM high WHERE i = 0),
climb(doc_id, source, leaf, depth, tops, place, i, s, proof, folded) AS (
  SELECT p.doc_id, p.source, p.leaf, 0, r.depth, p.i, CASE WHEN r.depth = 0 THEN r.s ELSE p.i END, r.s, '', coalesce(p.other, p.leaf) FROM placed AS p JOIN subroots AS r ON p.source IS NOT DISTINCT FROM r.source
  UNION ALL
  SELECT c.doc_id, c.source, c.leaf, c.depth + 1, c.tops, c.place, CASE WHEN c.depth + 1 = c.tops THEN c.s ELSE c.i // 16 END, c.s,
         c.proof || array_to_string(list_slice(n.kids, 1, c.i % 16), '') || array_to_string(list_slice(n.kids, c.i % 16 + 2, 16), ''), sha256(array_to_string(list_slice(n.kids, 1, c.i % 16), '') || c.folded || array_to_string(list_slice(n.kids, c.i % 16 + 2, 16), ''))
  FROM climb AS c JOIN nodes AS n ON c.source IS NOT DISTINCT FROM n.source AND n.depth = c.depth + 1 AND n.i = c.i // 16),
ends AS (SELECT source, place, doc_id, leaf, arg_max(proof, depth) AS proof, arg_max(folded, depth) AS folded FROM climb GROUP BY ALL)
SELECT e.doc_id, e.leaf, s.subroot, root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = root AS verified
FROM ends AS e JOIN subroots AS s ON e.source IS NOT DISTINCT FROM s.source, root
""",
    "op12_vector_codes": _VECTOR_CODES,
}
