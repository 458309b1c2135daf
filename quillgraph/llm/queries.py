"""Named queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import docpairs, handwritten, leakage, lookalike, names, packing, similar, together
from quillgraph.tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# 1. items that appear together


@_query
def p1_pairs(spark: SparkSession, root: str) -> DataFrame:
    return together.files_together(load(spark, root, "commits"), load(spark, root, "commit_files"), min_count=1, min_ratio=0.0)


@_query
def p1_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = together.files_together(load(spark, root, "commits"), load(spark, root, "commit_files"), min_count=5, min_ratio=3.0)
    return pairs.select("repository_id", "file_path_a", "file_path_b")


SQL["p1_found"] = r"""
WITH touched AS (
  SELECT DISTINCT c.repository_id, c.hash,
    regexp_replace(regexp_replace(replace(f.file_path, '\', '/'), '/+', '/', 'g'), '^(\./)+', '') AS path
  FROM commit_files f JOIN commits c ON c.id = f.commit_id
  WHERE f.file_path IS NOT NULL AND c.repository_id IS NOT NULL AND c.hash IS NOT NULL),
total AS (SELECT repository_id, count(DISTINCT hash) AS n FROM touched GROUP BY 1),
single AS (SELECT repository_id, path, count(*) AS k FROM touched GROUP BY 1, 2),
pair AS (
  SELECT a.repository_id, a.path AS pa, b.path AS pb, count(*) AS k
  FROM touched a JOIN touched b ON a.repository_id = b.repository_id AND a.hash = b.hash AND a.path < b.path
  GROUP BY 1, 2, 3 HAVING count(*) >= 5)
SELECT p.repository_id, p.pa AS file_path_a, p.pb AS file_path_b
FROM pair p JOIN total t USING (repository_id)
JOIN single a ON a.repository_id = p.repository_id AND a.path = p.pa
JOIN single b ON b.repository_id = p.repository_id AND b.path = p.pb
WHERE p.k * t.n >= 3 * a.k * b.k
"""


# 2. most similar vectors


@_query
def p2_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return similar.nearest_vectors(load(spark, root, "node_vectors")).withColumn("similarity", F.round("similarity", 6))


@_query
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return similar.similar_pairs(load(spark, root, "node_vectors"))


SQL["p2_found"] = """
WITH v AS (
  SELECT DISTINCT node_id, model, vector::DOUBLE[] AS vector FROM node_vectors
  WHERE vector IS NOT NULL AND list_inner_product(vector::DOUBLE[], vector::DOUBLE[]) > 0),
s AS (
  SELECT a.node_id AS a, b.node_id AS b, a.model, list_cosine_similarity(a.vector, b.vector) AS sim
  FROM v a JOIN v b ON a.model = b.model AND len(a.vector) = len(b.vector) AND a.node_id <> b.node_id),
r AS (SELECT a, b, sim, row_number() OVER (PARTITION BY model, a ORDER BY sim DESC, b) AS rk FROM s)
SELECT DISTINCT least(a, b) AS node_id_a, greatest(a, b) AS node_id_b FROM r WHERE rk <= 10 AND sim >= 0.9
"""


# 3. files nobody wrote by hand


@_query
def p3_files(spark: SparkSession, root: str) -> DataFrame:
    return handwritten.judge_files(load(spark, root, "nodes"), load(spark, root, "repositories"), load(spark, root, "source_heads"))


@_query
def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return p3_files(spark, root).where(F.col("reason").isNotNull()).select("node_id")


# 4. functions and their documentation


@_query
def p4_pairs(spark: SparkSession, root: str) -> DataFrame:
    return docpairs.documented_nodes(load(spark, root, "nodes"))


@_query
def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_pairs(spark, root).select("node_id").distinct()


@_query
def p4_sources(spark: SparkSession, root: str) -> DataFrame:
    return docpairs.documented_sources(load(spark, root, "documents").where(F.col("doc_kind") == "source"))


# 5. variant spellings of names


@_query
def p5_entities(spark: SparkSession, root: str) -> DataFrame:
    return names.name_entities(load(spark, root, "commits"))


@_query
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return names.same_entity_pairs(load(spark, root, "commits"))


# 7. contexts of fixed size


@_query
def p7_contexts(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(load(spark, root, "documents"))


# 8. leaked test items


@_query
def p8_leaks(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaked_items(load(spark, root, "documents"), load(spark, root, "eval_items"))


@_query
def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_leaks(spark, root).select("doc_id", "item_id")


# 9. one form for texts that look the same


@_query
def p9_texts(spark: SparkSession, root: str) -> DataFrame:
    return lookalike.consistent_texts(load(spark, root, "documents"))


@_query
def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return lookalike.lookalike_pairs(load(spark, root, "documents"))


@_query
def p9_classes(spark: SparkSession, root: str) -> DataFrame:
    return lookalike.lookalike_classes(load(spark, root, "documents"))
