"""Resolving a target and ranked search over nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import contains_like, path_depth

# Weights of node types in the score; other types weigh 0.5.
TYPE_WEIGHTS = {
    "api_endpoint": 1.2, "controller": 1.1, "service": 1.0, "class": 1.0, "interface": 1.0, "function": 0.9, "method": 0.9,
    "middleware": 1.0, "repository_layer": 1.0, "file": 0.7, "directory": 0.6, "job": 0.9, "worker": 0.9, "queue": 0.9,
}


def in_degree(edges: DataFrame) -> DataFrame:
    """(id, refs): incoming edges of every node that has any; duplicate edges count each."""
    return edges.where(F.col("target_node_id").isNotNull()).groupBy(F.col("target_node_id").alias("id")).agg(F.count("*").alias("refs"))


def name_score(name: Column, query: str) -> Column:
    lower, q = F.lower(name), query.lower()
    words = q.split()
    hits = sum((F.when(lower.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    several = F.when(hits > 0, F.lit(0.3) + F.lit(0.1) * hits) if len(words) > 1 else F.lit(None).cast("double")
    return F.when(lower == q, 1.0).when(lower.startswith(q), 0.8).when(lower.contains(q), 0.5).otherwise(F.coalesce(several, F.lit(0.1)))


def type_score(node_type: Column) -> Column:
    weights = F.create_map(*(F.lit(x) for kv in TYPE_WEIGHTS.items() for x in kv))
    return F.coalesce(F.try_element_at(weights, node_type), F.lit(0.5))


def search_nodes(
    nodes: DataFrame,
    edges: DataFrame,
    query: str,
    repository_id: int | None = None,
    node_type: str | None = None,
    limit: int | None = 20,
    rerank_all: bool = False,
) -> DataFrame:
    """(id, node_type, name, file_path, score), best first.

    The first ``limit`` matches by (exact, prefix, other), name and id are
    taken and ranked by score; with ``rerank_all`` every match is ranked before
    the limit, and with ``limit`` None all come out.  The in-degree that enters
    the score is taken within the repository where one is given.
    """
    found = nodes.where(contains_like("name", query))
    if repository_id is not None:
        found = found.where(F.col("repository_id") == repository_id)
        edges = edges.where(F.col("repository_id") == repository_id)
    if node_type is not None:
        found = found.where(F.col("node_type") == node_type)
    lower = F.lower("name")
    bucket = F.when(lower == query.lower(), 0).when(lower.startswith(query.lower()), 1).otherwise(2)
    found = found.select("id", "node_type", "name", "file_path", bucket.alias("_bucket"))
    if limit is not None and not rerank_all:
        found = found.orderBy("_bucket", "name", "id").limit(limit)
    refs = in_degree(edges)
    most = refs.agg(F.max("refs").alias("_most"))
    share = F.when(F.coalesce("_most", F.lit(0)) > 0, F.log2(F.coalesce("refs", F.lit(0)) + F.lit(1)) / F.greatest(F.log2(F.col("_most") + F.lit(1)), F.lit(1.0))).otherwise(0.0)
    score = (
        name_score(F.col("name"), query) * 0.5
        + type_score(F.col("node_type")) * 0.2
        + share * 0.2
        + F.lit(0.1) / F.sqrt(path_depth("file_path").cast("double"))
    )
    ranked = found.join(refs, "id", "left").crossJoin(F.broadcast(most)).withColumn("score", F.round(score, 4))
    ranked = ranked.select("id", "node_type", "name", "file_path", "score").orderBy(F.desc("score"), "name", "id")
    return ranked if limit is None else ranked.limit(limit)


def search_by_type(nodes: DataFrame, node_type: str, repository_id: int | None = None, limit: int = 50) -> DataFrame:
    """Nodes of a type by name."""
    found = nodes.where(F.col("node_type") == node_type)
    if repository_id is not None:
        found = found.where(F.col("repository_id") == repository_id)
    return found.select("id", "node_type", "name", "file_path").orderBy("name", "id").limit(limit)


def resolve_target(nodes: DataFrame, target: str, repository_id: int | None = None) -> DataFrame:
    """At most one node: by id if the target is digits, else equal name or path, else containing it; files first."""
    rules = [(F.col("name") == target) | (F.col("file_path") == target), contains_like("name", target) | contains_like("file_path", target)]
    scope = F.lit(True) if repository_id is None else F.col("repository_id") == repository_id
    priority = F.when(rules[0] & scope, 1).when(rules[1] & scope, 2)
    if target.isdigit():
        priority = F.when(F.col("id") == int(target), 0).otherwise(priority)
    found = nodes.withColumn("_p", priority).where(F.col("_p").isNotNull())
    order = [F.col("_p"), F.coalesce(F.col("node_type") == "file", F.lit(False)).desc(), F.col("id")]
    return found.orderBy(*order).limit(1).select("id", "repository_id", "node_type", "name", "file_path")
