"""Small graphs with answers worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph, search, summary

NODES = "id long, repository_id long, node_type string, name string, file_path string, metadata_json string"
EDGES = "id long, repository_id long, source_node_id long, target_node_id long, edge_type string, metadata_json string"


@pytest.fixture(scope="module")
def g(spark):
    nodes = [
        (1, 1, "directory", "src", "src", None), (2, 1, "file", "src/a.py", "src/a.py", None), (3, 1, "file", "src/b.py", "src/b.py", None), (4, 1, "class", "Alpha", "src/a.py", None),
        (5, 1, "method", "run", "src/a.py", None), (6, 1, "function", "run_all", "src/b.py", None), (7, 1, "function", "loop", "src/c.py", None),
    ]
    edges = [(1, 2, "CONTAINS"), (1, 3, "CONTAINS"), (2, 4, "DEFINES"), (4, 5, "DEFINES"), (3, 6, "DEFINES"), (3, 2, "IMPORTS"), (6, 5, "CALLS"), (6, 5, "CALLS"), (5, 6, "CALLS"), (7, 7, "CALLS")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame([(i, 1, s, t, k, None) for i, (s, t, k) in enumerate(edges)], EDGES)


def start(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_neighbours(spark, g, collect):
    _, edges = g
    assert collect(graph.neighbours(edges, start(spark, 4), 1)) == [(2, 1), (4, 0), (5, 1)]
    assert collect(graph.neighbours(edges, start(spark, 4), 2)) == [(1, 2), (2, 1), (3, 2), (4, 0), (5, 1), (6, 2)]
    assert collect(graph.neighbours(edges, start(spark, 99), 3)) == [(99, 0)]


def test_depth_is_minimal(spark, collect):
    edges = spark.createDataFrame([(i, 1, s, t, "CALLS", None) for i, (s, t) in enumerate([(0, 1), (0, 2), (1, 2), (2, 3)])], EDGES)
    assert collect(graph.neighbours(edges, start(spark, 0), 2)) == [(0, 0), (1, 1), (2, 1), (3, 2)]


def test_impact(spark, g, collect):
    _, edges = g
    assert collect(graph.impact(edges, start(spark, 5))) == [(1, 4, "DEFINES"), (1, 6, "CALLS"), (2, 2, "DEFINES"), (2, 3, "DEFINES"), (2, 5, "CALLS"), (3, 1, "CONTAINS")]
    assert collect(graph.impact(edges, start(spark, 2))) == [(1, 1, "CONTAINS"), (1, 3, "IMPORTS")]
    assert collect(graph.impact(edges, start(spark, 7))) == [(1, 7, "CALLS")]
    assert graph.impact(edges, start(spark, 1)).count() == 0


def test_path(spark, g, collect):
    _, edges = g
    assert collect(graph.shortest_path(edges, 4, 6)) == [(0, 4), (1, 5), (2, 6)]
    assert collect(graph.shortest_path(edges, 4, 4)) == [(0, 4)]
    assert graph.shortest_path(edges, 1, 7).count() == 0 and graph.shortest_path(edges, 1, 6, max_depth=1).count() == 0


def test_degrees_and_hubs(g, collect):
    nodes, edges = g
    assert collect(graph.degree(nodes, edges)) == [(1, 2), (2, 3), (3, 3), (4, 2), (5, 4), (6, 4), (7, 1)]
    assert collect(search.in_degree(edges)) == [(2, 2), (3, 1), (4, 1), (5, 3), (6, 2), (7, 1)]
    assert [r["id"] for r in graph.hub_nodes(nodes, edges, 1, limit=6).collect()] == [5, 6, 2, 3, 1, 4]
    assert [r["id"] for r in graph.hub_nodes(nodes, edges, 1, limit=3).collect()] == [5, 6, 2]
    assert collect(graph.expand_node(edges, 6)) == [(3,), (5,), (6,)]
    ids = nodes.where("id IN (5, 6)").select("id")
    assert graph.induced_edges(edges, ids).count() == 3


def test_search(g):
    nodes, edges = g
    found = [(r["name"], round(r["score"], 4)) for r in search.search_nodes(nodes, edges, "run").collect()]
    assert found == [("run", 0.9507), ("run_all", 0.8092)]
    assert [r["name"] for r in search.search_nodes(nodes, edges, "").collect()][:2]
    assert search.resolve_target(nodes, "5").first()["name"] == "run" and search.resolve_target(nodes, "src/a.py").first()["id"] == 2
    assert search.resolve_target(nodes, "99").first() is None and search.resolve_target(nodes, "b.p").first()["id"] == 3


def test_like_treats_a_backslash_as_itself(spark):
    rows = [(1, 1, "class", "a\\b", None, None), (2, 1, "class", "a%b", None, None), (3, 1, "class", "axb", None, None), (4, 1, "class", None, None, None)]
    nodes, none = spark.createDataFrame(rows, NODES), spark.createDataFrame([], EDGES)
    names = lambda q: {r["name"] for r in search.search_nodes(nodes, none, q).collect()}
    assert names("a\\b") == {"a\\b"} and names("a%b") == {"a\\b", "a%b", "axb"} and names("a_b") == {"a\\b", "a%b", "axb"}


def test_summaries(g, collect):
    nodes, edges = g
    assert collect(summary.type_counts(edges, "edge_type")) == [(1, "CALLS", 4), (1, "CONTAINS", 2), (1, "DEFINES", 3), (1, "IMPORTS", 1)]
    assert [(r["file_path"], r["entities"]) for r in summary.top_files(nodes).orderBy("rank").collect()] == [("src/a.py", 2), ("src/b.py", 1), ("src/c.py", 1)]
    assert [(r["name"], r["methods"]) for r in summary.top_classes(nodes, edges).collect()] == [("Alpha", 1)]
    assert collect(graph.directory_buckets(nodes)) == [("/", 1), ("src", 6)]
    assert {r["node_type"]: r["names"] for r in summary.file_entities(nodes, edges, "a.py").collect()} == {"class": "Alpha"}
    sections = summary.file_sections(nodes, edges).where("file_path = 'src/a.py'")
    assert collect(sections.where("section <> 'calls'")) == [(1, "src/a.py", "entities", 4), (1, "src/a.py", "imported by", 3)]
    assert sections.where("section = 'calls'").count() == 3


def test_empty_graph(spark):
    nodes, edges = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    assert search.search_nodes(nodes, edges, "x").count() == graph.degree(nodes, edges).count() == graph.hub_nodes(nodes, edges, 1).count() == 0
    assert graph.neighbours(edges, start(spark, 1), 2).count() == 1 and graph.impact(edges, start(spark, 1)).count() == 0


def test_pages_and_json(spark):
    nodes = spark.createDataFrame([(i, i % 2, "class" if i < 6 else "file", f"n{i}", f"d/f{i}", None) for i in range(12)], "id long, repository_id long, node_type string, name string, file_path string, metadata_json string")
    edges = spark.createDataFrame([(k, (k % 5) % 2, a, b, "CALLS", None) for k, (a, b) in enumerate([(0, 2), (1, 3), (2, 4), (3, 5), (0, 4), (0, 2)])], "id long, repository_id long, source_node_id long, target_node_id long, edge_type string, metadata_json string")
    shown, links = graph.graph_page(nodes, edges.withColumn("repository_id", F.col("source_node_id") % 2), 0, page=1, limit=3, node_type="class")
    assert {r["id"] for r in shown.collect()} <= {0, 2, 4} and links.count() == 3
    out = {r["repository_id"]: json.loads(r["graph_json"]) for r in graph.graph_json(nodes, edges.withColumn("repository_id", F.col("source_node_id") % 2)).collect()}
    assert set(out) == {0, 1} and out[0]["total_nodes"] == 6 and out[0]["total_edges"] == 4 and len(out[0]["nodes"]) == 6 and len(out[1]["edges"]) == 2
    assert out[0]["node_types"] == [{"node_type": "class", "n": 3}, {"node_type": "file", "n": 3}] and out[0]["directories"] == [{"directory": "d", "n": 6}]
