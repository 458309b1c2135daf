from collections import Counter, defaultdict

import pytest

from quillgraph.operators.skew import edge_ends, heavy_ends, neighbour_kinds, node_edge_types, node_ends, pack, plan_load

EDGES = "id long, repository_id long, source_node_id long, target_node_id long, edge_type string, task int, unit long"
NODES = "id long, name string, task int, base long"


def edges():
    rows = [(i, 1, i % 50, 7, "CALLS", 0, 0) for i in range(400)]  # one target holds most rows
    rows += [(1000 + i, 1, 3, i % 40, "IMPORTS", 0, 0) for i in range(200)] + [(2000 + i, 1, 3, 7, "CALLS", 0, 0) for i in range(300)]  # and one edge is repeated
    rows += [(3000, 1, 9, 9, "CALLS", 0, 0), (3001, None, None, 5, None, None, None), (3002, 1, 5, None, "CALLS", 0, 0), (3003, 1, None, None, "CALLS", 0, 0)]
    return rows


def brute(rows):
    n, near, kinds = Counter(), defaultdict(set), Counter()
    for _, _, s, t, kind, *_ in rows:
        for role, a, b in (("source", s, t), ("target", t, s)):
            if a is not None:
                n[role, a] += 1
                kinds[role, a, kind] += 1
                if b is not None:
                    near[role, a].add(b)
    return n, near, kinds


def test_against_brute_force(spark):
    table = spark.createDataFrame(edges(), EDGES)
    n, near, kinds = brute(edges())
    assert {(r[0], r[1]): (r[2], r[3]) for r in node_ends(table).collect()} == {k: (n[k], len(near[k])) for k in n}
    assert {(r[0], r[1], r[2]): r[3] for r in node_edge_types(table).collect()} == dict(kinds)
    total = len(edges())
    assert {tuple(r) for r in heavy_ends(table, 0.1).collect()} == {k for k in n if n[k] >= 0.1 * total}


def test_replicated_side(spark):
    nodes = spark.createDataFrame([(i, f"n{i}", 1, 1) for i in range(60)] + [(7, "a7", 1, 1), (None, "x", 1, 1), (3, None, 1, 1)], NODES)
    table = spark.createDataFrame(edges(), EDGES)
    _, _, kinds = brute(edges())
    out = neighbour_kinds(table, nodes).collect()
    assert {(r["end_role"], r["node_id"], r["edge_type"]): r["edges"] for r in out} == dict(kinds)
    assert {r["name"] for r in out if r["node_id"] == 7} == {"a7"} and len(out) == len(kinds)


def test_empty(spark):
    none = spark.createDataFrame([], EDGES)
    assert node_ends(none).count() == node_edge_types(none).count() == heavy_ends(none).count() == 0
    assert neighbour_kinds(none, spark.createDataFrame([], NODES)).count() == 0


def test_tasks_are_even(spark):
    from pyspark.sql import functions as F

    rows = [(i, 1, i, 7, "CALLS", 0, 0) for i in range(8000)]
    ends = edge_ends(spark.createDataFrame(rows, EDGES))
    plan = plan_load(ends.groupBy("end_role", "node_id").agg(F.count("*").alias("n")), ["end_role", "node_id"], 8)
    sizes = [r["count"] for r in plan.assign(ends, "neighbour_id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.2 * sum(sizes) / 8


@pytest.mark.parametrize("tasks", [1, 3, 10])
def test_pack(tasks):
    loads = [(i, (i * 37) % 101) for i in range(200)]
    at = pack(loads, tasks)
    sums = Counter()
    for unit, load in loads:
        sums[at[unit]] += load
    assert set(at) == {u for u, _ in loads} and max(sums.values()) <= sum(x for _, x in loads) / tasks + 101
