import threading
from pathlib import Path

import numpy as np

from quillgraph.llm.similar import PointTree, ShardTree, fit_shards, nearest_vectors, pack, similar_pairs, unpack

SCHEMA = "node_id long, model string, vector array<float>, class string, shard int, unit double"


def clustered(n=600, d=12, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, d))
    x = centres[rng.integers(0, 20, n)] + 0.25 * rng.normal(size=(n, d))
    return x.astype(np.float32)


def test_factor_one_is_exact():
    x = clustered()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    found, _ = PointTree(x, ids, leaf_rows=16).search(x, ids, 5, 1.0)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found, want)]) > 0.999
    tree = fit_shards(x, 8)
    homes = tree.home(x)
    assert len(set(homes)) == 8 and (tree.bounds(x)[ids, homes] <= 1e-6).all()
    assert ShardTree(np.zeros((0, 0), np.float32), np.zeros(0, np.float32), [], [], 1).home(x).max() == 0


def test_recall_against_brute_force(spark):
    x = clustered(900)
    rows = [(i, "m", v.tolist(), "c", 1, 0.5) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, SCHEMA)
    exact = {}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    exact = {i: set(np.argsort(-s[i])[:10]) for i in range(len(x))}
    for relax, least in ((1.0, 0.999), (6.0, 0.9)):
        got = {}
        for r in nearest_vectors(table, 10, relax, shard_rows=150).collect():
            got.setdefault(r["node_id"], set()).add(r["neighbour_id"])
        assert all(len(v) == 10 for v in got.values()) and len(got) == len(x)
        assert np.mean([len(got[i] & exact[i]) / 10 for i in exact]) >= least


def test_pairs_above_a_similarity(spark, collect):
    x = clustered(700, 16, 5)
    x[600:] = x[:100] + 0.05 * np.random.default_rng(1).normal(size=(100, 16)).astype(np.float32)
    table = spark.createDataFrame([(i, "m", v.tolist(), "c", 1, 0.5) for i, v in enumerate(x)], SCHEMA)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    near = np.argsort(-s, axis=1)[:, :10]
    want = {(min(i, j), max(i, j)) for i in range(len(x)) for j in near[i].tolist() if s[i, j] >= 0.98}
    assert len(want) > 100
    assert set(collect(similar_pairs(table, 0.98, relax=1.0, shard_rows=64))) == want
    assert len(set(collect(similar_pairs(table, 0.98, shard_rows=64))) & want) >= 0.97 * len(want)


def test_edge_cases(spark, collect):
    one, two = [1.0, 0.0], [0.0, 2.0]
    data = [(i, "m", [3.0, 0.0] if i % 2 else one, "c", 0, 0.0) for i in range(30)]  # one direction, differing norms
    data += [(100, "m", two, "c", 0, 0.0), (100, "m", two, "c", 0, 0.0), (101, "m", None, "c", 0, 0.0), (102, "m", [0.0, 0.0], "c", 0, 0.0)]
    data += [(103, "m", [None, 1.0], "c", 0, 0.0), (None, "m", one, "c", 0, 0.0), (104, None, one, "c", 0, 0.0), (105, "m", [1.0, 0.0, 0.0], "c", 0, 0.0), (106, "n", one, "c", 0, 0.0)]
    table = spark.createDataFrame(data, SCHEMA)
    near = nearest_vectors(table, 3).toPandas()
    assert set(near["node_id"]) == {*range(30), 100}
    assert near[near["node_id"] == 7].sort_values("rank")["neighbour_id"].tolist() == [0, 1, 2]
    assert near[near["node_id"] == 1].sort_values("rank")["neighbour_id"].tolist() == [0, 2, 3]
    assert near[near["node_id"] == 100]["similarity"].max() == 0.0
    pairs = collect(similar_pairs(table, k=3))
    assert all(a < b for a, b in pairs) and len(pairs) == len(set(pairs)) and (0, 29) in pairs and (28, 29) not in pairs
    assert nearest_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_disk_grows_as_the_vectors_not_as_the_visits(spark):
    x = np.random.default_rng(3).normal(size=(3000, 32)).astype(np.float32)
    table = spark.createDataFrame([(i, "m", v.tolist(), "c", 1, 0.5) for i, v in enumerate(x)], SCHEMA)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before, most, over = size(), 0, threading.Event()

    def watch():
        nonlocal most
        while not over.wait(0.05):
            try:
                most = max(most, size() - before)
            except OSError:
                pass

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        # Every vector looks into each of about fifty shards.
        near = nearest_vectors(table, 10, 1.0, shard_rows=60)
    finally:
        over.set()
        watcher.join()
    most = max(most, size() - before)
    assert x.nbytes < most < 6 * x.nbytes
    assert not list(folder.glob("shards-*"))
    assert near.count() == 30_000


def test_packing_loses_nothing():
    x = np.random.default_rng(4).normal(size=(500, 24)).astype(np.float32)
    steps = np.round(x * 32) / 32
    for v in (x, steps, x * 1e30, x * 1e-40, np.zeros((3, 0), np.float32)):
        back = unpack(pack(v))
        assert back.dtype == v.dtype and np.array_equal(back, v)
    assert len(pack(steps)) < 0.4 * steps.nbytes
