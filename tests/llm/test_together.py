import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from quillgraph.llm import queries, together
from quillgraph.llm.together import files_together, fit_null, pair_counts, tail

COMMITS = "id long, repository_id long, hash string, author string, item string, n long"
FILES = "commit_id long, file_path string, change_type string, `group` string, basket long"


def brute(baskets, min_count, min_ratio):
    single, pair, total = defaultdict(int), defaultdict(int), defaultdict(int)
    for (g, _), items in baskets.items():
        total[g] += 1
        for a in items:
            single[g, a] += 1
        for a, b in combinations(sorted(items), 2):
            pair[g, a, b] += 1
    return {(g, a, b): n for (g, a, b), n in pair.items() if n >= min_count and n * total[g] >= min_ratio * single[g, a] * single[g, b]}


def test_counts_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    baskets = {}
    for g in (1, 2):
        for c in range(120):
            k = rng.choice([1, 2, 3, 5, 30, 60]) if g == 1 else rng.choice([1, 2, 3])
            baskets[g, c] = set(rng.sample(range(80), k)) | ({5, 6} if c % 9 == 0 else set())
    rows = [(g, c, i) for (g, c), items in baskets.items() for i in items]
    table = spark.createDataFrame(rows, "`group` long, basket long, item long")
    want = brute(baskets, 4, 1.2)
    assert len(want) > 20
    # With rows only, with blocks only, and with both.
    for narrow, block in ((100, 2048), (1, 16), (4, 30)):
        monkeypatch.setattr(together, "NARROW", narrow)
        monkeypatch.setattr(together, "BLOCK_ITEMS", block)
        got = {(r["group"], *sorted((r["a"], r["b"]))): r["n_ab"] for r in pair_counts(table, 4, 1.2).collect()}
        assert got == want


def test_wide_baskets_of_a_hot_group_are_split(spark, monkeypatch):
    rng = random.Random(7)
    baskets = {(1, c): set(rng.sample(range(40), 12)) for c in range(200)}
    rows = [(g, c, i) for (g, c), items in baskets.items() for i in items]
    monkeypatch.setattr(together, "NARROW", 4)
    monkeypatch.setattr(together, "SLICE_ITEMS", 600, raising=False)
    wide = spark.createDataFrame([(g, c, 200, i, 60, 0) for g, c, i in rows], "`group` long, basket long, n long, item long, n_item long, block int")
    loads = together._tiles(wide).groupBy("group", "block_a", "block_b", "slice").agg({"n": "count"}).collect()
    assert sum(r["count(n)"] for r in loads) == 200 and len(loads) == 8 and max(r["count(n)"] for r in loads) * 24 < 2 * 600
    # The parts of a pair's count pass together only.
    want = brute(baskets, 20, 1.0)
    assert want
    table = spark.createDataFrame(rows, "`group` long, basket long, item long")
    got = {(r["group"], *sorted((r["a"], r["b"]))): r["n_ab"] for r in pair_counts(table, 20, 1.0).collect()}
    assert got == want


def test_null_model_keeps_degrees():
    items, baskets = {1: 30, 3: 10, 9: 2}, {2: 24, 5: 6}
    x, y = fit_null(items, baskets)
    for d, v in x.items():
        assert sum(n * v * y[s] / (1 + v * y[s]) for s, n in baskets.items()) == pytest.approx(d, rel=1e-3)
    for s, v in y.items():
        assert sum(n * v * x[d] / (1 + v * x[d]) for d, n in items.items()) == pytest.approx(s, rel=1e-3)


def test_tail_is_poisson_binomial():
    p, times = np.array([0.1, 0.4, 0.03]), np.array([5, 3, 10])
    each = np.repeat(p, times)
    dist = np.array([1.0])
    for q in each:
        dist = np.convolve(dist, [1 - q, q])
    for least in (0, 1, 2, 5, 9):
        assert tail(p, times, least) == pytest.approx(dist[least:].sum(), rel=1e-9)
    assert 0 < tail(np.array([1e-4]), np.array([1000]), 20) < 1e-35


def test_tail_of_a_large_count_near_its_mean():
    # P(X >= mean + 1) of a binomial of mean 10000 is near a half; the next 64 counts hold a third of it.
    assert tail(np.array([0.5]), np.array([20000]), 10000) == pytest.approx(0.5028, abs=2e-3)


def test_pairs_are_all_that_meet(spark, tmp_path):
    """p1_pairs has rare and unsurprising pairs too; p1_found keeps the thresholds."""
    rng = random.Random(3)
    touched = {c: set(rng.sample(range(12), rng.choice([1, 2, 4]))) for c in range(60)} | {c: {20, 21} for c in range(60, 64)} | {c: {30, 31} for c in range(64, 70)}
    spark.createDataFrame([(c, 1, f"h{c}") for c in touched], "id long, repository_id long, hash string").write.parquet(f"{tmp_path}/commits.parquet")
    spark.createDataFrame([(c, f"f{i:02}", "M") for c, s in touched.items() for i in s], "commit_id long, file_path string, change_type string").write.parquet(f"{tmp_path}/commit_files.parquet")
    want = {(f"f{a:02}", f"f{b:02}"): n for (_, a, b), n in brute({(1, c): s for c, s in touched.items()}, 1, 0).items()}
    pairs = {(r["file_path_a"], r["file_path_b"]): r for r in queries.p1_pairs(spark, str(tmp_path)).collect()}
    assert {k: r["n_ab"] for k, r in pairs.items()} == want and all(r["p_value"] <= r["q_value"] for r in pairs.values())
    assert pairs["f20", "f21"]["n_ab"] == 4 and pairs["f20", "f21"]["q_value"] < 0.05 and min(r["ratio"] for r in pairs.values()) < 3
    found = {(r["file_path_a"], r["file_path_b"]) for r in queries.p1_found(spark, str(tmp_path)).collect()}
    assert ("f30", "f31") in found and found == {k for k, r in pairs.items() if r["n_ab"] >= 5 and r["ratio"] >= 3}


def test_files(spark, collect):
    commits = [(i, 1, f"h{i % 20}", "x", "i", 3) for i in range(40)] + [(100, None, "z", None, None, None), (101, 1, None, None, None, None)]
    commits += [(200 + i, 1, f"q{i}", "x", "i", 1) for i in range(40)]
    files = [(i, p, "M", "g", 1) for i in range(40) for p in (["./a.py", "b//c.py", "b\\c.py"] if i % 20 < 6 else ["d.py"])]
    files += [(i, None, "M", "g", 1) for i in range(5)] + [(100, "a.py", None, "g", 1), (999, "a.py", "A", "g", 1), (0, "a.py", "A", "g", 1)]
    files += [(200 + i, "e.py", "M", "g", 1) for i in range(40)]
    out = files_together(spark.createDataFrame(commits, COMMITS), spark.createDataFrame(files, FILES)).collect()
    assert [(r["file_path_a"], r["file_path_b"], r["n_a"], r["n_b"], r["n_ab"], r["n"]) for r in out] == [("a.py", "b/c.py", 6, 6, 6, 60)]
    assert out[0]["ratio"] == pytest.approx(10.0) and 0 < out[0]["p_value"] < 1e-3 and out[0]["q_value"] >= out[0]["p_value"]
    empty = files_together(spark.createDataFrame([], COMMITS), spark.createDataFrame([], FILES))
    assert empty.count() == 0
