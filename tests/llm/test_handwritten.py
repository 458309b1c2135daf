import random

import pytest

from quillgraph.llm.handwritten import best_threshold, judge_files, nested_copies, path_evidence, split_notice

NODES = "id long, repository_id long, node_type string, name string, file_path string, key long"
REPOS = "id long, path string, name string, nested boolean"
HEADS = "repository_id long, file_path string, n_bytes long, n_lines long, longest_line long, head string, key string, label double"


@pytest.mark.parametrize(
    ("head", "noticed"),
    [
        ("// Code generated by x. DO NOT EDIT.\nfunc f() {}", True), ("/* @generated from x.schema */\nint a;", True), ("// <auto-generated> x 1.2 </auto-generated>", True),
        ("# Fichier produit par x, ne pas modifier\n", True), ("// Diese Datei wurde von x automatisch erzeugt.", True), ("// Output of x --emit y", True), ("// machine-written by x, see y.tmpl", True),
        ("// This file is part of x 1.2.3, copied unchanged from upstream.", True), ("// x v2.1.0 | MIT-style licence | (c) the x authors", True), ("# Imported from x@1.2.3; upstream tests removed", True),
        ("# AUTOGENERATED - run `make x` instead of changing this\n", True), ("// DON'T TOUCH: regenerated nightly from x.idl\n", True), ("// Generates x tables for the y; extend freely.\n", False),
        ("// Wraps the generated locale clients.\n", False), ("// Do not edit the exporter settings while the turbine runs.", False), ("/* Automatically created heartbeats expire. */", False),
        ("// Minified output is checked here.", False), ("// Vendored walker copies are listed by this cell", False), ("f = 1  # Code generated by x", False),
    ],
)
def test_notices(head, noticed):
    assert split_notice(head)[0] is noticed


def test_notice_is_hidden_from_features():
    assert "generated" not in split_notice("/*\n * Code generated by x.\n * DO NOT EDIT.\n */\nint a;\n")[1]


def test_paths(spark, collect):
    paths = {
        "a/generated/b.py": "generated", "a/generator/b.py": None, "a/gen_eral/b.c": None, "x_pb2.py": "generated", "zz_a_deepcopy.go": "generated", "src/vendors/a.py": None,
        "a/Vendor/lib/b.js": "vendored", "a/node_modules/x/i.js": "vendored", "a\\third_party\\b.c": "vendored", "a/x.min.js": "packed", "a/x.0b69bc7d.js": "packed", "a/orchard_min_max.py": None,
        "a/minimizer.js": None, "a/x_lut.c": "data", "generated": None, None: None,
    }
    table = spark.createDataFrame([(p,) for p in paths], "file_path string").withColumn("e", path_evidence(__import__("pyspark.sql.functions", fromlist=["col"]).col("file_path")))
    assert {r[0]: r[1] for r in table.collect()} == paths


def test_nested(spark, collect):
    repos = [(1, "/srv/a", "a", None), (2, "/srv/a/vendor/b", "b", None), (3, "/srv/a/build-tools/c", "c", None), (4, "/srv/ab/vendor/d", "d", None), (5, None, "e", None), (6, "C:\\w\\a", "f", None), (7, "C:\\w\\a\\extern\\g", "g", None)]
    assert collect(nested_copies(spark.createDataFrame(repos, REPOS))) == [(2,), (7,)]


def sources(n, seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["cache", "index", "buffer", "parcel", "ledger"]) + rng.choice(["Join", "Drop", "Load"])
    code = lambda: "\n".join(f"function {word()}({word()}) {{\n    {word()}();\n}}" for _ in range(6))
    packed = lambda: "!function(e,t,n){" + "".join(f"var {rng.choice('abcdef')}=n[{rng.randint(0, 99)}],x=function(e){{return e?{rng.randint(0, 9)}:{word()[:2]}}};" for _ in range(12)) + "}"
    data = lambda: "DATA = (" + ",".join(hex(rng.randint(0, 255)) for _ in range(120)) + ")"
    return code, packed, data


def test_content_is_found_without_a_name(spark):
    code, packed, data = sources(1)
    rows, nodes = [], []

    def add(path, head, lines, longest):
        nodes.append((len(nodes) + 1, 1, "file", path, path, 0))
        rows.append((1, path, len(head) if head else None, lines, longest, head, "k", 9.0))

    for i in range(60):
        add(f"src/f{i}.js", code(), 18, 40)
    for i in range(8):
        add(f"src/p{i}.min.js", packed(), 1, 4000)
        add(f"src/d{i}_lut.py", data(), 1, 900)
    add("src/hidden.js", packed(), 1, 5000)
    add("src/table.py", data(), 1, 900)
    add("src/noted.js", "// Code generated by x. DO NOT EDIT.\n" + code(), 19, 40)
    add("src/none.min.js", None, None, None)
    add("src/plain.js", None, None, None)
    add("src/empty.js", "", 0, 0)
    nodes.append((1000, 1, "file", "src/hidden.js", "src/hidden.js", 0))
    nodes += [(1001, 1, "file", "x", None, 0), (1002, None, "file", "x", "src/f1.js", 0), (1003, 1, "class", "x", "src/hidden.js", 0), (1004, 1, None, "x", "y", 0)]
    out = judge_files(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(1, "/r", "r", None)], REPOS), spark.createDataFrame(rows, HEADS)).collect()
    assert len(out) == len(nodes) - 2
    reason = {r["file_path"]: r["reason"] for r in out}
    assert reason["src/hidden.js"] == reason["src/table.py"] == "content" and reason["src/noted.js"] == "notice"
    assert reason["src/none.min.js"] == "packed" and reason["src/plain.js"] is None and reason["src/empty.js"] is None and reason[None] is None
    assert all(reason[f"src/f{i}.js"] is None for i in range(60)) and all(reason[f"src/p{i}.min.js"] == "content" for i in range(8))


def test_threshold():
    split = {(0.0, 5): 900, (0.0, 60): 5, (2.0, 60): 10, (2.0, 70): 90}
    t = best_threshold(split, 2.0)
    assert 0.01 < t < 0.95
    assert best_threshold({(0.0, 40): 50, (1.0, 40): 50}, 1.0) is None and best_threshold({(0.0, 1): 5}, 2.0) is None


def test_empty_tables(spark):
    none = judge_files(spark.createDataFrame([], NODES), spark.createDataFrame([], REPOS), spark.createDataFrame([], HEADS))
    assert none.count() == 0


def test_forests_and_threshold_see_every_row(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler

    from quillgraph.llm import handwritten

    # As many rows as were once drawn by hash, and more.
    n = 60_000
    rng = random.Random(2)
    rows = [(i, False, 2.0 if i % 3 == 0 else 0.0, *(rng.random() + (i % 3 == 0) for _ in handwritten.FEATURES)) for i in range(n)]
    schema = "key long, noticed boolean, label double, " + ", ".join(f"{f} double" for f in handwritten.FEATURES)
    binned = handwritten._binned(spark.createDataFrame(rows, schema)).cache()
    values = {r[0] for r in binned.select(handwritten.FEATURES[0]).distinct().collect()}
    assert values == set(map(float, range(handwritten.CUTS)))
    trained, counted = [], []
    fit, best = handwritten._fit, handwritten.best_threshold
    monkeypatch.setattr(handwritten, "_fit", lambda rows, *a: trained.append(rows.count()) or fit(rows, *a))
    monkeypatch.setattr(handwritten, "best_threshold", lambda h, k: counted.append(sum(h.values())) or best(h, k))
    contents = VectorAssembler(inputCols=list(handwritten.FEATURES), outputCol="features").transform(binned)
    found = handwritten._scored(contents, 5, 4).where("found").count()
    assert trained[0] == trained[-1] == sum(trained[1:-1]) == n and counted == [n]
    assert abs(found - n / 3) < n / 100
