import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions.text import commit_time, estimate_tokens, parsed_metadata
from quillgraph.operators import architecture, build, compress, history, imports, manifest, similarity, summary
from quillgraph.plans import queries as core
from quillgraph.plans import router
from quillgraph.tables import SCHEMAS, empty, load, save

NODES = "id long, repository_id long, node_type string, name string, file_path string, metadata_json string"


def test_scoring(spark, collect):
    def scored(table, hits):
        return [(r["name"], r["h"]["layer"], r["h"]["weight"]) for r in table.select("name", F.explode(hits(F.col("name"))).alias("h")).collect()]

    names = spark.createDataFrame([("UserController",), ("UserService",), ("UserRepository",), ("AbstractFactory",), ("ServiceBus",), ("MyServiceX",)], "name string")
    best = {(n, layer): w for n, layer, w in scored(names, architecture.class_hits)}
    assert best["UserController", "controller"] == 1.0 and best["UserService", "business"] == 1.0 and best["UserRepository", "data"] == 1.0
    assert best["ServiceBus", "business"] == 0.8 and best["MyServiceX", "business"] == 0.5 and best["AbstractFactory", "infrastructure"] == 0.7
    files = spark.createDataFrame([("user_controller.py",), ("test_helpers.py",), ("capitalize.py",), ("x/api.py",), ("my_api_v1.py",), ("dao.go",)], "name string")
    found = {x[:2] for x in scored(files, architecture.file_hits)}
    assert {("user_controller.py", "controller"), ("test_helpers.py", "testing"), ("test_helpers.py", "utility"), ("x/api.py", "api"), ("my_api_v1.py", "api"), ("dao.go", "data")} == found
    folders = spark.createDataFrame([("controllers",), ("Tests",), ("xtests",)], "name string")
    assert {x[:2] for x in scored(folders, architecture.directory_hits)} == {("controllers", "controller"), ("Tests", "testing")}
    layer = spark.createDataFrame([("models",), ("service",), ("routes",), ("unknown",)], "layer string").select(architecture.normalise_layer(F.col("layer")))
    assert [r[0] for r in layer.collect()] == ["data", "business", "controller", "unknown"]


def test_layer_confidence(spark):
    rows = [(1, "a", f"s{i}", w) for i, w in enumerate((1.0, 0.9, 0.8))] + [(1, "b", "s0", 1.0), (1, "b", "s1", 0.8)]
    table = spark.createDataFrame(rows, "repository_id long, layer string, source string, weight double")
    assert {r["layer"]: r["confidence"] for r in architecture.layers(table).collect()} == {"a": 0.96, "b": 0.64}


def test_frameworks(spark):
    repos = spark.createDataFrame(
        [(1, "p", "n", None, '{"frameworks": [{"name": "Ruby on Rails", "confidence": 0.9}]}'), (2, "q", "m", None, '{"frameworks": ['), (3, "r", "o", None, None)], SCHEMAS["repositories"]
    )
    nodes = spark.createDataFrame([(1, 2, "file", "manage.py", "x/manage.py", None), (2, 2, "directory", "settings", "app/settings", None), (3, 3, "file", "Gemfile", "Gemfile", None)], NODES)
    out = {(r["repository_id"], r["framework"]): r["confidence"] for r in architecture.frameworks(repos, nodes).collect()}
    assert out == {(1, "rails"): 0.9, (2, "django"): 1.0}


@pytest.mark.parametrize(
    ("question", "family", "target"),
    [
        ("what is the architecture", "architecture", None), ("layers", "architecture", None), ("what is this project", "summarize", None), ("overview", "summarize", None),
        ("summarize this", "summarize", None), ("explain Preprocessor", "explain", "Preprocessor"), ("what is Flask", "explain", "Flask"), ("what depends on render.py", "impact", "render.py"),
        ("path between cmd and config", "path", "cmd"), ("relationship", "path", None), ("who wrote render.rs", "git_blame", "render.rs"), ("authors", "git_blame", None),
        ("why was this introduced", "git_why", "this"), ("co-change", "git_cochange", None), ("find the book module", "search", None),
    ],
)
def test_intents(spark, question, family, target):
    name, targets = router.classify(spark, question)
    assert name == family and (target is None or targets[0] == target)
    row = spark.createDataFrame([(question,)], "q string").select(router.intent_column(F.col("q"))).first()
    assert row[0] == family


def test_router_keeps_targets_unless_strict(spark):
    assert router.classify(spark, "impact of Widget") == ("impact", ["impact of Widget"])
    assert router.classify(spark, "impact of Widget", strict=False) == ("impact", ["Widget"])


def test_times(spark):
    rows = [("2026-01-02 03:04:05 +0200",), ("2026-01-02T01:04:05Z",), ("yesterday",), (None,)]
    out = [r[0] for r in spark.createDataFrame(rows, "t string").select(commit_time("t").cast("string")).collect()]
    assert out == ["2026-01-02 01:04:05", "2026-01-02 01:04:05", None, None]


def test_metadata(spark):
    rows = [('{"a": "x"}',), ('"{\\"a\\": \\"y\\"}"',), ('{"a": ',), ("[1]",), (None,), ("",)]
    out = [r[0] for r in spark.createDataFrame(rows, "m string").select(F.get_json_object(parsed_metadata("m"), "$.a")).collect()]
    assert out == ["x", "y", None, None, None, None]


def test_history(spark, collect):
    commits = spark.createDataFrame([(1, 1, "h1", "A", "a@x", "m", "2026-01-01 23:30:00 -0800"), (2, 1, "h2", "B", "b@x", "m", "2026-01-02 01:00:00 +0000"), (3, 1, "h3", None, None, None, "bad")], SCHEMAS["commits"])
    files = spark.createDataFrame([(1, "a", "M"), (2, "a", "A"), (2, "b", "A"), (1, "b", "M"), (1, "c", None), (3, "a", "M"), (9, "a", "M"), (1, None, "M")], SCHEMAS["commit_files"])
    assert [r["hash"] for r in history.file_history(commits, files, "a").collect()] == ["h1", "h2", "h3"]
    assert collect(history.co_change(commits, files, "a")) == [("b", 2, "A"), ("c", 1, None)]
    assert {r["file_path"]: r["hash"] for r in history.introductions(commits, files).collect()} == {"a": "h2", "b": "h2", "c": "h1"}
    authors = spark.createDataFrame([(1, 1, "A", "a@x", 9), (2, 1, "Z", "z@x", None)], SCHEMAS["commit_authors"])
    assert collect(history.count_authors(commits, authors)) == [(1, "a@x", "A", 1), (1, "b@x", "B", 1), (1, "z@x", "Z", 0)]


def test_imports(spark, collect):
    sources = [
        (1, "pkg/a.py", "python", "import os.path\nfrom .b import x\nimport pkg.c as y\n"), (1, "web/m.ts", "typescript", "import {a} from './n'\nconst q = require(\"lib/z\")\n"),
        (1, "src/main.rs", "rust", "use crate::deep::thing;\n"), (1, "s.c", "c", '#include "h.h"\n#include <stdio.h>\n'), (1, "e.py", "python", None), (1, "g.go", "go", 'import (\n\t"fmt"\n\tx "a/b"\n)\n'),
    ]
    found = imports.extract_imports(spark.createDataFrame(sources, "repository_id long, file_path string, language string, text string"))
    targets = {r["target"] for r in found.collect()}
    assert targets == {"os.path", ".b", "pkg.c", "./n", "lib/z", "crate::deep::thing", "h.h", "stdio.h", "fmt", "a/b"}
    assert found.where("target = 'pkg.c'").count() == 2  # two patterns fit
    files = spark.createDataFrame([(1, p) for p in ("pkg/a.py", "pkg/b.py", "pkg/c/__init__.py", "web/m.ts", "web/n.ts", "inc/h.h", "src/deep/thing.rs", "x/lib/z.js")], "repository_id long, file_path string")
    out = {r["target"]: r["target_path"] for r in imports.resolve_imports(found, files).collect()}
    assert out == {".b": "pkg/b.py", "pkg.c": "pkg/c/__init__.py", "./n": "web/n.ts", "h.h": "inc/h.h", "crate::deep::thing": "src/deep/thing.rs", "lib/z": "x/lib/z.js"}


def test_manifest(spark, collect):
    files = [(1, "package.json", '{"workspaces": ["a"], "dependencies": {"express": "1", "react": "2"}}'), (1, "Cargo.toml", "axum = 1"), (1, "Cargo.lock", ""), (1, "requirements.txt", "x\nflask==1\ndjango\n"), (1, "src/a.PY", ""), (1, "Makefile", None), (2, "lerna.json", "{}"), (2, "noext", None)]
    table = spark.createDataFrame(files, "repository_id long, file_path string, content string")
    assert [r["name"] for r in manifest.package_managers(table).where("repository_id = 1").orderBy("ordinal").collect()] == ["npm", "pip", "cargo", "cargo"]
    assert collect(manifest.monorepos(table)) == [(1, "npm-workspaces"), (2, "lerna")]
    assert {r["framework"]: r["confidence"] for r in manifest.fingerprints(table).collect()} == {"Express": 0.7, "React": 0.5, "Axum": 0.7, "Flask": 0.5, "Django": 0.3}
    assert ("python", 1) in {(r["language"], r["files"]) for r in manifest.language_counts(table).collect()}
    assert manifest.manifests(table).count() == 2


def test_structure_and_resolution(spark, collect):
    files = spark.createDataFrame([("src/a.cs",), ("top.py",)], "file_path string")
    entities = spark.createDataFrame(
        [("src/a.cs", 0, None, "module", "N", None), ("src/a.cs", 1, 0, "class", "JobRepository", None), ("src/a.cs", 2, 1, "method", "run", None), ("src/a.cs", 3, 1, "constant", "X", None)],
        "file_path string, ordinal int, parent_ordinal int, kind string, name string, metadata_json string",
    )
    nodes, edges = build.structure(5, files, entities)
    by = {r["name"]: r for r in nodes.collect()}
    assert set(by) == {"src", "src/a.cs", "top.py", "JobRepository", "run", "X"} and by["JobRepository"]["node_type"] == "repository_layer"
    ids = {r["id"]: r["name"] for r in by.values()}
    assert {(ids[r["source_node_id"]], ids[r["target_node_id"]], r["edge_type"]) for r in edges.collect()} == {
        ("src", "src/a.cs", "CONTAINS"), ("src/a.cs", "JobRepository", "CONTAINS"), ("JobRepository", "run", "DEFINES"), ("JobRepository", "X", "DECLARES"),
    }
    assert build.orphans(nodes, edges).count() == 0
    relations = spark.createDataFrame([(5, "run", "X", "CALLS"), (5, "run", "run", "CALLS"), (5, "run", "gone", "CALLS"), (5, "run", "X", "CALLS")], "repository_id long, source_name string, target_name string, edge_type string")
    assert build.resolve_names(nodes, relations).count() == 2 and build.resolve_names(nodes, relations, distinct=True).count() == 1


def test_store(spark, collect, tmp_path):
    old = spark.createDataFrame([(1, "/a", "a", None, "{1}"), (2, "/b", "b", None, None)], SCHEMAS["repositories"])
    new = spark.createDataFrame([("/a", "A", None, None), ("/c", "c", None, "{3}")], "path string, name string, indexed_at timestamp, manifest_json string")
    merged = {r["path"]: r for r in build.upsert_repositories(old, new).collect()}
    assert merged["/a"]["id"] == 1 and merged["/a"]["name"] == "A" and merged["/a"]["manifest_json"] == "{1}" and merged["/c"]["id"] > 0
    stored = spark.createDataFrame([(1, "m", [1.0])], SCHEMAS["node_vectors"])
    more = spark.createDataFrame([(1, "m", [9.0]), (2, "m", [2.0]), (2, "m", [2.0])], SCHEMAS["node_vectors"])
    assert collect(build.insert_missing(stored, more, ["node_id", "model"])) == [(1, "m", [1.0]), (2, "m", [2.0])]
    assert collect(build.replace_rows(stored, more, ["node_id", "model"])) == [(1, "m", [9.0]), (2, "m", [2.0])]
    save(old.withColumn("part", F.col("id")), str(tmp_path), "repositories", "part")
    save(old.where("id = 1").withColumn("name", F.lit("z")).withColumn("part", F.col("id")), str(tmp_path), "repositories", "part")
    assert {(r["id"], r["name"]) for r in load(spark, str(tmp_path), "repositories").collect()} == {(1, "z"), (2, "b")}
    assert empty(spark, "edges").count() == 0


def test_vectors(spark):
    rows = [(1, "m", [1.0, 0.0]), (2, "m", [2.0, 0.0]), (3, "m", [0.0, 1.0]), (4, "m", None), (5, "m", [0.0, 0.0]), (6, "n", [1.0, 0.0]), (7, "m", [1.0])]
    table = spark.createDataFrame(rows, SCHEMAS["node_vectors"])
    assert [(r["node_id"], r["score"]) for r in similarity.similar_to_node(table, 1, "m", 99).collect()] == [(2, 1.0), (3, 0.0)]
    assert [tuple(r) for r in similarity.similar_to(similarity.vector_norms(table), [1.0, 0.0], "m", 2).collect()] == [tuple(r) for r in similarity.similar_to(table, [1.0, 0.0], "m", 2).collect()]
    assert similarity.similar_to(table, [0.0, 0.0], "m").count() == 0 and similarity.similar_to_node(table, 99, "m").count() == 0
    nodes = spark.createDataFrame([(1, 1, "class", "A", "a.py", None), (9, 1, "method", "run", "a.py", '{"docstring": "Runs.", "parameters": ["x"], "return_type": "int"}'), (10, 1, "job", "J", None, None)], NODES)
    todo = similarity.backlog(nodes, table, "m")
    assert [r["id"] for r in todo.collect()] == [9]
    text = similarity.node_text(todo).first()["text"]
    assert text == "method: run\nfile: a.py\ndocstring: Runs.\nparameters: x\nreturns: int"
    made = similarity.encode_nodes(todo, similarity.HashingEncoder(16)).first()
    assert made["model"] == "hashing-16" and sum(x * x for x in made["vector"]) == pytest.approx(1.0)


def test_compression(spark):
    assert compress.estimate("hello") == 1 and compress.estimate("x" * 100) == 25
    nodes = spark.createDataFrame([(i, 1, "function", f"f{i}", f"d/f{i}.py", None) for i in range(20)], NODES)
    assert compress.node_lines(nodes.limit(0), 80) == "No results."
    two = compress.node_lines(nodes.where("id < 2"), 80)
    assert "f0" in two and "d/f1.py" in two
    many = compress.node_lines(nodes, 80)
    assert "function: 20" in many and "Files:" in many and compress.estimate(many) <= 81
    assert compress.node_lines(nodes, 1) == "function: 20"  # one line always stays
    rows = spark.createDataFrame([(1, 3, "IMPORTS"), (1, 4, "IMPORTS")], "level int, id long, via_edge string")
    text = compress.impact_lines(rows, nodes, 100)
    assert "2 dependents" in text and "IMPORTS" in text
    path = spark.createDataFrame([(0, 1), (1, 2)], "depth int, id long")
    assert "2 hops" in compress.path_lines(path, nodes, 100)
    used = compress.within_budget(nodes.withColumn("line", F.lit("x" * 9)), 10, ["repository_id"], ["id"])
    assert used.count() == 4
    assert spark.createDataFrame([("",), ("abcd" * 3,), (None,)], "t string").select(estimate_tokens("t")).collect()[1][0] == 3


def test_context_package(spark):
    nodes = spark.createDataFrame([(1, 1, "class", "UserController", "a.py", None), (2, 1, "file", "a.py", "a.py", None)], NODES)
    edges = empty(spark, "edges")
    tables = {"nodes": nodes, "edges": edges, "repositories": spark.createDataFrame([(1, "/r", "shop", None, None), (2, "/r/sub", "inner", None, None)], SCHEMAS["repositories"])}
    text = router.context_package(tables, 200)
    assert "controller" in text and "UserController" in text and "shop" in text
    assert compress.estimate(router.context_package(tables, 10)) <= 12
    assert router.answer("what depends on UserController", tables).count() == 0
    assert router.answer("find a.py", tables).count() == 0
    assert "Repository: shop" in router.answer_text("overview", tables) and "controller" in router.answer_text("what is the architecture", tables)
    assert router.answer_text("what depends on UserController", tables) == "0 dependents"
    assert "UserController" in router.answer_text("UserController", tables) and "a.py" in router.answer_text("a.py", tables)
    assert router.answer_text("overview", tables, repository="inner").startswith("Repository: inner") and "class: 1" not in router.answer_text("overview", tables, repository="/r/sub")
    found = lambda **k: summary.find_repository(tables["repositories"], nodes, **k).first()[0]
    assert found(name="inner") == 2 and found(folder="/r/sub/x") == 2 and found(folder="/r/other") == 1 and found(folder="/elsewhere") == 1 and found() == 1
    empty_tables = {t: empty(spark, t) for t in ("nodes", "edges", "repositories")}
    assert router.context_package(empty_tables) == "No data available." and router.answer_text("overview", empty_tables) == "No summary available."


def test_texts_within_a_budget(spark):
    rows = spark.createDataFrame([("shop", "/r", 9, 4, s, k, f"item{k}", 10 - k) for s in ("node types", "edge types", "largest files", "largest classes") for k in range(1, 6)], "name string, path string, nodes long, edges long, section string, rank int, item string, n long")
    whole = compress.summary_lines(rows, 500)
    assert "item1 (9 entities)" in whole and "item5 (5 methods)" in whole and "Nodes by type" in whole
    assert compress.estimate(compress.summary_lines(rows, 30)) <= 31
    layers = spark.createDataFrame([(1, "data", 0.9, 3, 3)], "repository_id long, layer string, confidence double, entities long, sources long")
    none = layers.limit(0)
    text = compress.as_text("architecture", 100, rows=layers, patterns=none.withColumn("pattern", F.lit("")), domains=none.withColumn("domain", F.lit("")).withColumn("files", F.lit(1)))
    assert "data (confidence=0.90, entities=3)" in text
    assert compress.as_text("other", 2, rows=layers).startswith("1 data") and compress.as_text("other", 9, rows=none) == "No results."


def test_all_best_import_targets(spark, collect):
    files = spark.createDataFrame([(1, p) for p in ("a/foo.h", "b/foo.h", "c/main.c", "foo.h", "src/a/b.rs", "src/a/mod.rs", "src/a/c.rs", "src/lib.rs", "x/y.py")], "repository_id long, file_path string")
    asked = [("c/main.c", "c", 1, "bar/foo.h"), ("c/main.c", "c", 2, "foo.h"), ("src/a/b.rs", "rust", 1, "super::c::Thing"), ("src/a/b.rs", "rust", 2, "crate::a::c"), ("x/y.py", "python", 1, "x.y"), ("x/y.py", "python", 2, "nothing")]
    rows = spark.createDataFrame([(1, p, lang, n, t) for p, lang, n, t in asked] + [(1, "c/main.c", "c", 2, "foo.h")], "repository_id long, file_path string, language string, line int, target string")
    out = [(r["source_path"], r["line"], r["target_path"]) for r in imports.resolve_imports(rows, files).collect()]
    assert sorted(out) == [("c/main.c", 2, "foo.h"), ("c/main.c", 2, "foo.h"), ("src/a/b.rs", 1, "src/a/c.rs"), ("src/a/b.rs", 2, "src/a/c.rs")]
    headers = imports.resolve_imports(rows.where("line = 2 AND language = 'c'").limit(1), files.where("file_path <> 'foo.h'"))
    assert {r["target_path"] for r in headers.collect()} == {"a/foo.h", "b/foo.h"}


def test_structure_of_all_repositories(spark, collect, tmp_path):
    """Equal paths of two repositories stay apart, and build_structure leaves no repository out."""
    files = spark.createDataFrame([(r, "src/a.py") for r in (1, 2)] + [(2, "b.py")], "repository_id long, file_path string")
    entities = spark.createDataFrame([(1, "src/a.py", 0, None, "module", "m", None), (1, "src/a.py", 1, 0, "class", "A", None), (2, "src/a.py", 1, 0, "function", "f", None), (2, "src/a.py", 0, None, "class", "B", None)], "repository_id long, file_path string, ordinal int, parent_ordinal int, kind string, name string, metadata_json string")
    for k, whole in enumerate(build.structure(None, files, entities)):
        each = [build.structure(r, *(t.where(f"repository_id = {r}").drop("repository_id") for t in (files, entities)))[k] for r in (1, 2)]
        assert collect(whole) == collect(each[0].unionByName(each[1]))
    heads = [(r, f"d/f{r}.py", 10, 1, 10, "x = 1\n") for r in (1, 2, 3)]
    spark.createDataFrame(heads, "repository_id long, file_path string, n_bytes long, n_lines long, longest_line long, head string").write.parquet(f"{tmp_path}/source_heads.parquet")
    kinds = [r["node_type"] for r in core.build_structure(spark, str(tmp_path)).collect()]
    assert kinds.count("file") == 3 and kinds.count("directory") == 3 and kinds.count("constant") == 3


def test_semantic_search(spark):
    nodes = spark.createDataFrame([(1, 1, "class", "Cache", "a.py", None), (2, 1, "class", "CacheStore", "b.py", None), (3, 2, "class", "Other", "c.py", None)], NODES)
    repos = spark.createDataFrame([(1, "/r", "shop", None, None)], SCHEMAS["repositories"])
    encoder = similarity.HashingEncoder(64)
    vectors = similarity.encode_nodes(nodes, encoder)
    tables = {"nodes": nodes, "repositories": repos, "node_vectors": vectors}
    by_name = similarity.semantic_search(tables, "Cache", encoder, 5).collect()
    assert {r["node_id"] for r in by_name} == {2, 3} and {r["node_id"]: r["repository"] for r in by_name} == {2: "shop", 3: None}
    by_text = similarity.semantic_search(tables, "class: Cache file: a.py", encoder, 1).collect()
    assert [(r["node_id"], r["name"]) for r in by_text] == [(1, "Cache")]


def test_framework_evidence(spark):
    nodes = spark.createDataFrame(
        [(1, 1, "file", "shop/models.py", "shop/models.py", None), (2, 1, "file", "models.py", "models.py", None), (3, 2, "file", "shop/models.py", "shop/models.py", None), (4, 1, "directory", "models", "app/models", None)], NODES
    )
    known = spark.createDataFrame([(1, "django"), (1, "rails")], "repository_id long, framework string")
    out = {(r["node_id"], r["kind"], r["layer"], r["weight"]) for r in architecture.framework_evidence(nodes, known).collect()}
    assert out == {(1, "framework_file", "data", 1.0), (2, "framework_file", "data", 1.0), (1, "django_app", "controller", 0.5), (4, "rails_convention", "data", 1.0)}


def test_go_imports_come_before_declarations(spark):
    text = 'package p\n\nimport (\n\t"fmt"\n\tx "a/b"\n)\n\nvar names = []string{\n\t"not/an/import"\n}\n'
    rows = spark.createDataFrame([(1, "a.go", "go", text)], "repository_id long, file_path string, language string, text string")
    assert [(r["line"], r["target"]) for r in imports.extract_imports(rows).orderBy("line").collect()] == [(4, "fmt"), (5, "a/b")]


def test_word_vectors(spark):
    """Words of one topic come nearer than words of another, in texts not trained on."""
    rng, topics = random.Random(3), [["cache", "evict", "entry", "hit", "miss"], ["socket", "packet", "route", "port", "frame"]]
    rows = [(i, 1, "function", "".join(w.title() for w in rng.sample(topics[i % 2], 4)), f"t{i % 2}/f.py", None) for i in range(400)]
    encoder = similarity.WordVectorEncoder.fit(spark.createDataFrame(rows, NODES), dimensions=16, rounds=8)
    held = [(1000 + i, 1, "function", "".join(w.title() for w in rng.sample(topics[i % 2], 2)), None, None) for i in range(20)] + [(2000, 1, "function", "Qqq", None, None), (2001, 1, None, None, None, None)]
    out = {r["node_id"]: r["vector"] for r in similarity.encode_nodes(spark.createDataFrame(held, NODES), encoder).collect()}
    assert len(out) == 22 and encoder.model == "words-16" and out[2001] is None
    x = np.array([out[1000 + i] for i in range(20)])
    s = x @ x.T
    same = np.equal.outer(np.arange(20) % 2, np.arange(20) % 2)
    assert s[same].mean() > s[~same].mean() + 0.3 and abs(np.linalg.norm(x[0]) - 1) < 1e-5
    assert encoder.encode(["zzz yyy"]).tolist() == [[0.0] * 16]
