import subprocess

from pyspark.sql import functions as F

from quillgraph.operators import build, search, similarity
from quillgraph.plans import index
from quillgraph.streaming import watch


def write(root, tree):
    for name, text in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_index_update_and_embed(spark, tmp_path, collect):
    root, store = tmp_path / "repo", str(tmp_path / "store")
    write(root, {
        "hello.py": "from lib.util import helper\n\nclass Greeter(Base):\n    def greet(self, name):\n        return helper(name)\n", "lib/util.py": "class Base:\n    pass\n\ndef helper(x):\n    return x\n",
        "web/main.js": "import {x} from './part'\nfunction main() {}\n", "web/part.js": "export const x = 1;\n", "bad.py": "def broken(:\n", "package.json": '{"dependencies": {"react": "1"}}', ".git/config": "x",
    })
    counts = index.index_repository(spark, str(root), store)
    assert counts["errors"] == 1 and counts["files"] == 6
    opened = index.open_store(spark, store)
    nodes, edges = opened["nodes"], opened["edges"]
    assert build.orphans(nodes, edges).count() == 0
    names = {r["id"]: r["name"] for r in nodes.collect()}
    kinds = {(names[r["source_node_id"]], names[r["target_node_id"]], r["edge_type"]) for r in edges.collect()}
    assert {("hello.py", "lib/util.py", "IMPORTS"), ("web/main.js", "web/part.js", "IMPORTS"), ("Greeter", "Base", "INHERITS"), ("greet", "helper", "CALLS"), ("lib", "lib/util.py", "CONTAINS"), ("Greeter", "greet", "DEFINES")} <= kinds
    repo = opened["repositories"].first()
    assert repo["name"] == "repo" and "React" in repo["manifest_json"]
    assert search.search_nodes(nodes, edges, "greet").first()["name"] == "greet"

    again = index.index_repository(spark, str(root), store)
    assert again == counts and index.open_store(spark, store)["nodes"].count() == counts["nodes"]

    (root / "web/part.js").unlink()
    (root / "web/main.js").unlink()
    write(root, {"lib/util.py": "class Base:\n    pass\n\ndef helper2(x):\n    return x\n", "new/a.py": "from lib.util import Base\n\ndef fresh():\n    return greet(1)\n"})
    changed = spark.createDataFrame([("web/part.js",), ("web/main.js",), ("lib/util.py",), ("new/a.py",)], "file_path string")
    index.update_files(spark, str(root), store, changed)
    opened = index.open_store(spark, store)
    left = {r["name"] for r in opened["nodes"].collect()}
    assert {"helper2", "fresh", "new", "Greeter"} <= left and not {"helper", "web/part.js", "web/main.js", "web", "x"} & left
    names = {r["id"]: r["name"] for r in opened["nodes"].collect()}
    kinds = {(names[r["source_node_id"]], names[r["target_node_id"]], r["edge_type"]) for r in opened["edges"].collect()}
    # Edges from files that didn't change stay where their end is still there.
    assert {("Greeter", "Base", "INHERITS"), ("hello.py", "lib/util.py", "IMPORTS"), ("new/a.py", "lib/util.py", "IMPORTS"), ("fresh", "greet", "CALLS"), ("new", "new/a.py", "CONTAINS")} <= kinds
    assert ("greet", "helper2", "CALLS") not in kinds
    assert build.orphans(opened["nodes"], opened["edges"]).count() == 0

    new, old = index.embed(spark, store, similarity.HashingEncoder(32))
    assert new > 0 and old == 0
    assert index.embed(spark, store, similarity.HashingEncoder(32)) == (0, new)


def test_empty_tree(spark, tmp_path):
    (tmp_path / "none").mkdir()
    store = str(tmp_path / "store")
    assert index.index_repository(spark, str(tmp_path / "none"), store)["nodes"] == 0
    assert index.open_store(spark, store)["repositories"].count() == 1


def test_names_ignore_files_and_emptied_trees(spark, tmp_path):
    root, store = tmp_path / "repo", str(tmp_path / "store")
    write(root, {"pkg/__init__.py": "from pkg import _core\n", "pkg/_core.py": "def run():\n    pass\n", "main.py": "import pkg\n", "gen/out.py": "x = 1\n", "old.py": "x = 1\n", ".gitignore": "gen/\n", ".quillignore": "# c\nold*\n"})
    index.index_repository(spark, str(root), store)
    opened = index.open_store(spark, store)
    names = {r["id"]: r["name"] for r in opened["nodes"].collect()}
    assert {"pkg/__init__.py", "pkg/_core.py", "main.py"} <= set(names.values()) and not {"gen/out.py", "old.py", "gen"} & set(names.values())
    imports = {(names[r["source_node_id"]], names[r["target_node_id"]]) for r in opened["edges"].where("edge_type = 'IMPORTS'").collect()}
    assert ("main.py", "pkg/__init__.py") in imports
    index.embed(spark, store, similarity.HashingEncoder(8))
    for name in ("pkg/__init__.py", "pkg/_core.py"):
        (root / name).unlink()
    index.update_files(spark, str(root), store, spark.createDataFrame([("pkg/__init__.py",), ("pkg/_core.py",)], "file_path string"))
    left = index.open_store(spark, store)
    assert [r["name"] for r in left["nodes"].collect()] == ["main.py"] and left["edges"].count() == 0 and left["node_vectors"].count() == 1
    (root / "main.py").unlink()
    assert index.update_files(spark, str(root), store, spark.createDataFrame([("main.py",)], "file_path string")) == {"nodes": 0, "edges": 0}
    assert index.open_store(spark, store)["nodes"].count() == 0
    write(root, {"again.py": "x = 1\n"})
    index.index_repository(spark, str(root), store)
    (root / "again.py").unlink()
    assert index.index_repository(spark, str(root), store)["nodes"] == 0
    assert index.open_store(spark, store)["nodes"].count() == 0


def test_modules_nest(spark, tmp_path):
    root, store = tmp_path / "repo", str(tmp_path / "store")
    write(root, {"a.rb": "module A\n  module B\n    class C\n      # Says it.\n      def d(x)\n        help(x)\n      end\n    end\n  end\nend\ndef help(x)\nend\n", "s.sql": "CREATE TABLE shop.\"item list\" (id INT, size DOUBLE PRECISION);\n"})
    index.index_repository(spark, str(root), store)
    opened = index.open_store(spark, store)
    names = {r["id"]: r["name"] for r in opened["nodes"].collect()}
    edges = {(names.get(r["source_node_id"]), names.get(r["target_node_id"]), r["edge_type"]) for r in opened["edges"].collect()}
    assert {("a.rb", "C", "DEFINES"), ("C", "d", "DEFINES"), ("d", "help", "CALLS"), ("s.sql", "item list", "CONTAINS"), ("item list", "size", "DECLARES")} <= edges
    assert build.orphans(opened["nodes"], opened["edges"]).count() == 0
    text = {r["node_id"]: r["text"] for r in similarity.node_text(opened["nodes"]).collect()}
    method = next(i for i, n in names.items() if n == "d")
    assert "docstring: Says it." in text[method] and "parent: C" in text[method] and "signature: def d(x)" in text[method]


def test_follow_a_stream(spark, tmp_path):
    root, store = tmp_path / "repo", str(tmp_path / "store")
    write(root, {"a.py": "def one():\n    pass\n", "b.py": "def two():\n    pass\n"})
    index.index_repository(spark, str(root), store)
    write(root, {"a.py": "def three():\n    pass\n"})
    (root / "b.py").unlink()
    events = spark.createDataFrame([(1, "a.py", "modified", None), (2, "b.py", "deleted", None)], "event_id long, path string, op string, ts timestamp").withColumn("ts", F.current_timestamp())
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    watch.follow(stream, spark, str(root), store, str(tmp_path / "progress"))
    assert {r["name"] for r in index.open_store(spark, store)["nodes"].collect()} == {"a.py", "three"}


def test_history_and_architecture_in_the_store(spark, tmp_path):
    root, store = tmp_path / "repo", str(tmp_path / "store")
    write(root, {"app/models.py": "class UserRepository:\n    pass\n\nclass ItemRepository:\n    pass\n\nclass OrderDao:\n    pass\n", "manage.py": "x = 1\n"})
    index.index_repository(spark, str(root), store)
    record = lambda c, name, mail: f"{c * 40}||{name}||{mail}||2026-01-02 03:04:05 +0200||m\n\nA\tapp/models.py\n"
    logs = spark.createDataFrame([(record("a", "Ann", "a@x") + record("b", "Bob", "b@x") + record("c", "Ann", "a@x"),)], "text string")
    assert index.index_history(spark, str(root), store, logs) == {"new": 3, "commits": 3, "commit_files": 3, "commit_authors": 2}
    assert index.index_history(spark, str(root), store, logs)["new"] == 0
    opened = index.open_store(spark, store)
    assert {(r["email"], r["commit_count"]) for r in opened["commit_authors"].collect()} == {("a@x", 2), ("b@x", 1)}
    assert index.store_architecture(spark, store, index.repository_of(spark, str(root))) > 0
    kept = {(r["layer"], r["pattern"]) for r in index.open_store(spark, store)["architecture"].collect()}
    # The manifest names the framework, whose own files are evidence.
    assert ("data", None) in kept and ("controller", None) in kept and ("pattern", "repository") in kept


def test_history_of_a_repository(spark, tmp_path):
    root, store = tmp_path / "repo", str(tmp_path / "store")
    write(root, {"a.py": "x = 1\n"})
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "a.py")
    git("commit", "-qm", "first || one")
    write(root, {"b.py": "y = 1\n"})
    git("add", "b.py")
    git("commit", "-qm", "second")
    assert index.index_history(spark, str(root), store) == {"new": 2, "commits": 2, "commit_files": 2, "commit_authors": 1}
    assert {r["message"] for r in index.open_store(spark, store)["commits"].collect()} == {"first || one", "second"}
    assert index.index_history(spark, str(tmp_path / "none"), store)["new"] == 0
