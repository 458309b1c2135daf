import json
import time

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import ddl, files, gitlog, parse
from quillgraph.streaming import watch


def test_scan(spark, tmp_path, collect):
    tree = {
        "hello.py": "def greet(name):\n    pass\n", "main.js": "function main() {}\n", "README.md": "# x", "node_modules/react/i.js": "x", ".git/config": "x", "__pycache__/a.pyc": "x",
        "pic.svg": "<svg/>", "blob": "a\0b", "notes": "plain", "out/gen.o2": "x", "keep/me.log": "x", "keep/other.log": "x",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    paths = lambda **k: {r["file_path"] for r in files.scan_tree(spark, str(tmp_path), **k).collect()}
    assert paths() == {"hello.py", "main.js", "README.md", "notes", "out/gen.o2", "keep/me.log", "keep/other.log"}
    assert paths(patterns=["*.md", "out/*"], gitignore=["*.log", "!me.log", "/notes"]) == {"hello.py", "main.js", "keep/me.log"}
    assert files.ignore_lines("# c\n\n*.md \n") == ["*.md"]
    only = spark.createDataFrame([("main.js",), ("gone.js",), ("node_modules/react/i.js",), ("pic.svg",)], "file_path string")
    assert paths(only=only) == {"main.js"}


def test_scan_private_names_and_depth(spark, tmp_path):
    names = ["pkg/__init__.py", "pkg/a.py", "pkg/_private.py", "pkg/_inner/b.py", "top.py", "a/b/c/d/e/f/g.py", "with space/x+y%20.py"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / "link.py").symlink_to(tmp_path / "top.py")
    assert sorted(r["file_path"] for r in files.scan_tree(spark, str(tmp_path)).collect()) == sorted(names)
    assert files.read_lines(str(tmp_path), "top.py") == ["x = 1"] and files.read_lines(str(tmp_path), "none") == []


@pytest.mark.parametrize(
    ("pattern", "path", "expected"),
    [("*.pyc", "foo.pyc", True), ("*.pyc", "foo.py", False), ("build/*", "build/output.o", True), ("build/*", "src/main.py", False), ("node_modules/*", "node_modules/express/index.js", True), ("*.pyc", "a/b.pyc", True)],
)
def test_patterns(spark, pattern, path, expected):
    assert spark.createDataFrame([(path,)], "p string").select(files.matches_pattern(F.col("p"), [pattern])).first()[0] is expected


def test_gitignore(spark):
    paths = ["foo.pyc", "build/output.o", ".env", "src/main.py", "README.md", "x/build/y"]
    out = {r[0]: r[1] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", files.gitignored(F.col("p"), ["*.pyc", "build/", ".env"])).collect()}
    assert out == {"foo.pyc": True, "build/output.o": True, ".env": True, "src/main.py": False, "README.md": False, "x/build/y": True}


def test_git_log(spark, collect):
    h = lambda c: c * 40
    text = (
        f"{h('a')}||Ann||ann@x||2026-01-02 03:04:05 +0200||fix || pipes\n\nA\tnew.py\nM\told.py\nR100\ta.py\tb.py\nC100\tq\tr\nT\tz\n"
        f"{h('b')}||Bob||bob@x||2026-01-02 02:30:00 +0000||later\n\nD\tgone.py\n{h('c')}||Ann||ann@x||2026-01-01 00:00:00 +0000||first\n"
    )
    logs = spark.createDataFrame([(1, text), (2, "")], "repository_id long, text string")
    commits = gitlog.log_commits(gitlog.log_records(logs))
    assert {r["hash"][0]: (r["author"], r["message"]) for r in commits.collect()} == {"a": ("Ann", "fix || pipes"), "b": ("Bob", "later"), "c": ("Ann", "first")}
    changes = {(r["file_path"], r["change_type"]) for r in gitlog.log_files(commits).collect()}
    assert changes == {("new.py", "A"), ("old.py", "M"), ("b.py", "A"), ("a.py", "D"), ("gone.py", "D")}
    known = spark.createDataFrame([(1, h("a"))], "repository_id long, hash string")
    assert {r["hash"][0] for r in gitlog.log_commits(gitlog.log_records(logs), known, 1).collect()} == {"b"}


SNIPPETS = [
    ("python", "class Foo:\n    def bar(self):\n        pass\n\ndef baz():\n    pass\n", {("class", "Foo"), ("method", "bar"), ("function", "baz")}),
    ("javascript", "function foo() {}\nclass Bar {}\nconst x = 1;\n", {("function", "foo"), ("class", "Bar"), ("constant", "x")}),
    ("typescript", "export function identity<T>(a: T): T { return a; }\ninterface Props { a: string }\ntype UserID = string;\nenum Color { Red }\nconst handler = (e: Event) => {};\n", {("function", "identity"), ("interface", "Props"), ("type_alias", "UserID"), ("enum", "Color"), ("function", "handler")}),
    ("tsx", "const App = () => <div/>;\nclass Bar {}\n", {("function", "App"), ("class", "Bar")}),
    ("go", "func foo() {}\ntype Bar struct {\n}\nfunc (b Bar) Baz() {}\n", {("function", "foo"), ("class", "Bar"), ("method", "Baz")}),
    ("rust", "fn foo() {}\npub struct Bar;\nimpl Bar {\n    pub fn run(&self) {}\n}\ntrait T {}\n", {("function", "foo"), ("class", "Bar"), ("method", "run"), ("interface", "T")}),
    ("java", "public class Foo {\n    public int run(int a) {\n    }\n}\ninterface Bar {}\n", {("class", "Foo"), ("method", "run"), ("interface", "Bar")}),
    ("ruby", "class Bar\n  def foo\n  end\nend\ndef top\nend\n", {("class", "Bar"), ("method", "foo"), ("function", "top")}),
    ("c", "struct P {\n};\nint add(int a, int b) {\n}\n#define MAX 3\n", {("class", "P"), ("function", "add"), ("constant", "MAX")}),
    ("kotlin", "class Foo {\n    fun run() {}\n}\nfun top() {}\n", {("class", "Foo"), ("method", "run"), ("function", "top")}),
    ("csharp", "namespace N\n{\n    public class Foo\n    {\n        public void Run()\n        {\n        }\n    }\n}\n", {("module", "N"), ("class", "Foo"), ("method", "Run")}),
    ("php", "class Foo {\n    public function run() {}\n}\nfunction top() {}\n", {("class", "Foo"), ("method", "run"), ("function", "top")}),
    ("cpp", "namespace n {\nclass Foo {\n};\n}\nint run(int a) {\n}\n", {("module", "n"), ("class", "Foo"), ("function", "run")}),
    ("swift", "protocol P {}\nstruct Foo {\n    func run() {}\n}\n", {("interface", "P"), ("class", "Foo"), ("method", "run")}),
    ("scala", "trait T\nclass Foo {\n  def run() = 1\n}\n", {("interface", "T"), ("class", "Foo"), ("method", "run")}),
    ("elixir", "defmodule A.B do\n  def run(x) do\n  end\nend\n", {("module", "A.B"), ("function", "run")}),
    ("lua", "local function a() end\nfunction M.b() end\n", {("function", "a"), ("function", "M.b")}),
    ("julia", "module M\nstruct P\nend\nfunction f(x)\nend\nend\n", {("module", "M"), ("class", "P"), ("function", "f")}),
    ("zig", "pub const P = struct {\n};\npub fn run() void {}\n", {("class", "P"), ("function", "run")}),
    ("groovy", "class Foo {\n    def run(a) {\n    }\n}\n", {("class", "Foo"), ("method", "run")}),
]


def test_parse(spark):
    rows = [(1, f"{lang}.x", lang, text) for lang, text, _ in SNIPPETS] + [(1, "e", "go", ""), (1, "n", "python", None), (1, "bad.py", "python", "def broken(:\n"), (1, "u", "unknown", "class X {}")]
    out = parse.parse_sources(spark.createDataFrame(rows, "repository_id long, file_path string, language string, text string")).collect()
    for lang, _, expected in SNIPPETS:
        got = {(r["kind"], r["name"]) for r in out if r["language"] == lang and r["error"] is None}
        assert expected <= got, (lang, got)
    errors = [r for r in out if r["error"]]
    assert [r["file_path"] for r in errors] == ["bad.py"] and errors[0]["error"].startswith("Parse")
    assert not any(r["language"] == "unknown" for r in out)
    parent = {(r["language"], r["name"]): r["parent_ordinal"] for r in out if r["error"] is None}
    assert parent["python", "bar"] == 0 and parent["java", "run"] == 0 and parent["ruby", "top"] is None


RELATIONS = [
    ("javascript", "class B extends A {\n  run() {\n    helper(1);\n    this.other();\n    helper(2);\n  }\n}\n", {("B", "INHERITS", "A"), ("run", "CALLS", "helper")}),
    ("typescript", "class B extends A<T> implements C, D {\n}\ninterface E extends F {}\n", {("B", "INHERITS", "A"), ("B", "INHERITS", "C"), ("B", "INHERITS", "D"), ("E", "INHERITS", "F")}),
    ("go", "func main() {\n\trun(1)\n\tfmt.Println(2)\n}\n", {("main", "CALLS", "run")}),
    ("rust", "trait T: A + B {}\nimpl T for P {\n    fn go(&self) -> u8 {\n        work()\n    }\n}\n", {("T", "INHERITS", "A"), ("T", "INHERITS", "B"), ("T impl P", "IMPLEMENTS", "T"), ("go", "CALLS", "work")}),
    ("java", "public class A<T> extends B<T> implements C, D {\n    void run() {\n        help(\"x(y)\"); // no(1)\n    }\n}\n", {("A", "INHERITS", "B"), ("A", "IMPLEMENTS", "C"), ("A", "IMPLEMENTS", "D"), ("run", "CALLS", "help")}),
    ("kotlin", "class A(val x: Int) : B(), C {\n    fun run() {\n        help()\n    }\n}\ninterface I : J\n", {("A", "IMPLEMENTS", "B"), ("A", "IMPLEMENTS", "C"), ("I", "INHERITS", "J"), ("run", "CALLS", "help")}),
    ("csharp", "public class A : B, IC\n{\n    public void Run()\n    {\n        Help();\n    }\n}\n", {("A", "INHERITS", "B"), ("A", "INHERITS", "IC"), ("Run", "CALLS", "Help")}),
    ("php", "class A extends B implements C {\n    function run() {\n        help(1);\n    }\n}\n", {("A", "INHERITS", "B"), ("A", "IMPLEMENTS", "C"), ("run", "CALLS", "help")}),
    ("ruby", "class A < B::C\n  def run\n    help(1)\n  end\nend\n", {("A", "INHERITS", "B::C"), ("run", "CALLS", "help")}),
    ("swift", "class A: B, C {\n    func run() {\n        help()\n    }\n}\nextension A {\n}\n", {("A", "INHERITS", "B"), ("A", "INHERITS", "C"), ("run", "CALLS", "help")}),
    ("scala", "class A extends B with C {\n  def run() = help(1)\n}\ntrait T extends U\n", {("A", "IMPLEMENTS", "B"), ("A", "IMPLEMENTS", "C"), ("T", "INHERITS", "U"), ("run", "CALLS", "help")}),
    ("elixir", "defimpl Size, for: Map do\n  def size(x) do\n    help(x)\n  end\nend\n", {("Size (impl)", "IMPLEMENTS", "Size"), ("size", "CALLS", "help")}),
    ("c", "int run(int a) {\n    if (a) return help(a);\n}\n", {("run", "CALLS", "help")}),
    ("cpp", "int run(int a) {\n    return help(a);\n}\n", {("run", "CALLS", "help")}),
    ("lua", "function run()\n  help(1)\nend\n", {("run", "CALLS", "help")}),
    ("julia", "function run(x)\n  help(x)\nend\n", {("run", "CALLS", "help")}),
    ("zig", "pub fn run() void {\n    help();\n}\n", {("run", "CALLS", "help")}),
    ("groovy", "class A extends B {\n    def run(a) {\n        help(a)\n    }\n}\n", {("A", "INHERITS", "B"), ("run", "CALLS", "help")}),
]


def test_relations_of_lines(spark):
    rows = [(1, f"{lang}.x", lang, text) for lang, text, _ in RELATIONS]
    out = parse.parse_sources(spark.createDataFrame(rows, "repository_id long, file_path string, language string, text string")).collect()
    for lang, _, expected in RELATIONS:
        got = [(r["name"], x["edge_type"], x["target_name"]) for r in out if r["language"] == lang for x in r["relations"]]
        assert set(got) == expected and len(got) == len(expected), (lang, got)


TYPESCRIPT = [
    ("function identity<T>(arg: T): T { return arg; }", "function", "identity", "<T>"), ("interface Props { a: string }", "interface", "Props", None), ("interface Response<T> { data: T }", "interface", "Response", "<T>"),
    ("type UserID = string;", "type_alias", "UserID", None), ("type Result<T> = T | null;", "type_alias", "Result", "<T>"), ("enum Color { Red }", "enum", "Color", None),
    ("export default function() { return 1; }", "function", "default", None), ("const handler = (e: Event) => {};", "function", "handler", None), ("const wrap = <T>(x: T) => x;", "function", "wrap", "<T>"),
    ("const App = () => <div/>;", "function", "App", None), ("function render() { return <div>Hi</div>; }", "function", "render", None), ("const Header: React.FC = () => <h1/>;", "function", "Header", None),
    ("export default function identity<T>(arg: T): T { return arg; }", "function", "identity", "<T>"),
]


@pytest.mark.parametrize("language", ["typescript", "tsx"])
def test_typescript(spark, language):
    rows = [(1, f"{i:02d}", language, text) for i, (text, *_) in enumerate(TYPESCRIPT)]
    out = parse.parse_sources(spark.createDataFrame(rows, "repository_id long, file_path string, language string, text string")).orderBy("file_path", "ordinal").collect()
    assert [(r["kind"], r["name"], json.loads(r["metadata_json"]).get("type_parameters")) for r in out] == [x[1:] for x in TYPESCRIPT]


def test_documentation_and_metadata_of_lines(spark):
    java = "/**\n * Runs it.\n */\n@Entity\n@Table(name = \"people\")\npublic final class Person {\n    private String name;\n\n    // Says hello.\n    public String hello(String to, int n) throws X {\n    }\n}\n"
    go = "// Baz adds.\nfunc (b Bar) Baz(x int, y int) int {\n}\n"
    table = spark.createDataFrame([(1, "P.java", "java", java), (1, "b.go", "go", go)], "repository_id long, file_path string, language string, text string")
    entities = parse.parse_sources(table)
    out = {r["name"]: (r["docstring"], json.loads(r["metadata_json"])) for r in entities.collect()}
    assert out["Person"][0] == "Runs it." and out["Person"][1]["modifiers"] == ["public", "final"] and out["Person"][1]["decorators"][0] == "@Entity"
    assert out["hello"][0] == "Says hello." and out["hello"][1]["parameters"] == ["String to", "int n"] and out["hello"][1]["parent_name"] == "Person"
    assert out["Baz"][0] == "Baz adds." and out["Baz"][1]["parameters"] == ["x int", "y int"] and out["Baz"][1]["exported"] is True
    assert [tuple(r)[2:] for r in ddl.annotated_tables(entities).collect()] == [("people", "name")]
    declared = ddl.declared_entities(table, entities).collect()
    assert {(r["kind"], r["name"]) for r in declared} == {("table", "people"), ("constant", "name")}


def test_python_relations(spark):
    text = "class A(Base, Protocol):\n    x = 1\n    @property\n    def p(self): return f(g(1))\n\n@app.get('/x')\ndef end(a, b): pass\n"
    out = {r["name"]: r for r in parse.parse_python(spark.createDataFrame([(1, "a.py", "python", text)], "repository_id long, file_path string, language string, text string")).collect()}
    assert {(x["edge_type"], x["target_name"]) for x in out["A"]["relations"]} == {("INHERITS", "Base"), ("IMPLEMENTS", "Protocol")}
    assert {x["target_name"] for x in out["p"]["relations"] if x["edge_type"] == "CALLS"} == {"f", "g"} and out["end"]["kind"] == "api_endpoint"


def test_declared_tables(spark, collect):
    text = "CREATE TABLE IF NOT EXISTS t (id INT PRIMARY KEY, price DECIMAL(10,2), CONSTRAINT c CHECK (price > 0), FOREIGN KEY (id) REFERENCES u(id))"
    assert ddl.ddl_tables(text) == [("t", 0, "id", "INT"), ("t", 1, "price", "DECIMAL(10,2)")]
    assert ddl.ddl_tables("create table open (a int") == []
    prisma = "model User {\n  id Int @id\n  name String?\n}\n"
    table = spark.createDataFrame([(1, "a.sql", text), (1, "db/schema.prisma", prisma), (1, "x", None)], "repository_id long, file_path string, text string")
    assert len(collect(ddl.sql_tables(table))) == 2
    assert [r[2:] for r in collect(ddl.prisma_tables(table))] == [("User", "id", "Int"), ("User", "name", "String?")]
    models = parse.parse_python(spark.createDataFrame([(1, "m.py", "python", "class Book(models.Model):\n    title = f()\n\nclass Plain:\n    x = 1\n")], "repository_id long, file_path string, language string, text string"))
    assert [r[2:] for r in collect(ddl.model_tables(models))] == [("book", "title")]


EVENTS = "event_id long, path string, op string, ts timestamp"


def write_events(spark, folder, rows):
    frame = spark.createDataFrame(rows, "event_id long, path string, op string, s string").select("event_id", "path", "op", F.col("s").cast("timestamp").alias("ts"))
    frame.coalesce(1).write.mode("append").parquet(str(folder))
    time.sleep(0.01)


def test_streams(spark, tmp_path, collect):
    at = lambda s: f"2026-01-01 00:00:{s:02d}"
    write_events(spark, tmp_path / "in", [(1, "a", "created", at(0)), (2, "a", "deleted", at(1)), (3, "b", "created", at(1)), (9, None, "created", at(1)), (10, "n", "created", None)])
    write_events(spark, tmp_path / "in", [(4, "a", "created", at(1)), (5, "b", "modified", at(10))])
    read = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {r["path"]: (r["op"], r["events"]) for r in watch.coalesce_stream(read(), spark).collect()}
    assert out == {"a": ("created", 3), "b": ("modified", 2)}
    runs = collect(watch.debounced(spark.read.parquet(str(tmp_path / "in"))).select("path", "events"))
    assert runs == [("a", 3), ("b", 1), ("b", 1)]


def test_watched(spark, collect):
    rows = spark.createDataFrame([(1, "/r/a.py", "created", None), (2, "/r/b.txt", "created", None), (3, "/rest/c.py", "created", None)], "event_id long, path string, op string, ts timestamp")
    assert [r[1] for r in collect(watch.watched(rows, "/r/"))] == ["a.py"]


def test_moves(spark, collect):
    rows = spark.createDataFrame([(1, "a", "b", "moved", None), (2, "c", None, "modified", None)], "event_id long, path string, moved_to string, op string, ts timestamp")
    assert [r[1:3] for r in collect(watch.moved_as_pairs(rows))] == [("a", "deleted"), ("b", "created"), ("c", "modified")]
