"""Definitions in source texts as rows.

Sources are split into lines in Spark and each line is tried against the
patterns of its language.  What encloses, documents and calls what follows from
indentation, in one pass over the lines that tell something, so a class's
functions become methods.  Python, whose own parser is at hand, is read with it.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|async|export|default|override|virtual|sealed|open|data|inline|suspend|pub(?:\([^)]*\))?|unsafe|const|extern|implicit|case|local|mutating|partial|readonly)\s+)*"
_NAME = r"([A-Za-z_$][\w$]*)"

# By language, kind and what a line that defines it looks like; the group is the name.
DEFINITIONS: dict[str, tuple[tuple[str, str], ...]] = {
    "javascript": (("function", r"^\s*export\s+(default)\s+(?:async\s+)?(?:function\s*\*?\s*(?:<[^>]*>)?\s*\(|(?:<[^>]*>\s*)?\([^)]*\)\s*(?::[^=]+)?=>)"), ("class", rf"^\s*{_MOD}class\s+{_NAME}"), ("function", rf"^\s*{_MOD}function\*?\s+{_NAME}"), ("function", rf"^\s*{_MOD}(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:<[^>]*>\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)"), ("method", rf"^\s+{_MOD}(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){_NAME}\s*\([^)]*\)\s*\{{"), ("constant", rf"^{_MOD}(?:const|let|var)\s+{_NAME}\b"), ("constant", rf"^const\s+{_NAME}\b")),
    "typescript": (("function", r"^\s*export\s+(default)\s+(?:async\s+)?(?:function\s*\*?\s*(?:<[^>]*>)?\s*\(|(?:<[^>]*>\s*)?\([^)]*\)\s*(?::[^=]+)?=>)"), ("interface", rf"^\s*{_MOD}interface\s+{_NAME}"), ("type_alias", rf"^\s*{_MOD}type\s+{_NAME}\s*(?:<[^=]*>)?\s*="), ("enum", rf"^\s*{_MOD}enum\s+{_NAME}"), ("class", rf"^\s*{_MOD}class\s+{_NAME}"), ("function", rf"^\s*{_MOD}function\*?\s+{_NAME}"), ("function", rf"^\s*{_MOD}(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:<[^>]*>\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)"), ("method", rf"^\s+{_MOD}(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){_NAME}\s*(?:<[^>]*>)?\([^)]*\)\s*(?::[^{{]+)?\{{"), ("constant", rf"^{_MOD}(?:const|let|var)\s+{_NAME}\b"), ("constant", rf"^const\s+{_NAME}\b")),
    "go": (("method", rf"^func\s+\([^)]*\)\s*{_NAME}"), ("function", rf"^func\s+{_NAME}"), ("interface", rf"^type\s+{_NAME}\s+interface\b"), ("class", rf"^type\s+{_NAME}\s+"), ("constant", rf"^const\s+{_NAME}"), ("variable", rf"^var\s+{_NAME}")),
    "rust": (("function", rf"^\s*{_MOD}fn\s+{_NAME}"), ("class", rf"^\s*{_MOD}struct\s+{_NAME}"), ("enum", rf"^\s*{_MOD}enum\s+{_NAME}"), ("interface", rf"^\s*{_MOD}trait\s+{_NAME}"), ("impl", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+([^{]+?)\s*(?:\{|where\b|$)"), ("module", rf"^\s*{_MOD}mod\s+{_NAME}"), ("constant", rf"^\s*{_MOD}type\s+{_NAME}"), ("constant", rf"^\s*(?:pub\s+)?const\s+{_NAME}"), ("variable", rf"^\s*(?:pub\s+)?static\s+(?:mut\s+)?{_NAME}")),
    "java": (("annotation", rf"^\s*{_MOD}@interface\s+{_NAME}"), ("class", rf"^\s*{_MOD}(?:class|record)\s+{_NAME}"), ("interface", rf"^\s*{_MOD}interface\s+{_NAME}"), ("enum", rf"^\s*{_MOD}enum\s+{_NAME}"), ("method", rf"^\s+{_MOD}(?!return\b|new\b|else\b|throw\b)[\w<>\[\],.? ]+\s+{_NAME}\s*\([^)]*\)\s*(?:throws\s+[\w., ]+)?(?:\{{|;)"), ("variable", rf"^\s+(?:(?:public|private|protected|static|final|volatile|transient)\s+)+[\w<>\[\],.? ]+\s+{_NAME}\s*(?:=|;)"), ("module", r"^\s*package\s+([\w.]+)")),
    "kotlin": (("interface", rf"^\s*{_MOD}interface\s+{_NAME}"), ("class", rf"^\s*{_MOD}(?:enum\s+)?(?:class|object)\s+{_NAME}"), ("function", rf"^\s*{_MOD}fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?{_NAME}"), ("constant", rf"^\s*typealias\s+{_NAME}"), ("variable", rf"^\s*{_MOD}va[lr]\s+{_NAME}")),
    "csharp": (("module", r"^\s*namespace\s+([\w.]+)"), ("class", rf"^\s*{_MOD}(?:class|struct|record)\s+{_NAME}"), ("interface", rf"^\s*{_MOD}interface\s+{_NAME}"), ("enum", rf"^\s*{_MOD}enum\s+{_NAME}"), ("method", rf"^\s+{_MOD}(?!return\b|new\b|else\b|throw\b)[\w<>\[\],.? ]+\s+{_NAME}\s*\([^)]*\)\s*(?:\{{|$|=>)"), ("variable", rf"^\s+{_MOD}[\w<>\[\],.?]+\s+{_NAME}\s*(?:;|=|\{{\s*get)")),
    "php": (("interface", rf"^\s*interface\s+{_NAME}"), ("class", rf"^\s*{_MOD}(?:class|trait)\s+{_NAME}"), ("enum", rf"^\s*enum\s+{_NAME}"), ("function", rf"^\s*{_MOD}function\s+&?{_NAME}")),
    "ruby": (("class", r"^\s*class\s+([A-Z][\w:]*)"), ("module", r"^\s*module\s+([A-Z][\w:]*)"), ("function", r"^\s*def\s+((?:self\.)?[A-Za-z_]\w*[?!=]?)")),
    "c": (("class", rf"^\s*(?:typedef\s+)?(?:struct|union)\s+{_NAME}\s*\{{"), ("enum", rf"^\s*(?:typedef\s+)?enum\s+{_NAME}"), ("function", rf"^(?!\s)(?!return\b|else\b|typedef\b)[\w*& ]+?[\s*&]{_NAME}\s*\([^;]*\)\s*\{{?\s*$"), ("constant", rf"^#\s*define\s+{_NAME}\b"), ("global", rf"^(?!return\b|typedef\b|using\b|goto\b|extern\b\s+\")[A-Za-z_][\w ]*[\s*]+{_NAME}\s*(?:\[[^\]]*\]\s*)*(?:=[^=].*|;\s*)$")),
    "cpp": (("class", rf"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct|union)\s+{_NAME}[^;]*$"), ("enum", rf"^\s*enum\s+(?:class\s+)?{_NAME}"), ("module", rf"^\s*namespace\s+{_NAME}"), ("interface", rf"^\s*concept\s+{_NAME}"), ("function", rf"^\s*(?!return\b|else\b|typedef\b|new\b)[\w*&:<>, ]+?[\s*&]{_NAME}\s*\([^;]*\)\s*(?:const\s*)?\{{?\s*$")),
    "swift": (("class", rf"^\s*{_MOD}(?:class|struct|actor)\s+{_NAME}"), ("enum", rf"^\s*{_MOD}enum\s+{_NAME}"), ("interface", rf"^\s*{_MOD}protocol\s+{_NAME}"), ("extension", rf"^\s*{_MOD}extension\s+{_NAME}"), ("function", rf"^\s*{_MOD}func\s+{_NAME}"), ("variable", rf"^\s*{_MOD}(?:let|var)\s+{_NAME}")),
    "scala": (("interface", rf"^\s*{_MOD}trait\s+{_NAME}"), ("class", rf"^\s*{_MOD}(?:class|object)\s+{_NAME}"), ("enum", rf"^\s*enum\s+{_NAME}"), ("function", rf"^\s*{_MOD}def\s+{_NAME}"), ("variable", rf"^\s*{_MOD}va[lr]\s+{_NAME}")),
    "elixir": (("module", r"^\s*defmodule\s+([\w.]+)"), ("interface", r"^\s*defprotocol\s+([\w.]+)"), ("defimpl", r"^\s*defimpl\s+([\w.]+)"), ("macro", r"^\s*defmacrop?\s+([a-z_]\w*[?!]?)"), ("function", r"^\s*defp?\s+([a-z_]\w*[?!]?)")),
    "lua": (("function", r"^\s*(?:local\s+)?function\s+([\w.:]+)"), ("function", r"^\s*(?:local\s+)?([\w.]+)\s*=\s*function\b"), ("variable", rf"^\s*local\s+{_NAME}\s*=")),
    "julia": (("module", rf"^\s*module\s+{_NAME}"), ("class", rf"^\s*(?:mutable\s+)?struct\s+{_NAME}"), ("macro", r"^\s*macro\s+([\w.!]+)"), ("function", r"^\s*function\s+([\w.!]+)"), ("function", rf"^{_NAME}\([^)]*\)\s*=[^=]")),
    "zig": (("class", rf"^\s*(?:pub\s+)?const\s+{_NAME}\s*=\s*(?:packed\s+|extern\s+)?(?:struct|union)\b"), ("enum", rf"^\s*(?:pub\s+)?const\s+{_NAME}\s*=\s*(?:enum|error)\b"), ("function", rf"^\s*(?:pub\s+)?(?:inline\s+|export\s+)?fn\s+{_NAME}"), ("function", r"^\s*test\s+\"([^\"]+)\""), ("global", rf"^\s*(?:pub\s+)?(?:const|var)\s+{_NAME}")),
    "groovy": (("interface", rf"^\s*{_MOD}interface\s+{_NAME}"), ("class", rf"^\s*{_MOD}(?:class|trait)\s+{_NAME}"), ("enum", rf"^\s*{_MOD}enum\s+{_NAME}"), ("function", rf"^\s*{_MOD}(?:def|void|[A-Z]\w*)\s+{_NAME}\s*\([^)]*\)\s*\{{")),
}
SAME = {"tsx": "typescript"}


def _python_rows(text: str) -> list[tuple]:
    """(ordinal, parent, kind, name, line, docstring, metadata, relations) of a Python text."""
    rows: list[tuple] = []

    def visit(body: list[ast.stmt], parent: int | None, in_class: bool) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                decorators = [ast.unparse(d) for d in node.decorator_list]
                bases = [ast.unparse(b) for b in node.bases]
                relations = [("IMPLEMENTS" if "Protocol" in b or "ABC" in b else "INHERITS", b) for b in bases]
                at = add(node, parent, "class", node.name, {"bases": bases, "decorators": decorators}, relations)
                visit(node.body, at, True)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                decorators = [ast.unparse(d) for d in node.decorator_list]
                methods = [m for m in ("route", "get", "post", "put", "delete", "patch") if any(f".{m}(" in d for d in decorators)]
                method = in_class or any(d in ("property", "staticmethod", "classmethod") for d in decorators)
                kind = "api_endpoint" if methods else "method" if method else "function"
                parameters = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
                calls = [("CALLS", n.func.id) for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)]
                returns = None if node.returns is None else ast.unparse(node.returns)
                signature = f"{node.name}({ast.unparse(node.args)})" + (f" -> {returns}" if returns else "")
                meta = {"signature": signature, "parameters": parameters, "decorators": decorators, "endpoint_methods": methods, "return_type": returns}
                at = add(node, parent, kind, node.name, meta, calls + [("DECORATES", d.split("(")[0]) for d in decorators])
                visit([n for n in node.body if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)], at, False)
            elif isinstance(node, ast.Assign | ast.AnnAssign):
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                for target in targets:
                    if isinstance(target, ast.Name):
                        add(node, parent, "constant", target.id, {}, [])
            elif hasattr(node, "body") and isinstance(node.body, list):
                visit(node.body + list(getattr(node, "orelse", [])), parent, in_class)

    def add(node: ast.stmt, parent: int | None, kind: str, name: str, meta: dict, relations: list) -> int:
        doc = ast.get_docstring(node) if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) else None
        meta = {"language": "python", **meta, "docstring": doc, "parent_name": None if parent is None else rows[parent][3]}
        rows.append((len(rows), parent, kind, name, node.lineno, doc, json.dumps({k: v for k, v in meta.items() if v}), relations))
        return len(rows) - 1

    visit(ast.parse(text).body, None, False)
    return rows


_SCHEMA = (
    "repository_id long, file_path string, language string, ordinal int, parent_ordinal int, kind string, name string, line int, docstring string, "
    "metadata_json string, relations array<struct<edge_type string, target_name string>>, error string"
)


def parse_python(sources: DataFrame) -> DataFrame:
    """Entities of Python texts by Python's own parser; a text that can't be parsed gives one row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _SCHEMA.split(", ") if "<" not in c]
        for batch in batches:
            out = []
            for repository, path, text in zip(batch["repository_id"], batch["file_path"], batch["text"]):
                try:
                    for row in _python_rows(text):
                        out.append((repository, path, "python", *row[:7], [{"edge_type": a, "target_name": b} for a, b in row[7]], None))
                except (SyntaxError, ValueError, RecursionError) as problem:
                    out.append((repository, path, "python", *[None] * 7, [], f"Parse error: {problem}"))
            columns = names[:10] + ["relations", "error"]
            yield pd.DataFrame(out, columns=columns).astype({"parent_ordinal": "Int32", "ordinal": "Int32", "line": "Int32"})

    rows = sources.where((F.col("language") == "python") & (F.length("text") > 0)).select("repository_id", "file_path", "text")
    return rows.mapInPandas(run, _SCHEMA)


#: Kinds whose entities hold others.
CONTAINERS = ("class", "interface", "enum", "module", "extension", "impl", "annotation", "defimpl")
#: Kinds that calls are made from.
CALLERS = ("function", "method", "macro")
# Languages whose comments begin so, and what a line of comment or annotation looks like.
HASH_COMMENTS = ("ruby", "elixir", "julia", "php")
COMMENT_LINE = r"^\s*(?://|/\*|\*(?:[\s/]|$)|--(?!>)|#(?![\[!]|\s*(?:include|define|undef|if|ifdef|ifndef|endif|else|elif|pragma|error|region)\b))"
ANNOTATION_LINE = r"^\s*(?:@(?!interface\b)[A-Za-z]|#\[|\[[A-Z]\w*(?:\(.*\))?\]\s*$)"
_STRINGS = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`"
# Words before a bracket that are no call.
NO_CALLS = (
    "if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "fun", "def", "sub", "when", "match", "with", "using", "lock", "sizeof", "typeof", "new", "throw",
    "elif", "elseif", "elsif", "else", "foreach", "synchronized", "super", "this", "and", "or", "not", "in", "is", "await", "async", "yield", "defined", "require", "import", "assert", "do", "end", "case", "unless", "until", "pub", "try", "catch",
)
_PASSED = "repository_id long, file_path string, language string, at int, code string, kind string, name string, ordinal int, parent_ordinal int, parent_kind string, parent_name string, calls array<string>, docstring string, decorators array<string>"
_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*|///?!?|#+|--+)|\*+/\s*$")


def _enclose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the definitions of each file in order, with what encloses, documents and annotates them and what they call.

    A definition's parent is the last container before it with less
    indentation; a call belongs to the last function of less indentation.
    """
    columns = [c.split()[0] for c in _PASSED.split(", ")]
    file, done, stack, notes, marks, last = None, [], [], [], [], -1
    for batch in batches:
        for repository, path, language, at, code, kind, name, calls, indent in batch.itertuples(index=False):
            here = (None if repository != repository else repository, path)
            if here != file:
                if done:
                    yield pd.DataFrame(done, columns=columns)
                file, done, stack, notes, marks, last = here, [], [], [], [], -1
            if kind is None and len(calls) == 0:
                # A comment or an annotation.
                if at != last + 1:
                    notes, marks = [], []
                last = at
                if re.match(ANNOTATION_LINE, code):
                    marks.append(code.strip())
                else:
                    notes.append(_MARKS.sub("", _MARKS.sub("", code)).strip())
                continue
            while stack and stack[-1][1] >= indent:
                stack.pop()
            if kind is not None:
                holder = next((x for x in reversed(stack) if x[2] in CONTAINERS), None)
                beside = at == last + 1
                said = "\n".join(notes).strip() if beside else ""
                done.append([here[0], path, language, at, code, kind, name, len(done), holder and holder[0], holder and holder[2], holder and done[holder[0]][6], [], said or None, marks if beside else []])
                stack.append((len(done) - 1, indent, kind))
                calls = [c for c in calls if c != name]
            owner = next((x for x in reversed(stack) if x[2] in CALLERS), None)
            if owner is not None:
                known = done[owner[0]][11]
                known += [c for c in dict.fromkeys(calls) if c not in known]
    if done:
        yield pd.DataFrame(done, columns=columns)


def _definition(language: str) -> Column:
    """(kind, name) of a line of a language: one alternation tells which pattern fits, the first in order."""
    kinds, patterns = zip(*DEFINITIONS[language])
    whole = "|".join(f"(?:{p})" for p in patterns)
    groups = F.split(F.regexp_replace("code", f"^(?:{whole}).*$", "\u0001".join(f"${i + 1}" for i in range(len(patterns)))), "\u0001")
    nth = F.array_position(F.transform(groups, lambda x: x != ""), True).cast("int")
    return F.when(F.col("code").rlike(whole), F.struct(F.element_at(F.array(*map(F.lit, kinds)), nth).alias("kind"), F.element_at(groups, nth).alias("name")))


def _names(clause: Column) -> Column:
    """The names in a list of bases, without arguments, modifiers and white space."""
    bare = F.regexp_replace(F.regexp_replace(clause, r"\([^()]*\)?", ""), r"\b(?:public|private|protected|virtual|class|where\b.*)\s*", "")
    parts = F.transform(F.split(bare, r"\s*[,+&]\s*|\s+with\s+"), lambda x: F.trim(F.regexp_replace(x, r"\s+by\s.*$|\{.*$", "")))
    return F.filter(parts, lambda x: x.rlike(r"^[A-Za-z_$\\][\w.$:\\]*$"))


def _bases() -> Column:
    """Relations of a class-like line to its bases, by the words of its language."""
    code, language, kind = F.regexp_replace(F.regexp_replace("code", "<[^<>]*>", ""), "<[^<>]*>", ""), F.col("language"), F.col("kind")
    listed = r"([A-Za-z_$\\][\w.$\\]*(?:\([^()]*\))?(?:\s*(?:,|\bwith\b)\s*[A-Za-z_$\\][\w.$\\]*(?:\([^()]*\))?)*)"
    extends, implements = (_names(F.regexp_extract(code, rf"\b{w}\s+{listed}", 1)) for w in ("extends", "implements"))
    colon = _names(F.regexp_extract(code, r"\b(?:class|interface|struct|record|protocol|enum|trait|object|extension|actor)\s+[\w.]+\s*(?:\([^()]*\))?\s*:\s*([^{]+)", 1))
    below = _names(F.regexp_extract("code", r"^\s*class\s+[\w:]+\s*<\s*([\w:]+)", 1))
    of = lambda names, edge: F.transform(names, lambda x: F.struct(F.lit(edge).alias("edge_type"), x.alias("target_name")))
    by_kind = lambda names: F.when(kind == "interface", of(names, "INHERITS")).otherwise(of(names, "IMPLEMENTS"))
    trait = _names(F.regexp_extract(code, r"^\s*impl\s+([\w:]+)\s+for\b", 1))
    return (
        F.when(language.isin("javascript", "typescript", "tsx"), of(F.concat(extends, implements), "INHERITS"))
        .when(language.isin("java", "php", "groovy"), F.concat(of(extends, "INHERITS"), of(implements, "IMPLEMENTS")))
        .when(language == "kotlin", by_kind(colon))
        .when(language == "scala", by_kind(extends))
        .when(language.isin("csharp", "swift"), of(colon, "INHERITS"))
        .when(language == "rust", F.concat(of(colon, "INHERITS"), of(trait, "IMPLEMENTS")))
        .when(language == "ruby", of(below, "INHERITS"))
        .when(language == "elixir", of(_names(F.regexp_extract("code", r"^\s*defimpl\s+([\w.]+)", 1)), "IMPLEMENTS"))
    )


def _metadata() -> Column:
    """The facts of a definition that its line tells, as JSON; empty ones are left out."""
    language, callable_ = F.col("language"), F.col("kind").isin("function", "method")
    line = F.trim(F.regexp_replace("code", r"\s*(?:\{[^}]*\}?|:|=>?|\bdo)?\s*$", ""))
    bare = F.regexp_replace("code", r"^(\s*func)\s+\([^)]*\)", "$1")
    inside = F.regexp_extract(bare, r"[\w$?!>=]\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)", 1)
    parameters = F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x)), lambda x: x != "")
    generic = F.nullif(F.regexp_extract("code", r"(?:[\w$]|=\s)(<[A-Za-z_][^<>()]*(?:<[^<>]*>[^<>()]*)*>)\s*[({=]", 1), F.lit(""))
    some = lambda array: F.when(F.size(array) > 0, array)
    words = F.regexp_extract_all(F.regexp_extract("code", r"^([^(={]*)", 1), F.lit(r"\b(public|private|protected|static|final|abstract|synchronized|native|default)\b"), 1)
    return F.to_json(
        F.struct(
            language.alias("language"), F.when(callable_, line).alias("signature"), F.when(callable_, some(parameters)).alias("parameters"),
            F.when(language.isin("typescript", "tsx"), generic).alias("type_parameters"), F.when(language == "java", some(words)).alias("modifiers"),
            F.when(language.isin("rust", "swift"), F.nullif(F.trim(F.regexp_extract("code", r"->\s*([^{]+)", 1)), F.lit(""))).alias("return_type"),
            F.when(language == "go", F.col("name").rlike("^[A-Z]")).alias("exported"), F.when(language == "rust", F.col("code").rlike(r"^\s*pub\b")).alias("public"),
            some(F.col("decorators")).alias("decorators"), F.col("docstring"), F.col("parent_name"),
        )
    )


def parse_lines(sources: DataFrame) -> DataFrame:
    """Entities of the other languages, line by line."""
    known = [*DEFINITIONS, *SAME]
    rows = sources.where(F.col("language").isin(*known) & (F.length("text") > 0))
    lines = rows.select("repository_id", "file_path", "language", F.posexplode(F.split("text", "\r?\n")).alias("at", "code"))
    hit = F.lit(None).cast("struct<kind:string,name:string>")
    for language in DEFINITIONS:
        hit = F.when(F.col("language").isin(language, *(k for k, v in SAME.items() if v == language)), _definition(language)).otherwise(hit)
    quiet = F.regexp_replace("code", _STRINGS, "\"\"")
    quiet = F.when(F.col("language").isin(*HASH_COMMENTS), F.regexp_replace(quiet, "#.*$", "")).when(F.col("language") == "lua", F.regexp_replace(quiet, "--.*$", "")).otherwise(F.regexp_replace(quiet, r"//.*$|/\*.*?(?:\*/|$)", ""))
    calls = F.regexp_extract_all(quiet, F.lit(r"(?<![\w.$@:>#])([A-Za-z_]\w*[?!]?)\s*\("), 1)
    calls = F.filter(calls, lambda x: ~x.isin(*NO_CALLS))
    aside = F.col("code").rlike(COMMENT_LINE) | F.col("code").rlike(ANNOTATION_LINE)
    no_calls = F.array().cast("array<string>")
    # The explode keeps the definition from being looked for again wherever it is used.
    told = lines.select("*", F.explode(F.array(F.struct(F.when(~aside, hit).alias("d"), aside.alias("aside")))).alias("t")).select("*", "t.d", "t.aside")
    told = told.select("*", F.explode(F.array(F.when(F.col("aside") | ~F.col("code").contains("("), no_calls).otherwise(calls))).alias("calls"))
    told = told.where(F.col("d").isNotNull() | F.col("aside") | (F.size("calls") > 0))
    indent = F.length(F.regexp_extract("code", r"^(\s*)", 1))
    code = F.when(F.col("d").isNotNull() | F.col("aside"), F.col("code"))
    # The lines of a text stay in one task and in order, so one pass with a stack finds what encloses each of them.
    numbered = told.select("repository_id", "file_path", "language", "at", code.alias("code"), "d.kind", "d.name", "calls", indent.alias("indent")).mapInPandas(_enclose, _PASSED)
    upper = F.when(F.upper("name") == F.col("name"), "constant").otherwise("variable")
    kind = (
        F.when((F.col("kind") == "function") & F.col("parent_kind").isin("class", "interface", "enum", "extension", "impl"), "method")
        .when(F.col("kind").isin("extension", "impl", "annotation", "defimpl"), "class").when(F.col("kind") == "macro", "function").when(F.col("kind") == "global", upper).otherwise(F.col("kind"))
    )
    name = (
        F.when(F.col("kind") == "extension", F.concat("name", F.lit("+"))).when(F.col("kind") == "annotation", F.concat(F.lit("@"), "name")).when(F.col("kind") == "defimpl", F.concat("name", F.lit(" (impl)")))
        .when(F.col("kind") == "macro", F.concat(F.lit("macro "), "name")).when(F.col("kind") == "impl", F.regexp_replace("name", r"^(.*?)\s+for\s+(.*)$", "$1 impl $2")).otherwise(F.col("name"))
    )
    named = numbered.select("repository_id", "file_path", "language", "at", "code", kind.alias("kind"), name.alias("name"), "ordinal", "parent_ordinal", "parent_name", "calls", "docstring", "decorators")
    empty = F.array().cast("array<struct<edge_type:string,target_name:string>>")
    bases = F.when(F.col("kind").isin("class", "interface", "enum"), F.coalesce(_bases(), empty)).otherwise(empty)
    called = F.transform("calls", lambda c: F.struct(F.lit("CALLS").alias("edge_type"), c.alias("target_name")))
    return named.select(
        "repository_id", "file_path", "language", F.col("ordinal").cast("int").alias("ordinal"), "parent_ordinal", "kind", "name",
        (F.col("at") + 1).cast("int").alias("line"), "docstring", _metadata().alias("metadata_json"), F.concat(bases, called).alias("relations"), F.lit(None).cast("string").alias("error"),
    )


def parse_sources(sources: DataFrame) -> DataFrame:
    """Entities and errors of (repository_id, file_path, language, text); empty and null texts give no row."""
    return parse_python(sources).unionByName(parse_lines(sources))
