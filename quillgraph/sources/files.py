"""Scanning a source tree."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import base_name
from quillgraph.operators.manifest import LANGUAGES
from quillgraph.session import cut

# Directories that are never entered.
IGNORED_DIRECTORIES = (
    ".git", "__pycache__", "node_modules", ".venv", "venv", "env", ".env", ".eggs", "dist", "build", "target", ".idea", ".vscode", ".DS_Store",
    ".next", ".nuxt", "vendor", "third_party", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "site-packages", ".git-rewrite",
    ".terraform", "Pods", ".build", "cmake-build-debug", "cmake-build-release",
)
# Suffixes of binary files.
BINARY_SUFFIXES = (
    ".pyc", ".pyo", ".so", ".dll", ".dylib", ".o", ".obj", ".lib", ".a", ".class", ".jar", ".war", ".ear", ".dex", ".apk", ".png", ".jpg", ".jpeg",
    ".gif", ".bmp", ".ico", ".svg", ".ttf", ".otf", ".woff", ".woff2", ".eot", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip",
    ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv", ".wasm",
)
# Suffixes of text files besides those of sources.
TEXT_SUFFIXES = (
    ".md", ".txt", ".rst", ".json", ".yaml", ".yml", ".toml", ".cfg", ".ini", ".conf", ".sh", ".bash", ".zsh", ".fish", ".env", ".gitignore",
    ".dockerignore", ".editorconfig", ".sql", ".graphql", ".css", ".scss", ".less", ".html", ".xml", ".svg", ".lock", ".gradle", ".properties",
)


def ignore_lines(text: str) -> list[str]:
    """Patterns of an ignore file: blank lines and comments left out."""
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]


def matches_pattern(path: Column, patterns: list[str]) -> Column:
    """Whether a glob pattern fits the path, or its last segment where the pattern has no slash; * crosses slashes."""
    out = F.lit(False)
    for p in patterns:
        java = re.sub(r"\(\?s:(.*)\)\\[Zz]$", r"(?s)^(?:\1)$", fnmatch.translate(p)).replace("(?>", "(?:")
        fits = path.rlike(java)
        out = out | (fits if "/" in p else fits | base_name(path).rlike(java))
    return out


def _gitignore_regex(line: str) -> str:
    anchored = "/" in line.rstrip("/")
    body = line.strip("/") if line.endswith("/") or line.startswith("/") else line
    out = ""
    i = 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    inside = "/.*" if line.endswith("/") else "(?:/.*)?"
    return f"^{'' if anchored else '(?:.*/)?'}{out}{inside}$"


def gitignored(path: Column, lines: list[str]) -> Column:
    """Whether a root .gitignore leaves a path out: the last line that fits decides, '!' takes it back."""
    out = F.lit(False)
    for line in lines:
        if line.startswith("!"):
            out = F.when(path.rlike(_gitignore_regex(line[1:])), False).otherwise(out)
        else:
            out = F.when(path.rlike(_gitignore_regex(line)), True).otherwise(out)
    return out


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"^.*(\.[^.]*)$", 1))


def is_binary(path: Column, content: Column) -> Column:
    """By suffix, binary ones first; else by a zero byte among the first 8,192."""
    sources = [f".{s}" for s in LANGUAGES]
    head = F.hex(F.substring(content, 1, 8192))
    return (
        F.when(suffix(path).isin(*BINARY_SUFFIXES), True)
        .when(suffix(path).isin(*TEXT_SUFFIXES, *sources), False)
        .otherwise(head.rlike("^(?:..)*?00"))
    )


#: Levels of folders that one task goes down before the next job takes over.
LEVELS = 4
#: Bytes of contents that a task holds at once, about.
BATCH_BYTES = 32 << 20
_LISTED = "folder string, name string, is_folder boolean, size long"


def read_lines(root: str, name: str) -> list[str]:
    """The lines of one small file in the root of a tree, none where it isn't there."""
    system, base = fs.FileSystem.from_uri(root)
    if system.get_file_info(f"{base}/{name}").type != fs.FileType.File:
        return []
    with system.open_input_stream(f"{base}/{name}") as stream:
        return stream.read().decode("utf-8", "replace").splitlines()


def list_tree(spark: SparkSession, root: str, patterns: list[str] | None = None, gitignore: list[str] | None = None) -> DataFrame:
    """(file_path, size) of the files below ``root``, paths relative to it; contents aren't read.

    Folders are listed by tasks, some levels a job, and ignored ones never
    entered.  Names that begin with a dot, symbolic links, paths that a pattern
    or the root's gitignore leaves out and folders that can't be read don't
    come out.
    """
    root = root.rstrip("/")
    # A folder whose files are all left out needn't be entered, unless a line takes some back.
    closed = not any(x.startswith("!") for x in gitignore or [])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            level, rows = list(batch["folder"]), []
            for depth in range(LEVELS):
                below = []
                for folder in level:
                    try:
                        infos = system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                    except (PermissionError, FileNotFoundError):
                        continue
                    for info in infos:
                        if info.base_name.startswith(".") or (local and os.path.islink(info.path)):
                            continue
                        if info.type == fs.FileType.Directory:
                            if info.base_name not in IGNORED_DIRECTORIES:
                                below.append(f"{folder}/{info.base_name}".lstrip("/"))
                        elif info.type == fs.FileType.File:
                            rows.append((folder, info.base_name, False, info.size))
                level = below
            rows += [(x, None, True, None) for x in level]
            yield pd.DataFrame(rows, columns=["folder", "name", "is_folder", "size"]).astype({"size": "Int64"})

    path = F.concat_ws("/", F.nullif("folder", F.lit("")), "name")
    ignored = lambda p: matches_pattern(p, patterns or []) | gitignored(p, gitignore or [])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier, found = spark.createDataFrame([("",)], "folder string"), None
    while True:
        listed = cut(frontier.mapInPandas(walk, _LISTED))
        files = listed.where("NOT is_folder").select(path.alias("file_path"), "size")
        found = files if found is None else found.unionByName(files)
        frontier = listed.where("is_folder").select("folder")
        if closed:
            frontier = frontier.where(~ignored(F.concat("folder", F.lit("/"))))
        if frontier.isEmpty():
            return found.where(~ignored(F.col("file_path")))
        frontier = frontier.repartition(tasks)


def read_files(files: DataFrame, root: str) -> DataFrame:
    """(file_path, size, content) of the files of a list (file_path) below ``root``; what isn't there gives no row."""
    root = root.rstrip("/")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root)
        columns = ["file_path", "size", "content"]
        for batch in batches:
            rows, held = [], 0
            for path in batch["file_path"]:
                try:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        content = stream.read()
                except OSError:
                    continue
                rows.append((path, len(content), content))
                held += len(content)
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return files.select("file_path").mapInPandas(read, "file_path string, size long, content binary")


def scan_tree(spark: SparkSession, root: str, patterns: list[str] | None = None, gitignore: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """(file_path, size, content) of the text files below ``root``, paths relative to it.

    With ``only``, a table of (file_path), nothing but these paths is read;
    what applies to a tree applies to them too.  Paths are chosen before any
    content is read.  An empty tree gives no row.
    """
    if only is None:
        files = list_tree(spark, root, patterns, gitignore)
    else:
        parts = F.split("file_path", "/")
        inner = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
        files = only.select("file_path").distinct().where(~F.exists(parts, lambda s: s.startswith(".")) & ~F.arrays_overlap(inner, F.array(*map(F.lit, IGNORED_DIRECTORIES))))
        files = files.where(~matches_pattern(F.col("file_path"), patterns or []) & ~gitignored(F.col("file_path"), gitignore or []))
    files = files.where(~suffix("file_path").isin(*BINARY_SUFFIXES)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_files(files, root).where(~is_binary(F.col("file_path"), F.col("content")))
