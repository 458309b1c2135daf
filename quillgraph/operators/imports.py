"""Import statements found in sources and resolved to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What imports look like, tried on every line; the first group is the target.
PATTERNS: dict[str, tuple[str, ...]] = {
    "python": (r"^\s*import\s+(\S+)", r"^\s*from\s+(\S+)\s+import", r"^\s*import\s+(\S+)\s+as\s+\S+"),
    "javascript": (
        r"import\s+(?:\S+\s+from\s+)?['\"]([^'\"]+)['\"]", r"import\s*\(\s*['\"]([^'\"]+)['\"]", r"(?:require|require\.resolve)\s*\(\s*['\"]([^'\"]+)['\"]",
    ),
    "go": (r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"]+)\"\s*$",),
    "rust": (r"^\s*use\s+([^;{]+)", r"^\s*extern\s+crate\s+(\S+)"),
    "java": (r"^\s*import\s+(?:static\s+)?(\S+)\s*;",),
    "kotlin": (r"^\s*import\s+(\S+)",),
    "csharp": (r"^\s*using\s+(?:static\s+)?(\S+)\s*;",),
    "php": (
        r"^\s*use\s+([^;]+)", r"(?:require|include|require_once|include_once)\s*\(\s*['\"]([^'\"]+)['\"]",
        r"(?:require|include|require_once|include_once)\s+['\"]([^'\"]+)['\"]",
    ),
    "ruby": (r"^\s*require\s+['\"]([^'\"]+)['\"]", r"^\s*require_relative\s+['\"]([^'\"]+)['\"]", r"^\s*load\s+['\"]([^'\"]+)['\"]"),
    "c": (r"#\s*include\s+\"([^\"]+)\"", r"#\s*include\s+<([^>]+)>"),
    "swift": (r"^\s*import\s+(?:\w+\s+)?(\S+)",),
    "scala": (r"^\s*import\s+(\S+)",),
    "elixir": (r"^\s*use\s+(\S+)", r"^\s*alias\s+(\S+)", r"^\s*import\s+(\S+)", r"^\s*require\s+(\S+)"),
    "lua": (r"require\s*\(\s*['\"]([^'\"]+)['\"]", r"require\s+['\"]([^'\"]+)['\"]"),
    "julia": (r"^\s*using\s+(\S+)", r"^\s*import\s+(\S+)"),
    "zig": (r"@import\s*\(\s*\"([^\"]+)\"",),
    "groovy": (r"^\s*import\s+(?:static\s+)?(\S+)",),
}
#: Languages that share the patterns of another.
SAME = {"typescript": "javascript", "tsx": "javascript", "cpp": "c"}
#: Where the declarations of a Go file begin; its imports come before.
GO_BODY = r"(?s)\n(?:func|type|var|const)\b.*$"
# Files that stand for their directory.
INDICATORS = ("__init__.py", "index.js", "index.ts", "index.tsx", "mod.rs")


def extract_imports(sources: DataFrame) -> DataFrame:
    """(repository_id, file_path, line, target) of ``sources`` (repository_id, file_path, language, text), multiplicity kept.

    Null and empty texts and other languages give no row.
    """
    # A line that is a string alone is an import only above the declarations.
    text = F.when(F.col("language") == "go", F.regexp_replace("text", GO_BODY, "")).otherwise(F.col("text"))
    numbered = sources.where(F.length("text") > 0).select("repository_id", "file_path", "language", F.posexplode(F.split(text, "\n")).alias("line", "code"))
    found = F.lit(None).cast("array<string>")
    for language, patterns in PATTERNS.items():
        names = [language, *(k for k, v in SAME.items() if v == language)]
        hits = F.concat(*(F.regexp_extract_all("code", F.lit(p), 1) for p in patterns))
        found = F.when(F.col("language").isin(*names), hits).otherwise(found)
    rows = numbered.select("repository_id", "file_path", "language", (F.col("line") + 1).alias("line"), F.explode(found).alias("target"))
    return rows.where(F.trim("target") != "").select("repository_id", "file_path", "language", "line", F.trim("target").alias("target"))


def suffix_index(files: DataFrame) -> DataFrame:
    """(repository_id, suffix, file_path): every suffix of whole segments of each path, in lower case."""
    parts = F.split(F.lower("file_path"), "/")
    starts = F.sequence(F.lit(1), F.size(parts))
    suffixes = F.transform(starts, lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + F.lit(1)), "/"))
    return files.where(F.col("file_path").isNotNull()).select("repository_id", "file_path").distinct().select("repository_id", F.explode(suffixes).alias("suffix"), "file_path")


def _normal(path: Column) -> Column:
    """A path without '.' and 'x/..' segments."""
    empty = F.array().cast("array<string>")
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    up = lambda acc, s: F.when((s == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.when(s == "..", acc).otherwise(F.array_append(acc, s)))
    return F.array_join(F.aggregate(parts, empty, up), "/")


def _shortened(path: Column) -> Column:
    """A path and the shorter ones without its last segments, the longest first: the last may name what is in a file."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def candidates(target: Column, path: Column, language: Column) -> Column:
    """Paths an import in the file ``path`` may mean, the most likely first."""
    folder, own = F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    dots = F.length(F.regexp_extract(target, r"^(\.+)", 1))
    rest = F.replace(F.regexp_replace(target, r"^\.+", ""), F.lit("."), F.lit("/"))
    above = F.concat(folder, F.lit("/"), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), rest)
    relative_python = F.array(_normal(above))
    beside = F.array(_normal(F.concat(folder, F.lit("/"), target)))
    # Of Rust: the module of a file lies in a folder of its name, but for those that stand for their folder.
    inner = F.when(own.isin("mod", "lib", "main"), folder).otherwise(F.concat_ws("/", folder, own))
    ups = F.size(F.regexp_extract_all(target, F.lit(r"(super::)"), 1))
    bare = F.replace(F.regexp_replace(target, r"^(?:(?:crate|self|super)::)+", ""), F.lit("::"), F.lit("/"))
    bare = F.regexp_replace(F.trim(bare), r"\s+as\s+.*$|/\*$", "")
    crate = F.regexp_extract(path, r"^(?:(.*)/)?src/", 1)
    relative_rust = _normal(F.concat(inner, F.lit("/"), F.repeat(F.lit("../"), ups), bare))
    in_crate = _normal(F.concat_ws("/", crate, F.lit("src"), bare))
    # A path into another crate names it first.
    outside = F.regexp_replace(bare, "^[^/]*/", "")
    rust = (
        F.when(target.rlike(r"^(?:self|super)::"), _shortened(relative_rust))
        .when(target.startswith("crate::"), F.concat(_shortened(in_crate), _shortened(bare)))
        .otherwise(F.concat(_shortened(bare), F.array(_normal(F.concat_ws("/", F.lit("src"), bare))), _shortened(_normal(F.concat_ws("/", crate, F.lit("src"), outside)))))
    )
    plain = F.array_distinct(F.array(target, F.replace(target, F.lit("."), F.lit("/"))))
    return (
        F.when((language == "python") & (dots > 0), relative_python)
        .when(target.rlike(r"^\.{1,2}/"), beside)
        .when(language == "rust", F.array_distinct(rust))
        .otherwise(plain)
    )


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, source_path, line, target, target_path, priority) of imports that name files of the repository.

    An exact path comes before a path with a suffix, that before a directory's
    own file, that before a match of the last segments only.  All files that
    match equally well come out, so an import may have several rows.
    Self-imports are dropped.
    """
    # The same import twice on a line counts twice.
    imports = imports.groupBy("repository_id", "file_path", "language", "line", "target").agg(F.count("*").alias("times"))
    asked = imports.select(
        "repository_id", F.col("file_path").alias("source_path"), "line", "target", "times",
        F.posexplode(candidates(F.col("target"), F.col("file_path"), F.col("language"))).alias("nth", "base"),
    )
    asked = asked.withColumn("base", F.lower(F.trim(F.col("base")))).where(F.col("base") != "")
    index = suffix_index(files)
    own = F.lower("file_path") == F.col("suffix")
    without = F.regexp_replace("suffix", r"\.[^./]+$", "")
    folder_file = F.when(F.regexp_extract("suffix", r"([^/]*)$", 1).isin(*INDICATORS), F.regexp_replace("suffix", r"/?[^/]*$", ""))
    keys = index.select(
        "repository_id", "file_path",
        F.explode(
            F.array(
                F.struct(F.col("suffix").alias("key"), F.when(own, 0).otherwise(3).alias("rank")),
                F.struct(without.alias("key"), F.when(own, 1).otherwise(4).alias("rank")),
                F.struct(folder_file.alias("key"), F.when(own, 2).otherwise(5).alias("rank")),
            )
        ).alias("k"),
    ).select("repository_id", "file_path", "k.key", "k.rank").where(F.length("key") > 0)
    keys = keys.groupBy("repository_id", "key", "file_path").agg(F.min("rank").alias("rank"))
    # Of each key the ranks in two steps: the best, and the next for an import whose own file is the only best.
    ranks = keys.groupBy("repository_id", "key").agg(F.sort_array(F.collect_set("rank")).alias("ranks"))
    wanted = asked.join(ranks, (asked["base"] == ranks["key"]) & asked["repository_id"].eqNullSafe(ranks["repository_id"])).select(
        asked["repository_id"], "source_path", "line", "target", "times", "nth", "key", F.explode(F.slice("ranks", 1, 2)).alias("rank")
    )
    # An import needs its best few (rank, candidate) only: all but one of them may stand for its own file.
    order = Window.partitionBy("repository_id", "source_path", "line", "target").orderBy("rank", "nth", "key")
    wanted = wanted.withColumn("_r", F.row_number().over(order)).where("_r <= 4")
    files_of = keys.select(F.col("repository_id").alias("k_repository"), F.col("key").alias("k_key"), F.col("rank").alias("k_rank"), "file_path")
    met = wanted.join(files_of, wanted["repository_id"].eqNullSafe(F.col("k_repository")) & (F.col("key") == F.col("k_key")) & (F.col("rank") == F.col("k_rank")))
    met = met.where(F.col("file_path") != F.col("source_path"))
    first = F.min("_r").over(Window.partitionBy("repository_id", "source_path", "line", "target"))
    best = met.withColumn("_first", first).where("_r = _first").withColumn("_n", F.explode(F.expr("sequence(1L, times)")))
    return best.select("repository_id", "source_path", "line", "target", F.col("file_path").alias("target_path"), F.col("rank").alias("priority"))
