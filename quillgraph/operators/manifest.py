"""What a repository is made of, from its list of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import base_name

# Languages by the suffix of a file name.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx",
    "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "cs": "csharp", "php": "php", "phtml": "php", "rb": "ruby",
    "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "swift": "swift", "scala": "scala", "sc": "scala",
    "ex": "elixir", "exs": "elixir", "lua": "lua", "jl": "julia", "zig": "zig", "groovy": "groovy", "gvy": "groovy", "gsh": "groovy",
}
# Files in the root that tell of a package manager, in order.
PACKAGE_MANAGERS = (
    ("package.json", "npm"), ("yarn.lock", "yarn"), ("pnpm-lock.yaml", "pnpm"), ("Pipfile", "pipenv"), ("poetry.lock", "poetry"),
    ("requirements.txt", "pip"), ("Cargo.toml", "cargo"), ("go.mod", "go-modules"), ("Cargo.lock", "cargo"), ("Gemfile", "bundler"),
    ("composer.json", "composer"), ("build.gradle", "gradle"), ("pom.xml", "maven"), ("Package.swift", "swift-pm"), ("pubspec.yaml", "pub"),
    ("mix.exs", "mix"), ("rebar.config", "rebar3"),
)
# Files in the root that tell of a build system, in order.
BUILD_SYSTEMS = (
    ("Makefile", "make"), ("CMakeLists.txt", "cmake"), ("meson.build", "meson"), ("BUILD", "bazel"), ("BUILD.bazel", "bazel"),
    ("justfile", "just"), ("Taskfile.yml", "taskfile"), ("noxfile.py", "nox"), ("invoke.yaml", "invoke"), ("Rakefile", "rake"),
)
# Files in the root that tell of a monorepo, the first that is there.
MONOREPOS = (("pnpm-workspace.yaml", "pnpm"), ("lerna.json", "lerna"), ("nx.json", "nx"), ("rush.json", "rush"), ("turborepo.json", "turbo"))
# Fixed values: (framework, file, pattern in it or None, by line, weight).
FINGERPRINTS = (
    ("Django", "manage.py", None, False, 0.6), ("Django", "django-admin", None, False, 0.4), ("Django", "requirements.txt", "^django", True, 0.3),
    ("FastAPI", "requirements.txt", "^fastapi", True, 0.5), ("FastAPI", "main.py", r"from\s+fastapi", False, 0.6),
    ("Flask", "requirements.txt", "^flask", True, 0.5),
    ("Spring Boot", "pom.xml", "spring-boot", False, 0.7), ("Spring Boot", "build.gradle", "spring-boot", False, 0.7),
    ("Spring Boot", "application.yml", None, False, 0.3), ("Spring Boot", "application.properties", None, False, 0.3),
    ("Express", "package.json", '"express"', False, 0.7),
    ("Next.js", "package.json", '"next"', False, 0.7), ("Next.js", "next.config.js", None, False, 0.4), ("Next.js", "next.config.ts", None, False, 0.4),
    ("NestJS", "package.json", '"@nestjs/core"', False, 0.7), ("NestJS", "nest-cli.json", None, False, 0.4),
    ("Laravel", "artisan", None, False, 0.6), ("Laravel", "composer.json", '"laravel/framework"', False, 0.7),
    ("Actix Web", "Cargo.toml", "actix-web", False, 0.7), ("Axum", "Cargo.toml", "axum", False, 0.7),
    ("React", "package.json", '"react"', False, 0.5), ("Vue", "package.json", '"vue"', False, 0.5),
    ("Ruby on Rails", "Gemfile", "rails", False, 0.7), ("Ruby on Rails", "bin/rails", None, False, 0.5),
)


def language_of(path):
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    suffix = F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1))
    return F.coalesce(F.try_element_at(names, suffix), F.lit("unknown"))


def language_counts(files: DataFrame) -> DataFrame:
    """(repository_id, language, files)."""
    return files.groupBy("repository_id", language_of("file_path").alias("language")).agg(F.count("*").alias("files"))


def _indicated(files: DataFrame, table: tuple[tuple[str, str], ...]) -> DataFrame:
    rules = files.sparkSession.createDataFrame([(i, f, n) for i, (f, n) in enumerate(table)], "ordinal int, file_path string, name string")
    return files.select("repository_id", "file_path").distinct().join(F.broadcast(rules), "file_path").select("repository_id", "ordinal", "name")


def package_managers(files: DataFrame) -> DataFrame:
    """(repository_id, ordinal, name): one row for each indicator in the root, so that a name may come twice."""
    return _indicated(files, PACKAGE_MANAGERS)


def build_systems(files: DataFrame) -> DataFrame:
    """(repository_id, ordinal, name)."""
    return _indicated(files, BUILD_SYSTEMS)


def monorepos(files: DataFrame) -> DataFrame:
    """(repository_id, tool) of monorepos; ``files`` has (repository_id, file_path, content)."""
    named = _indicated(files, MONOREPOS).groupBy("repository_id").agg(F.min_by("name", "ordinal").alias("tool"))
    workspaces = files.where((F.col("file_path") == "package.json") & F.get_json_object("content", "$.workspaces").isNotNull())
    npm = workspaces.select("repository_id", F.lit("npm-workspaces").alias("tool")).distinct()
    return named.unionByName(npm.join(named.select("repository_id"), "repository_id", "left_anti"))


def fingerprints(files: DataFrame) -> DataFrame:
    """(repository_id, framework, confidence): sum of the weights of the indicators met, one at most.

    One pass over the files: each is held against all indicators of its name.
    """
    checks = [
        F.when((F.col("file_path") == path) & (F.lit(True) if pattern is None else F.col("content").rlike(("(?m)" if by_line else "") + pattern)), F.struct(F.lit(framework).alias("framework"), F.lit(i).alias("rule"), F.lit(weight).alias("weight")))
        for i, (framework, path, pattern, by_line, weight) in enumerate(FINGERPRINTS)
    ]
    named = files.where(F.col("file_path").isin(*dict.fromkeys(path for _, path, *_ in FINGERPRINTS)))
    hits = named.select("repository_id", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("h")).select("repository_id", "h.*").distinct()
    return hits.groupBy("repository_id", "framework").agg(F.round(F.least(F.sum("weight"), F.lit(1.0)), 4).alias("confidence"))


def directory_count(files: DataFrame) -> DataFrame:
    """(repository_id, directories): distinct directories above the files, the root left out."""
    parts = F.split("file_path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = files.where(F.size(parts) > 1).select("repository_id", F.explode(prefixes).alias("directory"))
    return rows.groupBy("repository_id").agg(F.countDistinct("directory").alias("directories"))


def manifests(files: DataFrame) -> DataFrame:
    """(repository_id, manifest_json) from (repository_id, file_path, content)."""
    key = ["repository_id"]
    languages = language_counts(files).groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "files")))).alias("languages"))
    named = lambda rows, name: rows.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name"))), lambda s: s["name"]).alias(name))
    prints = fingerprints(files).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("framework").alias("name"), "confidence"))).alias("frameworks"))
    out = files.groupBy(*key).agg(F.count("*").alias("total_files"))
    for part in (languages, prints, named(package_managers(files), "package_managers"), named(build_systems(files), "build_systems"), monorepos(files).withColumnRenamed("tool", "monorepo_tool"), directory_count(files).withColumnRenamed("directories", "total_dirs")):
        out = out.join(part, key, "left")
    return out.select("repository_id", F.to_json(F.struct(*[c for c in out.columns if c != "repository_id"])).alias("manifest_json"))


def manifest_facts(files: DataFrame) -> DataFrame:
    """(repository_id, fact, name, value): what ``manifests`` tells, a row a fact.

    The value of an indicator is its place in the list, of a framework its
    confidence, else a count.
    """
    fact = lambda rows, kind, name, value: rows.select("repository_id", F.lit(kind).alias("fact"), name.cast("string").alias("name"), value.cast("double").alias("value"))
    none = F.lit(None)
    parts = [
        fact(language_counts(files), "language", F.col("language"), F.col("files")),
        fact(package_managers(files), "package manager", F.col("name"), F.col("ordinal")),
        fact(build_systems(files), "build system", F.col("name"), F.col("ordinal")),
        fact(monorepos(files), "monorepo", F.col("tool"), none),
        fact(fingerprints(files), "framework", F.col("framework"), F.col("confidence")),
        fact(files.groupBy("repository_id").agg(F.count("*").alias("n")), "files", none, F.col("n")),
        fact(directory_count(files), "directories", none, F.col("directories")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
