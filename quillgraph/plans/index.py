"""From a source tree to the graph tables, and keeping them in step with it.

A store is a folder of Parquet tables partitioned by repository; indexing a
repository replaces its partitions and no other's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph import tables
from quillgraph.operators import architecture, build, history, imports, manifest, similarity
from quillgraph.session import cut
from quillgraph.sources import ddl, gitlog, parse
from quillgraph.sources import files as tree

#: Tables of a store that are partitioned by repository.
PARTITIONED = ("nodes", "edges", "node_vectors", "commits", "commit_files", "commit_authors", "architecture")
#: The file in the root of a tree that says what isn't indexed.
IGNORE_FILE = ".quillignore"
_ENTITY = ("repository_id", "file_path", "ordinal", "parent_ordinal", "kind", "name", "metadata_json")


def _schema(name: str) -> T.StructType:
    fields = tables.SCHEMAS[name].fields
    own = [] if name == "repositories" or any(f.name == "repository_id" for f in fields) else [T.StructField("repository_id", T.LongType())]
    return T.StructType([*fields, *own])


def open_store(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """The tables of a store by name; a table that isn't there yet is empty."""
    out = {}
    for name in ("repositories", *PARTITIONED):
        schema, path = _schema(name), f"{store}/{name}.parquet"
        df = spark.read.schema(schema).parquet(path) if tables.exists(spark, path) else spark.createDataFrame([], schema)
        out[name] = df.select(*(F.col(f.name).cast(f.dataType) for f in schema))
    return out


def repository_of(spark: SparkSession, path: str) -> int:
    """The id of the repository at a path: it depends on the path only."""
    return spark.range(1).select(build.stable_id(F.lit(path.rstrip("/")))).first()[0]


def _sources(spark: SparkSession, path: str, repository_id: int, only: DataFrame | None = None, ignore_file: str = IGNORE_FILE) -> DataFrame:
    """(repository_id, file_path, language, text) of the text files of a tree; undecodable bytes are replaced.

    The ignore file and the .gitignore in the root say what is left out.
    """
    patterns = tree.ignore_lines("\n".join(tree.read_lines(path, ignore_file)))
    gitignore = tree.ignore_lines("\n".join(tree.read_lines(path, ".gitignore")))
    scanned = tree.scan_tree(spark, path, patterns, gitignore, only)
    return scanned.select(
        F.lit(repository_id).cast("long").alias("repository_id"), "file_path", manifest.language_of("file_path").alias("language"),
        F.decode("content", "UTF-8").alias("text"),
    )


def _entities(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities of definitions and declared tables, definitions with their relations, errors)."""
    parsed = cut(parse.parse_sources(sources))
    defined = parsed.where("error IS NULL")
    entities = defined.select(*_ENTITY).unionByName(ddl.declared_entities(sources, defined).select(*_ENTITY))
    return cut(entities), defined, parsed.where("error IS NOT NULL").select("file_path", "error")


def graph_of(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, errors) of the sources of repositories: structure, imports, and relations by name."""
    entities, defined, errors = _entities(sources)
    nodes, held = build.structure(None, sources.select("repository_id", "file_path"), entities)
    nodes = cut(nodes)
    return nodes, held.unionByName(_relations(nodes, sources, defined)), errors


def _relations(nodes: DataFrame, sources: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of the imports in ``sources`` and the relations of ``entities`` among ``nodes``."""
    files = nodes.where(F.col("node_type") == "file").select("repository_id", "file_path", "id")
    found = imports.resolve_imports(imports.extract_imports(sources), files.select("repository_id", "file_path"))
    source = files.toDF("repository_id", "source_path", "source_node_id")
    target = files.toDF("repository_id", "target_path", "target_node_id")
    imported = found.join(source, ["repository_id", "source_path"]).join(target, ["repository_id", "target_path"])
    imported = imported.select("repository_id", "source_node_id", "target_node_id", F.lit("IMPORTS").alias("edge_type"))
    named = entities.select("repository_id", F.col("name").alias("source_name"), F.explode("relations").alias("r"))
    related = build.resolve_names(nodes, named.select("repository_id", "source_name", F.col("r.target_name").alias("target_name"), F.col("r.edge_type").alias("edge_type")))
    loose = imported.unionByName(related).groupBy("repository_id", "source_node_id", "target_node_id", "edge_type").agg(F.count("*").alias("n"))
    # Repeated relations stay repeated, each with an id of its own.
    loose = loose.withColumn("k", F.explode(F.expr("sequence(1L, n)")))
    return loose.select(
        build.stable_id("source_node_id", "target_node_id", "edge_type", "k").alias("id"), "repository_id", "source_node_id", "target_node_id", "edge_type",
        F.lit(None).cast("string").alias("metadata_json"),
    )


def index_repository(spark: SparkSession, path: str, store: str, name: str | None = None, ignore_file: str = IGNORE_FILE) -> dict[str, int]:
    """Index the tree at ``path`` into ``store``; counts of what was written.

    The repository's id comes from its path, so indexing again replaces it,
    with the vectors and the architecture of the old nodes. An empty tree gives
    a repository without nodes.
    """
    path = path.rstrip("/")
    repository_id = repository_of(spark, path)
    sources = cut(_sources(spark, path, repository_id, ignore_file=ignore_file))
    nodes, edges, errors = graph_of(sources)
    described = manifest.manifests(sources.select("repository_id", "file_path", F.col("text").alias("content"))).select("manifest_json")
    row = spark.createDataFrame([(path, name or path.rsplit("/", 1)[-1])], "path string, name string").withColumn("indexed_at", F.current_timestamp())
    row = row.join(described, how="left") if not described.isEmpty() else row.withColumn("manifest_json", F.lit(None).cast("string"))
    old = open_store(spark, store)
    merged = cut(build.upsert_repositories(old["repositories"], row).select(*tables.SCHEMAS["repositories"].names))
    edges = cut(edges)
    tables.replace_repository(nodes, store, "nodes", repository_id)
    tables.replace_repository(edges, store, "edges", repository_id)
    for stale in ("node_vectors", "architecture"):
        tables.replace_repository(old[stale].limit(0), store, stale, repository_id)
    merged.write.mode("overwrite").parquet(f"{store}/repositories.parquet")
    return {"files": sources.count(), "nodes": nodes.count(), "edges": edges.count(), "errors": errors.count()}


def update_files(spark: SparkSession, path: str, store: str, changed: DataFrame, ignore_file: str = IGNORE_FILE) -> dict[str, int]:
    """Bring the files in ``changed`` (file_path) of a repository up to date: gone ones go, others are read again.

    Only these files are read and parsed, by the tasks, however many they are.
    Ids depend on the file and the place in it, so edges from other files into
    an entity that is still there under its name stay, and those into one that
    is gone go; the vectors of the files' old nodes go too.
    """
    path = path.rstrip("/")
    repository_id = repository_of(spark, path)
    opened = open_store(spark, store)
    own = F.col("repository_id") == repository_id
    before, old = cut(opened["nodes"].where(own)), cut(opened["edges"].where(own))
    touched = changed.select("file_path").distinct()
    sources = cut(_sources(spark, path, repository_id, touched, ignore_file))
    entities, defined, _ = _entities(sources)
    fresh, held = build.structure(None, sources.select("repository_id", "file_path"), entities)
    fresh = cut(fresh)
    gone = before.where(F.col("node_type") != "directory").join(touched, "file_path", "left_semi").select("id", "name")
    # Places that now hold another name: what pointed there points nowhere.
    lost = gone.join(fresh.select("id", "name"), ["id", "name"], "left_anti").select(F.col("id").alias("target_node_id"))
    gone = gone.select("id")
    kept = before.join(gone, "id", "left_anti").select(*before.columns)
    merged = kept.unionByName(fresh.select(*before.columns)).dropDuplicates(["id"])
    # A directory stays while a file lies below it.
    folders = build.directory_tree(merged.where(F.col("node_type") == "file").select("repository_id", "file_path")).select(F.col("directory").alias("file_path")).distinct()
    empty = merged.where(F.col("node_type") == "directory").join(folders, "file_path", "left_anti").select("id")
    merged = cut(merged.join(empty, "id", "left_anti").select(*before.columns))
    ids = merged.select("id")
    stay = old.join(gone.withColumnRenamed("id", "source_node_id"), "source_node_id", "left_anti").join(lost, "target_node_id", "left_anti").select(*old.columns)
    edges = stay.unionByName(held.select(*old.columns)).unionByName(_relations(merged, sources, defined).select(*old.columns)).dropDuplicates(["id"])
    sound = edges.join(ids.select(F.col("id").alias("source_node_id")), "source_node_id", "left_semi").join(ids.select(F.col("id").alias("target_node_id")), "target_node_id", "left_semi")
    sound = cut(sound.select(*old.columns))
    vectors = opened["node_vectors"].where(own)
    vectors = cut(vectors.join(gone.withColumnRenamed("id", "node_id"), "node_id", "left_anti").select(*vectors.columns))
    tables.replace_repository(merged, store, "nodes", repository_id)
    tables.replace_repository(sound, store, "edges", repository_id)
    tables.replace_repository(vectors, store, "node_vectors", repository_id)
    return {"nodes": merged.count(), "edges": sound.count()}


def embed(spark: SparkSession, store: str, encoder: similarity.Encoder) -> tuple[int, int]:
    """Encode the nodes that have no vector of the encoder's model yet: (new, left alone)."""
    opened = open_store(spark, store)
    done = opened["node_vectors"]
    todo = similarity.backlog(opened["nodes"], done, encoder.model)
    made = similarity.encode_nodes(todo, encoder).join(todo.select(F.col("id").alias("node_id"), "repository_id"), "node_id")
    fresh = cut(made.select("node_id", "model", "vector", "repository_id"))
    old = done.where(F.col("model") == encoder.model).count()
    fresh.write.mode("append").partitionBy("repository_id").parquet(f"{store}/node_vectors.parquet")
    return fresh.count(), old


def index_history(spark: SparkSession, path: str, store: str, logs: DataFrame | None = None, max_count: int | None = None) -> dict[str, int]:
    """Put the commits of git logs into the store: commits, their files and authors.

    ``logs`` has (text) of ``git log``; without it the log of the repository at
    ``path`` is read.  Commits that the store holds are left out, and
    ``max_count`` counts new ones.  Author counts grow by the new commits.
    """
    path = path.rstrip("/")
    repository_id = repository_of(spark, path)
    opened = open_store(spark, store)
    own = F.col("repository_id") == repository_id
    held = {name: opened[name].where(own) for name in ("commits", "commit_files", "commit_authors")}
    if logs is None:
        records = gitlog.read_logs(spark.createDataFrame([(repository_id, path)], "id long, path string"))
    else:
        records = gitlog.log_records(logs.select(F.lit(repository_id).cast("long").alias("repository_id"), "text"))
    fresh = cut(gitlog.log_commits(records, held["commits"], max_count))
    files = gitlog.log_files(fresh).withColumn("repository_id", F.lit(repository_id).cast("long"))
    authors = history.add_authors(fresh, held["commit_authors"])
    merged = {
        "commits": held["commits"].unionByName(fresh.select(*held["commits"].columns)),
        "commit_files": held["commit_files"].unionByName(files.select(*held["commit_files"].columns)),
        "commit_authors": authors.select(*held["commit_authors"].columns),
    }
    merged = {name: cut(table) for name, table in merged.items()}
    for name, table in merged.items():
        tables.replace_repository(table, store, name, repository_id)
    return {"new": fresh.count(), **{name: table.count() for name, table in merged.items()}}


def store_architecture(spark: SparkSession, store: str, repository_id: int) -> int:
    """Work out layers, patterns and domains of a repository and keep them in the store; the rows kept."""
    opened = open_store(spark, store)
    own = opened["nodes"].where(F.col("repository_id") == repository_id)
    known = architecture.frameworks(opened["repositories"].where(F.col("id") == repository_id), own)
    found = cut(architecture.layers(architecture.layer_evidence(own, known)))
    rows = cut(architecture.architecture_rows(found, architecture.patterns(found), architecture.domains(own, found)))
    tables.replace_repository(rows, store, "architecture", repository_id)
    return rows.count()
