"""Building and maintaining the graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of class names that make a class another kind, the first that fits.
CLASS_KINDS = (
    ("Controller", "controller"), ("Service", "service"), ("Middleware", "middleware"), ("Repository", "repository_layer"),
    ("Repo", "repository_layer"), ("DAO", "repository_layer"), ("Job", "job"), ("Worker", "worker"), ("Queue", "queue"),
)
# Kinds whose parent defines or declares them; of others it contains them.
DEFINED = ("class", "function", "method", "interface", "enum", "api_endpoint")
DECLARED = ("constant", "variable")


def stable_id(*parts: Column | str) -> Column:
    """A positive id that depends on the parts only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 1)


def retyped(kind: Column, name: Column) -> Column:
    """The kind of an entity, classes re-typed by the ending of their name."""
    out = kind
    for ending, other in reversed(CLASS_KINDS):
        out = F.when((kind == "class") & name.endswith(ending), other).otherwise(out)
    return out


def edge_type_for(kind: Column) -> Column:
    return F.when(kind.isin(*DEFINED), "DEFINES").when(kind.isin(*DECLARED), "DECLARES").otherwise("CONTAINS")


def directory_tree(files: DataFrame) -> DataFrame:
    """(repository_id, directory, parent): every directory above a file, the top ones with a null parent."""
    parts = F.split("file_path", "/")
    up_to = F.expr("slice(split(file_path, '/'), 1, n)")
    prefixes = files.where(F.size(parts) > 1).select("repository_id", "file_path", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("n"))
    rows = prefixes.select(
        "repository_id", F.array_join(up_to, "/").alias("directory"), F.when(F.col("n") > 1, F.array_join(F.expr("slice(split(file_path, '/'), 1, n - 1)"), "/")).alias("parent")
    )
    return rows.distinct()


def structure(repository_id: int | None, files: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the directories, files and entities of a repository, or with None of all in the tables' repository_id.

    ``files`` has (file_path); ``entities`` has (file_path, ordinal,
    parent_ordinal, kind, name, metadata_json), the parent null for those on
    the file's top level.  Modules give no node and their children hang on the
    module's own parent.
    """
    if repository_id is not None:
        files, entities = (t.withColumn("repository_id", F.lit(repository_id).cast("long")) for t in (files, entities))
    files = files.select("repository_id", "file_path").distinct()
    tree = directory_tree(files)
    key = lambda kind, path, n: stable_id("repository_id", F.lit(kind), path, F.lit(n) if isinstance(n, int) else n)
    folders = tree.select("repository_id", F.col("directory").alias("file_path"), "parent")
    nothing = F.lit(None).cast("string").alias("metadata_json")
    dir_nodes = folders.select(key("directory", F.col("file_path"), 0).alias("id"), "repository_id", F.lit("directory").alias("node_type"), F.regexp_extract("file_path", "([^/]*)$", 1).alias("name"), "file_path", nothing)
    file_nodes = files.select(key("file", F.col("file_path"), 0).alias("id"), "repository_id", F.lit("file").alias("node_type"), F.col("file_path").alias("name"), "file_path", nothing)

    # Modules may nest: of each file the parents of its modules, and the climb to the first that is no module.
    modules = entities.where(F.col("kind") == "module").groupBy("repository_id", "file_path").agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "parent_ordinal"))).alias("up"))
    modules = modules.toDF("m_repository", "m_path", "up")
    inner = entities.where(F.col("kind") != "module").join(modules, F.col("repository_id").eqNullSafe(F.col("m_repository")) & (F.col("file_path") == F.col("m_path")), "left")
    climb = F.aggregate(F.map_keys("up"), F.col("parent_ordinal"), lambda at, _: F.when(F.map_contains_key("up", F.coalesce(at, F.lit(-1))), F.try_element_at("up", at)).otherwise(at))
    above_module = F.when(F.col("up").isNull(), F.col("parent_ordinal")).otherwise(climb)
    inner = inner.select("repository_id", "file_path", "ordinal", above_module.alias("parent_ordinal"), "kind", "name", "metadata_json")
    entity_nodes = inner.select(key("entity", F.col("file_path"), F.col("ordinal")).alias("id"), "repository_id", retyped(F.col("kind"), F.col("name")).alias("node_type"), "name", "file_path", "metadata_json", "parent_ordinal")
    nodes = dir_nodes.unionByName(file_nodes).unionByName(entity_nodes.drop("parent_ordinal"))

    contained = folders.where(F.col("parent").isNotNull()).select("repository_id", key("directory", F.col("parent"), 0).alias("source_node_id"), key("directory", F.col("file_path"), 0).alias("target_node_id"), F.lit("CONTAINS").alias("edge_type"))
    folder = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
    held = files.where(folder != "").select("repository_id", key("directory", folder, 0).alias("source_node_id"), key("file", F.col("file_path"), 0).alias("target_node_id"), F.lit("CONTAINS").alias("edge_type"))
    above = F.when(F.col("parent_ordinal").isNull(), key("file", F.col("file_path"), 0)).otherwise(key("entity", F.col("file_path"), F.col("parent_ordinal")))
    owned = entity_nodes.select("repository_id", above.alias("source_node_id"), F.col("id").alias("target_node_id"), edge_type_for(F.col("node_type")).alias("edge_type"))
    edges = contained.unionByName(held).unionByName(owned)
    edges = edges.select(stable_id("source_node_id", "target_node_id", "edge_type").alias("id"), "repository_id", "source_node_id", "target_node_id", "edge_type", nothing)
    return nodes, edges


def resolve_names(nodes: DataFrame, relations: DataFrame, distinct: bool = False) -> DataFrame:
    """(repository_id, source_node_id, target_node_id, edge_type) of relations by name.

    ``relations`` has (repository_id, source_name, target_name, edge_type).
    Either name stands for the first node of that name in the repository;
    names without a node and self-loops are dropped and multiplicity is kept.
    """
    first = nodes.where(F.col("name").isNotNull() & ~F.col("node_type").isin("directory", "file")).groupBy("repository_id", "name").agg(F.min("id").alias("node_id"))
    source = first.toDF("repository_id", "source_name", "source_node_id")
    target = first.toDF("repository_id", "target_name", "target_node_id")
    rows = relations.join(source, ["repository_id", "source_name"]).join(target, ["repository_id", "target_name"])
    rows = rows.where("source_node_id <> target_node_id").select("repository_id", "source_node_id", "target_node_id", "edge_type")
    return rows.distinct() if distinct else rows


def without_files(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the nodes of the files in ``gone`` (repository_id, file_path), their edges and vectors."""
    dead = nodes.join(gone.select("repository_id", "file_path").distinct(), ["repository_id", "file_path"], "left_semi").select("id")
    kept = nodes.join(dead, "id", "left_anti")
    left = edges.join(dead.select(F.col("id").alias("source_node_id")), "source_node_id", "left_anti")
    left = left.join(dead.select(F.col("id").alias("target_node_id")), "target_node_id", "left_anti")
    return kept, left.select(*edges.columns), vectors.join(dead.select(F.col("id").alias("node_id")), "node_id", "left_anti")


def upsert_repositories(old: DataFrame, new: DataFrame) -> DataFrame:
    """Repositories merged by path; a null manifest doesn't replace a stored one.

    ``new`` has (path, name, indexed_at, manifest_json).  A new path gets an id
    from its text, a stored one keeps its own.
    """
    n = new.dropDuplicates(["path"]).select("path", F.col("name").alias("n_name"), F.col("indexed_at").alias("n_at"), F.col("manifest_json").alias("n_manifest"))
    return old.join(n, "path", "full").select(
        F.coalesce("id", stable_id("path")).alias("id"), "path", F.coalesce("n_name", "name").alias("name"),
        F.coalesce("n_at", "indexed_at").alias("indexed_at"), F.coalesce("n_manifest", "manifest_json").alias("manifest_json"),
    )


def insert_missing(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` whose keys it doesn't hold."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def replace_rows(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those of the same keys."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").select(*stored.columns).unionByName(new.dropDuplicates(keys).select(*stored.columns))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of equal keys the first in order, combined on the map side."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_first"))
    return first.select("_first.*")


def without_repository(repository_id: int, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without a repository's rows; tables that hang on nodes or commits follow these."""
    out = {}
    for name, table in tables.items():
        column = "id" if name == "repositories" else "repository_id"
        if column in table.columns:
            out[name] = table.where(~F.col(column).eqNullSafe(repository_id))
    if "node_vectors" in tables:
        dead = tables["nodes"].where(F.col("repository_id") == repository_id).select(F.col("id").alias("node_id"))
        out["node_vectors"] = tables["node_vectors"].join(dead, "node_id", "left_anti")
    if "commit_files" in tables:
        dead = tables["commits"].where(F.col("repository_id") == repository_id).select(F.col("id").alias("commit_id"))
        out["commit_files"] = tables["commit_files"].join(dead, "commit_id", "left_anti")
    return out


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node; empty in a sound store."""
    ids = nodes.select("id")
    lone = [edges.join(ids.select(F.col("id").alias(c)), c, "left_anti").select("id", "source_node_id", "target_node_id") for c in ("source_node_id", "target_node_id")]
    return lone[0].unionByName(lone[1]).distinct()
