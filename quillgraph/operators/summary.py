"""Summaries and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import base_name

# Kinds listed in the summary of a file.
LISTED_KINDS = ("class", "function", "method", "interface", "enum", "constant", "variable")


def type_counts(rows: DataFrame, column: str) -> DataFrame:
    """(repository_id, <column>, n)."""
    return rows.groupBy("repository_id", column).agg(F.count("*").alias("n"))


def top_files(nodes: DataFrame, k: int = 10) -> DataFrame:
    """(repository_id, file_path, entities, rank): the files with most entities of every repository."""
    counts = (
        nodes.where(~F.col("node_type").isin("file", "directory") & F.col("file_path").isNotNull())
        .groupBy("repository_id", "file_path")
        .agg(F.count("*").alias("entities"))
    )
    order = Window.partitionBy("repository_id").orderBy(F.desc("entities"), "file_path")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_classes(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """(repository_id, id, name, methods, rank): the classes with most edges to methods or functions."""
    members = nodes.where(F.col("node_type").isin("method", "function")).select(F.col("id").alias("target_node_id"))
    to_members = edges.join(members, "target_node_id", "left_semi").groupBy(F.col("source_node_id").alias("id")).agg(F.count("*").alias("methods"))
    classes = nodes.where(F.col("node_type") == "class").select("id", "repository_id", "name")
    order = Window.partitionBy("repository_id").orderBy(F.desc("methods"), "name", "id")
    return classes.join(to_members, "id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def repository_counts(repositories: DataFrame, nodes: DataFrame, edges: DataFrame, commits: DataFrame) -> DataFrame:
    """(id, name, nodes, edges, commits) of every repository, zero where there is nothing."""
    out = repositories.select("id", "name")
    for name, table in (("nodes", nodes), ("edges", edges), ("commits", commits)):
        counts = table.groupBy(F.col("repository_id").alias("id")).agg(F.count("*").alias(name))
        out = out.join(counts, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def store_info(**tables: DataFrame) -> DataFrame:
    """(table_name, n): rows of every table."""
    out = None
    for name, table in tables.items():
        row = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def file_sections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repository_id, file_path, section, item) of every file node, the item a node's id, or an edge's for calls.

    Sections: entities defined or declared in the file, imports of it and
    importers of it, calls that touch it, and what its entities inherit.
    """
    files = nodes.where(F.col("node_type") == "file").select("id", "repository_id", "file_path")
    ends = nodes.select("id", "node_type", "name", "file_path")
    source = ends.select(F.col("id").alias("source_node_id"), F.col("node_type").alias("s_type"), F.col("name").alias("s_name"), F.col("file_path").alias("s_path"))
    target = ends.select(F.col("id").alias("target_node_id"), F.col("node_type").alias("t_type"), F.col("name").alias("t_name"), F.col("file_path").alias("t_path"))
    typed = edges.select("id", "repository_id", "source_node_id", "target_node_id", "edge_type")
    full = typed.withColumnRenamed("id", "edge_id").join(source, "source_node_id").join(target, "target_node_id")
    here = lambda path: F.col(path).alias("file_path")
    parts = [
        full.where(F.col("edge_type").isin("DEFINES", "DECLARES") & (F.col("s_type") == "file") & F.col("t_type").isin(*LISTED_KINDS)).select("repository_id", here("s_path"), F.lit("entities").alias("section"), F.col("target_node_id").alias("item")),
        full.where(F.col("edge_type") == "IMPORTS").select("repository_id", here("s_path"), F.lit("imports").alias("section"), F.col("target_node_id").alias("item")),
        full.where(F.col("edge_type") == "IMPORTS").select("repository_id", here("t_path"), F.lit("imported by").alias("section"), F.col("source_node_id").alias("item")),
        full.where(F.col("edge_type") == "CALLS").select("repository_id", F.explode(F.array_distinct(F.array("s_path", "t_path"))).alias("file_path"), F.lit("calls").alias("section"), F.col("edge_id").alias("item")),
        full.where(F.col("edge_type").isin("INHERITS", "IMPLEMENTS")).select("repository_id", here("s_path"), F.lit("inherits").alias("section"), F.col("target_node_id").alias("item")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    paths = files.select("repository_id", "file_path").distinct()
    return rows.distinct().join(paths, ["repository_id", "file_path"], "left_semi")


def file_entities(nodes: DataFrame, edges: DataFrame, path: str, names: int = 15) -> DataFrame:
    """(node_type, names): entities of one file, given by its path or its last segment."""
    file = nodes.where((F.col("node_type") == "file") & ((F.col("file_path") == path) | (base_name("file_path") == path))).orderBy((F.col("file_path") == path).desc(), "id").limit(1)
    inside = edges.where(F.col("edge_type").isin("DEFINES", "DECLARES")).join(F.broadcast(file.select(F.col("id").alias("source_node_id"))), "source_node_id", "left_semi")
    entities = nodes.join(inside.select(F.col("target_node_id").alias("id")).distinct(), "id", "left_semi").where(F.col("node_type").isin(*LISTED_KINDS))
    order = Window.partitionBy("node_type").orderBy("name", "id")
    kept = entities.withColumn("r", F.row_number().over(order)).where(F.col("r") <= names)
    return kept.groupBy("node_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda s: s["name"]), ", ").alias("names"))


def repository_summary(repositories: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repository_id, name, path, nodes, edges, section, rank, item, n) of every repository: its types of nodes and edges, largest files and classes.

    Of types the 8 and 6 most frequent; a repository without nodes has one row
    with a null section.
    """
    ranked = lambda rows, k: rows.withColumn("rank", F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("n"), F.col("item").asc_nulls_first()))).where(F.col("rank") <= k)
    part = lambda rows, name: rows.select("repository_id", F.lit(name).alias("section"), "rank", "item", "n")
    kinds = type_counts(nodes, "node_type").withColumnRenamed("node_type", "item")
    links = type_counts(edges, "edge_type").withColumnRenamed("edge_type", "item")
    files = top_files(nodes).select("repository_id", "rank", F.col("file_path").alias("item"), F.col("entities").alias("n"))
    classes = top_classes(nodes, edges).select("repository_id", "rank", F.col("name").alias("item"), F.col("methods").alias("n"))
    sections = part(ranked(kinds, 8), "node types").unionByName(part(ranked(links, 6), "edge types")).unionByName(part(files, "largest files")).unionByName(part(classes, "largest classes"))
    sizes = repositories.select(F.col("id").alias("repository_id"), "name", "path")
    for name, table in (("nodes", nodes), ("edges", edges)):
        counts = table.groupBy("repository_id").agg(F.count("*").alias(name))
        sizes = sizes.join(counts, "repository_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return sizes.join(sections, "repository_id", "left")


def find_repository(repositories: DataFrame, nodes: DataFrame, name: str | None = None, folder: str | None = None) -> DataFrame:
    """(id): the repository of a name or path, else the innermost one that holds a folder, else the one with most nodes; ties by id."""
    if name is not None:
        named = repositories.where((F.col("path") == name) | (F.col("name") == name)).orderBy((F.col("path") == name).desc(), "id").limit(1)
        if not named.isEmpty():
            return named.select("id")
    if folder is not None:
        inside = F.lit(folder.rstrip("/") + "/").startswith(F.concat(F.rtrim("path", F.lit("/")), F.lit("/")))
        holding = repositories.where(F.col("path").isNotNull() & inside).orderBy(F.length("path").desc(), "id").limit(1)
        if not holding.isEmpty():
            return holding.select("id")
    counts = nodes.groupBy(F.col("repository_id").alias("id")).agg(F.count("*").alias("n"))
    return repositories.select("id").join(counts, "id", "left").orderBy(F.col("n").desc_nulls_last(), "id").limit(1).select("id")
