"""Traversal, degrees, hubs and sub-graphs.

Traversals go level by level: a frontier is joined with the edges and what was
seen before is taken off.  Each level is written to the checkpoint folder, so
the plan of a level doesn't grow with the depth and a lost executor costs no
more than a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import parent_directory
from quillgraph.session import cut


#: A frontier of up to so many ids is sent to the edges; a larger one is joined by a shuffle.
BROADCAST_IDS = 100_000


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b): both ends of every edge in either direction, without self-loops; repeated edges repeat."""
    ends = edges.select(F.col("source_node_id").alias("s"), F.col("target_node_id").alias("t")).where("s <> t")
    turned = F.array(F.struct(F.col("s").alias("a"), F.col("t").alias("b")), F.struct(F.col("t").alias("a"), F.col("s").alias("b")))
    return ends.select(F.explode(turned).alias("e")).select("e.a", "e.b")


def _side(ids: DataFrame, n: int) -> DataFrame:
    """The ids of a frontier of ``n`` rows, broadcast where that is few."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def neighbours(edges: DataFrame, starts: DataFrame, max_depth: int = 1) -> DataFrame:
    """(id, depth): nodes within ``max_depth`` undirected edges of the nearest start, starts at depth 0.

    ``starts`` has (id).  Depths are minimal, also through cycles.  A start
    that no edge touches comes out alone.
    """
    links = both_ways(edges)
    frontier = cut(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in range(1, max_depth + 1):
        n = frontier.count()
        if not n:
            break
        step = links.join(_side(frontier.select("id"), n), F.col("a") == F.col("id")).select(F.col("b").alias("id")).distinct()
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def impact(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(level, id, via_edge): everything that depends on the starts, over incoming edges of any type.

    One row for each edge type over which a node is reached at the level where
    it is first reached.  A start on a cycle is reported again.
    """
    incoming = edges.where(F.col("source_node_id").isNotNull()).select(
        F.col("target_node_id").alias("t"), F.col("source_node_id").alias("dependent"), F.col("edge_type").alias("via_edge")
    )
    # Read at every level: each (target, source, type) once.
    incoming = cut(incoming.distinct())
    frontier = cut(starts.select("id").distinct())
    seen: DataFrame | None = None
    level = 0
    # A node reached over several edge types stands in the frontier as often.
    while max_depth is None or level < max_depth:
        level += 1
        n = frontier.count()
        if not n:
            break
        step = incoming.join(_side(frontier, n), F.col("t") == F.col("id")).select(F.col("dependent").alias("id"), "via_edge").distinct()
        if seen is not None:
            step = step.join(seen.select("id"), "id", "left_anti")
        step = cut(step.select(F.lit(level).alias("level"), "id", "via_edge"))
        seen = step if seen is None else seen.unionByName(step)
        frontier = step.select("id")
    return seen if seen is not None else starts.sparkSession.createDataFrame([], "level int, id long, via_edge string")


def shortest_path(edges: DataFrame, start: int, end: int, max_depth: int = 5) -> DataFrame:
    """(depth, id) along a shortest undirected path of at most ``max_depth`` edges; no row if there is none.

    Of several shortest paths the one with the least predecessor at every step,
    seen from the end, is taken.  Only the path's own nodes come to the driver.
    """
    spark = edges.sparkSession
    schema = "depth int, id long"
    if start == end:
        return spark.createDataFrame([(0, start)], schema)
    links = both_ways(edges)
    levels = [cut(spark.createDataFrame([(start, None)], "id long, parent long"))]
    seen = levels[0].select("id")
    reached = False
    while not reached and len(levels) <= max_depth:
        n = levels[-1].count()
        if not n:
            break
        step = links.join(_side(levels[-1].select("id"), n), F.col("a") == F.col("id")).groupBy("b").agg(F.min("a").alias("parent"))
        step = cut(step.select(F.col("b").alias("id"), "parent").join(seen, "id", "left_anti"))
        levels.append(step)
        seen = seen.unionByName(step.select("id"))
        reached = not step.where(F.col("id") == end).isEmpty()
    if not reached:
        return spark.createDataFrame([], schema)
    path = [end]
    for level in reversed(levels[1:]):
        path.append(level.where(F.col("id") == path[-1]).first()["parent"])
    return spark.createDataFrame(list(enumerate(reversed(path))), schema)


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every node: edges at either end, a self-loop once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source_node_id", "target_node_id"))).alias("id"))
    counts = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def expand_node(edges: DataFrame, node_id: int, repository_id: int | None = None, limit: int = 80) -> DataFrame:
    """(id): the node and its least ``limit - 1`` distinct neighbours."""
    if repository_id is not None:
        edges = edges.where(F.col("repository_id") == repository_id)
    other = F.when(F.col("source_node_id") == node_id, F.col("target_node_id")).otherwise(F.col("source_node_id"))
    near = edges.where((F.col("source_node_id") == node_id) | (F.col("target_node_id") == node_id)).select(other.alias("id"))
    near = near.where(F.col("id") != node_id).distinct().orderBy("id").limit(max(0, limit - 1))
    return edges.sparkSession.createDataFrame([(node_id,)], "id long").unionByName(near)


def hub_nodes(nodes: DataFrame, edges: DataFrame, repository_id: int | None = None, limit: int = 80, offset: int = 0, directory: str | None = None) -> DataFrame:
    """(repository_id, id, stage) of every repository, or of one: hubs (0), their neighbours (1) and nodes of the next degrees (2), ``limit`` in all.

    Hubs are the ``max(5, limit // 8)`` nodes of greatest degree from
    ``offset`` on, below ``directory`` where one is given; their neighbours
    need not lie there.
    """
    if repository_id is not None:
        nodes, edges = (t.where(F.col("repository_id") == repository_id) for t in (nodes, edges))
    chosen = nodes if directory is None else nodes.where(F.col("file_path").ilike(directory.replace("\\", "\\\\") + "%"))
    by_degree = Window.partitionBy("repository_id").orderBy(F.desc("degree"), "id")
    ranked = degree(chosen, edges).join(nodes.select("id", "repository_id"), "id").withColumn("r", F.row_number().over(by_degree))
    ranked = cut(ranked.where(F.col("r") <= 3 * limit + offset))
    # A few rows a repository.
    hubs = ranked.where((F.col("r") > offset) & (F.col("r") <= offset + min(limit, max(5, limit // 8))))
    hub = hubs.select("repository_id", F.col("id").alias("a"))
    around = both_ways(edges).join(hub, "a").select("repository_id", F.col("b").alias("id")).distinct()
    around = around.join(hubs.select("id"), "id", "left_anti").join(nodes.select("id", "repository_id"), ["id", "repository_id"], "left_semi")
    near = around.withColumn("r", F.row_number().over(Window.partitionBy("repository_id").orderBy("id"))).where(F.col("r") <= limit)
    stage = lambda rows, n, order: rows.select("repository_id", "id", F.lit(n).alias("stage"), order.alias("o"))
    staged = stage(hubs, 0, -F.col("degree")).unionByName(stage(near, 1, F.lit(0).cast("long"))).unionByName(stage(ranked, 2, -F.col("degree")))
    first = staged.groupBy("repository_id", "id").agg(F.min(F.struct("stage", "o")).alias("s"))
    order = Window.partitionBy("repository_id").orderBy("s.stage", "s.o", "id")
    return first.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).select("repository_id", "id", F.col("s.stage").alias("stage"))


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``."""
    return edges.join(ids.select(F.col("id").alias("source_node_id")), "source_node_id", "left_semi").join(
        ids.select(F.col("id").alias("target_node_id")), "target_node_id", "left_semi"
    ).select("id", "source_node_id", "target_node_id", "edge_type")


def directory_buckets(nodes: DataFrame) -> DataFrame:
    """(directory, nodes): nodes by the true parent directory of their path."""
    return nodes.where(F.col("file_path").isNotNull()).groupBy(parent_directory("file_path").alias("directory")).agg(F.count("*").alias("nodes"))


def union_pages(*pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages of a client put together, each key once."""
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out.dropDuplicates(keys)


def graph_page(nodes: DataFrame, edges: DataFrame, repository_id: int, page: int = 0, limit: int = 80, node_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all pages up to ``page``: the hubs go on where those of the page before end.

    A type filter applies after the pages are drawn; edges have both ends among
    what is left.  Nodes and edges come once.
    """
    step = min(limit, max(5, limit // 8))
    pages = [hub_nodes(nodes, edges, repository_id, limit, offset=i * step) for i in range(page + 1)]
    ids = union_pages(*pages, keys=["id"]).select("id")
    shown = nodes.join(ids, "id", "left_semi")
    if node_type is not None:
        shown = shown.where(F.col("node_type") == node_type)
    return shown, union_pages(induced_edges(edges, shown.select("id")), keys=["source_node_id", "target_node_id", "edge_type"])


def graph_json(nodes: DataFrame, edges: DataFrame, repository_id: int | None = None, limit: int = 80) -> DataFrame:
    """(repository_id, graph_json) of every repository, or of one: its hubs and what is around, and the totals of the whole.

    The object has nodes by id, the edges between them, the numbers of all
    nodes and edges, nodes by type and by directory.
    """
    if repository_id is not None:
        nodes, edges = (t.where(F.col("repository_id") == repository_id) for t in (nodes, edges))
    drawn = hub_nodes(nodes, edges, None, limit)
    shown = nodes.join(drawn.select("id"), "id", "left_semi")
    key = ["repository_id"]
    listed = lambda rows, name, *columns: rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    inside = induced_edges(edges, drawn.select("id")).join(shown.select(F.col("id").alias("source_node_id"), "repository_id"), "source_node_id")
    types = nodes.groupBy(*key, "node_type").agg(F.count("*").alias("n"))
    folders = nodes.where(F.col("file_path").isNotNull()).groupBy(*key, parent_directory("file_path").alias("directory")).agg(F.count("*").alias("n"))
    parts = [
        nodes.groupBy(*key).agg(F.count("*").alias("total_nodes")),
        edges.groupBy(*key).agg(F.count("*").alias("total_edges")),
        listed(shown, "nodes", "id", "node_type", "name", "file_path"),
        listed(inside, "edges", "id", "source_node_id", "target_node_id", "edge_type"),
        listed(types, "node_types", "node_type", "n"),
        listed(folders, "directories", "directory", "n"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, key, "left")
    return out.select("repository_id", F.to_json(F.struct(*[c for c in out.columns if c != "repository_id"])).alias("graph_json"))
