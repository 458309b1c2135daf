"""Named queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import parsed_metadata
from quillgraph.operators import architecture, build, compress, graph, history, imports, manifest, rules, search, similarity, skew, summary
from quillgraph.plans import router
from quillgraph.session import cut
from quillgraph.sources import gitlog, parse
from quillgraph.streaming import watch
from quillgraph.tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    """Register a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


@query
def p6_node_ends(spark: SparkSession, root: str) -> DataFrame:
    return skew.node_ends(load(spark, root, "edges"))


@query
def p6_edge_types(spark: SparkSession, root: str) -> DataFrame:
    return skew.node_edge_types(load(spark, root, "edges"))


@query
def p6_neighbour_kinds(spark: SparkSession, root: str) -> DataFrame:
    return skew.neighbour_kinds(load(spark, root, "edges"), load(spark, root, "nodes"))


@query
def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return skew.heavy_ends(load(spark, root, "edges"))


_ENDS = """
WITH ends AS (
  SELECT 'source' AS end_role, source_node_id AS node_id, target_node_id AS other, edge_type FROM edges WHERE source_node_id IS NOT NULL
  UNION ALL
  SELECT 'target', target_node_id, source_node_id, edge_type FROM edges WHERE target_node_id IS NOT NULL)
"""
SQL["p6_node_ends"] = _ENDS + "SELECT end_role, node_id, count(*) AS edges, count(DISTINCT other) AS neighbours FROM ends GROUP BY 1, 2"
SQL["p6_edge_types"] = _ENDS + "SELECT end_role, node_id, edge_type, count(*) AS edges FROM ends GROUP BY 1, 2, 3"
SQL["p6_neighbour_kinds"] = _ENDS + (
    ", named AS (SELECT id, min(name) AS name FROM nodes WHERE id IS NOT NULL GROUP BY id) "
    "SELECT end_role, node_id, name, edge_type, count(*) AS edges, count(DISTINCT other) AS neighbours "
    "FROM ends JOIN named ON id = node_id GROUP BY 1, 2, 3, 4"
)
SQL["p6_found"] = _ENDS + (
    "SELECT end_role, node_id FROM ends GROUP BY 1, 2 HAVING count(*) >= 0.02 * (SELECT count(*) FROM edges)"
)


# ---------------------------------------------------------------- search


@query
def ranked_search(spark: SparkSession, root: str) -> DataFrame:
    return search.search_nodes(load(spark, root, "nodes"), load(spark, root, "edges"), "parser")


@query
def ranked_search_all(spark: SparkSession, root: str) -> DataFrame:
    return search.search_nodes(load(spark, root, "nodes"), load(spark, root, "edges"), "stream", limit=None)


@query
def search_by_type(spark: SparkSession, root: str) -> DataFrame:
    return search.search_by_type(load(spark, root, "nodes"), "service")


@query
def resolve_target(spark: SparkSession, root: str) -> DataFrame:
    return search.resolve_target(load(spark, root, "nodes"), "scheduler")


_SCORE = """
WITH refs AS (SELECT target_node_id AS id, count(*) AS refs FROM edges WHERE target_node_id IS NOT NULL GROUP BY 1),
most AS (SELECT max(refs) AS m FROM refs),
weights(t, w) AS (VALUES ('api_endpoint', 1.2), ('controller', 1.1), ('service', 1.0), ('class', 1.0), ('interface', 1.0), ('function', 0.9), ('method', 0.9),
  ('middleware', 1.0), ('repository_layer', 1.0), ('file', 0.7), ('directory', 0.6), ('job', 0.9), ('worker', 0.9), ('queue', 0.9))
SELECT f.id, f.node_type, f.name, f.file_path, round(
  {name_score} * 0.5 + coalesce(w.w, 0.5)::DOUBLE * 0.2
  + CASE WHEN coalesce(m.m, 0) > 0 THEN log2(coalesce(r.refs, 0) + 1) / greatest(log2(m.m + 1), 1.0) ELSE 0.0 END * 0.2
  + 0.1 / sqrt((length(coalesce(f.file_path, '')) - length(replace(coalesce(f.file_path, ''), '/', '')) + 1)::DOUBLE), 4) AS score
FROM {found} f LEFT JOIN refs r ON r.id = f.id LEFT JOIN weights w ON w.t = f.node_type CROSS JOIN most m
"""
SQL["ranked_search"] = _SCORE.format(
    name_score="(CASE WHEN lower(f.name) = 'parser' THEN 1.0 WHEN starts_with(lower(f.name), 'parser') THEN 0.8 WHEN contains(lower(f.name), 'parser') THEN 0.5 ELSE 0.1 END)::DOUBLE",
    found="(SELECT * FROM nodes WHERE name ILIKE '%parser%' ORDER BY CASE WHEN lower(name) = 'parser' THEN 0 WHEN starts_with(lower(name), 'parser') THEN 1 ELSE 2 END, name, id LIMIT 20)",
)
SQL["ranked_search_all"] = _SCORE.format(
    name_score="(CASE WHEN lower(f.name) = 'stream' THEN 1.0 WHEN starts_with(lower(f.name), 'stream') THEN 0.8 WHEN contains(lower(f.name), 'stream') THEN 0.5 ELSE 0.1 END)::DOUBLE",
    found="(SELECT * FROM nodes WHERE name ILIKE '%stream%')",
)
SQL["search_by_type"] = "SELECT id, node_type, name, file_path FROM nodes WHERE node_type = 'service' ORDER BY name, id LIMIT 50"
SQL["resolve_target"] = """
SELECT id, repository_id, node_type, name, file_path FROM (
  SELECT *, CASE WHEN name = 'scheduler' OR file_path = 'scheduler' THEN 1 WHEN name ILIKE '%scheduler%' OR file_path ILIKE '%scheduler%' THEN 2 END AS p FROM nodes)
WHERE p IS NOT NULL ORDER BY p, coalesce(node_type = 'file', false) DESC, id LIMIT 1
"""


# ---------------------------------------------------------------- traversal


def _busiest(spark: SparkSession, root: str) -> DataFrame:
    """The node with most incoming edges."""
    edges = load(spark, root, "edges").where(F.col("target_node_id").isNotNull())
    return edges.groupBy(F.col("target_node_id").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


_BUSIEST = "(SELECT target_node_id AS id FROM edges WHERE target_node_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query
def neighbors_k2(spark: SparkSession, root: str) -> DataFrame:
    return graph.neighbours(load(spark, root, "edges"), _busiest(spark, root), 2)


@query
def neighbors_of_many(spark: SparkSession, root: str) -> DataFrame:
    starts = load(spark, root, "nodes").where(F.col("id") % 100 == 0).select("id")
    return graph.neighbours(load(spark, root, "edges"), starts, 3)


@query
def impact_closure(spark: SparkSession, root: str) -> DataFrame:
    return graph.impact(load(spark, root, "edges"), _busiest(spark, root))


@query
def shortest_path(spark: SparkSession, root: str) -> DataFrame:
    links = load(spark, root, "edges").where("source_node_id <> target_node_id")
    start = links.groupBy(F.col("source_node_id").alias("id")).agg(F.count("*").alias("n")).orderBy("n", "id").first()["id"]
    return graph.shortest_path(load(spark, root, "edges"), start, _busiest(spark, root).first()["id"], 12)


_BALL = """
WITH RECURSIVE links AS (
  SELECT source_node_id AS a, target_node_id AS b FROM edges WHERE source_node_id <> target_node_id
  UNION SELECT target_node_id, source_node_id FROM edges WHERE source_node_id <> target_node_id),
ball(id, depth) AS (
  SELECT id, 0 FROM {starts}
  UNION SELECT l.b, ball.depth + 1 FROM ball JOIN links l ON l.a = ball.id WHERE ball.depth < {depth})
"""
SQL["neighbors_k2"] = _BALL.format(starts=_BUSIEST, depth=2) + "SELECT id, min(depth)::INT AS depth FROM ball GROUP BY id"
SQL["neighbors_of_many"] = _BALL.format(starts="(SELECT id FROM nodes WHERE id % 100 = 0)", depth=3) + "SELECT id, min(depth)::INT AS depth FROM ball GROUP BY id"
SQL["impact_closure"] = """
WITH RECURSIVE up(t, id, via_edge) AS (SELECT DISTINCT target_node_id, source_node_id, edge_type FROM edges WHERE source_node_id IS NOT NULL),
reach(id, level) AS (
  SELECT id, 1 FROM up WHERE t IN (SELECT id FROM {start})
  UNION SELECT up.id, reach.level + 1 FROM reach JOIN up ON up.t = reach.id WHERE reach.level < 60),
first AS (SELECT id, min(level) AS level FROM reach GROUP BY id),
seed AS (SELECT id, 0 AS level FROM {start}),
froms AS (SELECT * FROM first UNION ALL SELECT * FROM seed)
SELECT DISTINCT f.level::INT AS level, f.id, up.via_edge
FROM first f JOIN up ON up.id = f.id JOIN froms g ON g.id = up.t AND g.level = f.level - 1
""".format(start=_BUSIEST)
_FROM = "(SELECT source_node_id AS id FROM edges WHERE source_node_id <> target_node_id GROUP BY 1 ORDER BY count(*), 1 LIMIT 1)"
SQL["shortest_path"] = (
    _BALL.format(starts=_FROM, depth=12)
    + f""", far AS (SELECT id, min(depth) AS depth FROM ball GROUP BY id),
up AS (SELECT l.b AS id, min(l.a) AS parent FROM links l JOIN far x ON x.id = l.b JOIN far y ON y.id = l.a AND y.depth = x.depth - 1 GROUP BY 1),
back(depth, id) AS (SELECT depth, id FROM far WHERE id = (SELECT id FROM {_BUSIEST})
  UNION ALL SELECT back.depth - 1, up.parent FROM back JOIN up ON up.id = back.id)
SELECT depth::INT AS depth, id FROM back"""
)


@query
def node_degree(spark: SparkSession, root: str) -> DataFrame:
    return graph.degree(load(spark, root, "nodes"), load(spark, root, "edges"))


@query
def expand_node(spark: SparkSession, root: str) -> DataFrame:
    return graph.expand_node(load(spark, root, "edges"), _busiest(spark, root).first()["id"])


@query
def hub_nodes(spark: SparkSession, root: str) -> DataFrame:
    return graph.hub_nodes(load(spark, root, "nodes"), load(spark, root, "edges"))


@query
def induced_subgraph(spark: SparkSession, root: str) -> DataFrame:
    hubs = graph.hub_nodes(load(spark, root, "nodes"), load(spark, root, "edges"))
    return graph.induced_edges(load(spark, root, "edges"), hubs)


@query
def dir_buckets(spark: SparkSession, root: str) -> DataFrame:
    return graph.directory_buckets(load(spark, root, "nodes"))


@query
def dir_tree(spark: SparkSession, root: str) -> DataFrame:
    files = load(spark, root, "nodes").where((F.col("node_type") == "file") & F.col("file_path").isNotNull())
    return build.directory_tree(files.select("repository_id", "file_path"))


_DEGREE = """
ends AS (SELECT source_node_id AS id FROM edges UNION ALL SELECT target_node_id FROM edges WHERE source_node_id <> target_node_id),
deg AS (SELECT n.id, n.repository_id, count(e.id) AS degree FROM nodes n LEFT JOIN ends e ON e.id = n.id GROUP BY 1, 2)
"""
_HUBS = f"""
{_DEGREE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY degree DESC, id) AS r FROM deg),
hubs AS (SELECT * FROM ranked WHERE r <= 10),
around AS (SELECT DISTINCT h.repository_id, l.b AS id FROM hubs h JOIN (
    SELECT source_node_id AS a, target_node_id AS b FROM edges UNION ALL SELECT target_node_id, source_node_id FROM edges) l ON l.a = h.id
  JOIN nodes n ON n.id = l.b AND n.repository_id = h.repository_id WHERE l.b NOT IN (SELECT id FROM hubs)),
near AS (SELECT repository_id, id, row_number() OVER (PARTITION BY repository_id ORDER BY id) AS r FROM around),
staged AS (SELECT repository_id, id, 0 AS stage, -degree AS o FROM hubs UNION ALL SELECT repository_id, id, 1, 0 FROM near WHERE r <= 80
  UNION ALL SELECT repository_id, id, 2, -degree FROM ranked WHERE r <= 240),
first AS (SELECT repository_id, id, min(stage) AS stage, arg_min(o, stage) AS o FROM staged GROUP BY 1, 2),
hub_set AS (SELECT repository_id, id, stage FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY stage, o, id) AS k FROM first) WHERE k <= 80)
"""
SQL["node_degree"] = f"WITH {_DEGREE} SELECT id, degree FROM deg"
SQL["expand_node"] = f"""
WITH s AS (SELECT id FROM {_BUSIEST}),
o AS (SELECT DISTINCT CASE WHEN source_node_id = s.id THEN target_node_id ELSE source_node_id END AS id
  FROM edges, s WHERE source_node_id = s.id OR target_node_id = s.id)
SELECT id FROM s UNION ALL SELECT id FROM (SELECT id FROM o WHERE id NOT IN (SELECT id FROM s) ORDER BY id LIMIT 79)
"""
SQL["hub_nodes"] = f"WITH {_HUBS} SELECT repository_id, id, stage::INT AS stage FROM hub_set"
SQL["induced_subgraph"] = f"""
WITH {_HUBS} SELECT id, source_node_id, target_node_id, edge_type FROM edges
WHERE source_node_id IN (SELECT id FROM hub_set) AND target_node_id IN (SELECT id FROM hub_set)
"""
SQL["dir_buckets"] = """
SELECT CASE WHEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(file_path, '^(.*)/[^/]*$', 1) END AS directory, count(*) AS nodes
FROM nodes WHERE file_path IS NOT NULL GROUP BY 1
"""
SQL["dir_tree"] = """
WITH f AS (SELECT DISTINCT repository_id, string_split(file_path, '/') AS p FROM nodes WHERE node_type = 'file' AND file_path IS NOT NULL),
n AS (SELECT repository_id, p, unnest(range(1, len(p))) AS k FROM f)
SELECT DISTINCT repository_id, array_to_string(p[1:k], '/') AS directory, CASE WHEN k > 1 THEN array_to_string(p[1:k - 1], '/') END AS parent FROM n
"""


# ---------------------------------------------------------------- summaries


@query
def node_type_counts(spark: SparkSession, root: str) -> DataFrame:
    return summary.type_counts(load(spark, root, "nodes"), "node_type")


@query
def edge_type_counts(spark: SparkSession, root: str) -> DataFrame:
    return summary.type_counts(load(spark, root, "edges"), "edge_type")


@query
def top_files(spark: SparkSession, root: str) -> DataFrame:
    return summary.top_files(load(spark, root, "nodes"))


@query
def top_classes(spark: SparkSession, root: str) -> DataFrame:
    return summary.top_classes(load(spark, root, "nodes"), load(spark, root, "edges"))


@query
def repo_counts(spark: SparkSession, root: str) -> DataFrame:
    return summary.repository_counts(*(load(spark, root, t) for t in ("repositories", "nodes", "edges", "commits")))


@query
def db_info(spark: SparkSession, root: str) -> DataFrame:
    return summary.store_info(**{t: load(spark, root, t) for t in ("repositories", "nodes", "edges", "node_vectors", "commits")})


@query
def file_summary(spark: SparkSession, root: str) -> DataFrame:
    return summary.file_sections(load(spark, root, "nodes"), load(spark, root, "edges"))


@query
def repository_summary(spark: SparkSession, root: str) -> DataFrame:
    return summary.repository_summary(*(load(spark, root, t) for t in ("repositories", "nodes", "edges")))


@query
def graph_json(spark: SparkSession, root: str) -> DataFrame:
    return graph.graph_json(load(spark, root, "nodes"), load(spark, root, "edges"))


SQL["node_type_counts"] = "SELECT repository_id, node_type, count(*) AS n FROM nodes GROUP BY 1, 2"
SQL["edge_type_counts"] = "SELECT repository_id, edge_type, count(*) AS n FROM edges GROUP BY 1, 2"
SQL["top_files"] = """
SELECT repository_id, file_path, entities, rank::INT AS rank FROM (
  SELECT repository_id, file_path, count(*) AS entities, row_number() OVER (PARTITION BY repository_id ORDER BY count(*) DESC, file_path) AS rank
  FROM nodes WHERE node_type NOT IN ('file', 'directory') AND file_path IS NOT NULL GROUP BY 1, 2) WHERE rank <= 10
"""
SQL["top_classes"] = """
SELECT repository_id, id, name, methods, rank::INT AS rank FROM (
  SELECT c.repository_id, c.id, c.name, count(*) AS methods, row_number() OVER (PARTITION BY c.repository_id ORDER BY count(*) DESC, c.name, c.id) AS rank
  FROM nodes c JOIN edges e ON e.source_node_id = c.id
  WHERE c.node_type = 'class' AND e.target_node_id IN (SELECT id FROM nodes WHERE node_type IN ('method', 'function')) GROUP BY 1, 2, 3) WHERE rank <= 5
"""
SQL["repo_counts"] = """
SELECT r.id, r.name, (SELECT count(*) FROM nodes n WHERE n.repository_id = r.id) AS nodes,
  (SELECT count(*) FROM edges e WHERE e.repository_id = r.id) AS edges, (SELECT count(*) FROM commits c WHERE c.repository_id = r.id) AS commits FROM repositories r
"""
SQL["db_info"] = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("repositories", "nodes", "edges", "node_vectors", "commits"))
SQL["file_summary"] = """
WITH full_e AS (
  SELECT e.id AS eid, e.repository_id, e.edge_type, s.id AS sid, s.node_type AS st, s.file_path AS sp, t.id AS tid, t.node_type AS tt, t.file_path AS tp
  FROM edges e JOIN nodes s ON s.id = e.source_node_id JOIN nodes t ON t.id = e.target_node_id),
rows_ AS (
  SELECT repository_id, sp AS file_path, 'entities' AS section, tid AS item FROM full_e WHERE edge_type IN ('DEFINES', 'DECLARES') AND st = 'file'
    AND tt IN ('class', 'function', 'method', 'interface', 'enum', 'constant', 'variable')
  UNION SELECT repository_id, sp, 'imports', tid FROM full_e WHERE edge_type = 'IMPORTS'
  UNION SELECT repository_id, tp, 'imported by', sid FROM full_e WHERE edge_type = 'IMPORTS'
  UNION SELECT repository_id, sp, 'calls', eid FROM full_e WHERE edge_type = 'CALLS'
  UNION SELECT repository_id, tp, 'calls', eid FROM full_e WHERE edge_type = 'CALLS'
  UNION SELECT repository_id, sp, 'inherits', tid FROM full_e WHERE edge_type IN ('INHERITS', 'IMPLEMENTS')),
files AS (SELECT DISTINCT repository_id, file_path FROM nodes WHERE node_type = 'file' AND file_path IS NOT NULL)
SELECT repository_id, file_path, section, item FROM rows_ JOIN files USING (repository_id, file_path)
"""


SQL["repository_summary"] = f"""
WITH parts AS (
  SELECT repository_id, 'node types' AS section, rank, item, n FROM (SELECT repository_id, node_type AS item, count(*) AS n,
    row_number() OVER (PARTITION BY repository_id ORDER BY count(*) DESC, node_type NULLS FIRST) AS rank FROM nodes GROUP BY 1, 2) WHERE rank <= 8
  UNION ALL SELECT repository_id, 'edge types', rank, item, n FROM (SELECT repository_id, edge_type AS item, count(*) AS n,
    row_number() OVER (PARTITION BY repository_id ORDER BY count(*) DESC, edge_type NULLS FIRST) AS rank FROM edges GROUP BY 1, 2) WHERE rank <= 6
  UNION ALL SELECT repository_id, 'largest files', rank, file_path, entities FROM ({SQL["top_files"]})
  UNION ALL SELECT repository_id, 'largest classes', rank, name, methods FROM ({SQL["top_classes"]}))
SELECT r.id AS repository_id, r.name, r.path, (SELECT count(*) FROM nodes n WHERE n.repository_id = r.id) AS nodes,
  (SELECT count(*) FROM edges e WHERE e.repository_id = r.id) AS edges, section, rank::INT AS rank, item, n
FROM repositories r LEFT JOIN parts p ON p.repository_id = r.id
"""


# ---------------------------------------------------------------- history


@query
def file_history(spark: SparkSession, root: str) -> DataFrame:
    return history.file_history(load(spark, root, "commits"), load(spark, root, "commit_files"), "CHANGELOG.md")


@query
def co_change(spark: SparkSession, root: str) -> DataFrame:
    return history.co_change(load(spark, root, "commits"), load(spark, root, "commit_files"), "CHANGELOG.md")


@query
def author_impact(spark: SparkSession, root: str) -> DataFrame:
    return history.author_impact(load(spark, root, "commits"), load(spark, root, "commit_files"))


@query
def why_introduced(spark: SparkSession, root: str) -> DataFrame:
    return history.introductions(load(spark, root, "commits"), load(spark, root, "commit_files"))


@query
def list_authors(spark: SparkSession, root: str) -> DataFrame:
    return history.list_authors(load(spark, root, "commit_authors"))


@query
def author_counts(spark: SparkSession, root: str) -> DataFrame:
    return history.count_authors(load(spark, root, "commits"), load(spark, root, "commit_authors"))


@query
def author_summary(spark: SparkSession, root: str) -> DataFrame:
    return history.author_summary(*(load(spark, root, t) for t in ("commits", "commit_files", "commit_authors")))


SQL["author_summary"] = """
WITH r AS (SELECT c.author, f.commit_id, f.file_path FROM commit_files f JOIN commits c ON c.id = f.commit_id WHERE f.file_path IS NOT NULL AND c.author IS NOT NULL),
k AS (SELECT name, min(email) AS email, max(commit_count) AS total FROM commit_authors GROUP BY 1)
SELECT author, count(DISTINCT commit_id) AS commits, count(*) AS changes, count(DISTINCT file_path) AS files, any_value(email) AS email, any_value(total) AS total
FROM r LEFT JOIN k ON k.name = r.author GROUP BY author
"""
_TS = "coalesce(try_strptime(committed_at, '%Y-%m-%d %H:%M:%S %z'), CASE WHEN committed_at LIKE '%T%Z' THEN try_strptime(replace(committed_at, 'Z', '+0000'), '%Y-%m-%dT%H:%M:%S%z') END)"
SQL["file_history"] = f"""
SELECT c.id, hash, author, message, {_TS} AS committed_ts, change_type FROM commits c JOIN commit_files f ON f.commit_id = c.id
WHERE file_path = 'CHANGELOG.md' ORDER BY committed_ts DESC NULLS LAST, c.id, change_type NULLS FIRST LIMIT 30
"""
SQL["co_change"] = """
SELECT f.file_path, count(*) AS n, min(change_type) AS change_type FROM commit_files f JOIN commits c ON c.id = f.commit_id
WHERE f.file_path <> 'CHANGELOG.md' AND f.commit_id IN (SELECT commit_id FROM commit_files WHERE file_path = 'CHANGELOG.md')
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20
"""
SQL["author_impact"] = """
SELECT author, file_path, changes, commits, rank::INT AS rank FROM (
  SELECT author, file_path, count(*) AS changes, count(DISTINCT commit_id) AS commits, row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, file_path) AS rank
  FROM commit_files f JOIN commits c ON c.id = f.commit_id WHERE author IS NOT NULL AND file_path IS NOT NULL GROUP BY 1, 2) WHERE rank <= 10
"""
SQL["why_introduced"] = f"""
SELECT repository_id, file_path, hash, author, committed_ts FROM (
  SELECT *, row_number() OVER (PARTITION BY repository_id, file_path ORDER BY committed_ts ASC NULLS LAST, id) AS r FROM (
    SELECT c.repository_id, f.file_path, c.id, hash, author, {_TS} AS committed_ts FROM commits c JOIN commit_files f ON f.commit_id = c.id WHERE f.file_path IS NOT NULL))
WHERE r = 1
"""
SQL["list_authors"] = "SELECT id, name, email, commit_count FROM commit_authors ORDER BY commit_count DESC NULLS LAST, name NULLS FIRST, id LIMIT 20"
SQL["author_counts"] = """
WITH s AS (SELECT repository_id, email, count(DISTINCT hash) AS seen, min(author) AS seen_name FROM commits WHERE email IS NOT NULL GROUP BY 1, 2),
o AS (SELECT repository_id, email, coalesce(max(commit_count), 0) AS stored, min(name) AS name FROM commit_authors WHERE email IS NOT NULL GROUP BY 1, 2)
SELECT repository_id, email, coalesce(name, seen_name) AS name, coalesce(seen, stored) AS commit_count FROM o FULL JOIN s USING (repository_id, email)
"""


# ---------------------------------------------------------------- architecture


def _layers(spark: SparkSession, root: str) -> DataFrame:
    return cut(architecture.layers(architecture.layer_evidence(load(spark, root, "nodes"))))


@query
def layer_confidence(spark: SparkSession, root: str) -> DataFrame:
    return architecture.layers(architecture.layer_evidence(load(spark, root, "nodes")))


@query
def layer_examples(spark: SparkSession, root: str) -> DataFrame:
    return architecture.layer_examples(architecture.layer_evidence(load(spark, root, "nodes")))


@query
def layer_kinds(spark: SparkSession, root: str) -> DataFrame:
    return architecture.layer_kinds(architecture.layer_evidence(load(spark, root, "nodes")))


@query
def flow_examples(spark: SparkSession, root: str) -> DataFrame:
    return architecture.flow_examples(load(spark, root, "edges"), load(spark, root, "nodes"), _layers(spark, root))


@query
def pattern_match(spark: SparkSession, root: str) -> DataFrame:
    return architecture.patterns(_layers(spark, root))


@query
def framework_scores(spark: SparkSession, root: str) -> DataFrame:
    return architecture.frameworks(load(spark, root, "repositories"), load(spark, root, "nodes"))


@query
def framework_patterns(spark: SparkSession, root: str) -> DataFrame:
    # How well each repository fits the pattern of every framework of the catalog.
    every = F.explode(F.array(*(F.lit(f) for f, *_ in rules.FRAMEWORK_PATTERNS)))
    known = load(spark, root, "repositories").select(F.col("id").alias("repository_id"), every.alias("framework"), F.lit(1.0).alias("confidence"))
    return architecture.framework_patterns(_layers(spark, root), known)


@query
def file_layers(spark: SparkSession, root: str) -> DataFrame:
    return architecture.file_layers(load(spark, root, "nodes"), _layers(spark, root))


@query
def flow_matrix(spark: SparkSession, root: str) -> DataFrame:
    return architecture.layer_flows(load(spark, root, "edges"), load(spark, root, "nodes"), _layers(spark, root))


#: Directions asked for: those expected of any repository, and tests' and controllers' towards what they use.
DIRECTIONS = (*rules.EXPECTED_FLOWS, ("testing", "infrastructure"), ("testing", "controller"), ("controller", "infrastructure"), ("testing", "presentation"))


@query
def flow_directions(spark: SparkSession, root: str) -> DataFrame:
    flows = architecture.layer_flows(load(spark, root, "edges"), load(spark, root, "nodes"), _layers(spark, root))
    return architecture.expected_flows(cut(flows), DIRECTIONS)


@query
def domain_coverage(spark: SparkSession, root: str) -> DataFrame:
    return architecture.domains(load(spark, root, "nodes"), _layers(spark, root))


@query
def architecture_rows(spark: SparkSession, root: str) -> DataFrame:
    found = _layers(spark, root)
    return architecture.architecture_rows(found, architecture.patterns(found), architecture.domains(load(spark, root, "nodes"), found))


def _values(table: tuple) -> str:
    return ", ".join(f"({i}, '{k}', '{layer}', {w}::DOUBLE)" for i, (k, layer, w) in enumerate(table))


_ALIAS = "CASE layer " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.ALIASES) + " ELSE layer END"
_EVIDENCE = f"""
cr(o, k, layer, w) AS (VALUES {_values(rules.CLASS_RULES)}), fr(o, k, layer, w) AS (VALUES {_values(rules.FILE_RULES)}), dr(o, k, layer, w) AS (VALUES {_values(rules.DIRECTORY_RULES)}),
n AS (SELECT *, replace(lower(name), '-', '_') AS l, regexp_replace(lower(regexp_extract(name, '([^/]*)$', 1)), '(.)\\.[^.]*$', '\\1') AS st FROM nodes WHERE name IS NOT NULL),
named AS (SELECT n.*, cr.o, cr.layer, cr.w * CASE WHEN ends_with(l, k) THEN 1.0::DOUBLE WHEN starts_with(l, k) THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM n JOIN cr ON contains(l, k)),
filed AS (SELECT n.*, fr.o, fr.layer, fr.w AS weight FROM n JOIN fr ON CASE WHEN length(k) <= 3 THEN contains('_' || st || '_', '_' || k || '_') ELSE contains(st, k) END WHERE node_type = 'file'),
ev AS (
  SELECT repository_id, {_ALIAS} AS layer, kind, name AS source, weight FROM (
    SELECT repository_id, layer, 'class_naming' AS kind, name, weight FROM named WHERE node_type IN ('class', 'interface', 'enum') AND weight >= 0.6
    UNION ALL SELECT repository_id, 'data', 'interface_naming', name, 0.7::DOUBLE FROM n WHERE node_type = 'interface' AND regexp_matches(name, '^I[A-Z]')
    UNION ALL SELECT repository_id, 'business', 'interface_naming', name, 0.6::DOUBLE FROM n WHERE node_type IN ('class', 'interface', 'enum') AND regexp_matches(name, '^Abstract[A-Z]')
    UNION ALL SELECT repository_id, layer, 'function_naming', name, weight * 0.8::DOUBLE FROM named WHERE node_type IN ('function', 'method') AND weight >= 0.7
    UNION ALL SELECT repository_id, layer, 'file_naming', name, weight FROM filed
    UNION ALL SELECT repository_id, dr.layer, 'directory', name, dr.w FROM n JOIN dr ON lower(name) = k WHERE node_type = 'directory')),
layers AS (
  SELECT repository_id, layer, round(least((avg(weight) * 0.4 + max(weight) * 0.6) * least(count(DISTINCT source) / 3.0::DOUBLE, 1.0::DOUBLE), 1.0::DOUBLE), 2) AS confidence,
    count(*) AS entities, count(DISTINCT source) AS sources FROM ev GROUP BY 1, 2)
"""
SQL["layer_confidence"] = f"WITH {_EVIDENCE} SELECT * FROM layers"
SQL["layer_kinds"] = f"WITH {_EVIDENCE} SELECT repository_id, layer, kind, count(*) AS n FROM ev GROUP BY 1, 2, 3"
SQL["layer_examples"] = f"""
WITH {_EVIDENCE}, d AS (SELECT DISTINCT repository_id, layer, source FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY repository_id, layer ORDER BY source) AS r FROM d)
SELECT repository_id, layer, string_agg(source, ', ' ORDER BY source) AS examples FROM r WHERE r <= 8 GROUP BY 1, 2
"""
_PATTERN_VALUES = ", ".join(f"('{p}', '{layer}', {len(ls)})" for p, *ls in rules.PATTERNS for layer in ls)
SQL["pattern_match"] = f"""
WITH {_EVIDENCE}, asked(pattern, layer, n) AS (VALUES {_PATTERN_VALUES})
SELECT repository_id, pattern, round(avg(confidence) * (count(*) / n::DOUBLE), 2) AS confidence, count(*) AS matched
FROM layers JOIN asked USING (layer) GROUP BY repository_id, pattern, n HAVING count(*) / n::DOUBLE >= 0.5
"""
_FILE_LAYERS = f"""{_EVIDENCE},
f AS (SELECT DISTINCT repository_id, file_path FROM nodes WHERE node_type = 'file' AND file_path IS NOT NULL),
fs AS (SELECT *, regexp_replace(lower(regexp_extract(file_path, '([^/]*)$', 1)), '(.)\\.[^.]*$', '\\1') AS st FROM f),
seg AS (SELECT repository_id, file_path, unnest(string_split(file_path, '/')[1:-2]) AS s FROM f),
scored AS (SELECT fs.repository_id, fs.file_path, fr.layer, fr.w AS weight, fr.o FROM fs JOIN fr ON CASE WHEN length(k) <= 3 THEN contains('_' || st || '_', '_' || k || '_') ELSE contains(st, k) END),
hits AS (
  SELECT * FROM scored
  UNION ALL SELECT repository_id, file_path, layer, weight, o + 2000 FROM named WHERE node_type IN ('class', 'interface', 'enum') AND weight >= 0.6 AND file_path IS NOT NULL
  UNION ALL SELECT repository_id, file_path, dr.layer, dr.w, dr.o + 1000 FROM seg JOIN dr ON lower(s) = k),
best AS (SELECT repository_id, file_path, layer FROM (
  SELECT h.*, row_number() OVER (PARTITION BY repository_id, file_path ORDER BY weight DESC, o) AS r FROM hits h JOIN layers USING (repository_id, layer)) WHERE r = 1),
placed AS (SELECT n.id, n.repository_id, b.layer FROM nodes n JOIN best b USING (repository_id, file_path) WHERE node_type = 'file'),
imp AS (SELECT DISTINCT source_node_id, target_node_id FROM edges WHERE edge_type = 'IMPORTS'),
flows AS (SELECT s.repository_id, s.layer AS source_layer, t.layer AS target_layer, count(*) AS n
  FROM imp JOIN placed s ON s.id = source_node_id JOIN placed t ON t.id = target_node_id WHERE s.layer <> t.layer GROUP BY 1, 2, 3)
"""
SQL["file_layers"] = f"WITH {_FILE_LAYERS} SELECT repository_id, file_path, layer FROM best"
SQL["flow_matrix"] = f"WITH {_FILE_LAYERS} SELECT * FROM flows"
SQL["flow_examples"] = f"""
WITH {_FILE_LAYERS}, x AS (SELECT DISTINCT s.repository_id, s.layer AS source_layer, t.layer AS target_layer, a.file_path AS source_path, b.file_path AS target_path
  FROM imp JOIN placed s ON s.id = source_node_id JOIN placed t ON t.id = target_node_id JOIN nodes a ON a.id = s.id JOIN nodes b ON b.id = t.id WHERE s.layer <> t.layer)
SELECT repository_id, source_layer, target_layer, source_path, target_path FROM (
  SELECT *, row_number() OVER (PARTITION BY repository_id, source_layer, target_layer ORDER BY source_path, target_path) AS r FROM x) WHERE r <= 3
"""
_DIRECTIONS = ", ".join(f"('{a}', '{b}')" for a, b in DIRECTIONS)
SQL["flow_directions"] = f"""
WITH {_FILE_LAYERS}, d(source_layer, target_layer) AS (VALUES {_DIRECTIONS}),
x AS (SELECT repository_id, source_layer, target_layer, n AS forward, 0 AS reverse FROM flows JOIN d USING (source_layer, target_layer)
  UNION ALL SELECT repository_id, d.source_layer, d.target_layer, 0, n FROM flows JOIN d ON flows.source_layer = d.target_layer AND flows.target_layer = d.source_layer)
SELECT repository_id, source_layer, target_layer, sum(forward)::BIGINT AS forward, sum(reverse)::BIGINT AS reverse, sum(forward) >= sum(reverse) AS expected FROM x GROUP BY 1, 2, 3
"""
_FRAMEWORK_VALUES = ", ".join(f"('{f}', {'NULL' if c is None else c}::DOUBLE, '{layer}', {len(ls)})" for f, c, *ls in rules.FRAMEWORK_PATTERNS for layer in ls)
SQL["framework_patterns"] = f"""
WITH {_EVIDENCE}, asked(framework, fixed, layer, n) AS (VALUES {_FRAMEWORK_VALUES})
SELECT repository_id, framework, coalesce(fixed, round(sum(confidence) / n::DOUBLE, 2)) AS confidence FROM layers JOIN asked USING (layer)
WHERE repository_id IN (SELECT id FROM repositories) GROUP BY repository_id, framework, fixed, n
"""
_segments = ", ".join(f"('{f}', '{h}', {w}::DOUBLE)" for f, h, w in rules.FRAMEWORK_SEGMENTS)
_hints = ", ".join(f"('{f}', '{h}', {w}::DOUBLE)" for f, h, w in rules.FRAMEWORK_FILES)
SQL["framework_scores"] = f"""
WITH seg(framework, hint, w) AS (VALUES {_segments}), hint(framework, hint, w) AS (VALUES {_hints}),
j AS (SELECT id AS repository_id, unnest(from_json(manifest_json::JSON -> '$.frameworks', '[{{"name":"VARCHAR","confidence":"DOUBLE"}}]')) AS f FROM repositories WHERE json_valid(manifest_json)),
stated AS (SELECT repository_id, regexp_replace(lower(f.name), '[ -]', '_', 'g') AS framework, f.confidence AS confidence FROM j WHERE f.name <> ''),
guess AS (
  SELECT DISTINCT n.repository_id, s.framework, s.hint, s.w FROM nodes n JOIN seg s ON contains('/' || lower(n.file_path) || '/', '/' || s.hint || '/') WHERE n.node_type = 'directory'
  UNION ALL SELECT DISTINCT n.repository_id, h.framework, h.hint, h.w FROM nodes n JOIN hint h ON lower(regexp_extract(n.file_path, '([^/]*)$', 1)) = h.hint
    WHERE n.node_type = 'file' AND (h.framework <> 'rails' OR n.repository_id IN (SELECT repository_id FROM nodes WHERE node_type = 'file' AND file_path LIKE '%.rb')))
SELECT repository_id, CASE WHEN framework IN ('ruby_on_rails', 'ruby_rails') THEN 'rails' ELSE framework END AS framework, confidence FROM stated
UNION ALL SELECT repository_id, framework, round(least(sum(w), 1.0::DOUBLE), 2) FROM guess WHERE repository_id NOT IN (SELECT repository_id FROM stated) GROUP BY 1, 2
"""
_NO_DOMAIN = ", ".join(f"'{x}'" for x in architecture.NO_DOMAIN)
SQL["domain_coverage"] = f"""
WITH {_FILE_LAYERS},
i AS (SELECT *, regexp_extract(file_path, '^([^/]+)/', 1) AS domain FROM nodes WHERE file_path IS NOT NULL),
inside AS (SELECT * FROM i WHERE domain <> '' AND NOT starts_with(domain, '.') AND domain NOT IN ({_NO_DOMAIN})),
df AS (SELECT DISTINCT repository_id, domain, file_path FROM inside WHERE node_type = 'file'),
sizes AS (SELECT repository_id, domain, count(*) AS files FROM df GROUP BY 1, 2 HAVING count(*) >= 2),
one AS (SELECT repository_id, file_path, layer FROM (SELECT s.*, row_number() OVER (PARTITION BY repository_id, file_path ORDER BY o) AS r
  FROM scored s JOIN layers USING (repository_id, layer) WHERE weight >= 0.5) WHERE r = 1),
service AS (SELECT repository_id, domain, count(*) AS k FROM df JOIN one USING (repository_id, file_path) WHERE layer IN ('controller', 'business', 'data') GROUP BY 1, 2),
kinds AS (SELECT repository_id, domain, count(DISTINCT node_type) AS kinds FROM inside JOIN df USING (repository_id, domain, file_path) GROUP BY 1, 2),
x AS (SELECT repository_id, domain, files, coalesce(k, 0) AS service_files, round(least(0.3::DOUBLE + coalesce(k, 0) / files::DOUBLE * 0.4::DOUBLE + kinds / 5.0::DOUBLE * 0.3::DOUBLE, 1.0::DOUBLE), 2) AS confidence
  FROM sizes JOIN kinds USING (repository_id, domain) LEFT JOIN service USING (repository_id, domain))
SELECT * FROM x WHERE service_files >= 2 OR confidence >= 0.4
"""


SQL["architecture_rows"] = f"""
SELECT repository_id, layer, NULL::VARCHAR AS pattern, printf('confidence %.2f', confidence) AS description FROM ({SQL["layer_confidence"]})
UNION ALL SELECT repository_id, 'pattern', pattern, printf('confidence %.2f', confidence) FROM ({SQL["pattern_match"]})
UNION ALL SELECT repository_id, 'domain', domain, printf('confidence %.2f', confidence) FROM ({SQL["domain_coverage"]})
"""


# ---------------------------------------------------------------- manifest and imports


def _files(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "nodes").where((F.col("node_type") == "file") & F.col("file_path").isNotNull()).select("repository_id", "file_path")


def _sources(spark: SparkSession, root: str) -> DataFrame:
    # Parsing takes far more time than its input takes to read: spread over all tasks.
    heads = load(spark, root, "source_heads").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return heads.select("repository_id", "file_path", manifest.language_of("file_path").alias("language"), F.col("head").alias("text"))


@query
def language_counts(spark: SparkSession, root: str) -> DataFrame:
    return manifest.language_counts(_files(spark, root))


@query
def directory_counts(spark: SparkSession, root: str) -> DataFrame:
    return manifest.directory_count(_files(spark, root))


@query
def manifest_rows(spark: SparkSession, root: str) -> DataFrame:
    return manifest.manifests(load(spark, root, "source_heads").select("repository_id", "file_path", F.col("head").alias("content")))


@query
def manifest_facts(spark: SparkSession, root: str) -> DataFrame:
    return manifest.manifest_facts(load(spark, root, "source_heads").select("repository_id", "file_path", F.col("head").alias("content")))


@query
def import_extract(spark: SparkSession, root: str) -> DataFrame:
    return imports.extract_imports(_sources(spark, root)).select("repository_id", "file_path", "line", "target")


@query
def suffix_index(spark: SparkSession, root: str) -> DataFrame:
    return imports.suffix_index(_files(spark, root)).groupBy("repository_id", "suffix").agg(F.count("*").alias("files"))


@query
def import_resolve(spark: SparkSession, root: str) -> DataFrame:
    return imports.resolve_imports(imports.extract_imports(_sources(spark, root)), _files(spark, root))


_LANG = "CASE lower(regexp_extract(regexp_extract(file_path, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in manifest.LANGUAGES.items()) + " ELSE 'unknown' END"
SQL["language_counts"] = f"SELECT repository_id, {_LANG} AS language, count(*) AS files FROM nodes WHERE node_type = 'file' AND file_path IS NOT NULL GROUP BY 1, 2"
SQL["directory_counts"] = """
WITH f AS (SELECT DISTINCT repository_id, string_split(file_path, '/') AS p FROM nodes WHERE node_type = 'file' AND file_path IS NOT NULL),
n AS (SELECT repository_id, p, unnest(range(1, len(p))) AS k FROM f)
SELECT repository_id, count(DISTINCT array_to_string(p[1:k], '/')) AS directories FROM n GROUP BY 1
"""
SQL["suffix_index"] = """
WITH f AS (SELECT DISTINCT repository_id, file_path, string_split(lower(file_path), '/') AS p FROM nodes WHERE node_type = 'file' AND file_path IS NOT NULL),
n AS (SELECT repository_id, file_path, p, unnest(range(1, len(p) + 1)) AS k FROM f)
SELECT repository_id, array_to_string(p[k:len(p)], '/') AS suffix, count(*) AS files FROM n GROUP BY 1, 2
"""


def _json(text: str) -> str:
    return text.replace("'", "''")


_MANAGERS, _BUILDS, _MONOREPOS = (
    ", ".join(f"({i}, '{f}', '{n}')" for i, (f, n) in enumerate(table)) for table in (manifest.PACKAGE_MANAGERS, manifest.BUILD_SYSTEMS, manifest.MONOREPOS)
)
_CHECKS = " UNION ALL ".join(
    f"SELECT DISTINCT repository_id, '{f}' AS framework, {i} AS rule, {w}::DOUBLE AS w FROM f WHERE file_path = '{path}'" + ("" if pattern is None else f" AND regexp_matches(content, '{'(?m)' if by_line else ''}{_json(pattern)}')")
    for i, (f, path, pattern, by_line, w) in enumerate(manifest.FINGERPRINTS)
)
SQL["manifest_facts"] = f"""
WITH f AS (SELECT repository_id, file_path, head AS content FROM source_heads),
pm(o, path, name) AS (VALUES {_MANAGERS}), bs(o, path, name) AS (VALUES {_BUILDS}), mono(o, path, name) AS (VALUES {_MONOREPOS}),
checks AS ({_CHECKS}),
named AS (SELECT repository_id, arg_min(name, o) AS tool FROM f JOIN mono ON path = file_path GROUP BY 1),
dirs AS (SELECT repository_id, unnest(range(1, len(string_split(file_path, '/')))) AS k, string_split(file_path, '/') AS p FROM f),
languages AS (SELECT repository_id, {_LANG} AS language, count(*) AS n FROM f GROUP BY 1, 2)
SELECT repository_id, 'language' AS fact, language AS name, n::DOUBLE AS value FROM languages
UNION ALL SELECT repository_id, 'package manager', name, o::DOUBLE FROM (SELECT DISTINCT repository_id, file_path FROM f) JOIN pm ON path = file_path
UNION ALL SELECT repository_id, 'build system', name, o::DOUBLE FROM (SELECT DISTINCT repository_id, file_path FROM f) JOIN bs ON path = file_path
UNION ALL SELECT repository_id, 'monorepo', tool, NULL FROM named
UNION ALL SELECT DISTINCT repository_id, 'monorepo', 'npm-workspaces', NULL::DOUBLE FROM f WHERE file_path = 'package.json' AND CASE WHEN json_valid(content) THEN json_extract(content, '$.workspaces') END IS NOT NULL AND repository_id NOT IN (SELECT repository_id FROM named)
UNION ALL SELECT repository_id, 'framework', framework, round(least(sum(w), 1.0::DOUBLE), 4) FROM checks GROUP BY 1, 3
UNION ALL SELECT repository_id, 'files', NULL, count(*)::DOUBLE FROM f GROUP BY 1
UNION ALL SELECT repository_id, 'directories', NULL, count(DISTINCT array_to_string(p[1:k], '/'))::DOUBLE FROM dirs GROUP BY 1
"""


def _import_branch(language: str, pattern: str) -> str:
    names = ", ".join(f"'{x}'" for x in (language, *(k for k, v in imports.SAME.items() if v == language)))
    quoted = pattern.replace("'", "''").replace(r"\"", '"')
    return f"SELECT repository_id, file_path, line, unnest(regexp_extract_all(code, '{quoted}', 1)) AS target FROM code WHERE language IN ({names})"


SQL["import_extract"] = (
    f"WITH src AS (SELECT repository_id, file_path, {_LANG} AS language, string_split(CASE WHEN ends_with(lower(file_path), '.go') THEN regexp_replace(head, '{imports.GO_BODY}', '') ELSE head END, chr(10)) AS lines FROM source_heads WHERE length(head) > 0),\n"
    "code AS (SELECT repository_id, file_path, language, unnest(range(1, len(lines) + 1))::INT AS line, unnest(lines) AS code FROM src)\n"
    "SELECT repository_id, file_path, line, trim(target) AS target FROM (\n"
    + "\nUNION ALL ".join(_import_branch(k, p) for k, ps in imports.PATTERNS.items() for p in ps)
    + "\n) WHERE trim(target) <> ''"
)


def _normal_sql(path: str) -> str:
    """A path without '.' and 'x/..' segments, for up to eight of the latter."""
    out = f"regexp_replace('/' || {path} || '/', '/(\\./|/)+', '/', 'g')"
    for _ in range(8):
        out = f"regexp_replace({out}, '/(?:[^/.][^/]*|\\.[^/.][^/]*|\\.\\.[^/]+)/\\.\\./', '/')"
    return f"trim(regexp_replace({out}, '^(/\\.\\.)+/', '/'), '/')"


def _shortened_sql(path: str) -> str:
    return f"list_transform(range(len(string_split({path}, '/')), 0, -1), lambda n: array_to_string(string_split({path}, '/')[1:n], '/'))"


_INDICATORS = ", ".join(f"'{x}'" for x in imports.INDICATORS)
SQL["import_resolve"] = f"""
WITH raw AS ({SQL["import_extract"]}),
asked AS (SELECT repository_id, file_path AS source_path, {_LANG} AS language, line, target, count(*) AS times, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder,
  regexp_extract(file_path, '([^/]*?)(?:\\.[^./]*)?$', 1) AS own, length(regexp_extract(target, '^(\\.+)', 1)) AS dots,
  trim(regexp_replace(replace(regexp_replace(target, '^(?:(?:crate|self|super)::)+', ''), '::', '/'), '/\\*$', '')) AS b0,
  coalesce(regexp_extract(file_path, '^(?:(.*)/)?src/', 1), '') AS crate FROM raw GROUP BY ALL),
more AS (SELECT *, regexp_replace(b0, '\\s+as\\s+.*$', '') AS bare, CASE WHEN own IN ('mod', 'lib', 'main') THEN folder ELSE folder || '/' || own END AS inner_,
  len(regexp_extract_all(target, '(super::)', 1)) AS ups FROM asked),
lists AS (SELECT repository_id, source_path, line, target, times, CASE
    WHEN language = 'python' AND dots > 0 THEN [{_normal_sql("folder || '/' || repeat('../', greatest(dots - 1, 0)) || replace(regexp_replace(target, '^\\.+', ''), '.', '/')")}]
    WHEN regexp_matches(target, '^\\.{{1,2}}/') THEN [{_normal_sql("folder || '/' || target")}]
    WHEN language = 'rust' AND regexp_matches(target, '^(?:self|super)::') THEN {_shortened_sql(_normal_sql("inner_ || '/' || repeat('../', ups) || bare"))}
    WHEN language = 'rust' AND starts_with(target, 'crate::') THEN list_concat({_shortened_sql(_normal_sql("crate || '/src/' || bare"))}, {_shortened_sql("bare")})
    WHEN language = 'rust' THEN list_concat(list_concat({_shortened_sql("bare")}, [{_normal_sql("'src/' || bare")}]), {_shortened_sql(_normal_sql("crate || '/src/' || regexp_replace(bare, '^[^/]*/', '')"))})
    ELSE [target, replace(target, '.', '/')] END AS bases FROM more),
bases AS (SELECT repository_id, source_path, line, target, times, trim(lower(trim(unnest(bases)))) AS base, generate_subscripts(bases, 1) AS nth FROM lists),
one AS (SELECT repository_id, source_path, line, target, times, base, min(nth) AS nth FROM bases WHERE base <> '' GROUP BY ALL),
f AS (SELECT DISTINCT repository_id, file_path, string_split(lower(file_path), '/') AS p FROM nodes WHERE node_type = 'file' AND file_path IS NOT NULL),
n AS (SELECT repository_id, file_path, p, unnest(range(1, len(p) + 1)) AS k FROM f),
sx AS (SELECT repository_id, file_path, array_to_string(p[k:len(p)], '/') AS suffix, k = 1 AS whole FROM n),
ks AS (SELECT repository_id, file_path, suffix AS key, CASE WHEN whole THEN 0 ELSE 3 END AS rank FROM sx
  UNION ALL SELECT repository_id, file_path, regexp_replace(suffix, '\\.[^./]+$', ''), CASE WHEN whole THEN 1 ELSE 4 END FROM sx
  UNION ALL SELECT repository_id, file_path, regexp_replace(suffix, '/?[^/]*$', ''), CASE WHEN whole THEN 2 ELSE 5 END FROM sx WHERE regexp_extract(suffix, '([^/]*)$', 1) IN ({_INDICATORS})),
keys AS (SELECT repository_id, key, file_path, min(rank) AS rank FROM ks WHERE key <> '' GROUP BY 1, 2, 3),
ranks AS (SELECT repository_id, key, rank, dense_rank() OVER (PARTITION BY repository_id, key ORDER BY rank) AS d FROM (SELECT DISTINCT repository_id, key, rank FROM keys)),
wanted AS (SELECT o.*, r.key, r.rank, row_number() OVER (PARTITION BY o.repository_id, source_path, line, target ORDER BY rank, nth, key) AS r
  FROM one o JOIN ranks r ON r.repository_id = o.repository_id AND r.key = o.base WHERE d <= 2),
met AS (SELECT w.*, k.file_path AS target_path FROM wanted w JOIN keys k ON k.repository_id = w.repository_id AND k.key = w.key AND k.rank = w.rank WHERE w.r <= 4 AND k.file_path <> source_path),
best AS (SELECT *, min(r) OVER (PARTITION BY repository_id, source_path, line, target) AS first FROM met)
SELECT repository_id, source_path, line, target, target_path, priority FROM (SELECT repository_id, source_path, line, target, target_path, rank AS priority, unnest(range(times)) FROM best WHERE r = first)
"""


# ---------------------------------------------------------------- vectors and texts


@query
def cosine_topk(spark: SparkSession, root: str) -> DataFrame:
    vectors = load(spark, root, "node_vectors")
    first = vectors.where(F.col("model") == "graph-mini-64").where("vector IS NOT NULL AND exists(vector, x -> x <> 0)").agg(F.min("node_id")).first()[0]
    return similarity.similar_to_node(vectors, first, "graph-mini-64", 20)


@query
def similar_nodes(spark: SparkSession, root: str) -> DataFrame:
    return similarity.named_matches(cosine_topk(spark, root), load(spark, root, "nodes"), load(spark, root, "repositories"))


@query
def embedding_backlog(spark: SparkSession, root: str) -> DataFrame:
    return similarity.backlog(load(spark, root, "nodes"), load(spark, root, "node_vectors"), "graph-mini-64").select("id", "node_type")


@query
def node_text(spark: SparkSession, root: str) -> DataFrame:
    return similarity.node_text(load(spark, root, "nodes"))


@query
def encode_backlog(spark: SparkSession, root: str) -> DataFrame:
    todo = similarity.backlog(load(spark, root, "nodes"), load(spark, root, "node_vectors"), "graph-mini-64")
    return similarity.encode_nodes(todo, similarity.HashingEncoder(64))


@query
def word_vectors(spark: SparkSession, root: str) -> DataFrame:
    nodes = load(spark, root, "nodes")
    return similarity.encode_nodes(nodes.where(F.col("node_type").isin(*similarity.EMBEDDED_TYPES)), similarity.WordVectorEncoder.fit(nodes))


@query
def metadata_extract(spark: SparkSession, root: str) -> DataFrame:
    meta = parsed_metadata("metadata_json")
    get = lambda k: F.get_json_object(meta, f"$.{k}")
    return load(spark, root, "nodes").select("id", get("language").alias("language"), get("return_type").alias("return_type"), get("signature").alias("signature"))


SQL["cosine_topk"] = """
WITH v AS (SELECT node_id, vector::DOUBLE[] AS vector FROM node_vectors WHERE model = 'graph-mini-64' AND vector IS NOT NULL AND list_inner_product(vector::DOUBLE[], vector::DOUBLE[]) > 0),
q AS (SELECT vector FROM v WHERE node_id = (SELECT min(node_id) FROM v) LIMIT 1)
SELECT node_id, round(max(list_cosine_similarity(v.vector, q.vector)), 4) AS score FROM v, q
WHERE node_id <> (SELECT min(node_id) FROM v) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20
"""
SQL["similar_nodes"] = f"""
SELECT k.node_id, k.score, n.node_type, n.name, n.file_path, r.name AS repository
FROM ({SQL["cosine_topk"]}) k JOIN nodes n ON n.id = k.node_id LEFT JOIN repositories r ON r.id = n.repository_id
"""
SQL["embedding_backlog"] = """
SELECT id, node_type FROM nodes WHERE node_type IN ('class', 'function', 'method', 'file', 'interface', 'enum', 'type_alias')
AND id NOT IN (SELECT node_id FROM node_vectors WHERE model = 'graph-mini-64' AND vector IS NOT NULL)
"""
_META = """
WITH m AS (SELECT id, CASE WHEN starts_with(metadata_json, '"') AND json_valid(metadata_json) THEN metadata_json::JSON ->> '$' WHEN NOT starts_with(metadata_json, '"') THEN metadata_json END AS t FROM nodes),
o AS (SELECT id, CASE WHEN json_valid(t) AND starts_with(ltrim(t), '{') THEN t END AS t FROM m)
"""
SQL["node_text"] = _META + """
, n AS (SELECT nodes.*, t FROM nodes JOIN o USING (id))
SELECT id AS node_id, concat_ws(chr(10), node_type || ': ' || name, 'file: ' || file_path,
  'docstring: ' || nullif(t ->> '$.docstring', ''), CASE WHEN node_type IN ('function', 'method') THEN 'signature: ' || nullif(t ->> '$.signature', '') END,
  CASE WHEN node_type = 'method' THEN 'parent: ' || nullif(t ->> '$.parent_name', '') END, CASE WHEN node_type = 'function' THEN 'module: ' || nullif(t ->> '$.parent_name', '') END,
  CASE WHEN json_array_length(t, '$.parameters') > 0 THEN 'parameters: ' || array_to_string((t -> '$.parameters')::VARCHAR[], ', ') END, 'returns: ' || nullif(t ->> '$.return_type', '')) AS text FROM n
"""
SQL["metadata_extract"] = _META + "SELECT id, t ->> '$.language' AS language, t ->> '$.return_type' AS return_type, t ->> '$.signature' AS signature FROM o"


# ---------------------------------------------------------------- budgets and questions


@query
def token_estimate(spark: SparkSession, root: str) -> DataFrame:
    return compress.token_totals(load(spark, root, "documents"))


@query
def budget_truncate(spark: SparkSession, root: str) -> DataFrame:
    lines = load(spark, root, "nodes").select("repository_id", "id", F.concat_ws(" ", "node_type", "name").alias("line"))
    return compress.within_budget(lines, 200, ["repository_id"], ["id"]).select("repository_id", "id", "used")


@query
def classify_intent(spark: SparkSession, root: str) -> DataFrame:
    text = F.col("message")
    return load(spark, root, "commits").select("id", router.intent_column(text).alias("intent"), router.confidence_column(text).cast("double").alias("confidence")).where(F.col("intent").isNotNull())


SQL["token_estimate"] = "SELECT source, count(text) AS documents, coalesce(sum(greatest(1, length(text) // 4)), 0)::BIGINT AS tokens FROM documents GROUP BY 1"
SQL["budget_truncate"] = """
SELECT repository_id, id, used::BIGINT AS used FROM (
  SELECT repository_id, id, sum(length(concat_ws(' ', node_type, name)) + 1) OVER (PARTITION BY repository_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS used FROM nodes) WHERE used <= 804
"""
_INTENT = "CASE " + " ".join("WHEN regexp_matches(message, '" + "|".join(f"(?:{p})" for _, p, _ in rs).replace("'", "''") + f"') THEN '{name}'" for name, rs in router.FAMILIES) + " ELSE 'search' END"
SQL["classify_intent"] = f"SELECT id, intent, (CASE WHEN intent <> 'search' THEN 0.8 WHEN regexp_matches(message, '[A-Z]\\w+') THEN 0.5 ELSE 0.3 END)::DOUBLE AS confidence FROM (SELECT id, message, {_INTENT} AS intent FROM commits)"


# ---------------------------------------------------------------- maintenance


@query
def dedupe_keep_first(spark: SparkSession, root: str) -> DataFrame:
    kept = build.keep_first(load(spark, root, "edges"), ["source_node_id", "target_node_id", "edge_type"], ["id"])
    return kept.select("id", "source_node_id", "target_node_id", "edge_type")


@query
def resolve_names(spark: SparkSession, root: str) -> DataFrame:
    nodes = load(spark, root, "nodes")
    ends = nodes.select("id", "name")
    calls = load(spark, root, "edges").where(F.col("edge_type").isin("CALLS", "INHERITS", "IMPLEMENTS", "DECORATES"))
    named = calls.join(ends.select(F.col("id").alias("source_node_id"), F.col("name").alias("source_name")), "source_node_id").join(
        ends.select(F.col("id").alias("target_node_id"), F.col("name").alias("target_name")), "target_node_id"
    )
    return build.resolve_names(nodes, named.select("repository_id", "source_name", "target_name", "edge_type"), distinct=True)


def _deleted(spark: SparkSession, root: str) -> DataFrame:
    """(repository_id, file_path) of the files that some commit deleted."""
    commits = load(spark, root, "commits").select(F.col("id").alias("commit_id"), "repository_id")
    return load(spark, root, "commit_files").where("change_type = 'D' AND file_path IS NOT NULL").join(commits, "commit_id").select("repository_id", "file_path").distinct()


def _rows_of(**tables: DataFrame) -> DataFrame:
    """(table_name, id, other): the keys of the rows of several tables."""
    out = None
    for name, table in tables.items():
        key = next(c for c in ("id", "node_id", "commit_id") if c in table.columns)
        other = next((F.col(c) for c in ("model", "file_path") if c in table.columns), F.lit(None).cast("string"))
        rows = table.select(F.lit(name).alias("table_name"), F.col(key).alias("id"), other.alias("other"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def delete_files(spark: SparkSession, root: str) -> DataFrame:
    kept, edges, vectors = build.without_files(load(spark, root, "nodes"), load(spark, root, "edges"), load(spark, root, "node_vectors"), _deleted(spark, root))
    return _rows_of(nodes=kept, edges=edges, vectors=vectors)


@query
def remove_repository(spark: SparkSession, root: str) -> DataFrame:
    names = ("repositories", "nodes", "edges", "node_vectors", "commits", "commit_files", "commit_authors")
    return _rows_of(**build.without_repository(2, **{t: load(spark, root, t) for t in names}))


@query
def upsert_repositories(spark: SparkSession, root: str) -> DataFrame:
    old = load(spark, root, "repositories")
    new = old.where(F.col("indexed_at").isNull()).select("path", F.upper("name").alias("name"), F.lit(None).cast("timestamp").alias("indexed_at"), F.lit(None).cast("string").alias("manifest_json"))
    return build.upsert_repositories(old, new).select("id", "path", "name", "manifest_json")


@query
def orphan_edges(spark: SparkSession, root: str) -> DataFrame:
    nodes = load(spark, root, "nodes")
    left = nodes.join(_deleted(spark, root), ["repository_id", "file_path"], "left_anti")
    return build.orphans(left, load(spark, root, "edges"))


_GONE = """
WITH gone AS (SELECT DISTINCT c.repository_id, f.file_path FROM commit_files f JOIN commits c ON c.id = f.commit_id WHERE f.change_type = 'D' AND f.file_path IS NOT NULL),
dead AS (SELECT id FROM nodes JOIN gone USING (repository_id, file_path)),
kept AS (SELECT id, file_path FROM nodes WHERE id NOT IN (SELECT id FROM dead))
"""
SQL["dedupe_keep_first"] = """
SELECT id, source_node_id, target_node_id, edge_type FROM (
  SELECT *, row_number() OVER (PARTITION BY source_node_id, target_node_id, edge_type ORDER BY id) AS r FROM edges) WHERE r = 1
"""
SQL["resolve_names"] = """
WITH f AS (SELECT repository_id, name, min(id) AS id FROM nodes WHERE name IS NOT NULL AND node_type NOT IN ('directory', 'file') GROUP BY 1, 2)
SELECT DISTINCT e.repository_id, a.id AS source_node_id, b.id AS target_node_id, e.edge_type
FROM edges e JOIN nodes s ON s.id = e.source_node_id JOIN nodes t ON t.id = e.target_node_id
JOIN f a ON a.repository_id = e.repository_id AND a.name = s.name JOIN f b ON b.repository_id = e.repository_id AND b.name = t.name
WHERE e.edge_type IN ('CALLS', 'INHERITS', 'IMPLEMENTS', 'DECORATES') AND a.id <> b.id
"""
SQL["delete_files"] = _GONE + """
SELECT 'nodes' AS table_name, id, file_path AS other FROM kept
UNION ALL SELECT 'edges', id, NULL FROM edges WHERE source_node_id NOT IN (SELECT id FROM dead) AND target_node_id NOT IN (SELECT id FROM dead)
UNION ALL SELECT 'vectors', node_id, model FROM node_vectors WHERE node_id NOT IN (SELECT id FROM dead)
"""
SQL["remove_repository"] = """
SELECT 'repositories' AS table_name, id, NULL::VARCHAR AS other FROM repositories WHERE id <> 2
UNION ALL SELECT 'nodes', id, file_path FROM nodes WHERE repository_id <> 2 UNION ALL SELECT 'edges', id, NULL FROM edges WHERE repository_id <> 2
UNION ALL SELECT 'commits', id, NULL FROM commits WHERE repository_id <> 2 UNION ALL SELECT 'commit_authors', id, NULL FROM commit_authors WHERE repository_id <> 2
UNION ALL SELECT 'node_vectors', node_id, model FROM node_vectors WHERE node_id NOT IN (SELECT id FROM nodes WHERE repository_id = 2)
UNION ALL SELECT 'commit_files', commit_id, file_path FROM commit_files WHERE commit_id NOT IN (SELECT id FROM commits WHERE repository_id = 2)
"""
SQL["upsert_repositories"] = "SELECT id, path, CASE WHEN indexed_at IS NULL THEN upper(name) ELSE name END AS name, manifest_json FROM repositories"
SQL["orphan_edges"] = _GONE + """
SELECT id, source_node_id, target_node_id FROM edges WHERE source_node_id NOT IN (SELECT id FROM kept) OR target_node_id NOT IN (SELECT id FROM kept)
"""


# ---------------------------------------------------------------- sources and streams


@query
def parse_entities(spark: SparkSession, root: str) -> DataFrame:
    rows = parse.parse_sources(_sources(spark, root)).where("error IS NULL")
    return rows.select("repository_id", "file_path", "ordinal", "parent_ordinal", "kind", "name", "line")


@query
def parse_errors(spark: SparkSession, root: str) -> DataFrame:
    return parse.parse_sources(_sources(spark, root)).where("error IS NOT NULL").select("repository_id", "file_path")


@query
def build_structure(spark: SparkSession, root: str) -> DataFrame:
    sources = _sources(spark, root)
    entities = parse.parse_sources(sources).where("error IS NULL")
    nodes, edges = build.structure(None, sources.select("repository_id", "file_path"), cut(entities.select("repository_id", "file_path", "ordinal", "parent_ordinal", "kind", "name", "metadata_json")))
    # Every edge with the names of its ends; what has none is a tree's top.
    ends = nodes.select("id", "node_type", "name", "file_path")
    above = edges.select("source_node_id", "target_node_id", "edge_type").join(ends.select(F.col("id").alias("source_node_id"), F.col("name").alias("parent"), F.col("node_type").alias("parent_type")), "source_node_id")
    return nodes.join(above, nodes["id"] == above["target_node_id"], "left").select("repository_id", "node_type", "name", "file_path", "parent_type", "parent", "edge_type")


@query
def tree_structure(spark: SparkSession, root: str) -> DataFrame:
    """The directories and files of ``build_structure`` only, which SQL can tell."""
    return build_structure(spark, root).where(F.col("node_type").isin("directory", "file"))


SQL["tree_structure"] = """
WITH f AS (SELECT DISTINCT repository_id, file_path, string_split(file_path, '/') AS p FROM source_heads WHERE file_path IS NOT NULL),
n AS (SELECT repository_id, p, unnest(range(1, len(p))) AS k FROM f),
d AS (SELECT DISTINCT repository_id, array_to_string(p[1:k], '/') AS path, p[k] AS name, CASE WHEN k > 1 THEN p[k - 1] END AS parent FROM n)
SELECT repository_id, 'directory' AS node_type, name, path AS file_path, CASE WHEN parent IS NOT NULL THEN 'directory' END AS parent_type, parent, CASE WHEN parent IS NOT NULL THEN 'CONTAINS' END AS edge_type FROM d
UNION ALL SELECT repository_id, 'file', file_path, file_path, CASE WHEN len(p) > 1 THEN 'directory' END, CASE WHEN len(p) > 1 THEN p[len(p) - 1] END, CASE WHEN len(p) > 1 THEN 'CONTAINS' END FROM f
"""


@query
def git_log_parse(spark: SparkSession, root: str) -> DataFrame:
    commits = load(spark, root, "commits").where("hash IS NOT NULL AND repository_id IS NOT NULL")
    first = build.keep_first(commits, ["repository_id", "hash"], ["id"])
    parsed = gitlog.log_commits(gitlog.log_text(first, load(spark, root, "commit_files")))
    files = gitlog.log_files(parsed).groupBy(F.col("commit_id").alias("id")).agg(F.count("*").alias("files"))
    return parsed.join(files, "id", "left").select("repository_id", "hash", "author", "email", "committed_at", "message", F.coalesce("files", F.lit(0)).alias("files"))


SQL["git_log_parse"] = """
WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, hash ORDER BY id) AS r FROM commits WHERE hash IS NOT NULL AND repository_id IS NOT NULL) WHERE r = 1),
f AS (SELECT commit_id, count(DISTINCT change_type || chr(9) || file_path) AS files FROM commit_files WHERE file_path IS NOT NULL AND change_type IN ('A', 'M', 'D') GROUP BY 1)
SELECT repository_id, hash, coalesce(author, '') AS author, coalesce(email, '') AS email, coalesce(committed_at, '') AS committed_at, coalesce(message, '') AS message, coalesce(files, 0) AS files
FROM c LEFT JOIN f ON f.commit_id = c.id
"""


def _file_events(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("op"), "ts")


@query
def stream_coalesce(spark: SparkSession, root: str) -> DataFrame:
    schema = load(spark, root, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root)
    return watch.coalesce_stream(_file_events(stream), spark)


@query
def debounce_sessions(spark: SparkSession, root: str) -> DataFrame:
    return watch.debounced(_file_events(load(spark, root, "events")), "1 hour")


SQL["stream_coalesce"] = """
SELECT user_id::VARCHAR AS path, arg_max(event_type, (ts, event_id)) AS op, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS events
FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1
"""
SQL["debounce_sessions"] = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM events WHERE user_id IS NOT NULL),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id::VARCHAR AS path, min(ts) AS started, max(ts) + INTERVAL 1 HOUR AS ended, count(*) AS events FROM s GROUP BY user_id, k
"""
