"""Results cut to a budget of tokens (a quarter of the characters)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import estimate_tokens


def token_totals(documents: DataFrame) -> DataFrame:
    """(source, documents, tokens); a null text has no tokens."""
    tokens = F.coalesce(F.sum(estimate_tokens("text")), F.lit(0))
    return documents.groupBy("source").agg(F.count("text").alias("documents"), tokens.alias("tokens"))


def within_budget(lines: DataFrame, budget: int, group: list[str], order: list[str], text: str = "line") -> DataFrame:
    """The first lines of every group, in order, that fit ``budget`` tokens with a line break each.

    A line takes a character at least, so no more rows of a group than the
    budget has characters are brought together, however large the group.
    """
    room = 4 * budget + 4
    ranked = Window.partitionBy(*group).orderBy(*order)
    first = lines.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= room)
    used = F.sum(F.length(text) + 1).over(Window.partitionBy(*group).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("used", used).where(F.col("used") <= room).drop("_r")


def node_lines(nodes: DataFrame, budget: int, group: bool = True) -> str:
    """Nodes as text: a list of up to ten, else counts by type and as many files as fit."""
    first = nodes.orderBy("id").limit(11).collect()
    if not first:
        return "No results."
    if len(first) <= 10 or not group:
        rows = first[:10] if group else nodes.orderBy("id").limit(max(1, budget)).collect()
        return _cut([f"{(r['node_type'] or '').ljust(12)} {r['name']} {r['file_path'] or ''}".rstrip() for r in rows], budget)
    kinds = nodes.groupBy("node_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node_type").limit(max(1, budget)).collect()
    lines = [f"{r['node_type']}: {r['n']}" for r in kinds]
    left = budget - len("\n".join(lines)) // 4
    if left > 20:
        files = nodes.where(F.col("file_path").isNotNull()).select("file_path").distinct().orderBy("file_path").limit(max(1, left // 30)).collect()
        lines += ["Files:", *(f"  {r['file_path']}" for r in files)]
    return _cut(lines, budget)


def impact_lines(rows: DataFrame, nodes: DataFrame, budget: int) -> str:
    """Dependents as text, by edge type, the largest first."""
    named = rows.join(nodes.select("id", "node_type", "name", "file_path"), "id")
    sizes = named.groupBy("via_edge").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "via_edge").limit(max(1, budget)).collect()
    total = sum(r["n"] for r in sizes)
    lines = [f"{total} dependents"]
    order = Window.partitionBy("via_edge").orderBy("level", "name", "id")
    shown = named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(1, budget // 40)).orderBy("via_edge", "r").collect()
    for kind in sizes:
        lines.append(f"{kind['via_edge']} ({kind['n']}):")
        lines += [f"  {r['node_type']} {r['name']}" for r in shown if r["via_edge"] == kind["via_edge"]]
    return _cut(lines, budget)


def path_lines(path: DataFrame, nodes: DataFrame, budget: int) -> str:
    """A path as text; hops are counted as nodes."""
    rows = path.join(nodes, "id").orderBy("depth").collect()
    if not rows:
        return "No path found."
    return _cut([f"Path ({len(rows)} hops):", *(f"  {r['node_type']} {r['name']}" for r in rows)], budget)


def summary_lines(rows: DataFrame, budget: int) -> str:
    """The summary of one repository, rows of ``summary.repository_summary``, as text: types first, then as many files and classes as there is room for."""
    found = rows.orderBy("section", "rank").limit(64).collect()
    if not found:
        return "No summary available."
    one = found[0]
    lines = [f"Repository: {one['name']}", f"  Path: {one['path']}", f"  Nodes: {one['nodes']}", f"  Edges: {one['edges']}"]
    for section, title, unit in (("node types", "Nodes by type", ""), ("edge types", "Edges by type", ""), ("largest files", "Top files", "entities"), ("largest classes", "Largest classes", "methods")):
        items = [r for r in found if r["section"] == section]
        if unit:
            items = items[: max(1, (budget - estimate("\n".join(lines))) // 25)]
        if items:
            lines.append(f"  {title}:")
            lines += [f"    {r['item']} ({r['n']} {unit})" if unit else f"    {r['item']}: {r['n']}" for r in items]
    return _cut(lines, budget)


def architecture_lines(found: DataFrame, shapes: DataFrame, parts: DataFrame, budget: int, name: str = "") -> str:
    """Layers, four patterns and five domains of one repository as text, the surest first."""
    layers = found.orderBy(F.desc("confidence"), "layer").limit(16).collect()
    patterns = shapes.orderBy(F.desc("confidence"), "pattern").limit(4).collect()
    domains = parts.orderBy(F.desc("confidence"), F.desc("files"), "domain").limit(5).collect()
    if not layers and not patterns and not domains:
        return "No architecture data available."
    lines = [f"Architecture: {name}".rstrip()]
    lines += ["  Layers:", *(f"    {r['layer']} (confidence={r['confidence']:.2f}, entities={r['entities']})" for r in layers)] if layers else []
    lines += ["  Patterns:", *(f"    {r['pattern']} (confidence={r['confidence']:.2f})" for r in patterns)] if patterns else []
    lines += ["  Domains:", *(f"    {r['domain']} (confidence={r['confidence']:.2f}, files={r['files']})" for r in domains)] if domains else []
    return _cut(lines, budget)


def row_lines(rows: DataFrame, budget: int) -> str:
    """Any rows as text, one a line, as many as fit."""
    # A row takes a character at least.
    found = rows.limit(max(1, 4 * budget)).collect()
    if not found:
        return "No results."
    return _cut([" ".join(str(v) for v in r if v is not None) for r in found], budget)


def as_text(kind: str, budget: int, **tables: DataFrame) -> str:
    """Rows as text by what they are: 'nodes', 'impact', 'path', 'summary' or 'architecture'; anything else row by row."""
    if kind == "nodes":
        return node_lines(tables["rows"], budget)
    if kind in ("impact", "path"):
        return (impact_lines if kind == "impact" else path_lines)(tables["rows"], tables["nodes"], budget)
    if kind == "summary":
        return summary_lines(tables["rows"], budget)
    if kind == "architecture":
        return architecture_lines(tables["rows"], tables["patterns"], tables["domains"], budget)
    return row_lines(tables["rows"], budget)


def estimate(text: str) -> int:
    return max(1, len(text) // 4)


def _cut(lines: list[str], budget: int) -> str:
    """Drop lines from the end until the text fits, with one ellipsis in their place."""
    kept = list(lines)
    while len(kept) > 1 and estimate("\n".join(kept)) > budget:
        kept.pop()
    if len(kept) < len(lines):
        kept.append("...")
    return "\n".join(kept)
