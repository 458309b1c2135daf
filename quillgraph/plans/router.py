"""Questions in plain words: which operator they ask for, and about what."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import architecture, compress, graph, history, search, summary
from quillgraph.session import cut

# Families of patterns in the order they are tried; group 0 asks
# for no target, -1 takes all groups, another number that group.
FAMILIES: tuple[tuple[str, tuple[tuple[int, str, int], ...]], ...] = (
    ("architecture", ((10, r"\barchitecture\b", 0), (10, r"\blayers?\b", 0), (10, r"\bpatterns?\b", 0), (10, r"(how is|how are).*(organized|structured)", 0))),
    ("summarize", ((10, r"\boverview\b", 0), (10, r"\bsummarize\b", 0), (10, r"what (is this|does this)", 0), (10, r"describe (the )?(project|repo|codebase)", 0), (10, r"tell me about", 0))),
    ("path", ((10, r"\brelationship\b", 0), (5, r"path (?:between|from)\s+(\S+)\s+(?:and|to)\s+(\S+)", -1), (5, r"(?:how are|connection between)\s+(\S+)\s+(?:and|to)\s+(\S+)", -1))),
    ("git_blame", ((10, r"\bauthors?\b", 0), (5, r"who (wrote|changed|made|created|authored)\s+(\S+)", 2), (5, r"\bblame\s+(\S+)", 1), (5, r"history of\s+(\S+)", 1))),
    ("git_why", ((5, r"why (was|is|does)\s+(\S+)", 2), (5, r"\bintroduced\s+(\S+)", 1))),
    ("git_cochange", ((5, r"what changes (with|together)\s+(\S+)", 2), (5, r"\bco-change\b", 0))),
    ("impact", ((5, r"(what depends on|what uses|who calls|dependents of|impact of)\s+(\S+)", 2), (3, r"\bimpact\b", 0), (3, r"\bdependents?\b", 0))),
    ("explain", ((5, r"(?:what is|what's|explain|describe)\s+([A-Z]\w+)", 1), (5, r"how does\s+(\S+)\s+work", 1), (5, r"what does\s+(\S+)\s+do", 1))),
)


def intent_column(text: Column) -> Column:
    """The family of a question, 'search' where none fits; case matters."""
    out = F.lit("search")
    for name, rules in reversed(FAMILIES):
        out = F.when(text.rlike("|".join(f"(?:{p})" for _, p, _ in rules)), name).otherwise(out)
    return out


def confidence_column(text: Column) -> Column:
    return F.when(intent_column(text) != "search", 0.8).when(text.rlike(r"[A-Z]\w+"), 0.5).otherwise(0.3)


def target_column(text: Column, strict: bool = True) -> Column:
    """(family, targets) of a column of questions, with the question itself as target where a family names none.

    All patterns of all families are tried at once; of those that fit, the one
    of the first family, greatest priority and first place decides.  With
    ``strict`` a pattern that asks for no target outranks those of its family
    that do; else it comes after them.
    """
    tried = []
    for nth, (name, rules) in enumerate(FAMILIES):
        for place, (priority, pattern, group) in enumerate(rules):
            groups = range(1, re.compile(pattern).groups + 1) if group < 0 else (group,)
            found = F.array(text) if group == 0 else F.filter(F.array(*(F.regexp_extract(text, pattern, g) for g in groups)), lambda x: x != "")
            bare = int((group == 0) == strict)
            order = F.struct(F.lit(-nth).alias("family"), F.lit(bare).alias("bare"), F.lit(priority).alias("priority"), F.lit(-place).alias("place"))
            tried.append(F.when(text.rlike(pattern), F.struct(order.alias("order"), F.lit(name).alias("family"), found.alias("targets"))))
    best = F.array_max(F.filter(F.array(*tried), lambda x: x.isNotNull()))
    return F.when(best.isNotNull(), F.struct(best["family"].alias("family"), best["targets"].alias("targets"))).otherwise(F.struct(F.lit("search").alias("family"), F.array(text).alias("targets")))


def classify(spark: SparkSession, question: str, strict: bool = True) -> tuple[str, list[str]]:
    """The family and the targets of one question."""
    row = spark.createDataFrame([(question,)], "q string").select(target_column(F.col("q"), strict).alias("t")).first()["t"]
    return row["family"], list(row["targets"])


def answer(question: str, tables: dict[str, DataFrame], repository_id: int | None = None, strict: bool = False) -> DataFrame:
    """The rows that answer a question.

    ``tables`` has the graph tables by name.  A target that no node fits gives
    an empty result.
    """
    nodes, edges = tables["nodes"], tables["edges"]
    family, targets = classify(nodes.sparkSession, question, strict)
    if repository_id is not None:
        nodes, edges = (t.where(F.col("repository_id") == repository_id) for t in (nodes, edges))
    if family == "architecture":
        return architecture.layers(architecture.layer_evidence(nodes))
    if family == "summarize":
        return _summary(tables, repository_id)
    if family == "path" and len(targets) == 2:
        ends = [search.resolve_target(nodes, t).first() for t in targets]
        return graph.shortest_path(edges, *(e["id"] if e else -1 for e in ends)) if all(ends) else graph.shortest_path(edges.limit(0), -1, -2)
    if family == "git_blame" and targets == [question]:
        return history.list_authors(tables["commit_authors"])
    if family in ("git_blame", "git_why", "git_cochange"):
        node = search.resolve_target(nodes, targets[0]).first()
        path = node["file_path"] if node else targets[0]
        if family == "git_blame":
            return history.file_history(tables["commits"], tables["commit_files"], path)
        if family == "git_cochange":
            return history.co_change(tables["commits"], tables["commit_files"], path)
        return history.introductions(tables["commits"], tables["commit_files"].where(F.col("file_path") == path))
    if family == "impact":
        return graph.impact(edges, search.resolve_target(nodes, targets[0]).select("id"))
    if family == "explain":
        return graph.neighbours(edges, search.resolve_target(nodes, targets[0]).select("id"), 1)
    return search.search_nodes(nodes, edges, targets[0])


def _summary(tables: dict[str, DataFrame], repository_id: int | None) -> DataFrame:
    """The summary of the repository asked for, else of the one with most nodes."""
    own = tables["repositories"]
    chosen = own.where(F.col("id") == repository_id) if repository_id is not None else own.join(summary.find_repository(own, tables["nodes"]), "id", "left_semi")
    return summary.repository_summary(chosen, *(tables[t].join(chosen.select(F.col("id").alias("repository_id")), "repository_id", "left_semi") for t in ("nodes", "edges")))


def _architecture_text(tables: dict[str, DataFrame], nodes: DataFrame, repository_id: int | None, budget: int) -> str:
    own = tables["repositories"]
    chosen = own.where(F.col("id") == repository_id) if repository_id is not None else own.join(summary.find_repository(own, nodes), "id", "left_semi")
    row = chosen.select("id", "name").first()
    nodes = nodes.where(F.col("repository_id") == (row["id"] if row else -1))
    found = cut(architecture.layers(architecture.layer_evidence(nodes, architecture.frameworks(chosen, nodes))))
    return compress.architecture_lines(found, architecture.patterns(found), architecture.domains(nodes, found), budget, row["name"] if row else "")


def answer_text(question: str, tables: dict[str, DataFrame], budget: int = 500, repository: str | None = None, strict: bool = False) -> str:
    """The answer to a question as text within a budget of tokens.

    ``repository`` names one by name or path.  Lines go from the end while the
    text is too long, but for the first three.
    """
    nodes = tables["nodes"]
    repository_id = None
    if repository is not None:
        row = summary.find_repository(tables["repositories"], nodes, repository).first()
        repository_id = row["id"] if row else None
    family, targets = classify(nodes.sparkSession, question, strict)
    if family == "architecture":
        text = _architecture_text(tables, nodes, repository_id, budget)
    else:
        rows = answer(question, tables, repository_id, strict)
        if family == "summarize":
            text = compress.summary_lines(rows, budget)
        elif family == "impact":
            text = compress.impact_lines(rows, nodes, budget)
        elif family == "path" and len(targets) == 2:
            text = compress.path_lines(rows, nodes, budget)
        elif family in ("explain", "search", "path"):
            text = compress.node_lines(nodes.join(rows.select("id"), "id", "left_semi"), budget)
        else:
            text = compress.row_lines(rows, budget)
    lines = text.split("\n")
    while len(lines) > 3 and compress.estimate("\n".join(lines)) > budget:
        lines.pop()
    return "\n".join(lines) if len(lines) == len(text.split("\n")) else "\n".join([*lines, "..."])


def context_package(tables: dict[str, DataFrame], budget: int = 1500, key_nodes: int = 10, repository: str | None = None) -> str:
    """Summary, architecture and key nodes of a repository as one text within a budget of tokens: a third for the summary, what is left for the rest."""
    nodes, edges = tables["nodes"], tables["edges"]
    chosen = summary.find_repository(tables["repositories"], nodes, repository).first()
    if chosen is None:
        return "No data available."
    sections = ["## Graph Summary\n" + compress.summary_lines(_summary(tables, chosen["id"]), max(1, budget // 3))]
    used = compress.estimate(sections[0])
    if used < budget:
        sections.append("## Architecture\n" + _architecture_text(tables, nodes, chosen["id"], max(budget - used, 50)))
        used += compress.estimate(sections[-1])
    if used < budget:
        own = lambda t: t.where(F.col("repository_id") == chosen["id"])
        keys = search.search_nodes(own(nodes), own(edges), "", limit=key_nodes)
        sections.append("## Key Nodes\n" + compress.node_lines(nodes.join(keys.select("id"), "id", "left_semi"), max(budget - used, 50)))
    return compress._cut("\n\n".join(sections).split("\n"), budget)
