"""Layers, patterns and domains, by rules joined with names.

The catalogs are a few dozen rows each and fixed in the code, so they stand in
the plan as array literals; everything else is grouped by repository.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import base_name, stem
from quillgraph.operators import rules


def _literals(table: tuple) -> Column:
    """A catalog of (keyword, layer, weight) as an array, so that rules cost no join and no further scan."""
    return F.expr("array(" + ", ".join(f"named_struct('ordinal', {i}, 'keyword', '{k}', 'layer', '{layer}', 'weight', {float(w)}D)" for i, (k, layer, w) in enumerate(table)) + ")")


def _weighted(hits: Column, factor: Callable[[Column], Column], shift: int = 0) -> Column:
    """Hits as (layer, ordinal, weight), the weight times a factor that depends on the rule."""
    return F.transform(hits, lambda r: F.struct(r["layer"].alias("layer"), (r["ordinal"] + shift).alias("ordinal"), (r["weight"] * factor(r)).alias("weight")))


def normalise_layer(column):
    """One name for each layer."""
    names = F.create_map(*(F.lit(x) for kv in rules.ALIASES for x in kv))
    return F.coalesce(F.try_element_at(names, column), column)


def class_hits(name: Column, shift: int = 0) -> Column:
    """Every class rule that fits a name: full weight as an ending, 0.8 as a start, 0.5 inside."""
    lower = F.replace(F.lower(name), F.lit("-"), F.lit("_"))
    factor = lambda r: F.when(lower.endswith(r["keyword"]), 1.0).when(lower.startswith(r["keyword"]), 0.8).otherwise(0.5)
    return _weighted(F.filter(_literals(rules.CLASS_RULES), lambda r: lower.contains(r["keyword"])), factor, shift)


def file_hits(name: Column) -> Column:
    """Every file rule whose keyword is in the stem of a name; short ones only between underscores."""
    inner = stem(F.lower(base_name(name)))
    between = F.concat(F.lit("_"), inner, F.lit("_"))
    fits = lambda r: F.when(F.length(r["keyword"]) <= 3, between.contains(F.concat(F.lit("_"), r["keyword"], F.lit("_")))).otherwise(inner.contains(r["keyword"]))
    return _weighted(F.filter(_literals(rules.FILE_RULES), fits), lambda r: F.lit(1.0))


def directory_hits(name: Column, shift: int = 0) -> Column:
    """The directory rule of a name."""
    return _weighted(F.filter(_literals(rules.DIRECTORY_RULES), lambda r: r["keyword"] == F.lower(name)), lambda r: F.lit(1.0), shift)


_EVIDENCE = ("repository_id", "node_id", "layer", "kind", "source", "ordinal", "weight")


def layer_evidence(nodes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(repository_id, node_id, layer, kind, source, ordinal, weight): every hint at a layer, from one pass over the nodes.

    Class-like names count from a weight of 0.6, function names from 0.7 and
    then with 0.8 of it; an interface named I... speaks for data, a class named
    Abstract... for business where no rule fits better.  ``known`` has the
    (repository_id, framework) whose own files and folders are hints too.
    """
    rows = nodes.where(F.col("name").isNotNull()).select("repository_id", F.col("id").alias("node_id"), "node_type", "name", "file_path")
    kind, name = F.col("node_type"), F.col("name")
    classes = kind.isin("class", "interface", "enum")
    one = lambda layer, weight: F.array(F.struct(F.lit(layer).alias("layer"), F.lit(1000).alias("ordinal"), F.lit(weight).alias("weight")))
    prefix = F.when((kind == "interface") & name.rlike("^I[A-Z]"), one("data", 0.7)).when(classes & name.rlike("^Abstract[A-Z]"), one("business", 0.6))
    hits = class_hits(name)
    functions = F.transform(F.filter(hits, lambda h: h["weight"] >= 0.7), lambda h: F.struct(h["layer"].alias("layer"), h["ordinal"].alias("ordinal"), (h["weight"] * 0.8).alias("weight")))
    none = F.array().cast("array<struct<kind:string,layer:string,ordinal:int,weight:double>>")
    told = lambda label, array: F.coalesce(F.transform(array, lambda h: F.struct(F.lit(label).alias("kind"), h["layer"].alias("layer"), h["ordinal"].alias("ordinal"), h["weight"].alias("weight"))), none)
    hints = (
        F.when(classes, F.concat(told("class_naming", F.filter(hits, lambda h: h["weight"] >= 0.6)), told("interface_naming", prefix)))
        .when(kind.isin("function", "method"), told("function_naming", functions))
        .when(kind == "file", told("file_naming", file_hits(name)))
        .when(kind == "directory", told("directory", directory_hits(name)))
    )
    found = rows.where(kind.isin("class", "interface", "enum", "function", "method", "file", "directory")).select("repository_id", "node_id", name.alias("source"), F.explode(hints).alias("h"))
    found = found.select("repository_id", "node_id", normalise_layer(F.col("h.layer")).alias("layer"), "h.kind", "source", "h.ordinal", "h.weight")
    return found if known is None else found.unionByName(framework_evidence(nodes, known))


def framework_evidence(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """The hints of frameworks' own files, of applications of Django and of Rails' folders, in repositories that have the framework."""
    rows = nodes.where(F.col("file_path").isNotNull() & F.col("name").isNotNull() & F.col("node_type").isin("file", "directory"))
    last = F.lower(base_name("name"))
    own = F.expr(
        "array("
        + ", ".join(
            f"named_struct('framework', '{framework}', 'kind', 'framework_file', 'layer', '{layer}', 'weight', {float(w)}D, 'ordinal', {i}, 'whole', '{keyword.lower()}', 'stem', '{keyword.lower().rsplit('.', 1)[0]}')"
            for i, (framework, keyword, layer, w) in enumerate(rules.FRAMEWORK_FILE_RULES)
        )
        + ")"
    )
    hint = lambda framework, kind, layer, weight: F.struct(F.lit(framework).alias("framework"), F.lit(kind).alias("kind"), F.lit(layer).alias("layer"), F.lit(weight).alias("weight"), F.lit(0).alias("ordinal"))
    files = F.transform(F.filter(own, lambda r: (r["whole"] == last) | (r["stem"] == stem(last))), lambda r: F.struct(*(r[c].alias(c) for c in ("framework", "kind", "layer", "weight", "ordinal"))))
    django = F.when(last.isin(*rules.DJANGO_APP_FILES) & F.col("file_path").contains("/"), F.array(hint("django", "django_app", "controller", 0.5)))
    none = F.array().cast("array<struct<framework:string,kind:string,layer:string,weight:double,ordinal:int>>")
    rails = F.filter(F.array(*(F.when(F.col("file_path") == path, hint("rails", "rails_convention", layer, 1.0)) for path, layer in rules.RAILS_FOLDERS)), lambda x: x.isNotNull())
    hints = F.when(F.col("node_type") == "file", F.concat(files, F.coalesce(django, none))).otherwise(rails)
    asked = rows.select("repository_id", F.col("id").alias("node_id"), F.col("file_path").alias("source"), F.explode(hints).alias("h")).select("repository_id", "node_id", "source", "h.*")
    met = asked.join(known.select("repository_id", "framework").distinct(), ["repository_id", "framework"], "left_semi")
    return met.select(*(normalise_layer(F.col("layer")).alias("layer") if c == "layer" else c for c in _EVIDENCE))


def layers(evidence: DataFrame) -> DataFrame:
    """(repository_id, layer, confidence, entities, sources): (0.4 mean + 0.6 max) of the weights, less with fewer than three sources."""
    grouped = evidence.groupBy("repository_id", "layer").agg(
        F.avg("weight").alias("mean"), F.max("weight").alias("most"), F.count("*").alias("entities"), F.countDistinct("source").alias("sources")
    )
    confidence = F.least((F.col("mean") * 0.4 + F.col("most") * 0.6) * F.least(F.col("sources") / 3.0, F.lit(1.0)), F.lit(1.0))
    return grouped.select("repository_id", "layer", F.round(confidence, 2).alias("confidence"), "entities", "sources")


def layer_examples(evidence: DataFrame, k: int = 8) -> DataFrame:
    """(repository_id, layer, examples): the first sources of each layer by name."""
    order = Window.partitionBy("repository_id", "layer").orderBy("source")
    first = evidence.select("repository_id", "layer", "source").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    examples = F.array_join(F.array_sort(F.collect_list("source")), ", ")
    return first.groupBy("repository_id", "layer").agg(examples.alias("examples"))


def layer_kinds(evidence: DataFrame) -> DataFrame:
    """(repository_id, layer, kind, n): how many hints of each kind speak for a layer."""
    return evidence.groupBy("repository_id", "layer", "kind").agg(F.count("*").alias("n"))


def patterns(found: DataFrame) -> DataFrame:
    """(repository_id, pattern, confidence, matched): patterns of whose layers at least half were found."""
    spark = found.sparkSession
    needed = [(p, layer, len(asked)) for p, *asked in rules.PATTERNS for layer in asked]
    needed = F.broadcast(spark.createDataFrame(needed, "pattern string, layer string, asked int"))
    grouped = found.join(needed, "layer").groupBy("repository_id", "pattern", "asked").agg(F.avg("confidence").alias("mean"), F.count("*").alias("matched"))
    ratio = F.col("matched") / F.col("asked")
    return grouped.where(ratio >= 0.5).select("repository_id", "pattern", F.round(F.col("mean") * ratio, 2).alias("confidence"), "matched")


def frameworks(repositories: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repository_id, framework, confidence): from the manifest, or from directory and file names where it names none.

    A manifest that is null or cut off names none.
    """
    spark = nodes.sparkSession
    listed = F.from_json("manifest_json", "frameworks array<struct<name string, confidence double>>")
    named = repositories.select(F.col("id").alias("repository_id"), F.explode(listed["frameworks"]).alias("f")).where(F.col("f.name") != "")
    key = F.regexp_replace(F.lower("f.name"), "[ -]", "_")
    key = F.when(key.isin("ruby_on_rails", "ruby_rails"), "rails").otherwise(key)
    stated = named.select("repository_id", key.alias("framework"), F.col("f.confidence").alias("confidence"))
    segments = spark.createDataFrame(list(rules.FRAMEWORK_SEGMENTS), "framework string, hint string, weight double")
    names = spark.createDataFrame(list(rules.FRAMEWORK_FILES), "framework string, hint string, weight double")
    folders = nodes.where((F.col("node_type") == "directory") & F.col("file_path").isNotNull())
    inner = F.concat(F.lit("/"), F.lower("file_path"), F.lit("/"))
    by_folder = folders.join(F.broadcast(segments), inner.contains(F.concat(F.lit("/"), F.col("hint"), F.lit("/")))).select("repository_id", "framework", "hint", "weight").distinct()
    files = nodes.where((F.col("node_type") == "file") & F.col("file_path").isNotNull())
    ruby = files.where(F.col("file_path").endswith(".rb")).select("repository_id").distinct().withColumn("ruby", F.lit(True))
    by_file = files.join(F.broadcast(names), F.lower(base_name("file_path")) == F.col("hint")).select("repository_id", "framework", "hint", "weight").distinct()
    by_file = by_file.join(ruby, "repository_id", "left").where((F.col("framework") != "rails") | F.col("ruby")).drop("ruby")
    guessed = by_folder.unionByName(by_file).groupBy("repository_id", "framework").agg(F.round(F.least(F.sum("weight"), F.lit(1.0)), 2).alias("confidence"))
    return stated.unionByName(guessed.join(stated.select("repository_id").distinct(), "repository_id", "left_anti"))


def framework_patterns(found: DataFrame, known: DataFrame) -> DataFrame:
    """(repository_id, framework, confidence) of the frameworks' own patterns, for frameworks known with at least 0.3."""
    spark = found.sparkSession
    asked = [(f, c, layer, len(ls)) for f, c, *ls in rules.FRAMEWORK_PATTERNS for layer in ls]
    asked = F.broadcast(spark.createDataFrame(asked, "framework string, fixed double, layer string, n int"))
    sure = known.where(F.col("confidence") >= 0.3).select("repository_id", "framework").distinct()
    rows = found.join(asked, "layer").join(sure, ["repository_id", "framework"], "left_semi")
    grouped = rows.groupBy("repository_id", "framework", "fixed", "n").agg(F.sum("confidence").alias("s"))
    return grouped.select("repository_id", "framework", F.coalesce("fixed", F.round(F.col("s") / F.col("n"), 2)).alias("confidence"))


def file_layers(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(repository_id, file_path, layer): of each file the layer of greatest weight among those found, the first rule on a tie."""
    path = F.col("file_path")
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    hits = F.when(F.col("node_type") == "file", F.concat(file_hits(path), F.flatten(F.transform(folders, lambda x: directory_hits(x, 1000))))).otherwise(
        F.filter(class_hits(F.col("name"), 2000), lambda h: h["weight"] >= 0.6)
    )
    rows = nodes.where(path.isNotNull() & ((F.col("node_type") == "file") | F.col("node_type").isin("class", "interface", "enum") & F.col("name").isNotNull()))
    hits = rows.select("repository_id", "file_path", F.explode(hits).alias("h")).select("repository_id", "file_path", "h.*")
    hits = hits.join(found.select("repository_id", "layer"), ["repository_id", "layer"], "left_semi")
    return hits.groupBy("repository_id", "file_path").agg(F.max_by("layer", F.struct(F.col("weight"), -F.col("ordinal"))).alias("layer"))


def _placed_imports(edges: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct imports between files of different layers, with both layers and paths."""
    of_file = file_layers(nodes, found)
    placed = nodes.where(F.col("node_type") == "file").join(of_file, ["repository_id", "file_path"]).select("id", "repository_id", "layer", "file_path")
    imports = edges.where(F.col("edge_type") == "IMPORTS").select("source_node_id", "target_node_id").distinct()
    source = placed.select(F.col("id").alias("source_node_id"), "repository_id", F.col("layer").alias("source_layer"), F.col("file_path").alias("source_path"))
    target = placed.select(F.col("id").alias("target_node_id"), F.col("layer").alias("target_layer"), F.col("file_path").alias("target_path"))
    return imports.join(source, "source_node_id").join(target, "target_node_id").where("source_layer <> target_layer")


def layer_flows(edges: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(repository_id, source_layer, target_layer, n): distinct imports between files of different layers."""
    both = _placed_imports(edges, nodes, found)
    return both.groupBy("repository_id", "source_layer", "target_layer").agg(F.count("*").alias("n"))


def flow_examples(edges: DataFrame, nodes: DataFrame, found: DataFrame, k: int = 3) -> DataFrame:
    """(repository_id, source_layer, target_layer, source_path, target_path): the first imports by path of each flow."""
    order = Window.partitionBy("repository_id", "source_layer", "target_layer").orderBy("source_path", "target_path")
    columns = ["repository_id", "source_layer", "target_layer", "source_path", "target_path"]
    both = _placed_imports(edges, nodes, found).select(*columns).distinct()
    return both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def expected_flows(flows: DataFrame, directions: tuple[tuple[str, str], ...] = rules.EXPECTED_FLOWS) -> DataFrame:
    """(repository_id, source_layer, target_layer, forward, reverse, expected) for the directions layers should depend in."""
    asked = F.broadcast(flows.sparkSession.createDataFrame(list(directions), "source_layer string, target_layer string"))
    keys = ["repository_id", "source_layer", "target_layer"]
    forward = flows.join(asked, ["source_layer", "target_layer"]).withColumnRenamed("n", "forward")
    turned = flows.toDF("repository_id", "target_layer", "source_layer", "reverse").join(asked, ["source_layer", "target_layer"])
    both = forward.join(turned, keys, "full").select(*keys, F.coalesce("forward", F.lit(0)).alias("forward"), F.coalesce("reverse", F.lit(0)).alias("reverse"))
    return both.withColumn("expected", F.col("forward") >= F.col("reverse"))


# Top-level directories that are no domain.
NO_DOMAIN = ("node_modules", "venv", ".git", "__pycache__", "dist", "build", "vendor", ".tox", ".eggs", "env")


def domains(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(repository_id, domain, files, service_files, confidence) of top-level directories that look like a domain."""
    top = F.regexp_extract("file_path", r"^([^/]+)/", 1)
    inside = nodes.where(F.col("file_path").isNotNull()).withColumn("domain", top).where((F.col("domain") != "") & ~F.col("domain").startswith(".") & ~F.col("domain").isin(*NO_DOMAIN))
    files = inside.where(F.col("node_type") == "file").select("repository_id", "domain", "file_path").distinct()
    scored = files.select("*", F.explode(file_hits(F.col("file_path"))).alias("h")).select(*files.columns, "h.*").where("weight >= 0.5").join(found.select("repository_id", "layer"), ["repository_id", "layer"], "left_semi")
    layered = scored.groupBy("repository_id", "domain", "file_path").agg(F.min_by("layer", "ordinal").alias("layer"))
    sizes = files.groupBy("repository_id", "domain").agg(F.count("*").alias("files"))
    service = layered.where(F.col("layer").isin("controller", "business", "data")).groupBy("repository_id", "domain").agg(F.count("*").alias("service_files"))
    kinds = inside.join(files, ["repository_id", "domain", "file_path"], "left_semi").groupBy("repository_id", "domain").agg(F.countDistinct("node_type").alias("kinds"))
    both = sizes.where("files >= 2").join(service, ["repository_id", "domain"], "left").join(kinds, ["repository_id", "domain"])
    served = F.coalesce("service_files", F.lit(0))
    confidence = F.round(F.least(F.lit(0.3) + served / F.col("files") * 0.4 + F.col("kinds") / 5.0 * 0.3, F.lit(1.0)), 2)
    out = both.select("repository_id", "domain", "files", served.alias("service_files"), confidence.alias("confidence"))
    return out.where("service_files >= 2 OR confidence >= 0.4")


def architecture_rows(found: DataFrame, shapes: DataFrame, parts: DataFrame) -> DataFrame:
    """(repository_id, layer, pattern, description): layers, patterns and domains in one table, told apart by the layer column."""
    text = lambda c: F.format_string("confidence %.2f", F.col(c))
    return (
        found.select("repository_id", "layer", F.lit(None).cast("string").alias("pattern"), text("confidence").alias("description"))
        .unionByName(shapes.select("repository_id", F.lit("pattern").alias("layer"), "pattern", text("confidence").alias("description")))
        .unionByName(parts.select("repository_id", F.lit("domain").alias("layer"), F.col("domain").alias("pattern"), text("confidence").alias("description")))
    )


def stored_architecture(rows: DataFrame, tag: str) -> DataFrame:
    """(repository_id, name, confidence) read back from ``architecture_rows``: of its 'layer', 'pattern' or 'domain' rows."""
    own = F.col("layer") == tag if tag != "layer" else ~F.col("layer").isin("pattern", "domain")
    name = F.col("layer") if tag == "layer" else F.col("pattern")
    return rows.where(own).select("repository_id", name.alias("name"), F.regexp_extract("description", r"confidence ([\d.]+)", 1).cast("double").alias("confidence"))
