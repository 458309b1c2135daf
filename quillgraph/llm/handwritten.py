"""Generated, minified or vendored source files.

A random forest judges the content of a file: compression ratio, entropy of
its tokens, lengths of its identifiers, comment density, white space, digits
and line lengths.  Its labels are marks that the features can't see: header
notices ("do not edit", "copied from", ...), which are cut out of the text
before the features are taken, and, as a third class, names that only packed
files and data have (``x.min.js``, ``x_lut.c``).  The second kind of label was
added since compressed files and data mostly carry no notice, so notices alone
teach a forest nothing about them.

Labels are rare and many files of a class have none.  So the classes are
weighted to equal shares, and a first forest adds to the third class what it is
sure of before the second is trained.  The score from which a class counts is
where fewest errors are made.  It is learned on all labelled rows, each scored
by a forest that was trained on the other half; the forest that judges is
trained on all rows.  A class that content doesn't tell from the rest decides
nothing; which ones do depends on the data.

A file like any other but for its header is found by the evidence that isn't
content: the notice itself, a path that only generators or package managers
write, and a repository that lies in another one below a folder of third-party
code.  A packed or data name decides only where there is no head to judge.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.session import cut

#: Values a feature is cut to before the forest sees it; the cuts are of equal counts over all rows.
CUTS = 31
#: Score from which the first forest is sure enough of a file to add it to a class.
SURE = 0.5
#: What a class must be told apart by, as recall less false alarms on held-out rows, to decide anything.
APART = 0.9
#: Bins of the scores on the logit scale between -BINS / 8 and BINS / 8.
BINS = 96

FEATURES = (
    "compression", "token_entropy", "char_entropy", "identifier_mean", "identifier_short", "comment_density",
    "space_share", "digit_share", "symbol_share", "head_line_mean", "bytes_per_line_log", "longest_line_log", "line_ratio_log",
)

_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\w\s]")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*")
_COMMENT_LINE = re.compile(r"^\s*(?://|#(?!\s*(?:include|define|if|endif|else|pragma)\b)|/\*|\*|--\s|;;|<!--|\"\"\"|''')")

# What header notices say. Each is tried on one comment line in lower case.
GENERATED_NOTICES = (
    r"code generated (?:by|from)\b", r"@generated\b", r"\bauto-?generated>", r"\bauto-?generated\b.*\b(?:by|from|file|code|do not)\b",
    r"^auto-?generated\b", r"\b(?:file|source|code) (?:is|was|has been) (?:auto-?)?generated\b", r"\bre-?generated\b.* from\b", r"\binstead of (?:changing|editing|modifying) this\b", r"\bdon'?t (?:touch|edit|modify|change)\b[^a-z]*(?:$|by hand|manually|directly|this file|(?:re-?)?generated)",
    r"\bautomatically (?:generated|created|produced|written) (?:by|from|with)\b", r"\b(?:this )?file (?:is|was|has been) (?:\w+ )?(?:generated|produced|created) (?:by|from|with)\b",
    r"^generated (?:by|from|with|using|at|on)\b", r"\bdo not (?:edit|modify|change)\b[^a-z]*(?:$|by hand|manually|directly|this file|unless)", r"^do not (?:edit|modify) this\b",
    r"^(?:output|produced|emitted|written|built|created|rendered) (?:of|by|with|from) \S+ (?:v?\d|--|on |from |at )", r"\bmachine[- ](?:written|generated|made)\b", r"^any (?:manual )?(?:change|edit|modification)s?\b.*\b(?:overwritten|lost|discarded)\b",
    r"\bchanges?\b.*\bwill be (?:overwritten|lost)\b", r"\bautomatisch (?:erzeugt|generiert|erstellt)\b", r"\b(?:fichier|code) (?:produit|généré|genere|créé)\b.*\bpar\b", r"\bne pas modifier\b", r"\bnicht (?:bearbeiten|ändern|von hand)\b",
    r"\b(?:generado|producido|creado) (?:automáticamente|por)\b", r"\bno (?:editar|modificar)\b", r"\b(?:сгенерирован|создан автоматически|не редактир)",
)
VENDORED_NOTICES = (
    r"\bcopied (?:unchanged|verbatim|as is) from\b", r"\b(?:imported|vendored|backported|taken|borrowed|copied|adapted|forked|ported) from \S+(?:@|\s+(?:release|version|v|commit|tag)?\s*v?)\d",
    r"\bkeep in sync with upstream\b", r"\bupstream\b.*\b(?:removed|unchanged|unmodified)\b", r"^\S+ v\d[\w.]* ?[|–-].*\blicen[cs]e\b", r"^copyright (?:\(c\) )?\d{4}\S* the \S+ (?:project|authors|contributors)\b",
    r"\b(?:this file is )?part of \S+ v?\d[\w.]*\b",
)
#: Folders that generators or package managers own.
GENERATED_FOLDERS = (
    "generated", "_generated", "__generated__", "autogen", "autogenerated", "auto-generated", "auto_generated", "gen-src", "gen_src", "generated-src",
    "generated-sources", "generated_sources", "gensrc", "codegen_out", "codegen-out", "gen",
)
VENDOR_FOLDERS = (
    "vendor", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "3rd-party", "extern", "externals",
    "node_modules", "bower_components", "jspm_packages", "web_modules", "site-packages", "dist-packages", "deps", "contrib", "pods", "carthage",
    "subprojects/packagecache", "_deps", "go/pkg/mod", ".cargo/registry", ".m2/repository", ".gradle/caches", ".bundle", "godeps/_workspace",
)
#: File names that only generators give.
GENERATED_NAMES = (
    r"_pb2(?:_grpc)?\.pyi?$", r"\.pb\.(?:go|h|cc|cpp|c|swift|rs|dart)$", r"\.pb\.gw\.go$", r"_pb\.(?:js|ts|rb|d\.ts)$", r"_services_pb\.rb$", r"\.g\.(?:cs|dart|i\.cs)$", r"\.designer\.(?:cs|vb)$",
    r"\.gen\.\w+$", r"\.generated\.\w+$", r"_gen\.(?:go|py|rs|c|h|ts|js)$", r"_generated\.\w+$", r"^zz_.*\.go$", r"_string\.go$", r"_deepcopy\.go$", r"_string_gen\.go$", r"outerclass(?:grpc)?\.java$", r"[a-z0-9]grpc\.java$", r"\.(?:freezed|mocks)\.dart$", r"_bindings?\.gen\.rs$", r"\.tab\.[ch](?:pp)?$", r"^lex\.yy\.", r"^moc_\w+\.\w+$", r"^ui_\w+\.h$", r"^qrc_\w+\.\w+$", r"^y\.tab\.",
)
PACKED_NAMES = (
    r"[.-]min\.\w+$", r"\.bundle\.\w+$", r"\.pack(?:ed)?\.\w+$", r"\.chunk\.\w+$", r"\.prod-[0-9a-f]{5,}\.\w+$", r"^(?:chunk|vendors?|main|app|runtime|index)[.-][0-9a-f]{6,}\.\w+$", r"\.[0-9a-f]{8,}\.(?:js|ts|css)$", r"\.base64\.\w+$",
)

DATA_NAMES = (r"\.base64\.\w+$", r"_(?:blob|lut|weights|table_data|fixture_dump|lookup_table|rom|bitmap|font_data|data_table)\.\w+$", r"^(?:glyphs?|font|bitmap|sprites?)_[0-9a-f]{4,}\.\w+$")


def _any(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


_NOTICE = re.compile(_any(GENERATED_NOTICES + VENDORED_NOTICES))
_LINE_MARKS = re.compile(r"^[\s/*#;<!\-\"'.]+|[\s*/\-\"'>]+$")


def split_notice(head: str) -> tuple[bool, str]:
    """Whether the leading comment holds a notice, and the text without that comment."""
    lines = head.split("\n")
    n, inside = 0, False
    while n < len(lines):
        line = lines[n]
        if inside:
            inside = "*/" not in line
        elif _COMMENT_LINE.match(line):
            inside = line.lstrip().startswith("/*") and "*/" not in line
        elif line.strip() or n > 40:
            break
        n += 1
    noticed = any(_NOTICE.search(_LINE_MARKS.sub("", x).lower()) for x in lines[:n])
    return noticed, "\n".join(lines[n:])


def content_features(body: str, n_bytes: float | None, n_lines: float | None, longest: float | None) -> list[float]:
    """The features of one file in the order of ``FEATURES``, from its text after the leading comment."""
    raw = body.encode("utf-8", "replace")
    size = max(len(body), 1)
    tokens = Counter(_TOKEN.findall(body))
    total = max(sum(tokens.values()), 1)
    entropy = -sum(v / total * math.log2(v / total) for v in tokens.values())
    chars = Counter(body)
    char_entropy = -sum(v / size * math.log2(v / size) for v in chars.values())
    names = _IDENTIFIER.findall(body)
    lines = body.split("\n")
    comment = sum(1 for x in lines if _COMMENT_LINE.match(x))
    per_line = (n_bytes or len(raw)) / max(n_lines or len(lines), 1)
    wide = longest or max(map(len, lines))
    return [
        len(zlib.compress(raw, 6)) / max(len(raw), 1),
        entropy / math.log2(total + 1),
        char_entropy,
        sum(map(len, names)) / max(len(names), 1),
        sum(1 for x in names if len(x) <= 2) / max(len(names), 1),
        comment / len(lines),
        sum(v for c, v in chars.items() if c.isspace()) / size,
        sum(v for c, v in chars.items() if c.isdigit()) / size,
        sum(v for c, v in chars.items() if not c.isalnum() and not c.isspace()) / size,
        size / len(lines),
        math.log1p(per_line),
        math.log1p(wide),
        math.log1p(wide / max(per_line, 1)),
    ]


_CONTENT = T.StructType(
    [T.StructField("key", T.LongType()), T.StructField("noticed", T.BooleanType())] + [T.StructField(f, T.DoubleType()) for f in FEATURES]
)


def _contents(files: DataFrame) -> DataFrame:
    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, head, size, lines, longest in batch.itertuples(index=False):
                noticed, body = split_notice(head)
                known = [None if v is None or v != v else float(v) for v in (size, lines, longest)]
                rows.append((key, noticed, *content_features(body, *known)))
            yield pd.DataFrame(rows, columns=_CONTENT.names)

    return files.select("key", "head", "n_bytes", "n_lines", "longest_line").mapInPandas(compute, _CONTENT)


def _in_folder(path: Column, folders: tuple[str, ...]) -> Column:
    inner = F.concat(F.lit("/"), F.lower(path), F.lit("/"))
    return inner.rlike("/(?:" + "|".join(re.escape(f) for f in folders) + ")/")


def path_evidence(path: Column) -> Column:
    """What the path of a file within its repository says: 'generated', 'packed', 'data', 'vendored' or null."""
    path = F.regexp_replace(path, r"\\", "/")
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return (
        F.when(_in_folder(folder, VENDOR_FOLDERS), "vendored")
        .when(_in_folder(folder, GENERATED_FOLDERS) | name.rlike(_any(GENERATED_NAMES)), "generated")
        .when(name.rlike(_any(PACKED_NAMES)), "packed")
        .when(name.rlike(_any(DATA_NAMES)), "data")
    )


def nested_copies(repositories: DataFrame) -> DataFrame:
    """(repository_id): repositories inside another one's path below a folder of third-party code.

    Ancestors are found by an equi-join on every prefix of a path, not by
    comparing all paths with all.
    """
    clean = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), "/+$", "")
    paths = repositories.where(F.col("path").isNotNull()).select(F.col("id").alias("repository_id"), clean.alias("path"))
    parts = F.split("path", "/")
    prefixes = paths.select("repository_id", "path", F.explode(F.expr("sequence(1, greatest(size(split(path, '/')) - 1, 1))")).alias("n"))
    prefixes = prefixes.select("repository_id", "path", F.array_join(F.slice(parts, 1, F.col("n")), "/").alias("outer"))
    outer = paths.select(F.col("path").alias("outer")).distinct()
    within = prefixes.join(outer, "outer").where(F.col("outer") != F.col("path"))
    folder = F.regexp_extract(F.expr("substring(path, length(outer) + 2)"), r"^(.*)/[^/]*$", 1)
    return within.where(_in_folder(folder, VENDOR_FOLDERS)).select("repository_id").distinct()


def _fit(rows: DataFrame, trees: int, depth: int) -> RandomForestClassificationModel:
    """A forest on (features, label), the labels weighted to equal shares."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = F.coalesce(*(F.when(F.col("label") == k, sum(counts.values()) / n) for k, n in counts.items()))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, weightCol="weight", seed=5, subsamplingRate=0.8)
    return forest.fit(rows.select("features", "label", weight.alias("weight")))


def best_threshold(histogram: dict[tuple[float, int], int], label: float) -> float | None:
    """The score from which a label counts, from how many rows each (label, bin) has; None where it isn't told from the rest.

    The score with fewest errors, labelled rows below it and rows of label 0
    from it on; in the middle of the bins where that is so.
    """
    own = [histogram.get((label, b), 0) for b in range(BINS + 1)]
    rest = [histogram.get((0.0, b), 0) for b in range(BINS + 1)]
    if not sum(own) or not sum(rest):
        return None
    if max(sum(own[b:]) / sum(own) - sum(rest[b:]) / sum(rest) for b in range(BINS + 1)) < APART:
        return None
    gain = [sum(own[b:]) - sum(rest[b:]) for b in range(BINS + 1)]
    best = [b for b, g in enumerate(gain) if g == max(gain)]
    return 1 / (1 + math.exp(-((best[0] + best[-1]) / 2 - BINS / 2) / 4))


def _binned(contents: DataFrame) -> DataFrame:
    """The features as numbers of bins, whose edges come from all rows.

    Left to itself the forest takes its candidate splits from some 10,000 rows;
    of at most 32 values it takes every one.
    """
    grid = [F.floor(F.col(f) * 1000).cast("long") for f in FEATURES]
    cells = contents.select(F.explode(F.array(*(F.struct(F.lit(i).alias("f"), g.alias("v")) for i, g in enumerate(grid)))).alias("c"))
    cells = cells.groupBy("c.f", "c.v").agg(F.count("*").alias("n"))
    # A cell's bin: how many of the CUTS equal parts of all rows lie below its middle.
    before = Window.partitionBy("f").orderBy("v")
    total = F.sum("n").over(Window.partitionBy("f"))
    cells = cells.withColumn("bin", F.floor((F.sum("n").over(before) - F.col("n") / 2) * CUTS / total))
    edges: dict[int, list[int]] = {}
    for r in cells.groupBy("f", "bin").agg(F.min("v").alias("least")).orderBy("f", "bin").collect():
        edges.setdefault(r["f"], []).append(r["least"])
    bins = [sum((F.when(g >= e, 1.0).otherwise(0.0) for e in edges.get(i, [])[1:]), F.lit(0.0)) for i, g in enumerate(grid)]
    return contents.select("key", "noticed", "label", *(b.alias(f) for f, b in zip(FEATURES, bins, strict=True)))


def _scored(contents: DataFrame, trees: int, depth: int) -> DataFrame:
    """(key, noticed, score, found) of every row of (key, noticed, features, label)."""
    counts = {r["label"]: r["n"] for r in contents.groupBy("label").agg(F.count("*").alias("n")).collect()}
    classes = [k for k in sorted(counts) if k]
    if not classes or len(counts) < 2:
        return contents.select("key", "noticed", F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("found"))
    half = F.pmod(F.xxhash64("key", F.lit(23)), F.lit(2))
    chance = lambda k: F.coalesce(F.get(vector_to_array("probability"), F.lit(int(k))), F.lit(0.0))
    first = _fit(contents, trees, depth)
    # Unlabelled rows that are surely packed or data.
    sure = F.when((F.col("label") == 0) & (chance(2.0) >= SURE), 2.0).otherwise(F.col("label"))
    labelled = cut(first.transform(contents).select("key", "noticed", "features", sure.alias("label")))
    judged = None
    for part in (0, 1):
        kept = labelled.where(half != part)
        if kept.select("label").distinct().count() < 2:
            continue
        own = _fit(kept, trees, depth).transform(labelled.where(half == part)).select("label", *(chance(k).alias(f"p{int(k)}") for k in classes))
        judged = own if judged is None else judged.unionByName(own)
    if judged is None:
        judged = first.transform(labelled.where(F.lit(False))).select("label", *(chance(k).alias(f"p{int(k)}") for k in classes))
    judged = cut(judged)
    model = _fit(labelled, trees, depth)
    found, score = F.lit(False), F.lit(0.0)
    for k in classes:
        p = F.least(F.greatest(F.col(f"p{int(k)}"), F.lit(1e-9)), F.lit(1 - 1e-9))
        place = F.least(F.greatest(F.floor(F.log(p / (1 - p)) * 4 + BINS / 2), F.lit(0)), F.lit(BINS)).cast("int")
        histogram = {(r["label"], r["bin"]): r["n"] for r in judged.groupBy("label", place.alias("bin")).agg(F.count("*").alias("n")).collect()}
        # Too few labels to hold any out: the middle.
        threshold = best_threshold(histogram, k) if any(x == k for x, _ in histogram) else 0.5
        if threshold is not None:
            found, score = found | (chance(k) >= threshold), F.greatest(score, chance(k))
    return model.transform(labelled).select("key", "noticed", score.alias("score"), found.alias("found"))


def judge_files(nodes: DataFrame, repositories: DataFrame, source_heads: DataFrame, trees: int = 40, depth: int = 8) -> DataFrame:
    """(node_id, repository_id, file_path, score, reason) of every node of type file.

    ``reason`` is 'notice', 'generated', 'vendored', 'nested copy', 'content',
    'packed' or 'data', and null for a file that counts as hand-written.
    ``score`` is the forest's, the greatest of the classes that decide; it is
    null where there is no head, or a blank one, to judge.  A file node without a path is judged by its
    repository alone; a file indexed twice gives two rows.  Without labels of
    two kinds there is no forest and names stand for it.
    """
    files = nodes.where(F.lower("node_type") == "file").select(F.col("id").alias("node_id"), "repository_id", "file_path")
    heads = source_heads.where(F.length(F.trim("head")) > 0).withColumn("key", F.xxhash64("repository_id", "file_path")).dropDuplicates(["key"])
    names = heads.select("key", path_evidence(F.col("file_path")).isin("packed", "data").alias("packed_name"))
    # Counted, sampled, fitted and judged: the features are taken once.
    contents = cut(_contents(heads).join(names, "key"))
    kind = F.when(F.coalesce("packed_name", F.lit(False)), 2.0).when(F.col("noticed"), 1.0).otherwise(0.0)
    contents = _binned(contents.withColumn("label", kind))
    contents = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(contents)
    scored = _scored(contents, trees, depth)

    nested = nested_copies(repositories).withColumn("nested", F.lit(True))
    judged = (
        files.withColumn("key", F.xxhash64("repository_id", "file_path"))
        .join(scored, "key", "left")
        .join(nested, "repository_id", "left")
    )
    path = path_evidence(F.col("file_path"))
    reason = (
        F.when(F.col("noticed"), "notice")
        .when(F.col("nested"), "nested copy")
        .when(path.isin("vendored", "generated"), path)
        .when(F.col("found"), "content")
        .when(F.col("score").isNull(), path)
    )
    return judged.select("node_id", "repository_id", "file_path", "score", reason.alias("reason"))
