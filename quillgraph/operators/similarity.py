"""Embedding texts and exact similarity search by one query."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import parsed_metadata

# Types of nodes that get a vector.
EMBEDDED_TYPES = ("class", "function", "method", "file", "interface", "enum", "type_alias")


class Encoder(Protocol):
    model: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Words hashed to signed dimensions, unit length; needs no model file and is the same everywhere."""

    def __init__(self, dimensions: int = 384) -> None:
        self.dimensions = dimensions
        self.model = f"hashing-{dimensions}"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[row, h % self.dimensions] += 1.0 if h >> 63 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


def text_words(text: Column) -> Column:
    """The words of a text in lower case, names in mixed case taken apart."""
    parted = F.regexp_replace(F.regexp_replace(text, r"([\p{Ll}\d])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.lower(parted), r"[^\p{L}\p{N}]+"), lambda w: w != "")


class WordVectorEncoder:
    """Word vectors trained on the texts of nodes; a text is the mean of its words', at unit length.

    Trained and applied by Spark; words in fewer than ``least`` places have no
    vector, which bounds the vocabulary, and a text without known words has a
    null one.
    """

    def __init__(self, fitted: Word2VecModel) -> None:
        self.fitted = fitted
        self.model = f"words-{fitted.getVectorSize()}"

    @classmethod
    def fit(cls, nodes: DataFrame, dimensions: int = 64, least: int = 3, rounds: int = 2) -> WordVectorEncoder:
        words = node_text(nodes).select(text_words(F.col("text")).alias("words")).where(F.size("words") > 1)
        tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        learner = Word2Vec(vectorSize=dimensions, minCount=least, maxIter=rounds, numPartitions=tasks, windowSize=8, seed=11, inputCol="words", outputCol="mean")
        return cls(learner.fit(words))

    def encode_frame(self, texts: DataFrame) -> DataFrame:
        """(node_id, model, vector) of (node_id, text)."""
        split = texts.select("node_id", F.coalesce(text_words(F.col("text")), F.array().cast("array<string>")).alias("words"))
        mean = self.fitted.transform(split).select("node_id", vector_to_array("mean").alias("v"))
        size = mean.select("node_id", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("n"))
        unit = F.when(F.col("n") > 0, F.transform("v", lambda x: (x / F.col("n")).cast("float")))
        return size.select("node_id", F.lit(self.model).alias("model"), unit.alias("vector"))

    def encode(self, texts: list[str]) -> np.ndarray:
        """The vectors of a few texts; zeros for one without known words."""
        frame = SparkSession.active().createDataFrame(list(enumerate(texts)), "node_id long, text string")
        found = {r["node_id"]: r["vector"] for r in self.encode_frame(frame).collect()}
        return np.array([found[i] or [0.0] * self.fitted.getVectorSize() for i in range(len(texts))], np.float32)


def node_text(nodes: DataFrame) -> DataFrame:
    """(node_id, text): what is encoded of a node, one line a fact; missing facts have no line."""
    meta = parsed_metadata("metadata_json")
    get = lambda key: F.nullif(F.get_json_object(meta, f"$.{key}"), F.lit(""))
    parameters = F.from_json(F.get_json_object(meta, "$.parameters"), "array<string>")
    lines = F.concat_ws(
        "\n",
        F.concat(F.col("node_type"), F.lit(": "), F.col("name")),
        F.concat(F.lit("file: "), F.col("file_path")),
        F.concat(F.lit("docstring: "), get("docstring")),
        F.when(F.col("node_type").isin("function", "method"), F.concat(F.lit("signature: "), get("signature"))),
        F.when(F.col("node_type") == "method", F.concat(F.lit("parent: "), get("parent_name"))),
        F.when(F.col("node_type") == "function", F.concat(F.lit("module: "), get("parent_name"))),
        F.when(F.size(parameters) > 0, F.concat(F.lit("parameters: "), F.array_join(parameters, ", "))),
        F.concat(F.lit("returns: "), get("return_type")),
    )
    return nodes.select(F.col("id").alias("node_id"), lines.alias("text"))


def backlog(nodes: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Nodes of the embedded types that have no vector of ``model``."""
    done = vectors.where((F.col("model") == model) & F.col("vector").isNotNull()).select(F.col("node_id").alias("id"))
    return nodes.where(F.col("node_type").isin(*EMBEDDED_TYPES)).join(done, "id", "left_anti")


def encode_nodes(nodes: DataFrame, encoder: Encoder, batch: int = 256) -> DataFrame:
    """(node_id, model, vector) of every row of ``nodes``; an encoder of tables is handed the whole table."""
    if hasattr(encoder, "encode_frame"):
        return encoder.encode_frame(node_text(nodes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = encoder.encode(part["text"].tolist())
                yield pd.DataFrame({"node_id": part["node_id"], "model": encoder.model, "vector": list(vectors)})

    return node_text(nodes).mapInPandas(run, "node_id long, model string, vector array<float>")


def vector_norms(vectors: DataFrame) -> DataFrame:
    """``vectors`` with their norms, to be kept beside them: a query then computes dot products only."""

    @F.pandas_udf("double")
    def norm(batch: pd.Series) -> pd.Series:
        return batch.map(lambda v: float(np.linalg.norm(np.asarray(v, np.float64))), na_action="ignore")

    return vectors.withColumn("norm", norm("vector"))


def similar_to(vectors: DataFrame, query: list[float], model: str, k: int = 10, exclude: int | None = None) -> DataFrame:
    """(node_id, score): exact cosine to one vector, best first, four decimals.

    Null, all-zero and shorter or longer vectors and such with null elements
    take no part, a node's best vector counts, and a query without length has
    no result.  Every task scores its vectors in batches, one matrix product
    each, and lets out its best only.  A column ``norm`` is used where there is one.
    """
    asked = np.asarray(query, np.float64)
    length = float(np.linalg.norm(asked))
    rows = vectors.where((F.col("model") == model) & (F.size("vector") == len(query)))
    if exclude is not None:
        rows = rows.where(F.col("node_id") != exclude)
    if not length:
        rows = rows.limit(0)
    given = "norm" in vectors.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, float] = {}
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(len(batch.column("vector")), -1)
            norms = batch.column("norm").to_numpy(zero_copy_only=False) if given else np.sqrt(np.einsum("ij,ij->i", x, x))
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = (x @ asked) / (norms * length)
            ids = batch.column("node_id").to_numpy(zero_copy_only=False)
            ok = np.flatnonzero((norms > 0) & np.isfinite(scores))
            # Rounded scores tie; the least ids of the worst one kept stay in.
            rounded = np.round(scores[ok], 4)
            order = np.lexsort((ids[ok], -rounded))
            taken: set[int] = set()
            for j in order:
                node = int(ids[ok[j]])
                best[node] = max(best.get(node, -2.0), float(scores[ok[j]]))
                taken.add(node)
                if len(taken) >= k:
                    break
        top = sorted(best.items(), key=lambda x: (-round(x[1], 4), x[0]))[:k]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in top], pa.int64()), pa.array([s for _, s in top], pa.float64())], ["node_id", "raw"])

    columns = ["node_id", "vector", *(["norm"] if given else [])]
    scored = rows.where(F.col("node_id").isNotNull()).select(*columns).mapInArrow(score, "node_id long, raw double")
    return scored.groupBy("node_id").agg(F.round(F.max("raw"), 4).alias("score")).orderBy(F.desc("score"), "node_id").limit(k)


def similar_to_node(vectors: DataFrame, node_id: int, model: str, k: int = 10) -> DataFrame:
    """The nodes most similar to a node, itself excluded; no row where it has no vector."""
    own = vectors.where((F.col("node_id") == node_id) & (F.col("model") == model) & F.col("vector").isNotNull()).select("vector").first()
    return similar_to(vectors, own["vector"] if own else [], model, k, node_id)


def named_matches(found: DataFrame, nodes: DataFrame, repositories: DataFrame) -> DataFrame:
    """(node_id, score, node_type, name, file_path, repository) of the nodes found, best first."""
    ids = nodes.select(F.col("id").alias("node_id"), "node_type", "name", "file_path", "repository_id")
    homes = repositories.select(F.col("id").alias("repository_id"), F.col("name").alias("repository"))
    return found.join(ids, "node_id").join(homes, "repository_id", "left").select("node_id", "score", "node_type", "name", "file_path", "repository").orderBy(F.desc("score"), "node_id")


def semantic_search(tables: dict[str, DataFrame], query: str, encoder: Encoder, k: int = 10) -> DataFrame:
    """The nodes most similar to a query, with names and repositories.

    A query that names a node is answered from its vector; any other, and a
    node without one, is encoded.
    """
    nodes, vectors = tables["nodes"], tables["node_vectors"]
    exact = nodes.where((F.col("name") == query) | (F.col("file_path") == query)).orderBy("id").select("id").first()
    found = None
    if exact is not None and not vectors.where((F.col("node_id") == exact["id"]) & (F.col("model") == encoder.model) & F.col("vector").isNotNull()).isEmpty():
        found = similar_to_node(vectors, exact["id"], encoder.model, k)
    if found is None:
        found = similar_to(vectors, [float(x) for x in encoder.encode([query])[0]], encoder.model, k)
    return named_matches(found, nodes, tables["repositories"])
