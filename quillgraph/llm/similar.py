"""Most similar vectors for every vector.

Cosine order equals the order of Euclidean distance between unit vectors,
which is a metric.  A vantage-point tree fitted on a bounded sample cuts the
space into shards; every shard holds a vantage-point tree of its own.  A query
is answered in its own shard first, which gives a radius, and then in every
shard, and there in every leaf, that the triangle inequality doesn't rule out:
one with lower bound ``b`` is left out if ``b * relax >= radius``.  With
``relax`` one the search is exact; a larger factor leaves out more.  Where only
neighbours of at least some similarity are asked for, no radius is longer than
the distance of that similarity.

Vectors of one direction are searched as one class, so a direction shared by
very many nodes costs no more than another, and each class carries no more
member ids than a result can show.

A query visits many shards, and more of them the more there are, so vectors are
never sent to what they visit.  Each shard is written once, packed, to the
shared checkpoint folder; a task holds the queries of some shards and reads the
others one by one.  What is on disk grows as the vectors, not as the visits.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.session import cut, ensure_checkpoint_dir

#: Vectors of one model that the shard tree is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Directions in a shard, about.
SHARD_ROWS = 8_192
#: Shards whose queries one task holds, at most.
QUERY_SHARDS = 8
#: Rows that a task gathers before it deals them to shards.
DEAL_ROWS = 65_536
LEAF_ROWS = 256
#: See the module's text; the loss is stated in the README.
RELAX = 6.0
#: The same for the search of pairs above a similarity, whose radius is short from the start.
PAIR_RELAX = 5.0
_SALTS = 64
#: By how much rounding may move a vector across a shard's border, and more.
_SLACK = 1e-4


@dataclass
class ShardTree:
    """Vantage points with their radii and what lies inside and outside: another point, or shard s as -s - 1."""

    points: np.ndarray
    radii: np.ndarray
    inner: list[int]
    outer: list[int]
    shards: int

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Lower bounds of the distance from each row to each shard; zero in its own."""
        if not len(self.points):
            return np.zeros((len(x), 1), np.float32)
        out = np.zeros((len(x), self.shards), np.float32)
        # Down the tree: a bound of a subtree holds for all of its shards.
        below = [(0, np.zeros(len(x), np.float32))]
        while below:
            at, bound = below.pop()
            if at < 0:
                out[:, -at - 1] = bound
                continue
            gap = _distance(x, self.points[at : at + 1])[:, 0] - self.radii[at]
            below += [(self.inner[at], np.maximum(bound, gap)), (self.outer[at], np.maximum(bound, -gap))]
        return out

    def visits(self, x: np.ndarray, radius: np.ndarray, relax: float) -> Iterator[tuple[int, np.ndarray]]:
        """Each shard with the rows that have to look there."""
        below = [(0 if len(self.points) else -1, np.arange(len(x)), np.zeros(len(x), np.float32))]
        while below:
            at, rows, bound = below.pop()
            near = (bound - _SLACK) * relax < radius[rows]
            rows, bound = rows[near], bound[near]
            if not len(rows):
                continue
            if at < 0:
                yield -at - 1, rows
                continue
            gap = _distance(x[rows], self.points[at : at + 1])[:, 0] - self.radii[at]
            below += [(self.inner[at], rows, np.maximum(bound, gap)), (self.outer[at], rows, np.maximum(bound, -gap))]

    def home(self, x: np.ndarray) -> np.ndarray:
        """The shard of each row: the one its turns lead to; the same for the same row whatever rows are beside it."""
        out = np.zeros(len(x), np.int32)
        below = [(0, np.arange(len(x)))] if len(self.points) else []
        while below:
            at, rows = below.pop()
            if at < 0:
                out[rows] = -at - 1
                continue
            near = np.einsum("ij,j->i", x[rows].astype(np.float64), self.points[at].astype(np.float64))
            outside = np.sqrt(np.maximum(2.0 - 2.0 * near, 0.0)) >= self.radii[at]
            below += [(self.inner[at], rows[~outside]), (self.outer[at], rows[outside])]
        return out


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))


def _vantage(x: np.ndarray, rng: np.random.Generator) -> tuple[int, np.ndarray]:
    """Of a few rows, the one with the widest spread of distances, and these."""
    tries = rng.choice(len(x), min(8, len(x)), replace=False)
    distances = _distance(x[tries], x)
    best = int(distances.std(axis=1).argmax())
    return int(tries[best]), distances[best]


def fit_shards(sample: np.ndarray, shards: int) -> ShardTree:
    """Halve the sample at the median distance until there are ``shards`` parts."""
    rng = np.random.default_rng(7)
    points, radii, inner, outer = [], [], [], []
    made = 0

    def split(rows: np.ndarray, parts: int) -> int:
        nonlocal made
        inside = None
        if parts > 1 and len(rows) > 1:
            k, distances = _vantage(sample[rows], rng)
            radius = float(np.median(distances))
            inside = distances < radius
        if inside is None or not inside.any() or inside.all():
            made += 1
            return -made
        at = len(points)
        points.append(sample[rows[k]])
        radii.append(radius)
        inner.append(0)
        outer.append(0)
        inner[at] = split(rows[inside], parts // 2)
        outer[at] = split(rows[~inside], parts - parts // 2)
        return at

    split(np.arange(len(sample)), shards)
    width = sample.shape[1] if sample.ndim == 2 else 0
    return ShardTree(np.array(points, np.float32).reshape(-1, width), np.array(radii, np.float32), inner, outer, made)


class PointTree:
    """The vantage-point tree of one shard, searched by many queries together."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        rng = np.random.default_rng(11)
        leaves: list[np.ndarray] = []
        points: list[int] = []
        self.rings: list[list[tuple[int, float, float]]] = []

        def split(rows: np.ndarray, path: list[tuple[int, float, float]]) -> None:
            if len(rows) > leaf_rows:
                k, distances = _vantage(x[rows], rng)
                inside = distances < np.median(distances)
                if inside.any() and not inside.all():
                    v = len(points)
                    points.append(int(rows[k]))
                    for side in (inside, ~inside):
                        split(rows[side], [*path, (v, float(distances[side].min()), float(distances[side].max()))])
                    return
            leaves.append(rows)
            self.rings.append(path)

        split(np.arange(len(x)), [])
        #: The rows leaf by leaf, and where each leaf begins.
        self.order = np.concatenate(leaves)
        self.starts = np.cumsum([0, *map(len, leaves)])
        self.x, self.ids = x[self.order], ids[self.order]
        self.at = np.argsort(self.order)[points] if points else np.zeros(0, np.int64)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, relax: float, radius: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and similarities of the ``k`` nearest of each query, but for the id in ``own``."""
        found, sims = nothing_yet(len(q), k, radius)
        self.improve(q, own, relax, found, sims)
        return found, sims

    def improve(self, q: np.ndarray, own: np.ndarray | None, relax: float, found: np.ndarray, sims: np.ndarray) -> None:
        """Put what is nearer here in the place of what was found; ``own``: the queries' ids, where they are among the rows."""
        lower = np.zeros((len(q), len(self.rings)), np.float32)
        if len(self.at):
            distances = _distance(q, self.x[self.at])
            for leaf, path in enumerate(self.rings):
                for v, low, high in path:
                    np.maximum(lower[:, leaf], low - distances[:, v], out=lower[:, leaf])
                    np.maximum(lower[:, leaf], distances[:, v] - high, out=lower[:, leaf])
        nearest = lower.argmin(axis=1)
        for first in (True, False):
            for leaf in range(len(self.rings)):
                reach = lower[:, leaf] * relax < np.sqrt(np.maximum(2.0 - 2.0 * sims[:, -1], 0.0))
                asks = np.flatnonzero(nearest == leaf if first else reach & (nearest != leaf))
                for at in range(0, len(asks), 4096):
                    self._scan(q, own, asks[at : at + 4096], slice(self.starts[leaf], self.starts[leaf + 1]), sims, found)

    def _scan(self, q: np.ndarray, own: np.ndarray | None, asks: np.ndarray, rows: slice, sims: np.ndarray, found: np.ndarray) -> None:
        k = sims.shape[1]
        near = q[asks] @ self.x[rows].T
        if own is not None:
            near[own[asks][:, None] == self.ids[rows][None, :]] = -3.0
        better = np.flatnonzero(near.max(axis=1) > sims[asks, -1])
        if not len(better):
            return
        at = asks[better]
        both = np.hstack([sims[at], near[better]])
        labels = np.hstack([found[at], np.broadcast_to(self.ids[rows], (len(at), near.shape[1]))])
        top = np.argpartition(-both, k - 1, axis=1)[:, :k] if both.shape[1] > k else np.broadcast_to(np.arange(both.shape[1]), both.shape)
        values = np.take_along_axis(both, top, 1)
        order = np.argsort(-values, axis=1, kind="stable")
        top = np.take_along_axis(top, order, 1)
        sims[at] = np.take_along_axis(both, top, 1)
        found[at] = np.take_along_axis(labels, top, 1)


def nothing_yet(n: int, k: int, radius: np.ndarray | float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of ``n`` queries before any search."""
    sims = np.full((n, k), -2.0, np.float32)
    if radius is not None:
        # A dot product just outside the radius stands for "no better neighbour yet".
        sims[:] = np.reshape(1.0 - np.square(radius) / 2.0, (-1, 1))
    return np.full((n, k), -1, np.int64), sims


def pack(x: np.ndarray) -> bytes:
    """Vectors without loss: in half the bytes where 16-bit floats hold them, and byte by byte of all values, so that they compress."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    least = half if np.array_equal(half.astype(x.dtype), x) else x
    planes = np.ascontiguousarray(least).view(np.uint8).reshape(-1, least.itemsize).T
    return pickle.dumps((x.shape, x.dtype.str, least.dtype.str, zlib.compress(planes.tobytes(), 1)))


def unpack(data: bytes) -> np.ndarray:
    shape, dtype, least, planes = pickle.loads(data)
    size = np.dtype(least).itemsize
    values = np.ascontiguousarray(np.frombuffer(zlib.decompress(planes), np.uint8).reshape(size, -1).T)
    return values.view(least).reshape(shape).astype(dtype)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


# ---------------------------------------------------------------- in Spark

_BLOCK = "group string, shard int, n long, block binary"


def _block(group: str, shard: int, n: int, *parts: Any) -> dict[str, Any]:
    return {"group": group, "shard": shard, "n": n, "block": pickle.dumps(parts)}


class Store:
    """Shards as files in the checkpoint folder, one a shard, which all executors can read."""

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoint_dir(spark)
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/shards-{uuid.uuid4().hex}"
        self.names: dict[tuple[str, int], str] = {}
        self.rows: dict[tuple[str, int], int] = {}

    def write(self, blocks: DataFrame) -> None:
        blocks.write.option("maxRecordsPerFile", 1).parquet(self.folder)
        written = blocks.sparkSession.read.schema(_BLOCK).parquet(self.folder)
        for r in written.select("group", "shard", "n", F.input_file_name().alias("file")).collect():
            self.names[r["group"], r["shard"]] = r["file"].rpartition("/")[2]
            self.rows[r["group"], r["shard"]] = r["n"]

    def read(self, group: str, shard: int) -> PointTree:
        """The tree of a shard."""
        path = f"{self.folder}/{self.names[group, shard]}"
        if re.match(r"(file:)?/", path):
            files, path = pyarrow.fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
        else:
            files, path = pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
        with files.open_input_file(path) as f:
            tree, x = pickle.loads(pyarrow.parquet.read_table(f, columns=["block"])["block"][0].as_py())
        tree.x = _unit(unpack(x))
        return tree

    def delete(self, spark: SparkSession) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _steps(unit: np.ndarray) -> np.ndarray:
    return np.rint(unit.astype(np.float64) * 100_000.0)


def class_ids(group: str, unit: np.ndarray) -> np.ndarray:
    """A number of 63 bits for each direction to five decimals."""
    steps = _steps(unit).astype(np.int64).view(np.uint64)
    h = np.full(len(unit), int.from_bytes(hashlib.blake2b(group.encode(), digest_size=8).digest()), np.uint64)
    for j in range(steps.shape[1]):
        # The finaliser of splitmix64 over the numbers so far and the next one.
        h = (h ^ steps[:, j]) + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(1)).astype(np.int64)


def _directions(vectors: DataFrame, whole: bool) -> DataFrame:
    """(group, cid, node_id) of every vector that has a direction; if ``whole`` with the vector."""
    element = "double" if isinstance(vectors.schema["vector"].dataType.elementType, T.DoubleType) else "float"
    vector = F.col("vector").cast(f"array<{element}>").alias("vector")

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.append_column("n", pc.list_value_length(table["vector"]))
            for key in table.select(["model", "n"]).group_by(["model", "n"]).aggregate([]).to_pylist():
                if not key["n"]:
                    continue
                part = table.filter((pc.field("model") == key["model"]) & (pc.field("n") == key["n"])).combine_chunks()
                # A null element reads as one that is no number.
                values = part["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
                x = values.reshape(-1, key["n"])
                with np.errstate(over="ignore", invalid="ignore"):
                    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
                well = (norm > 0) & (norm < np.inf)
                if not well.any():
                    continue
                group = f"{key['model']}/{key['n']}"
                part = part.filter(pa.array(well))
                columns = [pa.repeat(pa.scalar(group), len(part)), pa.array(class_ids(group, _unit(x[well]))), part["node_id"].cast(pa.int64()).combine_chunks()]
                names = ["group", "cid", "node_id"]
                if whole:
                    columns, names = [*columns, part["vector"].combine_chunks()], [*names, "vector"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kept = vectors.where(F.col("node_id").isNotNull() & F.col("model").isNotNull() & F.col("vector").isNotNull())
    return kept.select("node_id", "model", vector).mapInArrow(direct, "group string, cid long, node_id long" + f", vector array<{element}>" * whole)


def _first_members(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The least ``k`` node ids of each class; a class of any size is spread over salts first."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("node_id"), F.lit(_SALTS)))
    for part in (["_salt"], []):
        window = Window.partitionBy(*keys, *part).orderBy("node_id")
        salted = salted.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= k)
    return salted.groupBy(*keys).agg(F.sort_array(F.collect_list("node_id")).alias("members"))


def nearest_vectors(vectors: DataFrame, k: int = 10, relax: float = RELAX, shard_rows: int = SHARD_ROWS, least: float = -1.0) -> DataFrame:
    """(model, node_id, rank, neighbour_id, similarity): the ``k`` most similar nodes of every node.

    With ``least``, those of at least that similarity: no search goes farther
    than that from a query, so the higher it is the fewer shards are visited.

    ``vectors`` has (node_id, model, vector).  A null id, model or vector, a
    null or non-finite element and an all-zero vector take no part; vectors of
    different lengths are never compared.  A repeated row counts once; of
    several vectors of a node the neighbours of each come out.  Among equal
    similarities the lower node id comes first, and a similarity counts as
    equal where the unit vectors agree to five decimals (by a hash of 63 bits).
    """
    rows = _directions(vectors, False)
    spark = vectors.sparkSession

    # One row a model: the number of directions; then a bounded sample of each for the shard tree.
    totals = {r["group"]: r["n"] for r in rows.select("group", "cid").distinct().groupBy("group").agg(F.count("*").alias("n")).collect()}
    trees: dict[str, ShardTree] = {}
    for group, n in totals.items():
        shards = max(1, -(-n // shard_rows))
        if shards == 1:
            trees[group] = ShardTree(np.zeros((0, 0), np.float32), np.zeros(0, np.float32), [], [], 1)
            continue
        part = _directions(vectors, True).where(F.col("group") == group)
        part = part.where(F.pmod("cid", F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE_ROWS / n))) if n > SAMPLE_ROWS else part
        part = part.groupBy("cid").agg(F.min(F.struct("node_id", "vector"))["vector"].alias("vector"))
        sample = _unit(np.array([r["vector"] for r in part.orderBy("cid").select("vector").limit(SAMPLE_ROWS).collect()]))
        trees[group] = fit_shards(sample, shards)
    shared = spark.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def dealt(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for group, part in rows.sort_values(["group", "cid", "node_id"]).drop_duplicates(["group", "cid"]).groupby("group"):
                raw = np.stack(part["vector"].to_numpy())
                unit = _unit(raw)
                raw = raw if raw.dtype == np.float32 else unit
                # The rounded values that make the class also decide the shard, so a class has one.
                shards = shared.value[group].home(_steps(unit) / 100_000.0)
                order = np.argsort(shards, kind="stable")
                cid, node = part["cid"].to_numpy(np.int64), part["node_id"].to_numpy(np.int64)
                for at in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1):
                    out.append(_block(group, int(shards[at[0]]), len(at), cid[at], node[at], pack(raw[at])))
            return pd.DataFrame(out)

        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= DEAL_ROWS:
                yield dealt(pd.concat(held))
                held = []
        if sum(map(len, held)):
            yield dealt(pd.concat(held))

    def plant(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A shard has about shard_rows directions.
        parts = [pickle.loads(block) for batch in batches for block in batch["block"]]
        cid, node, raw = (np.concatenate(x) for x in zip(*((c, n, unpack(x)) for c, n, x in parts), strict=True))
        # Of a class that several tasks met, the vector of its least node.
        order = np.lexsort((node, cid))
        order = order[np.diff(cid[order], prepend=-1) != 0]
        tree = PointTree(_unit(raw[order]), cid[order])
        raw = raw[order][tree.order]
        tree.x = tree.order = None
        yield pd.DataFrame([_block(key[0], key[1], len(raw), tree, pack(raw))])

    # A little beyond the least similarity, so that rounding loses none.
    reach_most = float(np.sqrt(max(0.0, 2.0 - 2.0 * least))) + 1e-4

    store = Store(spark)
    try:
        blocks = _directions(vectors, True).mapInPandas(deal, _BLOCK)
        store.write(blocks.groupBy("group", "shard").applyInPandas(plant, _BLOCK))
        per = max(1, min(QUERY_SHARDS, len(store.names) // (3 * spark.sparkContext.defaultParallelism)))
        jobs = []
        for group in totals:
            shards = sorted(s for g, s in store.names if g == group)
            jobs += [(group, shards[at : at + per]) for at in range(0, len(shards), per)]
        plan = spark.sparkContext.broadcast((store, jobs))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            store, jobs = plan.value
            for job in (job for batch in batches for job in batch["id"]):
                group, shards = jobs[job]
                trees = [store.read(group, shard) for shard in shards]
                x, ids = np.concatenate([t.x for t in trees]), np.concatenate([t.ids for t in trees])
                home = np.repeat(shards, [len(t.ids) for t in trees])
                found, sims = nothing_yet(len(x), k, reach_most)
                at = 0
                for tree in trees:
                    own = slice(at, at := at + len(tree.ids))
                    tree.improve(x[own], ids[own], relax, found[own], sims[own])
                held = dict(zip(shards, trees, strict=True))
                # The radius of the own shard, in every other: a shorter one would leave out more of what the relax factor lets pass.
                radius = np.sqrt(np.maximum(2.0 - 2.0 * sims[:, -1], 0.0))
                for shard, asks in shared.value[group].visits(x, radius, relax):
                    asks = asks[home[asks] != shard]
                    if len(asks) and (group, shard) in store.names:
                        f, s = nothing_yet(len(asks), k, radius[asks])
                        (held.get(shard) or store.read(group, shard)).improve(x[asks], None, relax, f, s)
                        new = np.flatnonzero(f[:, 0] >= 0)
                        asks, f, s = asks[new], np.hstack([found[asks[new]], f[new]]), np.hstack([sims[asks[new]], s[new]])
                        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                        found[asks], sims[asks] = np.take_along_axis(f, top, 1), np.take_along_axis(s, top, 1)
                some = np.flatnonzero(found[:, 0] >= 0)
                near, sim = (pd.Series(list(x[some]), dtype=object) for x in (found, sims))
                yield pd.DataFrame({"group": group, "cid": ids[some], "near": near, "sims": sim})

        numbers = spark.range(0, len(jobs), 1, max(1, len(jobs)))
        near = cut(numbers.mapInPandas(search, "group string, cid long, near array<long>, sims array<float>"))
    finally:
        store.delete(spark)
    best = (
        near.select("group", "cid", F.explode(F.arrays_zip("near", "sims")).alias("n"))
        .select("group", "cid", F.col("n.near").alias("ncid"), F.col("n.sims").cast("double").alias("sim"))
        .where("ncid >= 0")
    )

    # From classes to nodes: a class's list of k + 1 nodes serves all of its members. Most classes have one node.
    classes = rows.groupBy("group", "cid").agg(F.min("node_id").alias("node_id"), F.max("node_id").alias("last"))
    single = classes.where(F.col("node_id") == F.col("last")).select("group", "cid", "node_id")
    several = classes.where(F.col("node_id") != F.col("last")).select("group", "cid")
    shared_by = rows.select("group", "cid", "node_id").join(several, ["group", "cid"], "leftsemi").distinct()
    lists = _first_members(shared_by, ["group", "cid"], k + 1)
    own = lists.select("group", "cid", F.lit(1.0).alias("sim"), "members")
    lists = lists.unionByName(single.select("group", "cid", F.array("node_id").alias("members")))
    theirs = best.where(F.col("sim") >= least).join(lists.select("group", F.col("cid").alias("ncid"), "members"), ["group", "ncid"])
    shown = theirs.select("group", "cid", "sim", "members").unionByName(own)
    shown = shown.select("group", "cid", "sim", F.explode("members").alias("neighbour_id"))
    order = Window.partitionBy("group", "cid").orderBy(F.desc("sim"), "neighbour_id")
    shown = shown.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    shown = shown.groupBy("group", "cid").agg(F.sort_array(F.collect_list(F.struct("_r", "neighbour_id", "sim"))).alias("shown"))
    named = single.unionByName(shared_by).join(shown, ["group", "cid"])
    others = F.slice(F.filter("shown", lambda s: s["neighbour_id"] != F.col("node_id")), 1, k)
    return named.select("group", "node_id", F.posexplode(others).alias("rank", "n")).select(
        F.regexp_replace("group", "/[0-9]+$", "").alias("model"),
        "node_id",
        (F.col("rank") + 1).alias("rank"),
        F.col("n.neighbour_id").alias("neighbour_id"),
        F.col("n.sim").alias("similarity"),
    )


def similar_pairs(vectors: DataFrame, least: float = 0.9, k: int = 10, relax: float = PAIR_RELAX, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(node_id_a, node_id_b): cosine at least ``least`` and one among the other's ``k`` nearest."""
    near = nearest_vectors(vectors, k, relax, shard_rows, least)
    return near.select(
        F.least("node_id", "neighbour_id").alias("node_id_a"), F.greatest("node_id", "neighbour_id").alias("node_id_b")
    ).distinct()
