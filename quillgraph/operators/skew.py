"""Per-key results where a few keys hold most records: fragment and replicate by load.

The load of every key is counted first.  A key of more than a task's share is
split into shards in proportion to its load, by a hash of a second column, so
that equal (key, second column) rows stay together and distinct counts add up
over shards.  All other keys are spread over buckets.  Shards and buckets, a
number bounded by the number of tasks, are packed to tasks, the heaviest first
to the least loaded.  A matching side is sent to the tasks of a key's shards
only.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import cut

#: Buckets of light keys for each task.
BUCKETS = 16


@dataclass
class LoadPlan:
    """``heavy`` has (keys..., shards, base); ``units`` has (unit, task)."""

    keys: list[str]
    tasks: int
    buckets: int
    heavy: DataFrame
    units: DataFrame

    def assign(self, rows: DataFrame, split_by: str) -> DataFrame:
        """Rows with the column ``task``, placed so that each task is one partition."""
        spread = F.pmod(F.xxhash64(split_by), F.col("shards"))
        unit = F.coalesce(F.col("base") + spread, self._bucket())
        placed = rows.join(F.broadcast(self.heavy), self.keys, "left").withColumn("unit", unit.cast("long"))
        placed = placed.join(F.broadcast(self.units), "unit").drop("shards", "base", "unit")
        return placed.repartition(self.tasks, "task")

    def replicate(self, rows: DataFrame) -> DataFrame:
        """One copy of each row for every shard of its key, placed with it."""
        shard = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shards"), F.lit(1)).cast("int") - 1))
        copies = rows.join(F.broadcast(self.heavy), self.keys, "left").withColumn("shard", shard)
        copies = copies.withColumn("unit", F.coalesce(F.col("base") + F.col("shard"), self._bucket()).cast("long"))
        copies = copies.join(F.broadcast(self.units), "unit").drop("shards", "base", "unit", "shard").dropDuplicates(["task", *self.keys])
        return copies.repartition(self.tasks, "task")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))


def pack(loads: list[tuple[int, int]], tasks: int) -> dict[int, int]:
    """Task of each (unit, load): the heaviest first, each to the least loaded task."""
    heap = [(0, t) for t in range(tasks)]
    out = {}
    for unit, load in sorted(loads, key=lambda x: (-x[1], x[0])):
        total, task = heapq.heappop(heap)
        out[unit] = task
        heapq.heappush(heap, (total + load, task))
    return out


def plan_load(counts: DataFrame, keys: list[str], tasks: int) -> LoadPlan:
    """Plan for ``counts`` (keys..., n): the rows of every key.

    What comes to the driver is bounded by the number of tasks: at most
    ``tasks`` keys hold more than a task's share, and the light keys come as
    ``BUCKETS`` sums a task.
    """
    spark = counts.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    share = max(1, total // tasks)
    heavy = counts.where(F.col("n") > share).withColumn("shards", F.ceil(F.col("n") / share).cast("long"))
    big = heavy.orderBy(*keys).collect()
    buckets = BUCKETS * tasks
    light = counts.where(F.col("n") <= share).groupBy(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("unit")).agg(F.sum("n").alias("n"))
    loads = {u: 0 for u in range(buckets)} | {r["unit"]: r["n"] for r in light.collect()}
    base, rows = buckets, []
    for r in big:
        rows.append((*(r[k] for k in keys), r["shards"], base))
        loads |= {base + s: r["n"] // r["shards"] for s in range(r["shards"])}
        base += r["shards"]
    at = pack(list(loads.items()), tasks)
    # Numbers that hash to different partitions, so that a task is a partition.
    slots = spark.range(64 * tasks).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks)).alias("p")).agg(F.min("id").cast("int").alias("slot"))
    slot = {r["p"]: r["slot"] for r in slots.collect()}
    free = iter(range(64 * tasks, 66 * tasks))
    number = [slot[p] if p in slot else next(free) for p in range(tasks)]
    types = ", ".join(f"{k} {counts.schema[k].dataType.simpleString()}" for k in keys)
    return LoadPlan(
        keys,
        tasks,
        buckets,
        spark.createDataFrame(rows, f"{types}, shards long, base long"),
        spark.createDataFrame([(u, number[t]) for u, t in at.items()], "unit long, task int"),
    )


def edge_ends(edges: DataFrame) -> DataFrame:
    """(end_role, node_id, neighbour_id, edge_type, n): distinct edges at both ends with their rows; null ends give no row.

    Equal edges are combined on the map side first, so rows repeated very often
    don't weigh on a task.
    """
    merged = cut(edges.groupBy("source_node_id", "target_node_id", "edge_type").agg(F.count("*").alias("n")))
    ends = F.array(
        F.struct(F.lit("source").alias("end_role"), F.col("source_node_id").alias("node_id"), F.col("target_node_id").alias("neighbour_id")),
        F.struct(F.lit("target").alias("end_role"), F.col("target_node_id").alias("node_id"), F.col("source_node_id").alias("neighbour_id")),
    )
    return merged.select(F.explode(ends).alias("e"), "edge_type", "n").select("e.*", "edge_type", "n").where(F.col("node_id").isNotNull())


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _placed_ends(edges: DataFrame) -> tuple[DataFrame, LoadPlan]:
    ends = edge_ends(edges)
    counts = cut(ends.groupBy("end_role", "node_id").agg(F.count("*").alias("n")))
    plan = plan_load(counts, ["end_role", "node_id"], _tasks(edges))
    return plan.assign(ends, "neighbour_id"), plan


def node_ends(edges: DataFrame) -> DataFrame:
    """(end_role, node_id, edges, neighbours): edges and distinct neighbours of every node at either end.

    Duplicate edges count as often as they stand there, a self-loop makes a
    node its own neighbour, and a null other end counts as an edge but as no
    neighbour.  An empty table gives no row.
    """
    placed, _ = _placed_ends(edges)
    distinct = placed.groupBy("task", "end_role", "node_id", "neighbour_id").agg(F.sum("n").alias("n"))
    shards = distinct.groupBy("task", "end_role", "node_id").agg(F.sum("n").alias("edges"), F.count("neighbour_id").alias("neighbours"))
    return shards.groupBy("end_role", "node_id").agg(F.sum("edges").alias("edges"), F.sum("neighbours").alias("neighbours"))


def node_edge_types(edges: DataFrame) -> DataFrame:
    """(end_role, node_id, edge_type, edges); a null type is a type of its own."""
    placed, _ = _placed_ends(edges)
    shards = placed.groupBy("task", "end_role", "node_id", "edge_type").agg(F.sum("n").alias("edges"))
    return shards.groupBy("end_role", "node_id", "edge_type").agg(F.sum("edges").alias("edges"))


def neighbour_kinds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(end_role, node_id, name, edge_type, edges, neighbours): the node side is replicated to the shards of its key only.

    Rows of a node that ``nodes`` doesn't hold are left out; a node id that
    stands there twice counts once, with its least name.
    """
    placed, plan = _placed_ends(edges)
    side = nodes.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("node_id")).agg(F.min("name").alias("name"))
    both = side.withColumn("end_role", F.explode(F.array(F.lit("source"), F.lit("target"))))
    distinct = placed.groupBy("task", "end_role", "node_id", "edge_type", "neighbour_id").agg(F.sum("n").alias("n"))
    shards = distinct.groupBy("task", "end_role", "node_id", "edge_type").agg(F.sum("n").alias("edges"), F.count("neighbour_id").alias("neighbours"))
    named = shards.join(plan.replicate(both), ["task", "end_role", "node_id"])
    return named.groupBy("end_role", "node_id", "name", "edge_type").agg(F.sum("edges").alias("edges"), F.sum("neighbours").alias("neighbours"))


def heavy_ends(edges: DataFrame, share: float = 0.02) -> DataFrame:
    """(end_role, node_id) of nodes that stand at that end in at least ``share`` of all rows."""
    total = edges.agg((F.count("*") * F.lit(share)).alias("least"))
    return node_ends(edges).crossJoin(F.broadcast(total)).where(F.col("edges") >= F.col("least")).select("end_role", "node_id")
