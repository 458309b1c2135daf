"""Filling fixed-capacity containers with items.

The work is done on the histogram of lengths, which has at most as many bins
as the capacity however many items there are.

* Items of more than ``sand`` units are put into classes of ``grid`` units
  (rounded up) and the configuration linear program over these classes, least
  number of containers that cover every class, is solved by multiplicative
  weights: the pattern of greatest weight is priced by a knapsack dynamic
  program over the capacity, used until one of its classes has had its share,
  and the weights of what it covers fall.
* The solution is rounded down to whole containers, whose slots take items of
  exact lengths, and whatever is left, the small items included, is placed by
  best fit, decreasing, into the exact gaps.
* The outcome is a table (length, rank range) -> containers.  Items get their
  rank among the items of their length through salted counts, and a broadcast
  join with that table, bounded by the histogram, gives the container.
"""

from __future__ import annotations

import base64
import bisect
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.session import cut

#: Where the public vocabulary lies on every machine; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to this vocabulary.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items ranked by one task at most, however many share a length.
RANK_ROWS = 200_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens) of every row with a non-empty text."""
    schema = T.StructType([T.StructField(id_col, documents.schema[id_col].dataType), T.StructField("tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Arrow keeps the ids as they are, nulls and large numbers included.
        encode = tokenizer(vocabulary).encode_ordinary
        for batch in batches:
            tokens = pa.array([len(encode(t)) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens], names=[id_col, "tokens"])

    return documents.where(F.length(text_col) > 0).select(id_col, text_col).mapInArrow(count, schema)


# ---------------------------------------------------------------- the linear program


def rooms_of(sizes: np.ndarray, capacity: int) -> list[np.ndarray]:
    """For every room from the smallest size on, the room that each size that fits leaves."""
    return [room - sizes[: np.searchsorted(sizes, room, side="right")] for room in range(int(sizes[0]), capacity + 1)]


def price(weights: np.ndarray, sizes: np.ndarray, capacity: int, rooms: list[np.ndarray] | None = None) -> tuple[float, np.ndarray]:
    """The pattern of greatest weight that fits, by unbounded knapsack: (weight, count of each class)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    least = int(sizes[0])
    for room, left in enumerate(rooms or rooms_of(sizes, capacity), least):
        values = best[left]
        values += weights[: len(left)]
        k = values.argmax()
        if values[k] > best[room - 1]:
            best[room], choice[room] = values[k], k
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room >= least:
        if choice[room] < 0:
            room -= 1
            continue
        counts[choice[room]] += 1
        room -= int(sizes[choice[room]])
    return float(best[capacity]), counts


def configuration_lp(demand: np.ndarray, sizes: np.ndarray, capacity: int, epsilon: float = 0.25) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Patterns, how often each is used, and a lower bound on the sum.

    Garg-Konemann steps for the covering program: every step uses the best
    pattern until one of its classes gets all of its demand once; the sum of
    steps is scaled so that every class is covered.  ``sizes`` ascend.
    """
    n = len(sizes)
    weights, covered = 1.0 / demand, np.zeros(n)
    rounds = max(1.0, math.log(max(n, 2)) / epsilon**2)
    used: dict[bytes, float] = {}
    bound, active = 0.0, np.ones(n, bool)
    rooms = rooms_of(sizes, capacity)
    while active.any():
        live = np.where(active, weights, 0.0)
        live /= live.max()
        value, counts = price(live, sizes, capacity, rooms)
        # By duality, demand . y is a lower bound for any y under which no pattern weighs more than one.
        bound = max(bound, float((demand * live).sum() / value))
        counts[~active] = 0
        inside = counts > 0
        step = float((demand[inside] / counts[inside]).min())
        used[counts.tobytes()] = used.get(counts.tobytes(), 0.0) + step
        share = counts * step / demand
        covered += share
        weights = weights * np.exp(-epsilon * share)
        active &= covered < rounds
    patterns = [np.frombuffer(k, np.int64) for k in used]
    amounts = np.array(list(used.values()))
    return patterns, amounts / covered.min(), bound


# ---------------------------------------------------------------- rounding


class Containers:
    """Groups of containers of equal contents, kept by the room they have left."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.rooms: list[int] = []
        self.by_room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}

    def add(self, count: int, contents: tuple[tuple[int, int], ...]) -> None:
        room = self.capacity - sum(size * times for size, times in contents)
        if room not in self.by_room:
            bisect.insort(self.rooms, room)
            self.by_room[room] = []
        self.by_room[room].append((count, contents))

    def place(self, size: int, count: int) -> None:
        """Best fit of ``count`` items of one size; new containers are opened where none has room."""
        while count:
            at = bisect.bisect_left(self.rooms, size)
            if at == len(self.rooms):
                each = min(self.capacity // size, count)
                self.add(count // each, ((size, each),))
                count -= count // each * each
                continue
            room = self.rooms[at]
            number, contents = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room], self.rooms[at]
            each = min(room // size, count)
            taken = min(number, count // each)
            if taken < number:
                self.add(number - taken, contents)
            self.add(taken, (*contents, (size, each)))
            count -= taken * each

    def groups(self) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
        return [g for room in self.rooms for g in self.by_room[room]]


def plan_containers(histogram: dict[int, int], capacity: int, grid: int, sand: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (size, first rank, last rank + 1, first container, containers) and the number of containers."""
    left = dict(histogram)
    containers = Containers(capacity)
    large = sorted(s for s in left if s > sand)
    if large:
        classes: dict[int, list[int]] = {}
        for s in large:
            classes.setdefault(min(-(-s // grid), capacity // grid), []).append(s)
        # A size that a whole number of grid units can't hold beside others keeps its exact units.
        sizes = np.array(sorted(classes))
        demand = np.array([sum(left[s] for s in classes[k]) for k in sizes], float)
        patterns, amounts, _ = configuration_lp(demand, sizes, capacity // grid)
        for amount, pattern in sorted(zip(amounts, patterns), key=lambda x: -x[0]):
            whole = int(amount)
            while whole:
                # The containers that can be filled alike: each slot takes the longest size left of its class.
                contents: dict[int, int] = {}
                for k in np.flatnonzero(pattern):
                    for _ in range(int(pattern[k])):
                        s = next((s for s in reversed(classes[int(sizes[k])]) if left[s] > contents.get(s, 0)), None)
                        if s is not None:
                            contents[s] = contents.get(s, 0) + 1
                if not contents or sum(s * t for s, t in contents.items()) > capacity:
                    break
                alike = min([whole, *(left[s] // t for s, t in contents.items())])
                containers.add(alike, tuple(contents.items()))
                for s, t in contents.items():
                    left[s] -= alike * t
                whole -= alike
    for s in sorted(left, reverse=True):
        if left[s]:
            containers.place(s, left[s])
    rows, at, taken = [], 0, dict.fromkeys(histogram, 0)
    for number, contents in containers.groups():
        for size, times in contents:
            rows.append((size, taken[size], taken[size] + times * number, at, number))
            taken[size] += times * number
        at += number
    return rows, at


def pack(
    documents: DataFrame,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    grid: int = 16,
    sand: int = 64,
) -> DataFrame:
    """(context, id, piece, tokens): every non-empty text in contexts of ``capacity`` tokens.

    A text of more tokens than the capacity is split into full pieces and a
    rest; no other text is split.  Null and empty texts take no place; repeated
    rows are packed as often as they stand there.  An empty table gives no row.
    """
    counted = token_counts(documents, id_col, text_col, vocabulary)
    pieces = F.expr(f"sequence(0L, (tokens - 1) div {capacity}L)")
    items = cut(
        counted.select(id_col, "tokens", F.explode(pieces).alias("piece")).select(
            id_col, "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("long").alias("tokens")
        )
    )
    # At most `capacity` rows, whatever the data.
    histogram = {r["tokens"]: r["n"] for r in items.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    rows, _ = plan_containers(histogram, capacity, grid, sand)
    spark = documents.sparkSession
    plan = spark.createDataFrame(rows, "tokens long, first long, past long, container long, containers long")

    salts = max(1, -(-max(histogram.values(), default=0) // RANK_ROWS))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)))
    before = Window.partitionBy("tokens").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("tokens", "_salt").agg(F.count("*").alias("_n")).select("tokens", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("tokens", "_salt").orderBy(id_col, "piece")
    ranked = (
        salted.withColumn("_row", F.row_number().over(within) - 1)
        .join(offsets, ["tokens", "_salt"])
        .select(id_col, "piece", "tokens", (F.col("_before") + F.col("_row")).alias("_rank"))
    )
    slot = F.broadcast(plan)
    return (
        ranked.join(slot, (ranked["tokens"] == slot["tokens"]) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("past")))
        .select((F.col("container") + (F.col("_rank") - F.col("first")) % F.col("containers")).alias("context"), id_col, "piece", ranked["tokens"])
    )
