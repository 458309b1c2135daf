"""Items that appear together, and how much more often than chance.

Pair counts are exact.  Items that can't reach the asked count or ratio are
left out first, which loses no pair.  Baskets of up to ``NARROW`` remaining
items give their pairs as rows, counted with map-side combination.  Wider
baskets never give pairs as rows: the items of a group are spread over blocks
and the wide baskets of two blocks over slices, a task adds those of a slice to
the count matrix of the blocks and lets out the counts of that slice.  Only the
sums over all slices and the narrow baskets are held against count and ratio.

The null model is the bipartite configuration model fitted to every item's
frequency and every basket's size: item a is in basket c with probability
x_a y_c / (1 + x_a y_c).  Items of one frequency share x and baskets of one size
share y, so the fit of a group works on two histograms.  The number of common
baskets is then Poisson-binomial, whose upper tail gives the p-value, and
q-values control the false discovery rate within a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import cut

#: Baskets of up to so many items give their pairs as rows.
NARROW = 48
#: Items of a block, about; a task holds a matrix of the square of it.
BLOCK_ITEMS = 2048
#: Items of the wide baskets of a task, about.
SLICE_ITEMS = 1_000_000
#: Kinds of pairs that are judged together, about.
KINDS = 256
#: Bins of the p-values, for each power of ten.
BINS = 64
#: Degrees up to this are fitted one by one, greater ones in bins of this ratio, so that a fit is bounded.
EXACT_DEGREES, DEGREE_RATIO = 256, 1.02


# ---------------------------------------------------------------- the null model


def fit_null(items: dict[float, int], baskets: dict[float, int], rounds: int = 2000) -> tuple[dict[float, float], dict[float, float]]:
    """x by item frequency and y by basket size; both arguments map a degree to how many have it."""
    d, m = np.array(list(items), float), np.array(list(items.values()), float)
    s, w = np.array(list(baskets), float), np.array(list(baskets.values()), float)
    total = math.sqrt(max(float((d * m).sum()), 1.0))
    x, y = d / total, s / total
    for _ in range(rounds):
        before = x
        x = np.minimum(d / (w * y / (1 + np.outer(x, y))).sum(axis=1), 1e12)
        y = np.minimum(s / (m * x / (1 + np.outer(y, x))).sum(axis=1), 1e12)
        if np.abs(x - before).max() <= 1e-9 * max(1.0, np.abs(x).max()):
            break
    return dict(zip(items, x)), dict(zip(baskets, y))


def tail(p: np.ndarray, times: np.ndarray, least: int) -> float:
    """P(X >= least) of a sum of independent trials, ``times[k]`` of them with probability ``p[k]``."""
    if least <= 0:
        return 1.0
    mean = float((p * times).sum())
    # Beyond, at least twelve standard deviations.
    top = least if mean > least else least + max(64, 12 * math.isqrt(least) + 12)
    dist = np.zeros(top + 1)
    dist[0] = 1.0
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))])
    for q, n in zip(p, times):
        if q <= 0 or n <= 0:
            continue
        q, n = min(float(q), 1 - 1e-15), int(n)
        j = np.arange(min(n, top) + 1)
        choose = np.concatenate([[0.0], np.cumsum(np.log(n - np.arange(len(j) - 1)))]) - logs[: len(j)]
        dist = np.convolve(dist, np.exp(choose + j * math.log(q) + (n - j) * math.log1p(-q)))[: top + 1]
    if mean > least:
        return float(min(1.0, max(0.0, 1.0 - dist[:least].sum())))
    return float(min(1.0, dist[least:].sum()))


# ---------------------------------------------------------------- exact counts


def _candidates(records: DataFrame, min_count: int, min_ratio: float) -> DataFrame:
    """(group, basket, item, n_item, n) of the items that can be in a pair that passes."""
    sizes = records.groupBy("group", "item").agg(F.count("*").alias("n_item"))
    totals = records.select("group", "basket").distinct().groupBy("group").agg(F.count("*").alias("n"))
    # With n_ab <= n_a, a ratio of r needs n >= r * n_b, for either item.
    able = sizes.join(totals, "group").where((F.col("n_item") >= min_count) & (F.col("n") >= min_ratio * F.col("n_item")))
    return records.join(able, ["group", "item"])


def _tile(key: tuple, wide: pd.DataFrame) -> pd.DataFrame:
    """The pairs, a < b, of two blocks of items in a slice of the wide baskets, each with its count there."""
    degree: dict[int, int] = {}
    sides: list[dict[int, int]] = [{}, {}]

    def index(side: int, item: int, size: int) -> int:
        degree[item] = size
        return sides[side].setdefault(item, len(sides[side]))

    one_block = key[1] == key[2]
    if one_block:
        sides[1] = sides[0]
    rows = []
    for a, na, b, nb in zip(wide["items_a"], wide["sizes_a"], wide["items_b"], wide["sizes_b"]):
        rows.append((np.array([index(0, *x) for x in zip(a, na)]), np.array([index(1, *x) for x in zip(b, nb)])))
    counts = np.zeros((len(sides[0]), len(sides[1])), np.int32)
    for a, b in rows:
        counts[np.ix_(a, b)] += 1
    left, right = np.array(list(sides[0]), np.int64), np.array(list(sides[1]), np.int64)
    i, j = np.nonzero(np.triu(counts, 1) if one_block else counts)
    a, b = np.minimum(left[i], right[j]), np.maximum(left[i], right[j])
    size_of = pd.Series(degree)
    return pd.DataFrame(
        {"group": key[0], "a": a, "n_a": size_of.loc[a].to_numpy(), "b": b, "n_b": size_of.loc[b].to_numpy(), "n_ab": counts[i, j].astype(np.int64), "n": int(wide["n"].iloc[0])}
    )


def _tiles(wide: DataFrame) -> DataFrame:
    """(group, block_a, block_b, slice, n, items_a, sizes_a, items_b, sizes_b): each wide basket in every two blocks it meets.

    ``wide`` has (group, basket, n, item, n_item, block).  The baskets of two
    blocks are spread by hash over slices of about ``SLICE_ITEMS`` items.
    """
    part = wide.groupBy("group", "basket", "n", "block").agg(F.sort_array(F.collect_list(F.struct("item", "n_item"))).alias("s"))
    part = cut(part.select("group", "basket", "n", "block", F.col("s.item").alias("items"), F.col("s.n_item").alias("sizes")))
    held = part.select("group", "basket", "block", F.size("items").alias("k"))
    met = held.withColumnsRenamed({"block": "block_a", "k": "k_a"}).join(held.withColumnsRenamed({"block": "block_b", "k": "k_b"}), ["group", "basket"])
    loads = met.where("block_a <= block_b").groupBy("group", "block_a", "block_b").agg(F.sum(F.col("k_a") + F.col("k_b")).alias("load"))
    slices = cut(loads.select("group", "block_a", "block_b", F.ceil(F.col("load") / SLICE_ITEMS).alias("slices")))
    other = part.select("group", "basket", F.col("block").alias("block_b"), F.col("items").alias("items_b"), F.col("sizes").alias("sizes_b"))
    return (
        part.withColumnsRenamed({"block": "block_a", "items": "items_a", "sizes": "sizes_a"})
        .join(other, ["group", "basket"])
        .join(slices, ["group", "block_a", "block_b"])
        .withColumn("slice", F.pmod(F.xxhash64("basket", F.lit(1)), F.col("slices")))
        .select("group", "block_a", "block_b", "slice", "n", "items_a", "sizes_a", "items_b", "sizes_b")
    )


def pair_counts(records: DataFrame, min_count: int = 5, min_ratio: float = 3.0) -> DataFrame:
    """(group, a, n_a, b, n_b, n_ab, n), each pair once, of pairs with n_ab >= min_count and n_ab n >= min_ratio n_a n_b.

    ``records`` has distinct (group LONG, basket LONG, item LONG); items of
    different groups never meet.
    """
    able = cut(_candidates(records, min_count, min_ratio))
    width = able.groupBy("group", "basket").agg(F.count("*").alias("width"))
    blocks = able.groupBy("group").agg(F.ceil(F.approx_count_distinct("item") / BLOCK_ITEMS).cast("int").alias("blocks"))
    sized = able.join(width.where("width > 1"), ["group", "basket"])

    one = F.struct("item", "n_item")
    # At most NARROW items each.
    lists = sized.where(F.col("width") <= NARROW).groupBy("group", "basket", "n").agg(F.sort_array(F.collect_list(one)).alias("s"))
    combos = F.expr(
        "flatten(transform(sequence(0, size(s) - 2), i -> transform(slice(s, i + 2, size(s)), y -> struct(s[i] as l, y as r))))"
    )
    pairs = lists.select("group", "n", F.explode(combos).alias("p")).select(
        "group", "n",
        F.col("p.l.item").alias("a"), F.col("p.l.n_item").alias("n_a"), F.col("p.r.item").alias("b"), F.col("p.r.n_item").alias("n_b"),
    )
    narrow = pairs.groupBy("group", "n", "a", "n_a", "b", "n_b").agg(F.count("*").alias("n_ab"))

    wide = sized.where(F.col("width") > NARROW).join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    dense = _tiles(wide).groupBy("group", "block_a", "block_b", "slice").applyInPandas(_tile, "group long, a long, n_a long, b long, n_b long, n_ab long, n long")
    counts = narrow.unionByName(dense).groupBy("group", "a", "n_a", "b", "n_b", "n").agg(F.sum("n_ab").alias("n_ab"))
    passing = (F.col("n_ab") >= min_count) & (F.col("n_ab") * F.col("n") >= min_ratio * F.col("n_a") * F.col("n_b"))
    return counts.where(passing).select("group", "a", "n_a", "b", "n_b", "n_ab", "n")


# ---------------------------------------------------------------- surprise


def surprising_pairs(records: DataFrame, min_count: int = 5, min_ratio: float = 3.0) -> DataFrame:
    """``pair_counts`` with ratio, expected, p_value and q_value.

    ``ratio`` is n_ab n / (n_a n_b), ``expected`` the mean under the null model.
    The q-value is Benjamini-Hochberg's with all pairs of the group's items as
    tests; pairs that aren't reported count as tests but not as rejections, and
    p-values are rounded up to a bin, so it is an upper bound.  With a
    ``min_count`` of 1 and a ``min_ratio`` of 0 only pairs that never meet, whose
    p-value is 1, aren't reported, and only the rounding is left.
    """
    records = cut(records)
    pairs = cut(pair_counts(records, min_count, min_ratio))
    degree = F.col("degree")
    binned = F.when(degree <= EXACT_DEGREES, degree).otherwise(EXACT_DEGREES + F.floor(F.log(degree / EXACT_DEGREES) / math.log(DEGREE_RATIO)))

    def histogram(of: str) -> DataFrame:
        # Bins of degrees, each with its mean degree.
        degrees = records.groupBy("group", of).agg(F.count("*").alias("degree"))
        bins = degrees.groupBy("group", binned.alias("bin")).agg(F.avg("degree").alias("degree"), F.count("*").alias("times"))
        return bins.select("group", "degree", "times", F.lit(of).alias("side"))

    histograms = histogram("item").unionByName(histogram("basket"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        # Two histograms of at most EXACT_DEGREES bins and one for each further DEGREE_RATIO.
        part = part.sort_values("degree")
        of = {side: dict(zip(p["degree"], p["times"])) for side, p in part.groupby("side")}
        x, y = fit_null(of["item"], of["basket"])
        return pd.DataFrame(
            {
                "group": [part["group"].iloc[0]], "degrees": [list(x)], "x": [list(x.values())], "y": [list(y.values())],
                "times": [list(of["basket"].values())], "items": [int(sum(of["item"].values()))],
            }
        )

    fitted = histograms.groupBy("group").applyInPandas(
        fit, "group long, degrees array<double>, x array<double>, y array<double>, times array<long>, items long"
    )
    fitted = cut(fitted)
    kinds = cut(pairs.select("group", "n_a", "n_b", "n_ab").distinct())
    # A group's fit travels once with up to about KINDS kinds of pairs.
    lots = kinds.groupBy("group").agg(F.ceil(F.count("*") / KINDS).alias("lots"))
    lot = F.pmod(F.xxhash64("n_a", "n_b", "n_ab"), F.col("lots"))
    kinds = kinds.join(lots, "group").groupBy("group", lot.alias("lot")).agg(F.collect_list(F.struct("n_a", "n_b", "n_ab")).alias("kinds"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                # Between the mean degrees of two bins x goes straight on.
                at = {n: float(np.interp(n, r.degrees, r.x)) for k in r.kinds for n in (k["n_a"], k["n_b"])}
                y, times = np.asarray(r.y, float), np.asarray(r.times, float)
                out = []
                for k in r.kinds:
                    both = (at[k["n_a"]] * y / (1 + at[k["n_a"]] * y)) * (at[k["n_b"]] * y / (1 + at[k["n_b"]] * y))
                    out.append((r.group, k["n_a"], k["n_b"], k["n_ab"], float((both * times).sum()), tail(both, times, k["n_ab"])))
                yield pd.DataFrame(out, columns=["group", "n_a", "n_b", "n_ab", "expected", "p_value"])

    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    judged = kinds.join(fitted.drop("items"), "group").repartition(tasks, "group", "lot").mapInPandas(
        judge, "group long, n_a long, n_b long, n_ab long, expected double, p_value double"
    )
    rows = pairs.join(judged, ["group", "n_a", "n_b", "n_ab"])
    rows = cut(rows.withColumn("bin", F.floor(-F.log10(F.greatest("p_value", F.lit(1e-300))) * BINS)))
    # A group has at most 300 BINS bins.
    binned = rows.groupBy("group", "bin").agg(F.count("*").alias("k")).join(fitted.select("group", "items"), "group")
    smaller = Window.partitionBy("group").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    larger = Window.partitionBy("group").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    tests = F.col("items") * (F.col("items") - 1) / 2
    bound = F.least(F.lit(1.0), F.pow(F.lit(10.0), -F.col("bin") / BINS) * tests / F.sum("k").over(smaller))
    binned = binned.withColumn("bound", bound).withColumn("q_value", F.min("bound").over(larger))
    return rows.join(binned.select("group", "bin", "q_value"), ["group", "bin"]).select(
        "group", "a", "n_a", "b", "n_b", "n_ab", "n",
        (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("ratio"), "expected", "p_value", "q_value",
    )


def normal_path(column: str = "file_path"):
    """One notation of a path: forward slashes, none doubled, no leading './'."""
    slashes = F.regexp_replace(F.regexp_replace(column, r"\\", "/"), "/+", "/")
    return F.regexp_replace(slashes, r"^(?:\./)+", "")


def files_together(commits: DataFrame, commit_files: DataFrame, min_count: int = 5, min_ratio: float = 3.0) -> DataFrame:
    """(repository_id, file_path_a, file_path_b, n_a, n_b, n_ab, n, ratio, expected, p_value, q_value).

    A commit is a distinct (repository_id, hash) and has a file once.  Rows
    with a null path, commit files of no commit, and commits without repository
    or hash are left out.  Paths are compared in one notation.  Empty tables
    give no row.
    """
    known = commits.where(F.col("repository_id").isNotNull() & F.col("hash").isNotNull())
    # The same commit under several ids is one basket, named by the least.
    one = known.groupBy("repository_id", "hash").agg(F.min("id").alias("basket"))
    of = known.join(one, ["repository_id", "hash"]).select(F.col("id").alias("commit_id"), F.col("repository_id").alias("group"), "basket")
    paths = commit_files.where(F.col("file_path").isNotNull()).select("commit_id", normal_path().alias("path"))
    touched = paths.join(of, "commit_id").select("group", "basket", "path").distinct()
    touched = cut(touched)
    # Ids of their own, so that counts are exact at any number of files.
    named = cut(touched.select("group", "path").distinct().withColumn("item", F.monotonically_increasing_id()))
    found = surprising_pairs(touched.join(named, ["group", "path"]).select("group", "basket", "item"), min_count, min_ratio)
    named = named.select("item", "path")
    a, b = named.toDF("a", "path_1"), named.toDF("b", "path_2")
    both = found.join(a, "a").join(b, "b")
    turned = F.col("path_1") > F.col("path_2")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return both.select(
        F.col("group").alias("repository_id"), pick("path_1", "path_2").alias("file_path_a"), pick("path_2", "path_1").alias("file_path_b"),
        pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), "n_ab", "n", "ratio", "expected", "p_value", "q_value",
    )
