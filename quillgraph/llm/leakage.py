"""Evaluation texts leaking into training text.

The held-out items form a BM25 inverted index of sparse posting lists, built in
Spark and cut into shards of bounded size.  Every document is cut into passages
of half of ``overlap_words`` words, so that any ``overlap_words`` consecutive
words hold a whole passage.  Each passage is a query, answered by block-max
WAND: the passage's rarest term is the pivot, whose list gives the blocks of
items to look at; a block is left out as soon as the greatest impacts that the
passage's terms have in it don't reach its threshold, and only what is left is
scored item by item.  The threshold of an item is the least score of any
passage of its own words, so a passage that does occur in a document is always
retrieved.  As the verification demands every word, a block or an item that
lacks one is left out like one below its threshold.  What is retrieved is
verified word by word around the passage.

Both texts are brought to their look-alike form first; a word is a longest run
of letters and digits in lower case.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.lookalike import Looks, shared_letters
from quillgraph.session import cut

_WORD = re.compile(r"[^\W_]+")
#: Postings of one shard of the index, about: bounds what a pass broadcasts (some 30 bytes each).
MAX_POSTINGS = 6_000_000
#: Items of a block; its items are neighbours by number.
BLOCK_ITEMS = 4
#: Passages that are looked up together.
CHUNK = 1 << 16
#: Cells of the block maxima up to which they are kept as a table too, which is read faster than lists.
TABLE_CELLS = 4_000_000
K1, B = 1.2, 0.75


def words_of(text: str, looks: Looks) -> list[str]:
    return _WORD.findall(looks.form(text).lower())


@dataclass
class Index:
    """Posting lists of the terms by item and by block of items, thresholds, and the words of the items."""

    term_ids: dict[str, int]
    item_ids: list
    keys: np.ndarray  # term * items + item, sorted
    impacts: np.ndarray
    block_keys: np.ndarray  # term * blocks + block, sorted
    block_max: np.ndarray
    block_table: np.ndarray | None  # the same by term and block, where that is small
    block_start: np.ndarray  # where a term's blocks begin among the block keys
    term_max: np.ndarray
    item_threshold: np.ndarray
    block_threshold: np.ndarray
    words: np.ndarray  # the coded words of all items
    run_hash: np.ndarray  # sorted hashes of the runs of overlap words
    run_at: np.ndarray  # where in ``words`` each begins
    run_item: np.ndarray


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _run_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive ids."""
    n = len(ids) - width + 1
    codes = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    codes ^= codes >> np.uint64(29)
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * np.uint64(1_000_003) + codes[k : k + n]
    return out


def _lookup(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values of sorted keys; minus infinity where a key isn't there."""
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], np.float32(-np.inf))


def build_index(items: list[tuple[object, list[str]]], df: dict[str, int], n_items: int, mean_words: float, overlap: int, passage: int) -> Index:
    """Index the items of a shard; each has at least ``overlap`` words. ``df``, ``n_items`` and ``mean_words`` are those of all shards."""
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws))}
    n = len(items)
    coded = [np.fromiter((vocabulary[w] for w in ws), np.int64, len(ws)) for _, ws in items]
    lengths = np.array([len(ws) for ws in coded])
    words, owner = np.concatenate(coded), np.repeat(np.arange(n), lengths)
    keys, tf = np.unique(words * n + owner, return_counts=True)
    terms, holders = keys // n, keys % n
    frequency = np.array([df[w] for w in vocabulary], np.float64)
    idf = np.log1p((n_items - frequency + 0.5) / (frequency + 0.5))
    impacts = (idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[holders] / mean_words))).astype(np.float32)

    of_word = impacts[np.searchsorted(keys, words * n + owner)]
    ends = np.cumsum(lengths)
    threshold = np.empty(n, np.float32)
    run_at, run_item, hashes = [], [], []
    for i, ids in enumerate(coded):
        begin = ends[i] - lengths[i]
        spans = np.lib.stride_tricks.sliding_window_view(of_word[begin : ends[i]], passage)
        # A repeated word counts as often as it stands there, as in the search.
        threshold[i] = spans.sum(axis=1).min() - 1e-3
        codes = _run_hashes(ids, overlap)
        hashes.append(codes)
        run_at.append(begin + np.arange(len(codes)))
        run_item.append(np.full(len(codes), i, np.int64))
    order = np.argsort(np.concatenate(hashes), kind="stable")

    blocks = -(-n // BLOCK_ITEMS)
    block_keys, first = np.unique(terms * blocks + holders // BLOCK_ITEMS, return_index=True)
    block_max, table = np.maximum.reduceat(impacts, first), None
    if len(vocabulary) * blocks <= TABLE_CELLS:
        table = np.full(len(vocabulary) * blocks, -np.inf, np.float32)
        table[block_keys] = block_max
    return Index(
        vocabulary, [i for i, _ in items], keys, impacts, block_keys, block_max, table,
        np.searchsorted(block_keys, np.arange(len(vocabulary) + 1) * blocks), np.maximum.reduceat(impacts, np.searchsorted(terms, np.arange(len(vocabulary)))),
        threshold, np.minimum.reduceat(threshold, np.arange(0, n, BLOCK_ITEMS)),
        words, np.concatenate(hashes)[order], np.concatenate(run_at)[order], np.concatenate(run_item)[order],
    )


def _retrieve(index: Index, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of what reaches its threshold; all terms of the passages are in the index."""
    n, blocks = len(index.item_ids), len(index.block_threshold)
    held = index.block_start[passages + 1] - index.block_start[passages]
    # The rarest term is the pivot, and the next rarest leave out most of what it brings.
    passages = np.take_along_axis(passages, held.argsort(axis=1), 1)
    rest = np.concatenate([index.term_max[passages][:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros((len(passages), 1), np.float32)], axis=1)
    start, count = index.block_start[passages[:, 0]], held.min(axis=1)
    rows = np.repeat(np.arange(len(passages)), count)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
    block, bound = index.block_keys[at] % blocks, index.block_max[at]
    for k in range(passages.shape[1]):
        # What the terms so far and the best of those to come can reach.
        if k:
            asked = passages[rows, k] * blocks + block
            bound = bound + (_lookup(index.block_keys, index.block_max, asked) if index.block_table is None else index.block_table[asked])
        ok = bound + rest[rows, k + 1] >= index.block_threshold[block]
        rows, block, bound = rows[ok], block[ok], bound[ok]
    items = block[:, None] * BLOCK_ITEMS + np.arange(BLOCK_ITEMS)
    rows, items = np.repeat(rows, BLOCK_ITEMS), items.ravel()
    ok = items < n
    rows, items = rows[ok], items[ok]
    score = np.zeros(len(rows), np.float32)
    for k in range(passages.shape[1]):
        score += _lookup(index.keys, index.impacts, passages[rows, k] * n + items)
        ok = score > -np.inf
        rows, items, score = rows[ok], items[ok], score[ok]
    ok = score >= index.item_threshold[items]
    return rows[ok], items[ok], score[ok]


def search(index: Index, ids: np.ndarray, overlap: int, passage: int) -> list[tuple[int, int, float]]:
    """(position, item number, score) of every verified run of ``overlap`` words in the coded words; -1 stands for a word of no item."""
    segments = ids[: len(ids) // passage * passage].reshape(-1, passage)
    alive = np.flatnonzero((segments >= 0).all(axis=1))
    alive = alive[index.term_max[segments[alive]].sum(axis=1) >= index.item_threshold.min()]
    out: dict[tuple[int, int], float] = {}
    for at in range(0, len(alive), CHUNK):
        part = alive[at : at + CHUNK]
        rows, items, scores = _retrieve(index, segments[part])
        starts = part[rows] * passage
        # Verification: the runs that hold the whole passage.
        where = (starts[:, None] - np.arange(overlap - passage, -1, -1)).ravel()
        which = np.repeat(np.arange(len(starts)), overlap - passage + 1)
        ok = (where >= 0) & (where + overlap <= len(ids))
        where, which = where[ok], which[ok]
        places, back = np.unique(where, return_inverse=True)
        run = ids[places[:, None] + np.arange(overlap)]
        codes = np.zeros(len(places), np.uint64)
        mixed = (run.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        for k in range(overlap):
            codes = codes * np.uint64(1_000_003) + mixed[:, k]
        low, high = np.searchsorted(index.run_hash, codes), np.searchsorted(index.run_hash, codes, side="right")
        for j in np.flatnonzero((high > low)[back]):
            place, item = back[j], items[which[j]]
            same = index.run_at[low[place] : high[place]][index.run_item[low[place] : high[place]] == item]
            if any((index.words[x : x + overlap] == run[place]).all() for x in same):
                key = int(where[j]), int(item)
                out[key] = max(out.get(key, 0.0), float(scores[which[j]]))
    return [(position, item, score) for (position, item), score in out.items()]


def _shards(items: DataFrame, id_col: str, text_col: str, overlap: int, passage: int) -> tuple[DataFrame, int]:
    """(shard, index) of the items' index in shards of about ``MAX_POSTINGS``, each packed in one value; and their number."""
    letters = shared_letters(items.sparkSession)
    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).distinct()

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        looks = Looks(letters.value)
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"], "words": [words_of(t, looks) for t in batch["_text"]]})

    schema = T.StructType([T.StructField("_id", items.schema[id_col].dataType), T.StructField("words", T.ArrayType(T.StringType()))])
    known = cut(rows.mapInPandas(tokens, schema).where(F.size("words") >= overlap))
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(F.array_distinct("words"))), F.lit(0)).alias("postings"), F.avg(F.size("words")).alias("mean")).first()
    n_items, mean, shards = total["n"], total["mean"], -(-total["postings"] // MAX_POSTINGS)
    known = known.withColumn("shard", F.pmod(F.xxhash64("_id", "words"), F.lit(max(shards, 1))).cast("int"))
    df = known.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # The terms of a shard with their frequencies over all shards.
    terms = known.select(F.col("shard").alias("of"), F.explode(F.array_distinct("words")).alias("term")).distinct().join(df, "term")

    def build(key: tuple, part: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame({"shard": [], "index": []})
        part = part.sort_values("_id", kind="stable")
        listed = [(i, list(ws)) for i, ws in zip(part["_id"].tolist(), part["words"])]
        index = build_index(listed, dict(zip(counts["term"], counts["df"])), n_items, mean, overlap, passage)
        return pd.DataFrame({"shard": [key[0]], "index": [pickle.dumps(index, protocol=5)]})

    packed = known.groupBy("shard").cogroup(terms.groupBy("of")).applyInPandas(build, "shard int, index binary")
    return packed, shards


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    overlap_words: int = 12,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, item id, passages, score) of documents that hold a passage of an item.

    ``passages`` counts the positions in the document at which
    ``overlap_words`` consecutive words of the item begin and ``score`` is the
    best BM25 score among them.  Null and empty texts hold no passage and a row without id is left out; an item
    of fewer words than ``overlap_words`` can't be found.  A document in
    several rows of the same id comes out once, with its best row's figures.
    One shard of the index, some hundred thousand items, is broadcast at a
    time.  The documents are read and tokenised once: where there are several
    shards, their words are written to the checkpoint folder for the passes.
    """
    spark = documents.sparkSession
    out_type = T.StructType(
        [
            T.StructField(id_col, documents.schema[id_col].dataType),
            T.StructField(item_col, items.schema[item_col].dataType),
            T.StructField("passages", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    passage = (overlap_words + 1) // 2
    packed, shards = _shards(items, item_col, item_text_col, overlap_words, passage)
    letters = shared_letters(spark)
    texts = documents.where((F.length(text_col) > 0) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        looks = Looks(letters.value)
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"], "_text": [" ".join(words_of(t, looks)) for t in batch["_text"]]})

    several = shards > 1
    if several:
        texts = cut(texts.mapInPandas(tokens, texts.schema))

    found = None
    for row in packed.toLocalIterator():
        shared = spark.sparkContext.broadcast(row["index"])

        def query(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index: Index = pickle.loads(shared.value)
            looks, code = Looks(letters.value), index.term_ids.get
            for batch in batches:
                coded, starts, at = [], [], 0
                for text in batch["_text"]:
                    words = text.split(" ") if several else words_of(text, looks)
                    # The next text begins a passage of its own, so none spans two texts.
                    gap = passage - len(words) % passage
                    coded.append(np.fromiter((code(w, -1) for w in words), np.int64, len(words)))
                    coded.append(np.full(gap, -1))
                    starts.append(at)
                    at += len(words) + gap
                hits = search(index, np.concatenate(coded), overlap_words, passage) if coded else []
                frame = pd.DataFrame(hits, columns=["at", "item", "score"])
                row = np.searchsorted(np.array(starts), frame["at"].to_numpy(), side="right") - 1
                frame["row"] = row
                frame[id_col] = batch["_id"].to_numpy()[row]
                frame[item_col] = np.array(index.item_ids)[frame["item"].to_numpy(dtype=int)]
                yield (
                    frame.groupby([id_col, item_col, "row"], as_index=False)
                    .agg(passages=("at", "size"), score=("score", "max"))[[id_col, item_col, "passages", "score"]]
                )

        part = texts.mapInPandas(query, out_type)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], out_type)
    return found.groupBy(id_col, item_col).agg(F.max("passages").alias("passages"), F.max("score").alias("score"))
