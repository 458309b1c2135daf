import random
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import packing
from quillgraph.llm.packing import configuration_lp, pack, plan_containers, price

SCHEMA = "doc_id long, text string, tokens long, context string"


def test_price_is_an_exact_knapsack():
    rng = np.random.default_rng(1)
    sizes, weights = np.array([3, 5, 7, 11]), rng.random(4)
    best = max(
        (a * weights[0] + b * weights[1] + c * weights[2] + d * weights[3])
        for a in range(11) for b in range(7) for c in range(5) for d in range(4) if 3 * a + 5 * b + 7 * c + 11 * d <= 32
    )
    value, counts = price(weights, sizes, 32)
    assert value == pytest.approx(best) and (counts * sizes).sum() <= 32 and (counts * weights).sum() == pytest.approx(best)


def test_linear_program_covers_and_bounds():
    sizes, demand = np.array([30, 45, 60, 70]), np.array([40.0, 30.0, 20.0, 10.0])
    patterns, amounts, bound = configuration_lp(demand, sizes, 128, epsilon=0.1)
    cover = sum(p * x for p, x in zip(patterns, amounts))
    assert (cover >= demand - 1e-6).all() and all((p * sizes).sum() <= 128 for p in patterns)
    assert bound <= amounts.sum() <= bound * 1.3


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_item_once(seed):
    rng = random.Random(seed)
    histogram = Counter(min(200, max(1, int(rng.lognormvariate(3.5, 1)))) for _ in range(3000))
    rows, containers = plan_containers(dict(histogram), 200, 4, 8)
    fill, seen = Counter(), Counter()
    for size, first, past, at, number in rows:
        seen[size] += past - first
        for r in range(first, past):
            fill[at + (r - first) % number] += size
    assert seen == histogram and max(fill.values()) <= 200 and len(fill) == containers
    assert containers <= 1.02 * -(-sum(s * n for s, n in histogram.items()) // 200) + 1


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)  # several salts for a length
    rng = random.Random(3)
    data = [(i, " ".join(["word"] * rng.randint(1, 90)), 5, "c") for i in range(120)]
    data += [(200, None, 1, "c"), (201, "", 1, "c"), (202, "word " * 1000, 1, "c"), (0, data[0][1], 1, "c"), (None, "word word", 1, "c"), (2**62 + 1, "word", 1, "c")]
    docs = spark.createDataFrame(data, SCHEMA)
    out = pack(docs, capacity=128).toPandas()
    assert out.groupby("context")["tokens"].sum().max() <= 128
    encode = packing.tokenizer(packing.VOCABULARY).encode_ordinary
    want = Counter()
    for i, text, *_ in data:
        if text:
            want[-1 if i is None else i] += len(encode(text))
    assert 2**62 + 1 in {r["doc_id"] for r in pack(docs, capacity=128).select("doc_id").collect()}
    got = out.assign(doc_id=out["doc_id"].fillna(-1)).groupby("doc_id")["tokens"].sum().to_dict()
    assert {int(k): v for k, v in got.items() if k < 1e9} == {k: v for k, v in want.items() if k < 1e9}
    long = out[out["doc_id"] == 202].sort_values("piece")
    assert list(long["piece"]) == list(range(len(long))) and (long["tokens"].iloc[:-1] == 128).all()
    whole = out[(out["doc_id"] != 202) & (out["doc_id"] != 0)]
    assert whole.groupby("doc_id").size().max() == 1
    assert out["context"].nunique() <= -(-out["tokens"].sum() // 128) + 2
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0
