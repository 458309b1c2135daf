import random
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import leakage
from quillgraph.llm.leakage import leaked_items
from quillgraph.llm.lookalike import Looks

DOCS = "doc_id long, text string, item_id string, score double, row long"
ITEMS = "item_id long, text string, suite string"
LOOKS = Looks()


def words_of(text):
    return leakage.words_of(text, LOOKS)


def brute(docs, items, n=12):
    runs = {}
    for i, text in items:
        words = words_of(text or "")
        for k in range(len(words) - n + 1):
            runs.setdefault(tuple(words[k : k + n]), set()).add(i)
    out = set()
    for d, text in docs:
        words = words_of(text or "")
        for k in range(len(words) - n + 1):
            out |= {(d, i) for i in runs.get(tuple(words[k : k + n]), ())}
    return out


def material(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, text(rng.randint(5, 60))) for i in range(40)] + [(90, None), (91, ""), (92, "too short")]
    docs = []
    for d in range(150):
        body = text(rng.randint(0, 200)).split()
        if d % 3 == 0:
            words = items[rng.randrange(40)][1].split()
            k = rng.randint(0, max(0, len(words) - 12))
            part = words[k : k + rng.randint(8, 20)]
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((d, rng.choice([" ", "\n", ", "]).join(body).upper() if d % 2 else " ".join(body)))
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = material()
    docs += [(500, None), (501, ""), (502, " ".join(f"w{i % 60}" for i in range(300_000))), (0, docs[0][1])]
    nameless = [(None, docs[0][1]), (None, "x")]
    frame = spark.createDataFrame([(d, t, "x", 1.0, 2) for d, t in docs + nameless], DOCS)
    tests = spark.createDataFrame([(i, t, "s") for i, t in items], ITEMS)
    want = brute(docs, items)
    assert len(want) > 20
    assert {(r["doc_id"], r["item_id"]) for r in leaked_items(frame, tests).collect()} == want
    # The same in several passes over a bounded index.
    monkeypatch.setattr(leakage, "MAX_POSTINGS", 300)
    got = [(r["doc_id"], r["item_id"]) for r in leaked_items(frame, tests).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("cells", [0, leakage.TABLE_CELLS])
def test_other_widths(monkeypatch, cells):
    monkeypatch.setattr(leakage, "TABLE_CELLS", cells)
    docs, items = material(9)
    for n in (5, 8, 13):
        listed = [(i, words_of(t)) for i, t in items if t and len(words_of(t)) >= n]
        df = Counter(w for _, ws in listed for w in set(ws))
        index = leakage.build_index(listed, df, len(listed), sum(len(ws) for _, ws in listed) / len(listed), n, (n + 1) // 2)
        want = brute(docs, items, n)
        got = set()
        for d, text in docs:
            ids = np.array([index.term_ids.get(w, -1) for w in words_of(text)], np.int64)
            got |= {(d, index.item_ids[i]) for _, i, _ in leakage.search(index, ids, n, (n + 1) // 2)}
        assert got == want


def test_impacts_and_bounds():
    listed = [(i, words_of(t)) for i, t in material(3)[1] if t and len(words_of(t)) >= 12]
    df = Counter(w for _, ws in listed for w in set(ws))
    mean = sum(len(ws) for _, ws in listed) / len(listed)
    index = leakage.build_index(listed, df, len(listed), mean, 12, 6)
    n, blocks = len(listed), len(index.block_threshold)
    for i, (_, ws) in enumerate(listed):
        scores = {}
        for w in set(ws):
            tf = ws.count(w)
            want = np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
            t = index.term_ids[w]
            scores[w] = float(index.impacts[np.searchsorted(index.keys, t * n + i)])
            bound = index.block_max[np.searchsorted(index.block_keys, t * blocks + i // leakage.BLOCK_ITEMS)]
            assert abs(scores[w] - want) < 1e-4 and scores[w] <= bound <= index.term_max[t]
        least = min(sum(scores[w] for w in ws[k : k + 6]) for k in range(len(ws) - 5))
        assert abs(index.item_threshold[i] - (least - 1e-3)) < 1e-3


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    some = spark.createDataFrame([(1, "a b c", "", 0.0, 1)], DOCS)
    tests = spark.createDataFrame([(1, " ".join("abcdefghijklm"), "s")], ITEMS)
    assert leaked_items(none, tests).count() == 0
    assert leaked_items(some, spark.createDataFrame([], ITEMS)).count() == 0
    changed = spark.createDataFrame([(1, "A b\u200b C\nd, e - f ｇ h і j. k l", "", 0.0, 1)], DOCS)
    assert leaked_items(changed, tests).count() == 1
