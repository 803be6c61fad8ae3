import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folioweave.llm import lexical as X


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    """The contract: every item against every document."""
    bags = [Counter(terms(t)) for _, t in docs]
    n = [sum(b.values()) for b in bags]
    N, L = sum(x > 0 for x in n), sum(n)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), bag, size in zip(docs, bags, n, strict=True):
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * (75 + 25 * size * N // L))) for t in terms(text) if bag[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(8)] + [f"Rare{i}" for i in range(150)] + ["é", "Été", "x9"]
    say = lambda n: " ".join(rnd.choice(words[:8] if rnd.random() < 0.6 else words) for _ in range(n))
    docs = [(rnd.choice([None, *range(300)]), say(rnd.randint(0, 60))) for _ in range(250)] + [(7, None), (None, ""), (8, "--- !")]
    docs += [(900 + i, docs[3][1]) for i in range(40)]
    items = [(f"q{i % 20}", say(rnd.randint(0, 25)).replace(" ", rnd.choice([" ", ", "]))) for i in range(30)] + [("none", None), (None, "rare1 w1"), ("no", "zzz"), ("same", docs[3][1])]
    return docs, items


@pytest.mark.parametrize("seed, block, set_bytes", [(0, 16_384, 1 << 20), (1, 13, 1 << 20), (2, 50, 600)])
def test_against_brute_force(spark, monkeypatch, seed, block, set_bytes):
    monkeypatch.setattr(X, "BLOCK_DOCS", block)
    monkeypatch.setattr(X, "SET_BYTES", set_bytes)
    docs, items = corpus(seed)
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, rank int").repartition(3)
    q = spark.createDataFrame([(*r, 3) for r in items], "item_id string, text string, item int")
    for k in (20, 3):
        found = [(r.item_id, r["rank"], r.doc_id, r.score) for r in X.search(d, q, k).collect()]
        assert sorted(map(str, found)) == plain(docs, items, k)


def test_pair_bounds_hold_and_tighten():
    """No document scores more than the units' bounds; terms that never meet bound less together than apart."""
    rnd = np.random.default_rng(1)
    texts = [" ".join(rnd.choice([f"t{i}" for i in range(30)], rnd.integers(1, 4))) for _ in range(80)]
    asked = X.Asked.of(["t0 t1 t2 t3 t4 t5 t6 t7 t8"])
    has = np.array([[int(h in X.terms_of(*X.byte_view(pa.array([t])))[0]) for h in asked.hashes] for t in texts])
    plan = X.Plan.of(asked, has.sum(0), len(texts))
    term, doc = np.nonzero(has.T)
    starts = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))
    block = X.Block(pa.array(range(80)), np.unique(term), starts, doc, plan.weights[term])
    joint, lists, sums = X._pair_lists(block, plan.pairs)
    whole = has @ plan.weights
    bound = sum(int(joint[p]) if p >= 0 else block.most[u[0][0]] for u, p in plan.units[0])
    assert whole.max() <= bound < plan.weights.sum()
    for least in (0, 1, int(np.sort(whole)[-5]), int(whole.max()), int(whole.max()) + 1):
        at, score = X._search_block(block, joint, plan, 0, max(1, least), 80)
        assert dict(zip(at.tolist(), score.tolist(), strict=True)) == {i: s for i, s in enumerate(whole.tolist()) if s >= max(1, least)}
    for (a, _, b, _), docs, got in zip(plan.pairs, lists, sums, strict=True):
        assert docs.tolist() == np.flatnonzero(has[:, a] & has[:, b]).tolist() and set(got.tolist()) <= {plan.weights[a] + plan.weights[b]}


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "w " * 500_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id int, text string")
    assert X.search(docs, none).collect() == [] and X.search(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id int, text string")).collect() == []
    rows = [(1, "a b"), (2, "w " * 500_000), (3, "c"), (4, "a")]
    found = X.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5, "W a a")], "item_id int, text string")).collect()
    assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in found) == plain(rows, [(5, "W a a")], 20)
