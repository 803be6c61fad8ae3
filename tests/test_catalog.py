"""Every catalogue query against its SQL, and the others against plain Python."""

import functools
import itertools
import re

import pytest
from against_sql import compare

from folioweave.functions import arrow
from folioweave.functions.stem import stem
from folioweave.plans import catalog, file_queries, score_queries

SF_DIR = "/root/testdata/sf0.001"
assert file_queries and score_queries  # they register their queries in the catalogue


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF_DIR)


def turns(spark):
    """Turns of each conversation in order: conv_id to a list of (turn, role, text)."""
    rows = spark.read.parquet(f"{SF_DIR}/conversations.parquet").orderBy("conv_id", "turn").collect()
    return {c: [(r.turn, r.role, r.text) for r in rows if r.conv_id == c] for c in dict.fromkeys(r.conv_id for r in rows)}


def slow_lcs(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        last = row
    return last[-1]


def test_rouge_l(spark):
    words = lambda t: [stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", t.lower())]
    want = {}
    for c, rows in turns(spark).items():
        for (_, _, a), (turn, _, b) in itertools.pairwise(rows):
            n, p, r = slow_lcs(words(a), words(b)), len(words(b)), len(words(a))
            want[c, turn] = (round(2 * n / (p + r), 6), round(n / r, 6)) if n else (0, 0)
    got = {(r.conv_id, r.turn): (r.f1, r.recall) for r in catalog.rouge_l(spark, SF_DIR).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def plain_near_duplicate(a, b):
    """The three ratios from their definitions; partial over every window."""
    ratio = lambda x, y: 2 * arrow.lcs(x, y) / (len(x) + len(y)) if x or y else 1.0
    a, b = a.lower(), b.lower()
    short, long_ = sorted((a, b), key=len)
    n = len(short)
    windows = {long_[max(0, e - n) : e] for e in range(1, len(long_) + n)}
    partial = max(ratio(short, w) for w in windows if w) if n else float(not long_)
    x, y = set(a.split()), set(b.split())
    same, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    one, two = f"{same} {left}".strip(), f"{same} {right}".strip()
    sets = 0.0 if not x or not y else 1.0 if same and not (left and right) else max([ratio(one, two), *([ratio(same, one), ratio(same, two)] if same else [])])
    return 0.4 * ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) + 0.3 * partial + 0.3 * sets


def test_near_duplicates(spark):
    """near_dup_score on neighbouring turns, promote_similar on all turns against those of the assistant."""
    told = turns(spark)
    score = functools.cache(plain_near_duplicate)
    got = {(r.conv_id, r.turn): r.score for r in catalog.near_dup_score(spark, SF_DIR).collect()}
    want = {(c, turn): score(a, b) for c, rows in told.items() for (_, _, a), (turn, _, b) in itertools.pairwise(rows)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    for r in catalog.promote_similar(spark, SF_DIR).collect():
        texts = [(role, text.strip()) for _, role, text in told[r.id]]
        gold = [i for i, (role, _) in enumerate(texts) if role == "assistant"]
        best = {i: max(score(texts[i][1], texts[g][1]) for g in gold) for i in range(len(texts)) if gold and i not in gold}
        promoted = sorted((i for i in best if best[i] >= 0.6), key=lambda i: (-best[i], i))[:10]
        assert r.promoted == ",".join(f"[DOC {i}]" for i in sorted({*gold, *promoted})), r.id


def test_every_query_is_compared():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"near_dup_score", "promote_similar", "rouge_l", "truncate_tokens", "learned_sentences"}  # compared above, test_tokens.py


def test_entry(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["doc_id", "ordinal", "passage", "pid"]
