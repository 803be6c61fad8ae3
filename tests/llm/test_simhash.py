import random

import numpy as np
import pytest
import xxhash

from folioweave.llm import simhash
from folioweave.llm.shared import SharedTables


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            votes[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * votes[k] > len(shingles))


def slow_components(ids, prints):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        least[r] = d if least.get(r) is None else (least[r] if d is None else min(d, least[r]))
    return [least[root(i)] for i in range(len(ids))]


def test_fingerprint():
    for text in ["", " \n", "One", "a b c", "a b c d", "A b c d e\x0bf é x  g", "x " * 50]:
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(None, "x y z"), (1, None), (2, ""), (2, ""), (3, " \t ")]
    for i in range(4, 60):
        base = [rnd.choice(words) for _ in range(rnd.randint(1, 60))]
        rows.append((i, " ".join(base)))
        for k in range(rnd.randint(0, 3)):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((1000 * k + i, " ".join(copy)))
    rows.append((None, "x y z"))
    docs = spark.createDataFrame([(*r, 7, "u") for r in rows], "doc_id long, text string, fingerprint int, _fp string")
    found = simhash.near_duplicates(docs).collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    want = sorted(map(str, zip([r[0] for r in rows], [f"{p:016x}" for p in prints], slow_components([r[0] for r in rows], prints), strict=True)))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in found) == want


@pytest.mark.parametrize("full, three", [(1, simhash.THREE), (3, simhash.THREE), (1024, simhash.THREE), (1024, 0), (40, 0)])
def test_links_connect_everything_within_reach(spark, full, three):
    """three = 0: as for more fingerprints than three segments are for."""
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**63, 12, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base.tolist():
        for _ in range(15):
            for k in rnd.choice(64, rnd.integers(1, 6), replace=False):
                b ^= 1 << int(k)
            prints.add(b)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    tables = SharedTables(spark)
    links = simhash.link_fingerprints(tables, spark.createDataFrame([(p,) for p in signed], "_fp long"), full, three).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in links)
    parts = simhash.connected_components(tables, spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long"))
    label = {r.node: r.component for r in parts.collect()}
    assert [label.get(p, p) for p in signed] == slow_components(signed, prints)


def test_first_of_each(spark, monkeypatch):
    rows = [(5, "a b c d e f"), (3, "A b  c d e f"), (3, "a b c d e f"), (9, "quite another text than the others are"), (None, None), (7, " ")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _row int").repartition(3)
    for sent in (2_000_000, 0):
        monkeypatch.setattr("folioweave.llm.shared.SENT_ROWS", sent)
        kept = simhash.first_of_each(docs).collect()
        assert sorted(r.doc_id for r in kept) == [3, 7, 9] and kept[0].asDict().keys() == {"doc_id", "text", "_row"}


def test_very_long_texts_and_a_crowd_of_equal_ones(spark):
    long_ = " ".join(f"w{i * i % 9973}" for i in range(600_000)) + " "
    rows = [(i, "the same text again and again") for i in range(3000)] + [(5000, long_), (5001, long_ + "x"), (5002, "w" * 2_000_000)]
    found = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[i].component_id for i in range(3000)} == {0}
    assert found[5001].component_id == 5000 and found[5002].component_id == 5002
    assert found[5000].fingerprint == f"{slow_fingerprint(long_):016x}"


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
