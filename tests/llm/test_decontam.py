import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), 13)
        for a in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    found |= {str(i) for i in who if i is not None}
        out.append((d, len(w), sorted(hit), sorted(found)))
    return out


@pytest.mark.parametrize("bits", [decontam.MOST_BITS, 1 << 7])
def test_against_brute_force(spark, bits):
    """Few bits: the filter lets nearly everything pass, and the join decides by words."""
    rnd = random.Random(1)
    vocab = ["a", "B", "Ça", "été", "x1", "7", "zz", "q"]
    prose = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocab) for _ in range(n))
    items = [(k, prose(rnd.choice([0, 2, 5, 12, 13, 14, 40]))) for k in range(12)] + [(None, "only here"), (3, None), (99, "zz zz zz zz zz " * 4), (98, "zz zz zz zz zz " * 4)]
    docs = [(1, None), (2, ""), (2, "..."), (3, "ONLY\there")]
    for k in range(60):
        text = prose(rnd.randint(0, 30))
        for _ in range(rnd.randint(0, 2)):
            w = (rnd.choice(items)[1] or "").split()
            a = rnd.randrange(len(w) + 1)
            text += " " + " ".join(w[a : a + rnd.randint(5, 30)]) + "; " + prose(4)
        docs.append((k % 50, text))
    frame = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, hits string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [(r.doc_id, r.n_words, list(r["hits"]), list(r["items"])) for r in decontam.contamination(frame, bench, bits=bits).collect()]
    assert sorted(map(str, found)) == sorted(map(str, slow(docs, items)))
    kept = decontam.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    clean = sum(1 for _, n, h, _ in slow(docs, items) if not (h and 20 * len(h) >= n))
    assert kept.count() == clean


def test_a_window_of_all_items(spark):
    """An instruction that every item starts with, and a passage of a few: sets of items tell them apart, nulls are in none."""
    lead = " ".join(f"rule{k}" for k in range(15))
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(14))
    items = [(k, f"{lead} {own(k % 700)}") for k in range(1_500)] + [(None, f"{lead} {own(0)}"), (None, own(9_000))]
    docs = [(k, f"{lead} and {own(k)}") for k in range(40)] + [(100, f"so {lead}"), (101, own(9_000)), (102, "nothing of it"), (103, f"{own(3)} {own(4)}")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").repartition(5)
    found = sorted((r.doc_id, r.n_words, list(r["hits"]), list(r["items"])) for r in decontam.contamination(frame, bench).collect())
    assert found == slow(docs, items)
    assert len(found[0][3]) == 1_500 and found[-3] == (101, 14, list(range(14)), []) and found[-1][3] == sorted(str(k) for k in range(1_500) if k % 700 in (3, 4))
    assert {r.doc_id for r in decontam.decontaminate(frame, bench).select("doc_id").collect()} == {102}


def test_every_shared_window_shares_a_fingerprint():
    rnd = random.Random(2)
    for _ in range(50):
        shared = [rnd.randrange(1000) for _ in range(13)]
        prints = []
        for _ in range(2):
            text = " ".join(map(str, [rnd.randrange(1000) for _ in range(rnd.randint(0, 30))] + shared + [rnd.randrange(1000) for _ in range(20)])).encode()
            s = decontam.Spans(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            prints.append(set(decontam.winnow(s.prints(13)[1])[0].tolist()))
        assert prints[0] & prints[1]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.hits) for r in decontam.contamination(docs, none).collect()] == [(2, [])]
    assert decontam.contamination(docs.where(F.lit(False)), none).collect() == []


def test_words_decide_where_hashes_agree(spark):
    """Two different words of 4096 letters (Thue-Morse) whose polynomial hashes modulo 2**64 are equal."""
    bit = lambda i: bin(i).count("1") % 2
    one, other = ("".join("ab"[bit(i) ^ k] for i in range(4096)) for k in (0, 1))
    both = decontam.Spans(*(lambda t: (np.frombuffer(t, np.uint8), np.array([0, len(t)])))(f"{one} {other}".encode()))
    assert both.hashes[0] == both.hashes[1]
    bench = spark.createDataFrame([(1, f"{one} x y")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"z {one} x y"), (2, f"z {other} x y")], "doc_id long, text string")
    assert {r.doc_id: list(r.hits) for r in decontam.contamination(docs, bench).collect()} == {1: [1, 2, 3], 2: []}


def test_very_long_words_and_texts(spark):
    rnd = random.Random(8)
    passage = " ".join(f"p{rnd.randrange(10**6)}" for _ in range(60))
    docs = [(1, " ".join(f"w{rnd.randrange(5000)}" for _ in range(700_000)) + " " + passage), (2, "a" * 3_000_000 + " " + passage), (3, (passage + " ") * 3_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit) for r in decontam.contamination(frame, bench).select("doc_id", "n_words", F.size("hits").alias("n_hit")).collect()}
    assert found == {1: (700_060, 60), 2: (61, 60), 3: (180_000, 180_000)}
    assert [r.doc_id for r in decontam.decontaminate(frame, bench).select("doc_id").collect()] == [1]
