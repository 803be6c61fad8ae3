import hashlib
import random
import re

import pytest

from folioweave.llm import repeats as R


def plain(rows, length):
    """The contract over (doc_id, text), window by window."""
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (d, _), ws in zip(rows, texts, strict=True):
        for i in range(len(ws) - length + 1):
            w = tuple(ws[i : i + length])
            if d is not None:
                least[w] = min(d, least.get(w, d))
    out = []
    for (d, _), ws in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(ws) - length + 1):
            first = least.get(tuple(ws[i : i + length]))
            if d is not None and first is not None and first < d:
                gone.update(range(i, i + length))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(map(str, out))


def found(spark, rows, length):
    docs = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, n_words int, kept string, _row int").repartition(3)
    return sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept)) for r in R.remove_repeats(docs, length=length).collect())


def corpus(seed, length):
    """Texts of few words with passages, whole copies and near copies of each other in any order of ids."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 30)}"
    passages = [[word() for _ in range(rnd.randint(length - 2, 3 * length))] for _ in range(4)]
    rows = [(None, None), (3, ""), (4, " \t\n")]
    for _ in range(60):
        ws = []
        for _ in range(rnd.randint(0, 4)):
            ws += rnd.choice(passages) if rnd.random() < 0.6 else [word() for _ in range(rnd.randint(0, 2 * length))]
        rows.append((rnd.choice([None, *range(80)]), rnd.choice([" ", "\n", " \x0b"]).join(ws)))
        if ws and rnd.random() < 0.4:
            rows.append((rnd.randint(0, 80), rows[-1][1]))
        if ws and rnd.random() < 0.4:
            ws[rnd.randrange(len(ws))] = "é"
            rows.append((rnd.randint(0, 80), " ".join(ws)))
    return rows


@pytest.mark.parametrize("seed, length", [(0, 50), (1, 50), (2, 1), (3, 8), (4, 33), (5, 130)])
def test_against_brute_force(spark, seed, length):
    rows = corpus(seed, length)
    assert found(spark, rows, length) == plain(rows, length)


def test_one_passage_in_all_and_one_word_over_and_over(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"x{i} y{i} {passage} {'z ' * (i % 7)}") for i in range(300)] + [(400, "la " * 500), (401, "la " * 300 + "end"), (402, passage)]
    assert found(spark, rows, 50) == plain(rows, 50)


def test_levels():
    assert R.levels(50) == [25, 50] and R.levels(20) == [20] and R.levels(130) == [17, 33, 65, 130]


def test_very_long_texts_and_empty_table(spark):
    long = " ".join(f"w{i * i % 99991}" for i in range(300_000))
    rows = [(1, long), (2, "start " + long), (3, "w" * 2_000_000)]
    got = {r.doc_id: r for r in R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), texts=False).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].kept_sha256, got[3].n_words) == (0, 300_000, hashlib.sha256(b"start").hexdigest(), 1)
    assert "kept" not in got[1].asDict()
    assert R.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
