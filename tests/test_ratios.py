"""Stems, subsequences with places, bounds of near-duplicate scores, multisets, resampled means."""

import functools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.functions import arrow
from folioweave.functions import overlap as O
from folioweave.functions.stem import stem
from folioweave.operators import cited

# published examples of the algorithm's steps
STEMS = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic
operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form
formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll dying die news news generalization gener
oscillators oscil""".split()


def test_stems():
    for word, want in zip(STEMS[::2], STEMS[1::2], strict=True):
        assert stem(word) == want, word
    assert arrow.rouge_words("The Cats' RUNNING, été a1") == ["the", "cat", "run", "t", "a1"]
    assert arrow.rouge_words("running cats", stems=False) == ["running", "cats"]
    assert arrow.rouge_l("the cats were running", "cat runs") == (2 * 2 / 6, 1.0) and arrow.rouge_l("running", "runs", stems=False) == (0.0, 0.0)


def table_places(a, b):
    """From the whole table of lengths; late words of a go first."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[j]))
        rows.append(row)
    out, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif rows[i][j - 1] > rows[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def test_places_of_a_common_subsequence():
    rnd = random.Random(4)
    for _ in range(600):
        a, b = ([rnd.choice("abcde"[: rnd.randint(1, 5)]) for _ in range(rnd.randint(0, 30))] for _ in range(2))
        assert arrow.lcs_places(a, b) == table_places(a, b), (a, b)
    long = [f"w{rnd.randint(0, 3000)}" for _ in range(20_000)]
    other = [w if rnd.random() < 0.5 else "x" for w in long]
    assert len(arrow.lcs_places(long, other)) == arrow.lcs(long, other)


def test_bounds_never_drop_a_near_duplicate():
    rnd = random.Random(5)
    words = ["alpha", "beta", "be", "gamma", "g", "delta"]
    skipped = 0
    for _ in range(3000):
        a = [rnd.choice(words) for _ in range(rnd.randint(0, 9))]
        b = [w for w in a if rnd.random() < 0.8] + [rnd.choice(words) for _ in range(rnd.randint(0, 4))] if rnd.random() < 0.6 else ["zeta", "eta", "x y"][: rnd.randint(0, 3)]
        rnd.shuffle(b)
        a, b = rnd.choice([" ", "  ", "\n"]).join(a), " ".join(b).upper()
        score = arrow.near_duplicate(a, b)
        assert arrow.partial_bound(a.lower(), b.lower()) >= arrow.partial(a.lower(), b.lower()) - 1e-9
        assert arrow.token_set_bound(a.lower(), b.lower()) >= arrow.token_set(a.lower(), b.lower()) - 1e-9
        for least in (0.3, 0.6, 0.9, score):
            found = arrow.near_duplicate_from(a, b, least)
            assert found == (score if score >= least else None), (a, b, least)
            skipped += found is None
    assert skipped > 1000


def test_multisets_in_the_time_of_a_sort(spark):
    rnd = random.Random(6)
    rows = [([rnd.choice("abcé") for _ in range(rnd.randint(0, 12))], [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]) for _ in range(300)]
    rows += [(["w"] * 60_000 + [f"x{i}" for i in range(60_000)], [f"x{i}" for i in range(0, 120_000, 2)] + ["w"] * 10), (None, ["a"]), ([None, "a", None], [None])]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a array<string>, b array<string>")
    found = [r.n for r in frame.select("k", O.multiset_common(F.col("a"), F.col("b")).alias("n")).orderBy("k").collect()]
    assert found == [None if a is None else (Counter(a) & Counter(b)).total() for a, b in rows]


def plain_bootstrap(values, rounds, seed):
    means = []
    for r in range(1, rounds + 1):
        n = [cited.draws(k, r, seed) for k, _ in values]
        if sum(n):
            means.append(sum(m * v for m, (_, v) in zip(n, values, strict=True)) / sum(n))
    return np.median(means)


def test_resampled_means(spark):
    rnd = random.Random(7)
    groups = {g: [(f"{g}:{i}", rnd.gauss(5, 2)) for i in range(n)] for g, n in (("a", 400), ("b", 1), ("c", 37))}
    frame = spark.createDataFrame([(g, k, v) for g, rows in groups.items() for k, v in rows] + [("a", "null", None)], "g string, k string, v double").repartition(5)
    found = {r.g: r.mid for r in cited.bootstrap_mean(frame, "v", "g", ["k"], 60, 3).collect()}
    assert found == {g: pytest.approx(plain_bootstrap(rows, 60, 3)) for g, rows in groups.items()}
    weights = [cited.draws(f"k{i}", r, 1) for i in range(300) for r in range(1, 101)]
    assert abs(np.mean(weights) - 1) < 0.03 and abs(np.var(weights) - 1) < 0.05 and max(weights) >= 6
    many = cited.bootstrap_mean(spark.range(400).select(F.lit(1).alias("g"), "id", (F.col("id") % 2).alias("x")), "x", "g", ["id"], 200).first()
    assert abs(many.mid - 0.5) < 0.05
    assert functools.reduce(max, weights) < 20


def test_pairs_side_by_side_are_compared_as_one_by_one():
    """Pairs of all lengths at once, in few sets, each with the windows of its own texts."""
    draw = random.Random(5)
    pairs = [tuple("".join(draw.choice("ab c😀") for _ in range(draw.choice([0, 1, 7, 40, 90]))) for _ in "ab") for _ in range(150)]
    calls, whole = [], arrow.window_origins
    arrow.window_origins = lambda some: calls.append(len(some)) or whole(some)
    try:
        together = arrow.partials(pairs)
    finally:
        arrow.window_origins = whole
    assert len(calls) <= 4 and sum(calls) > 40
    for (a, b), got in zip(pairs, together, strict=True):
        short, long_ = sorted((a, b), key=len)
        windows = {long_[max(0, e - len(short)) : e] for e in range(1, len(long_) + len(short))} if short else set()
        want = max((arrow.indel(short, w) for w in windows if w), default=100.0 * (not long_))
        assert got == pytest.approx(want)
