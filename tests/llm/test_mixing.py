import pytest
from test_pipeline import plain_mix

from folioweave.llm import mixing


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    import random

    rnd = random.Random(seed)
    docs = [(rnd.choice([None, *range(40)]), rnd.choice([None, "", " \t", " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.randint(1, 50)))]), rnd.choice(["a", "b", "é", "Z", None, "tiny"] if k % 9 else ["tiny"])) for k in range(150)]
    docs = [d for d in docs if d[2] != "tiny"] + [(900, "one two three", "tiny")] * 4 + [(k, "", "empty") for k in range(3)]
    frame = spark.createDataFrame([(*d, 1, "t") for d in docs], "doc_id long, text string, source string, taken int, place string").repartition(3)
    target, taken, size = plain_mix(docs)
    got = mixing.mix_sources(frame).collect()
    assert sorted(map(str, [(r.doc_id, r.source, r.size, r.taken) for r in got])) == sorted(map(str, [(d[0], d[2], size[i], taken[i]) for i, d in enumerate(docs)]))
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
    again = mixing.mix_sources(frame.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(docs).collect() == []
    none = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix_sources(none).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.expand_mix(mixing.mix_sources(none)).collect() == []
    long = spark.createDataFrame([(1, "w " * 300_000, "a")], "doc_id long, text string, source string")
    assert [(r.size, r.taken) for r in mixing.mix_sources(long).collect()] == [(300_000, 300_000)]
