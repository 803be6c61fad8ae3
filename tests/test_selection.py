"""Selections that keep no whole group in a task, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.operators import attention, ranking, retrieval, selection, spans


@pytest.mark.parametrize("share", [0.0, 0.37, 0.9, 1.0])
def test_quantile_by_nested_histograms(spark, share):
    rnd = np.random.default_rng(3)
    groups = {
        "even": rnd.random(3000), "ties": rnd.integers(0, 3, 2000).astype(float), "steep": 10.0 ** rnd.uniform(-300, 300, 2500), "wide": np.array([-1.7e308, 1.7e308, *rnd.random(900)]),
        "equal": np.full(1500, 7.25), "one": np.array([3.0]), "near": 1.0 + np.arange(700) * 2.0**-52, "signed": rnd.normal(size=1200) * 1e-310,
    }
    rows = [(g, float(v), 1) for g, vs in groups.items() for v in vs] + [("even", None, 1), ("even", float("nan"), 1), ("void", None, 1)]
    frame = spark.createDataFrame(rows, "g string, v double, quantile int").repartition(5)
    for buckets, few in ((4, 10), (1024, 4096)):
        found = {r.g: r.quantile for r in selection.quantile(frame, ["g"], "v", share, buckets, few).collect()}
        assert found.keys() == groups.keys()
        for g, vs in groups.items():
            vs, at = np.sort(vs), share * (len(vs) - 1)
            low, high = int(np.floor(at)), int(np.ceil(at))
            assert found[g] == (vs[low] if low == high else (high - at) * vs[low] + (at - low) * vs[high]), g


@pytest.mark.parametrize("k", [1, 4, 50])
def test_metrics_by_counting_equal_those_by_ranks(spark, k):
    rnd = random.Random(k)
    docs = [(i, d, rnd.random() < 0.2 if i else False, rnd.choice([0.0, 0.5, rnd.random() * 2]), d) for i in range(9) for d in range(rnd.randint(1, 30))]
    said = [(i, d + rnd.randint(0, 3) * (i == 4), rnd.choice([0.25, rnd.random()]), d) for i, d, *_ in docs if rnd.random() < 0.8]
    said = list({(i, d): (i, d, s, d) for i, d, s, _ in said}.values()) + [(77, 1, 0.5, 1)]
    ideal = spark.createDataFrame(docs, "id int, doc int, is_gold boolean, score double, pos int")
    placed = spark.createDataFrame(said, "id int, doc int, score double, pos int")
    ranks = ranking.ranked(placed, ["id"], "score", ["pos"]).select("id", "doc", "rank")
    want = {r.id: r.asDict() for r in ranking.ranking_metrics(ranks, ranking.gold_ranking(ideal), k).collect()}
    found = {r.id: r.asDict() for r in selection.counted_metrics(placed, ideal, k).collect()}
    assert found.keys() == want.keys()
    for i in want:
        assert found[i] == pytest.approx(want[i]), i


def neighbours(queries, chunks, k):
    """Scores summed in component order, largest first, smaller ids first."""
    out = {}
    for q, v in queries:
        scored = []
        for c, w in chunks:
            if v is not None and w is not None and len(v) == len(w) and all(x is not None and np.isfinite(x) for x in w) and all(x is not None and np.isfinite(x) for x in v):
                total = 0.0
                for x, y in zip(v, w, strict=True):
                    total += float(np.float32(x)) * float(np.float32(y))
                scored.append((-total, c))
        out[q] = [(c, -s) for s, c in sorted(scored)][: k if k >= 0 else None]
    return {q: r for q, r in out.items() if r}


@pytest.mark.parametrize("k", [0, 3, 700, -1])
def test_blocked_retrieval_is_exact_on_equal_and_odd_vectors(spark, k, monkeypatch):
    monkeypatch.setattr(retrieval, "SIDE", 32)
    rnd = random.Random(1)
    base = [[rnd.uniform(-1, 1) for _ in range(9)] for _ in range(20)]
    chunks = [(i, rnd.choice(base) if i % 3 else [rnd.uniform(-1, 1) for _ in range(9)]) for i in range(600)]
    chunks += [(900, None), (901, [1.0]), (902, [None] * 9), (903, [float("nan")] * 9), (904, [0.0] * 9), (905, []), (906, [3e38] * 9)]
    queries = [(f"q{i}", v) for i, v in chunks[::20]] + [("short", [2.0]), ("none", None), ("nan", [float("nan")] * 9), ("big", [3e38] * 9)]
    c = spark.createDataFrame(chunks, "chunk_id int, embedding array<float>").repartition(4)
    q = spark.createDataFrame(queries, "query_id string, embedding array<float>")
    want = neighbours(queries, chunks, k)
    for set_bytes in (500, 1 << 26):
        found = {}
        for r in retrieval.top_k(q, c, k, set_bytes=set_bytes).orderBy("rank").collect():
            found.setdefault(r.query_id, []).append((r.chunk_id, r.score))
        assert found == want


def test_chunks_are_read_once_for_all_queries(spark):
    chunks = spark.range(3000).select(F.col("id").alias("chunk_id"), F.array(*[F.sin(F.col("id") * j).cast("float") for j in range(8)]).alias("embedding"))
    queries = chunks.select((F.col("chunk_id") + 10).alias("query_id"), "embedding").union(chunks.select((F.col("chunk_id") + 90_000).alias("query_id"), "embedding"))
    found = retrieval.top_k(queries, chunks, 2)
    assert found.count() == 12_000 and found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_ranking_all_ships_vectors_and_no_pairs(spark):
    """Queries of equal ids are ranked together; the same rows as by sorting all pairs, which more vectors than tasks hold take."""
    chunks = spark.range(400).select(F.col("id").alias("chunk_id"), F.array(*[F.sin(F.col("id") % 150 * j).cast("float") for j in range(8)]).alias("embedding"))
    queries = chunks.where("chunk_id % 9 = 0").select(F.when(F.col("chunk_id") > 9, F.col("chunk_id") % 200).alias("query_id"), "embedding")
    whole, sort = retrieval.top_k(queries, chunks, -1), retrieval.top_k(queries, chunks, -1, set_bytes=900)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (whole, sort)]
    assert ["Window" in p for p in plans] == [False, True] and plans[0].index("MapInArrow") < plans[0].index("Exchange")
    columns = ["query_id", "rank", "chunk_id", "score"]
    assert whole.columns == columns and whole.dtypes == sort.dtypes and whole.count() == 45 * 400
    assert whole.orderBy(columns).collect() == sort.orderBy(columns).collect()


#: Equal sums: added in this order the first comes to 0.6000000000000001, the other to 0.6.
PLUS, EVEN = (0.1, 0.2, 0.3), (0.3, 0.2, 0.1)


def test_equal_sums_rank_by_their_ties_in_whatever_order_they_are_added(spark):
    rows = [(7, step, span, v) for span, values in ((1, PLUS), (0, EVEN)) for step, v in enumerate(values)]
    by_step = spark.createDataFrame(rows, "instance int, step int, span_idx int, total double").coalesce(1)
    assert [r.span_idx for r in spans.document_rollup(by_step, by_step, 1).collect()] == [0]
    rolled = spark.createDataFrame([(s, v) for s, values in ((1, PLUS), (0, EVEN)) for v in values], "span_idx int, average double").coalesce(1)
    assert [r.span_idx for r in spans.roll_up_documents(rolled, 1).collect()] == [0]


def test_a_token_of_exactly_the_percentage_is_a_sink(spark):
    tokens = spark.createDataFrame([(1, p, v, "x") for p, v in enumerate(PLUS)], "instance int, pos int, score double, token string").coalesce(1)
    assert [r.pos for r in spans.mark_sinks(tokens, 9, 9, 50.0).where("is_sink").collect()] == [2]


def test_equal_totals_of_top_content_go_by_place(spark):
    tokens = spark.createDataFrame([(1, p, p, p + 1, v) for p, v in enumerate(EVEN + PLUS)], "instance int, pos int, beg int, end int, score double").coalesce(1)
    docs = spark.createDataFrame([(1, 0, 0, 3, "a"), (1, 1, 3, 6, "b")], "instance int, span_idx int, start int, end int, text string")
    texts = spark.createDataFrame([(1, "abcdef")], "instance int, text string")
    best = attention.top_content(tokens, texts, docs, F.lit("context"), 1)["documents"].collect()
    assert [(r.span_idx, r.rank) for r in best] == [(0, 1)]


def test_steps_without_any_score_have_zero_percent(spark):
    """As the reference has it: no share of nothing, and no sink in it."""
    tokens = spark.createDataFrame([(1, 0, 0, 0.0), (1, 1, 1, 2.0)], "instance int, step int, pos int, score double")
    rolled = spans.roll_up_sections(spans.sections(tokens, F.lit("prompt"), group=["instance", "step"])).collect()
    assert {r.section: r.percent for r in rolled} == {"prompt": 50.0, "context": 0.0, "other": 0.0}
    row = spans.sink_rollup(spans.mark_sinks(tokens, 9, 9, 30.0, ["instance", "step"])).first()
    assert (row.steps, row.sinks, row.percent, row.presence) == (2, 1, 50.0, 0.5)


@pytest.mark.parametrize("k", [1, 4, 20])
def test_metrics_of_retrieval_equal_those_of_all_scores(spark, k, monkeypatch):
    """Few gold chunks, none, equal vectors, broken ones and two widths; no list of all pairs is made."""
    rnd = random.Random(k)
    vector = lambda n: [rnd.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(n)]
    rows = [(i, vector(3 if i % 5 else 2), i % 3 if i < 40 else 7 if i == 41 else 8) for i in range(70)]
    rows += [(70, None, 1), (71, [float("nan"), 1.0, 1.0], 1), (72, [None, 1.0, 1.0], 1)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, label int").repartition(3)
    queries = chunks.where("chunk_id % 4 <> 1 OR chunk_id = 41").withColumnRenamed("chunk_id", "query_id")
    queries = queries.withColumn("label", F.when(F.col("query_id") == 2, 99).otherwise(F.col("label")))
    label = chunks.select("chunk_id", "label").join(queries.select("query_id", F.col("label").alias("own")))
    docs = retrieval.scores(queries, chunks).join(label, ["query_id", "chunk_id"])
    docs = docs.select(F.col("query_id").alias("id"), F.col("chunk_id").alias("doc"), "score", (F.col("label") == F.col("own")).alias("is_gold"), F.col("chunk_id").alias("pos"))
    want = {r.id: r.asDict() for r in selection.counted_metrics(docs.drop("is_gold"), docs, k).collect()}
    inner = retrieval.scores

    def bounded(q, c, on=None, k=-1, set_bytes=retrieval.SET_BYTES):
        assert k >= 0, "all pairs"
        return inner(q, c, on, k, set_bytes)

    monkeypatch.setattr(retrieval, "scores", bounded)
    found = {r.id: r.asDict() for r in selection.retrieved_metrics(queries, chunks, k).collect()}
    assert found.keys() == want.keys() and len(want) > 40
    for i in want:
        assert found[i] == pytest.approx(want[i]), i
