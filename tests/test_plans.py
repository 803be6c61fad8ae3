"""Operators and plans on small tables: edges, round trips, errors."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioweave.functions import arrow
from folioweave.operators import cited, ranking, retrieval, runs, sampling, spans
from folioweave.plans import corpus, file_queries, inference, prompts, training
from folioweave.sources import files
from folioweave.sources.tables import over_all_cores


def test_numbering_is_contiguous(spark):
    rows = spark.range(1000).withColumn("k", F.md5(F.col("id").cast("string")))
    got = [r.n for r in retrieval.number_rows(rows, ["k"], "n", 5).orderBy("k").collect()]
    assert got == list(range(5, 1005))
    assert retrieval.number_rows(rows.where("false"), ["k"], "n").collect() == []


def test_numbering_of_many_rows_with_a_payload(spark, tmp_path):
    """More rows than a range sample sees: the written numbers are contiguous, distinct and in order."""
    rows = spark.range(1_000_000).select(F.md5(F.col("id").cast("string")).alias("k"), F.repeat(F.lit("x"), 40).alias("payload"))
    retrieval.number_rows(rows, ["k"], "n").write.parquet(f"{tmp_path}/n")
    back = spark.read.parquet(f"{tmp_path}/n")
    assert back.agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max("n")).first()[:] == (1_000_000, 1_000_000, 0, 999_999)
    assert back.withColumn("next", F.lead("k").over(Window.orderBy("n"))).where("next < k").count() == 0
    n = {r.split: r["count"] for r in sampling.split(rows, "k").groupBy("split").count().collect()}
    assert n == {"test": 50_000, "train": 950_000}
    assert sampling.sample(rows, "k", 123_457).count() == 123_457


def test_neighbours_in_blocks_and_by_instance(spark):
    rnd = random.Random(4)
    rows = [(i % 3, i, [rnd.random() for _ in range(4)]) for i in range(60)]
    chunks = spark.createDataFrame(rows, "instance int, chunk_id int, embedding array<float>")
    queries = chunks.where("chunk_id < 30").select("instance", (F.col("chunk_id") % 10).alias("query_id"), "embedding").dropDuplicates(["instance", "query_id"])
    f32 = {r.chunk_id: list(r.embedding) for r in chunks.collect()}
    asked = {(r.instance, r.query_id): list(r.embedding) for r in queries.collect()}

    def slow(q, ids):
        return sorted(ids, key=lambda c: (-sum(x * y for x, y in zip(q, f32[c], strict=True)), c))[:4]

    got = {}
    for r in retrieval.top_k(queries, chunks, 4, ["instance"]).orderBy("rank").collect():
        got.setdefault((r.instance, r.query_id), []).append(r.chunk_id)
    assert got == {k: slow(q, [c for i, c, _ in rows if i == k[0]]) for k, q in asked.items()}
    one = queries.where("instance = 0").select("query_id", "embedding")
    for set_bytes in (64, 1 << 20):
        got = {}
        for r in retrieval.top_k(one, chunks, 4, set_bytes=set_bytes).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == {k[1]: slow(q, f32) for k, q in asked.items() if k[0] == 0}


def test_index_round_trip_and_errors(spark, tmp_path):
    docs = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0])], "text string, embedding array<float>")
    index = retrieval.build_index(docs, ["text"])
    files.write_index(index, f"{tmp_path}/i")
    back = files.read_index(spark, f"{tmp_path}/i")
    more = retrieval.append_to_index(back, docs, ["text"]).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.text) for r in more] == [(0, "a"), (1, "b"), (2, "a"), (3, "b")]
    assert list(more[0].embedding) == pytest.approx([0.6, 0.8]) and list(more[1].embedding) == [0.0, 0.0]
    with pytest.raises(ValueError):
        retrieval.build_index(docs.where("false"), ["text"])
    with pytest.raises(ValueError):
        retrieval.top_k(docs.where("false").withColumn("query_id", F.lit(1)), index, 1)
    docs.write.parquet(f"{tmp_path}/x")
    with pytest.raises(ValueError):
        files.read_index(spark, f"{tmp_path}/x")


def test_gap_tokens_go_to_the_next_span(spark):
    tokens = spark.createDataFrame([(1, p, 1.0) for p in range(12)], "instance int, pos int, score double")
    held = spark.createDataFrame([(1, 0, 0, 3, "a"), (1, 1, 5, 8, "b")], "instance int, span_idx int, start int, end int, text string")
    for bucket in (2, 4096):
        got = {r.text: r.n for r in spans.to_next_span(tokens, held, bucket).groupBy("text").agg(F.count("*").alias("n")).collect()}
        assert got == {"a": 3, "b": 5}
        got = {r.text: r.n for r in spans.to_span(tokens, held, bucket).groupBy("text").agg(F.count("*").alias("n")).collect()}
        assert got == {"a": 3, "b": 3}
    layers = tokens.withColumn("layer", F.lit(0)).union(tokens.withColumn("layer", F.lit(1)).withColumn("score", F.lit(3.0)))
    assert {r.score for r in spans.layer_mean(layers).collect()} == {2.0}
    assert {r.score for r in spans.layer_mean(layers, "last_layer").collect()} == {3.0}
    with pytest.raises(ValueError):
        spans.layer_mean(layers, "all_layer")


def test_attention_picks(spark):
    from folioweave.operators import attention

    texts = spark.createDataFrame([(1, "[DOC 0] one two. [DOC 1] three")], "instance int, text string")
    docs = attention.document_spans(texts).collect()
    assert [(d.start, d.end) for d in docs] == [(0, 17), (17, 30)]
    assert [s.text for s in attention.sentence_spans(texts).orderBy("span_idx").collect()] == ["[DOC 0] one two.", "[DOC 1] three"]
    tokens = spark.createDataFrame([(1, p, p, p + 1, "abcdefghij"[p % 10], float(p)) for p in range(30)], "instance int, pos int, beg int, end int, token string, score double")
    got = attention.gold_scores(tokens, attention.document_spans(texts), spark.createDataFrame([(1, 1)], "instance int, span_idx int"), 1).first()
    assert (got.precision, got.recall, got.f1) == (1.0, 1.0, 1.0)
    same = attention.token_overlap(tokens, tokens.where("pos < 25"), 5).first()
    assert same.overlap == 0.0 and list(same.top_full) == list("jihgf") and list(same.top_part) == list("edcba")
    run = attention.top_runs(tokens, texts, 1, 0.7, 3, 5).first()
    assert run.text == texts.first().text[30 - run.n_tokens : 30].strip() and run["rank"] == 1
    none = attention.span_overlap((tokens, attention.document_spans(texts)), (tokens.where("false"), attention.document_spans(texts)), 5).first()
    assert none.overlap is None


def test_bins_overlap_and_leave_gaps(spark):
    rows = spark.createDataFrame([(1, 99412), (2, 37500)], "id int, n long")
    bins = spark.createDataFrame([(9975, 37147), (37626, 99412), (99412, 210686)], "lo long, hi long")
    assert sorted((r.id, r.lo) for r in runs.in_bins(rows, "n", bins).collect()) == [(1, 37626), (1, 99412)]
    assert runs.accuracy(rows.where("false").withColumns({"pred": F.lit("a"), "gold": F.lit("a")}), []).first().accuracy == 0.0


def test_samples_repeat(spark):
    rows = spark.range(200)
    a, b = ([r.id for r in sampling.sample(x, "id", 20).orderBy("id").collect()] for x in (rows, rows.repartition(7)))
    assert a == b and len(a) == 20
    with pytest.raises(ValueError):
        sampling.sample(rows, "id", 201)
    n = {r.split: r["count"] for r in sampling.split(rows, "id").groupBy("split").count().collect()}
    assert n == {"test": 10, "train": 190}


def test_templates():
    with pytest.raises(KeyError):
        prompts.fill("{a} {b}", {"a": F.lit("x")})


def test_training_rows(spark):
    rows = spark.createDataFrame(
        [("q", (["t", "u", "t"], [0, 5, 1]), (["t", "u"], [["s0", "s1"], ["r0"]]))],
        "id string, supporting_facts struct<title:array<string>,sent_id:array<int>>, context struct<title:array<string>,sentences:array<array<string>>>",
    )
    assert [r.sentence for r in training.supporting_sentences(rows).orderBy("ordinal").collect()] == ["s0", "s1"]
    hits = spark.createDataFrame([("q", ["s1", "long"])], "id string, chunks array<string>")
    got = training.instances(rows, hits).first()
    assert len(got.gold_doc_ids) == 3 and got.training_context.count("[DOC ") == 4
    filled = spark.range(1).select(prompts.fill("{{x}} {a} {a}", {"a": F.lit("{b}")}).alias("v")).first().v
    assert filled == "{x} {b} {b}"
    asked = prompts.task_values("math_find", {"context": F.lit("c"), "input": F.lit("The largest number of these")})
    assert spark.range(1).select(prompts.fill("{prefix}", asked).alias("v")).first().v == "What is the largest number in the following list?"
    cands = spark.createDataFrame([("q", 2, 0.7), ("q", 10, 0.9), ("q", 3, 0.5), ("q", 2, 0.61)], "id string, doc_id int, similarity double")
    assert training.promote(cands, most=2).first().promoted == ["[DOC 2]", "[DOC 10]"]


def test_inference_plans(spark):
    rows = spark.createDataFrame([(None, "b", "one two three four")], "id string, _id string, context string")
    assert inference.with_id(rows).first().id == "b"
    with pytest.raises(ValueError):
        inference.contexts(rows, "some")
    made = inference.prepare(rows, 3, 1).first()
    assert (made.context, made.original_ctx_length, made.final_ctx_length) == ("one two", 4, 2)
    hits = spark.createDataFrame([("b", ["x", "y", "z"])], "id string, chunks array<string>")
    assert inference.contexts(inference.with_id(rows), "topk", hits, 2).first().context == "x\ny"
    assert "context" not in inference.contexts(rows, "none").columns


def test_citations(spark):
    s = spark.createDataFrame([(1, 0, [0, 1], 3), (1, 1, [], 3), (1, 2, [7], 3), (1, 3, [2], 3)], "item_id int, sent_id int, refs array<int>, n_docs int")
    v = spark.createDataFrame([(1, 0, "0,1", 1), (1, 0, "0", 0), (1, 0, "1", 1), (1, 3, "2", 1)], "item_id int, sent_id int, refs string, verdict int")
    got = cited.citation_scores(s, v).first()
    # 0 neither supports alone nor is needed (1 supports without it); 1 and 2 count
    assert (got.citation_recall, got.citation_precision) == (0.5, pytest.approx(2 / 3))


def test_arrow_functions_against_plain_python():
    rnd = random.Random(1)

    def slow_lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 20))) for _ in range(2))
        assert arrow.lcs(a, b) == slow_lcs(a, b)
        short, long_ = sorted((a, b), key=len)
        if short:
            n = len(short)
            every = [long_[max(0, e - n) : e] for e in range(1, len(long_) + n)]
            assert arrow.partial(a, b) == pytest.approx(max(200 * slow_lcs(short, w) / (n + len(w)) for w in every if w))
    assert arrow.near_duplicate("A b", "b a") == pytest.approx(0.4 + 0.3 * arrow.partial("a b", "b a") / 100 + 0.3)
    assert arrow.rouge_l("a b c", "a c") == (0.8, 1.0)


def test_record_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "pid long, title string, passage string")
    files.write_both(rows, f"{tmp_path}/both")
    assert files.read_json(spark, f"{tmp_path}/both/jsonl", "passage").count() == spark.read.parquet(f"{tmp_path}/both/parquet").count() == 2
    files.write_metrics(rows, f"{tmp_path}/m/run", 10, 20)
    tree = files.read_tree(spark, f"{tmp_path}/m/*/metrics_*/*.json", "pid long")
    assert "metrics_10_20" in tree.first().path
    assert files.read_bounded(spark, f"{tmp_path}/both/jsonl", "passage", "pid", (2, 3)).count() == 1
    (tmp_path / "p.json").write_text('[{"split": "a", "system": "s", "user_template": "u"}, {"split": "b"}]')
    assert prompts.load_prompt(spark, f"{tmp_path}/p.json", "a")["system"] == "s"
    with pytest.raises(ValueError, match="system, user_template"):
        prompts.load_prompt(spark, f"{tmp_path}/p.json", "b")


def test_streams(spark, tmp_path):
    from folioweave.streaming import corpus as stream

    docs = spark.createDataFrame([(i, "w " * 250) for i in range(6)], "doc_id long, text string")
    for k in range(3):
        docs.where(f"doc_id % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = stream.read_documents(spark, f"{tmp_path}/in", docs.schema)
    stream.write_passages(source, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == corpus.passages(docs).count() == 18
    q = stream.running_totals(stream.read_documents(spark, f"{tmp_path}/in", docs.schema)).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("totals").first().docs == 6
    vec = docs.select("text", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"), "doc_id")
    vec.coalesce(1).write.parquet(f"{tmp_path}/vec")
    rows = stream.read_documents(spark, f"{tmp_path}/vec", vec.schema)
    stream.grow_index(rows, f"{tmp_path}/index", f"{tmp_path}/istate", ["doc_id"]).awaitTermination(120)
    assert sorted(r.chunk_id for r in spark.read.parquet(f"{tmp_path}/index/batch=*").collect()) == list(range(6))


def test_settings_merge():
    from folioweave.plans.settings import merge

    base = {"model": {"name": "m", "window": 10}, "out": "${model.name}/x-${model.window}", "same": "${model.window}", "list": ["${same}"]}
    got = merge(base, ["model.window=32", "new.deep=true", "model.name=a=b"])
    assert got == {"model": {"name": "a=b", "window": 32}, "new": {"deep": True}, "out": "a=b/x-32", "same": 32, "list": [32]}
    assert base["model"]["window"] == 10
    with pytest.raises(KeyError):
        merge({"a": "${b}"}, [])
    with pytest.raises(ValueError):
        merge({"a": "${b}", "b": "${a}"}, [])


def test_missing_labels_and_predictions_are_errors(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "id int, pred string")
    with pytest.raises(ValueError):
        inference.labels(rows)
    with pytest.raises(ValueError):
        inference.predictions(rows.drop("pred"))
    with pytest.raises(Exception, match="no prediction"):
        rows.select(inference.predictions(rows)).collect()
    with pytest.raises(Exception, match="calls no function"):
        spark.range(1).select(prompts.task_values("code_run", {"input": F.lit("none here")})["func"]).collect()


def test_summary_rouge_by_lines():
    # the longest common subsequences of a reference line with every predicted line count together, words no more often than both have them
    assert arrow.rouge_lsum("a b c d\nx y", "a x c\nb") == (2 * 4 / 10, 1.0)
    assert arrow.rouge_lsum("a", "a a") == (2 / 3, 0.5)
    assert arrow.rouge_lsum("", "a") == (0.0, 0.0)
    for t in ("One two, three.", "a b\nc"):
        assert arrow.rouge_lsum(t, t) == (1.0, 1.0)
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(1, 9))] for _ in range(2))
        places = arrow.lcs_places(a, b)
        assert len(places) == arrow.lcs(a, b)


def test_near_duplicates_of_long_texts_are_quick():
    import time

    rnd = random.Random(3)
    words_ = [rnd.choice("lorem ipsum dolor sit amet elit sed do".split()) for _ in range(4000)]
    began = time.perf_counter()
    assert arrow.partial(" ".join(words_[1000:1100]), " ".join(words_)) == 100.0
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("block", [1, 2, 7, 4096])
def test_runs_cross_blocks(spark, block):
    """Runs found in blocks are those of a walk over all positions, also where a run covers whole blocks."""
    draw = random.Random(3)
    scores = {i: [draw.choice((0.0, 1.0, 2.0)) if (p // 20) % 2 else 3.0 for p in range(-5, 120)] for i in (1, 2)} | {3: [1.0] * 10}
    tokens = spark.createDataFrame([(i, p - 5, s) for i, row in scores.items() for p, s in enumerate(row)], "instance int, pos int, score double")
    expected = set()
    for i, row in scores.items():
        at = sorted(row)
        h = (len(row) - 1) * 0.4
        limit = at[int(h)] + (at[min(int(h) + 1, len(row) - 1)] - at[int(h)]) * (h - int(h))
        start = None
        for p, s in enumerate([*row, limit]):
            if s > limit and start is None:
                start = p
            elif s <= limit and start is not None:
                if p - start >= 2:
                    expected.add((i, start - 5, p - 6, p - start, sum(row[start:p])))
                start = None
    got = spans.high_runs(tokens, 0.4, 2, block).select("instance", "from_pos", "to_pos", "n_tokens", "total").collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_shared_gold_sets(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a"), (5, None)], "query_id int, group string")
    found = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x"), (3, "z"), (5, "x")], "query_id int, item string")
    gold = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (None, "x")], "group string, item string")
    got = {r.query_id: (r.precision, r.recall, round(r.f1, 6)) for r in ranking.shared_gold_scores(queries, found, gold).collect()}
    assert got == {1: (0.5, 1.0, 0.666667), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0), 4: (0.0, 0.0, 0.0), 5: (0.0, 0.0, 0.0)}


def test_a_table_of_one_row_group_in_many_splits_is_dealt_over_all_cores(spark, tmp_path):
    spark.range(60_000).withColumn("text", F.sha2(F.col("id").cast("string"), 512)).coalesce(1).write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        rows = spark.read.parquet(f"{tmp_path}/t")
        assert rows.rdd.getNumPartitions() >= 4  # all but one have no rows
        dealt = [r["count"] for r in over_all_cores(rows, "id").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(dealt) == 60_000 and len(dealt) == 4 and max(dealt) < 20_000
    assert over_all_cores(spark.range(100), "id").rdd.getNumPartitions() == spark.range(100).rdd.getNumPartitions()


def test_the_stream_of_documents_is_written_by_all_tasks(spark):
    docs, at = file_queries._stream(spark, "/root/testdata/sf0.001")
    assert len(spark.read.parquet(at).inputFiles()) >= 4
    assert spark.read.parquet(at).count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
