"""Queries that go through files, streams and indexes: what was written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioweave.functions import context as C
from folioweave.functions import text as T
from folioweave.operators import attention, retrieval, sampling
from folioweave.plans import corpus, inference, prompts
from folioweave.plans.catalog import _CONV, _FORMAT, _PASSAGES, _RANKED, _md5, _training_rows, _words, query, read
from folioweave.sources import files
from folioweave.sources.tables import SharedTables
from folioweave.streaming import corpus as stream


def _folder(spark, name):
    return SharedTables(spark).path(name)


# --- records ----------------------------------------------------------------------------------------------------------
@query("SELECT conv_id, turn::INT AS turn, role, md5(text) AS text FROM conversations")
def records_jsonl(spark, sf_dir):
    at = _folder(spark, "jsonl")
    files.write_jsonl(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), at)
    return files.read_json(spark, at, "conv_id long, turn int, role string, text string").withColumn("text", _md5(F.col("text")))


@query("SELECT doc_id::VARCHAR AS id, lang AS language, md5(text) AS context FROM documents")
def records_renamed(spark, sf_dir):
    at = _folder(spark, "reports")
    docs = read(spark, sf_dir, "documents")
    files.write_jsonl(docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("language"), F.col("text").alias("docs")), at)
    return files.read_reports(spark, at).select("id", "language", _md5(F.col("context")).alias("context"))


@query("""SELECT 'kilt' AS split, c_name AS question, n_name AS answer, 1 AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'alce', n_name, r_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey""")
def records_by_split(spark, sf_dir):
    at = _folder(spark, "splits")
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    c = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    files.write_jsonl(c.select(F.col("c_name").alias("question"), F.array("n_name").alias("answers"), F.array(F.struct(F.col("n_name").alias("id"), F.lit(True).alias("has_answer"))).alias("ctxs")), f"{at}/a.jsonl")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.struct(F.col("n_name").alias("question"), F.array(F.struct(F.lit("t").alias("title"), F.lit("x").alias("text"))).alias("docs"), F.col("r_name").alias("answer")).alias("x"))
    rows.agg(F.to_json(F.collect_list("x")).alias("value")).coalesce(1).write.text(f"{at}/b.json")  # a file of one array, a row per nation
    kilt = files.read_retrieved(spark, at, "kilt", "a").select(F.lit("kilt").alias("split"), "question", F.get("answers", 0).alias("answer"), F.size("ctxs").alias("n"))
    return kilt.unionByName(files.read_retrieved(spark, at, "alce", "b").select(F.lit("alce").alias("split"), "question", "answer", F.size("docs").alias("n")))


@query("SELECT 'most' AS bound, doc_id::VARCHAR AS id FROM documents WHERE n_chars <= 2000 UNION ALL SELECT 'range', doc_id::VARCHAR FROM documents WHERE n_chars BETWEEN 500 AND 3000 UNION ALL SELECT 'none', doc_id::VARCHAR FROM documents")
def records_bounded(spark, sf_dir):
    at = _folder(spark, "bounded")
    files.write_jsonl(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("length")), at)
    one = lambda name, bounds: files.read_bounded(spark, at, "reports", "length", bounds).select(F.lit(name).alias("bound"), "id")
    return one("most", 2000).union(one("range", (500, 3000))).union(one("none", None))


@query("SELECT o_orderkey, o_totalprice, CASE WHEN row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) <= (SELECT ceil(0.05 * count(*) - 1e-9) FROM orders) THEN 'test' ELSE 'train' END AS split FROM orders")
def records_train_test(spark, sf_dir):
    at = _folder(spark, "train_test")
    files.write_splits(sampling.split(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey"), at)
    return spark.read.schema("o_orderkey long, o_totalprice double, split string").parquet(at)


@query("SELECT f AS format, count(*) AS n, sum(len(text)) AS chars FROM conversations, (VALUES ('jsonl'), ('parquet')) t(f) GROUP BY f")
def records_both(spark, sf_dir):
    at = _folder(spark, "both")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "text")
    files.write_both(rows, at)
    one = lambda rows, name: rows.agg(F.lit(name).alias("format"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return one(files.read_json(spark, f"{at}/jsonl", rows.schema), "jsonl").union(one(spark.read.parquet(f"{at}/parquet"), "parquet"))


@query("""WITH b(lo, hi) AS (VALUES (0, 800), (800, 4000)) SELECT 'metrics_' || lo || '_' || hi AS name, count(*) AS n, round(avg(n_chars), 6) AS score FROM documents, b WHERE n_chars >= lo AND n_chars < hi GROUP BY ALL
UNION ALL SELECT 'metrics', count(*), round(avg(n_chars), 6) FROM documents""")
def metrics_tree(spark, sf_dir):
    at = _folder(spark, "metrics")
    docs = read(spark, sf_dir, "documents")
    mean = lambda rows: rows.agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("score"))
    for lo, hi in ((0, 800), (800, 4000)):
        files.write_metrics(mean(docs.where((F.col("n_chars") >= lo) & (F.col("n_chars") < hi))), f"{at}/run", lo, hi)
    files.write_metrics(mean(docs), f"{at}/run")
    back = files.read_tree(spark, f"{at}/run/*/*.json", "n long, score double")
    return back.select(F.regexp_extract("path", r"/(metrics(?:_\d+_\d+)?)/[^/]*$", 1).alias("name"), "n", "score")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS chunk_id, vec_id::VARCHAR AS text, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS first FROM embeddings")
def index_saved(spark, sf_dir):
    at = _folder(spark, "index")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("text"), "embedding")
    files.write_index(retrieval.build_index(rows, ["vec_id"]), at)
    return files.read_index(spark, at).select("chunk_id", "text", F.round(F.get("embedding", 0).cast("double"), 5).alias("first"))


@query("SELECT c_custkey, 'Say {it}. ' || c_name AS system, 'Q: ' || c_mktsegment || ' of ' || c_name AS user_text FROM customer")
def prompt_file(spark, sf_dir):
    at = _folder(spark, "prompts")
    text = '[{"split": "other"}, {"split": "main", "system": "Say {{it}}. {name}", "user_template": "Q: {segment} of {name}"}]'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(at)
    p = prompts.load_prompt(spark, at, "main")
    values = {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}
    return read(spark, sf_dir, "customer").select("c_custkey", prompts.fill(p["system"], values).alias("system"), prompts.fill(p["user_template"], values).alias("user_text"))


# --- streams ----------------------------------------------------------------------------------------------------------
def _stream(spark, sf_dir, *columns):
    """The documents as a stream of two batches, each of as many files as half of the tasks that read them make."""
    at = _folder(spark, "in")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", *columns)
    docs.write.parquet(at)
    written = len(spark.read.parquet(at).inputFiles())
    return stream.read_documents(spark, at, docs.schema, -(-written // 2)), at


@query(f"WITH {_PASSAGES} SELECT doc_id, ordinal::INT AS ordinal, md5(passage) AS passage FROM p")
def stream_passages(spark, sf_dir):
    docs, at = _stream(spark, sf_dir)
    stream.write_passages(docs, f"{at}-out", f"{at}-state").awaitTermination()
    return spark.read.parquet(f"{at}-out").withColumn("passage", _md5(F.col("passage")))


@query(f"SELECT count(*) AS docs, count(*) FILTER (len({_words('text')}) < 10) AS short, sum(len({_words('text')}))::BIGINT AS words FROM documents")
def stream_totals(spark, sf_dir):
    docs, at = _stream(spark, sf_dir)
    name = f"totals_{at[-8:]}"
    stream.running_totals(docs).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("SELECT count(*) AS n, min(k)::BIGINT AS least, max(k)::BIGINT AS most, count(DISTINCT k) AS ids FROM (SELECT row_number() OVER () - 1 AS k FROM documents)")
def stream_index(spark, sf_dir):
    """Which file comes first is not told, so the numbers as a whole are compared."""
    docs, at = _stream(spark, sf_dir)
    rows = docs.select("doc_id", "text", F.array(F.length("text").cast("float"), F.lit(1).cast("float")).alias("embedding"))
    stream.grow_index(rows, f"{at}-index", f"{at}-istate", ["doc_id"]).awaitTermination()
    return spark.read.parquet(f"{at}-index/batch=*").agg(F.count("*").alias("n"), F.min("chunk_id").alias("least"), F.max("chunk_id").alias("most"), F.count_distinct("chunk_id").alias("ids"))


# --- chunks, neighbours of an instance ----------------------------------------------------------------------------------
@query("""WITH t AS (SELECT conv_id, string_split(text, '') AS ts, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS turn FROM conversations WHERE len(text) > 0),
c AS (SELECT conv_id, turn, k, array_to_string(ts[k * 50 + 1 : k * 50 + 50], '') AS text FROM (SELECT *, unnest(range(0, ceil(len(ts) / 50.0)::BIGINT)) AS k FROM t))
SELECT (row_number() OVER (ORDER BY conv_id, turn, k) - 1)::BIGINT AS chunk_id, md5(text) AS text, round((length(text) / sqrt(length(text) * length(text) + 1.0)), 5)::DOUBLE AS first FROM c""")
def long_document_index(spark, sf_dir):
    """Characters are the tokens."""
    t = read(spark, sf_dir, "conversations").where("length(text) > 0").select("conv_id", "turn", T.characters(F.col("text")).alias("tokens"))
    made = corpus.index_long_documents(t, lambda x: F.array(F.length(x).cast("float"), F.lit(1).cast("float")), 50, ("conv_id", "turn"))
    return made.select("chunk_id", _md5(F.col("text")).alias("text"), F.round(F.get("embedding", 0).cast("double"), 5).alias("first"))


@query(f"WITH {_RANKED}, i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS own FROM r WHERE label = q_label) SELECT q_label AS label, query_id, own AS rank, chunk_id FROM i WHERE own <= 4")
def knn_per_instance(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("chunk_id"), "embedding")
    picked = rows.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    return retrieval.top_k(picked, rows, 4, ["label"]).select("label", "query_id", "rank", "chunk_id")


# --- around generation --------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'XXXXXXXXXX' ELSE o_orderpriority END AS label, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'later' END AS pred FROM orders")
def ids_and_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 2 == 0, k.cast("string")).alias("id"), k.cast("string").alias("_id"), F.when(k % 3 > 0, F.col("o_orderpriority")).alias("ground_truth"),
        F.when(k % 2 == 0, F.col("o_orderstatus")).alias("pred"), F.lit("later").alias("model_output"),
    )
    rows = inference.with_id(o)
    return rows.select("o_orderkey", "id", inference.labels(rows).alias("label"), inference.predictions(rows).alias("pred"))


@query(f"""WITH d AS (SELECT doc_id, {_words('text')} AS ws FROM documents), c AS (SELECT doc_id, len(ws) AS n, CASE WHEN len(ws) > 400 THEN ws[1:300] ELSE ws END AS ws FROM d),
p AS (SELECT doc_id, unnest(range(0, greatest(ceil(len(ws) / 50.0)::BIGINT, 1))) AS k, ws FROM c)
SELECT c.doc_id, any_value(n)::INT AS original_ctx_length, (any_value(len(c.ws)) + 2 * count(*))::INT AS final_ctx_length, md5(string_agg('[DOC ' || k || ']' || chr(10) || array_to_string(p.ws[k * 50 + 1 : k * 50 + 50], ' ') || chr(10) || chr(10), '' ORDER BY k)) AS context
FROM c JOIN p USING (doc_id) GROUP BY c.doc_id HAVING any_value(len(c.ws)) + 2 * count(*) <= 310""")
def split_at_inference(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("context"), F.lit("x").alias("messages"))
    made = inference.outputs(inference.prepare(docs, 400, 100, 310, 50).withColumn("made", _md5(F.col("context"))))
    return made.withColumnRenamed("made", "context")


@query("SELECT doc_id, mode, CASE mode WHEN 'none' THEN NULL WHEN 'full' THEN md5(text) ELSE md5(CASE WHEN doc_id % 2 = 0 THEN lang || chr(10) || source ELSE text END) END AS context FROM documents, (VALUES ('full'), ('topk'), ('none')) m(mode)")
def context_modes(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("context"), "lang", "source")
    hits = docs.where("id % 2 = 0").select("id", F.array(F.col("lang"), F.col("source"), F.lit("third")).alias("chunks"))
    out = None
    for mode in inference.MODES:
        rows = inference.contexts(docs, mode, hits, 2)
        context = _md5(F.col("context")) if "context" in rows.columns else F.lit(None).cast("string")
        one = rows.select(F.col("id").alias("doc_id"), F.lit(mode).alias("mode"), context.alias("context"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT doc_id, len({_words('text')})::INT AS n FROM documents WHERE len({_words('text')}) BETWEEN 1 AND 300 ORDER BY n, doc_id LIMIT 40")
def prompts_within_limit(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("n"), T.words(F.col("text")).alias("ctxs"))
    return sampling.first_rows(attention.with_contexts(attention.within_limit(docs, "n", 300)), ["n", "doc_id"], 40).drop("ctxs")


@query(f"""WITH {_FORMAT}, p AS (SELECT conv_id, 'Relevant documents:' || chr(10) || coalesce(string_agg(CASE WHEN role = 'assistant' THEN '[DOC ' || i || ']' || chr(10) || body || chr(10) || chr(10) END, '' ORDER BY i), '') || chr(10) || chr(10) AS pre FROM c GROUP BY conv_id)
SELECT conv_id, k AS pos, ['system', 'user', 'assistant'][k + 1] AS role, md5([conv_id::VARCHAR, 'what {{is}} ' || conv_id, pre][k + 1]) AS content FROM p, (VALUES (0), (1), (2)) t(k)""")
def chat_messages(spark, sf_dir):
    rows = _training_rows(spark, sf_dir)
    gold = F.transform(F.filter(C.parse(F.col("training_context")), lambda d: F.array_contains("gold_doc_ids", C.tag(d["doc_id"]))), lambda d: d["content"])
    said = prompts.messages(F.col("answer"), F.col("question"), prompts.gold_prefill(F.col("gold_doc_ids"), gold))
    return rows.select("conv_id", F.posexplode(said).alias("pos", "m")).select("conv_id", "pos", "m.role", _md5(F.col("m.content")).alias("content"))


@query(f"""WITH {_CONV}, f AS (SELECT conv_id, string_agg(body, chr(10) || chr(10) || chr(10) ORDER BY i) FILTER (i < 2) AS t FROM c GROUP BY conv_id),
s AS (SELECT conv_id, body, row_number() OVER (PARTITION BY conv_id ORDER BY md5('42:' || conv_id || ':' || i), i) AS k FROM c), g AS (SELECT conv_id, string_agg(body, '|' ORDER BY k) FILTER (k <= 2) AS t FROM s GROUP BY conv_id)
SELECT conv_id, md5(f.t) AS first, md5(g.t) AS drawn FROM f JOIN g USING (conv_id)""")
def demonstrations(spark, sf_dir):
    rows = _training_rows(spark, sf_dir).select("conv_id", F.transform(C.parse(F.col("training_context")), lambda d: d["content"]).alias("demos"))
    drawn = prompts.demonstrations(F.col("demos"), 2, "|", F.col("conv_id"))
    return rows.select("conv_id", _md5(prompts.demonstrations(F.col("demos"), 2)).alias("first"), _md5(drawn).alias("drawn"))


@query("""SELECT o_orderkey, s AS split, CASE s WHEN 'code_run' THEN 'func_' || o_custkey || '(-' || o_orderkey || ') by func_' || o_custkey WHEN 'math_find' THEN 'What is the smallest number of order ' || o_orderkey || ' in the following list?'
WHEN 'code_debug' THEN o_orderstatus || o_orderpriority ELSE o_orderpriority || o_orderstatus || ' Find it' END AS prompt FROM orders, (VALUES ('code_run'), ('math_find'), ('code_debug'), ('longbook_choice_eng')) t(s)""")
def task_prompts(spark, sf_dir):
    k, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    asked = {
        "code_run": ("{func_call} by {func}", F.concat(F.lit("Run func_"), cust, F.lit("(-"), k, F.lit(") now"))),
        "math_find": ("{prefix}", F.concat(F.lit("The smallest number of order "), k, F.lit(" of it"))),
        "code_debug": ("{OPTION_A}{OPTION_B}", F.lit("Find it")),
        "longbook_choice_eng": ("{choice_b}{choice_a} {question}", F.lit("Find it")),
    }
    out = None
    for split, (template, question) in asked.items():
        values = prompts.task_values(split, {"context": F.lit("c"), "input": question, "options": F.array("o_orderstatus", "o_orderpriority")})
        one = read(spark, sf_dir, "orders").select("o_orderkey", F.lit(split).alias("split"), prompts.fill(template, values).alias("prompt"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_FORMAT} SELECT conv_id AS index, v AS variant, md5(ctx || 'what {{is}} ' || conv_id) AS prompt, conv_id::VARCHAR AS truth, CASE WHEN v = 'answer_only' THEN NULL ELSE tags END AS tags,
  CASE WHEN v IN ('content', 'judge') THEN md5(gold) END AS gold, CASE WHEN v = 'judge' THEN md5(ctx) END AS context FROM x, (VALUES ('ids'), ('answer_only'), ('content'), ('judge')) t(v)""")
def rl_formats(spark, sf_dir):
    out = None
    for v in ("ids", "answer_only", "content", "judge"):
        rows = prompts.rl_rows(_training_rows(spark, sf_dir), "{context}{question}", v)
        has = set(rows.schema["extra_info"].dataType.names)
        of = lambda name, made: (made if name in has else F.lit(None).cast("string")).alias  # noqa: B023, E731
        one = rows.select(
            "extra_info.index", F.lit(v).alias("variant"), _md5(F.get("prompt", 0)["content"]).alias("prompt"), F.col("reward_model.ground_truth").alias("truth"),
            of("gold_doc_ids", F.array_join("extra_info.gold_doc_ids", ", ") if "gold_doc_ids" in has else None)("tags"),
            of("relevant_gold_docs", _md5(F.array_join("extra_info.relevant_gold_docs", "|")) if "relevant_gold_docs" in has else None)("gold"),
            of("training_context", _md5(F.col("extra_info.training_context")) if "training_context" in has else None)("context"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderkey, 'Q ' || o_orderkey || ' A ' || o_orderpriority || ' P ' || o_orderstatus || ' D ' || CASE WHEN o_orderkey % 2 = 0 THEN o_clerk ELSE '' END AS prompt FROM (SELECT *, 'doc ' || o_custkey AS o_clerk FROM orders)")
def judge_prompts(spark, sf_dir):
    kind = F.when(F.col("o_orderkey") % 2 == 0, "paper").otherwise("book")
    docs = F.concat(F.lit("doc "), F.col("o_custkey").cast("string"))
    made = prompts.judge_prompt("Q {question} A {answer} P {prediction} D {docs}", F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus"), kind, docs)
    return read(spark, sf_dir, "orders").select("o_orderkey", made.alias("prompt"))
