"""What rows pay for once: how often a costly step stands in a plan, and in the elements of its arrays."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioweave.functions import arrow
from folioweave.functions import offsets
from folioweave.functions import overlap as O
from folioweave.functions import scorers as S
from folioweave.operators import cited
from folioweave.plans import inference


def times(spark, column, needle):
    """How often the needle stands in what a row computes for the column."""
    rows = spark.range(1).select(F.col("id").cast("string").alias("t"), F.array(F.lit("x"), F.col("id").cast("string")).alias("many"))
    return rows.select(column.alias("c"))._jdf.queryExecution().analyzed().toString().count(needle)


def test_lists_are_normalised_once(spark):
    groups = F.array(F.col("many"), F.col("many"))
    assert times(spark, cited.list_scores(F.col("t"), groups)["f1"], "Punct") == 2  # the said ones, the gold ones


def test_answers_are_normalised_once(spark):
    assert times(spark, S.qa_english(F.col("t"), F.col("many")), "Punct") == 4  # the answer, the whole, the parsed one; the truths
    assert times(spark, S.qa_chinese(F.col("t"), F.col("many")), "array_sort") == 0
    in_elements = times(spark, O.best_answer_f1(F.col("t"), F.col("many")), "lower(lambda")
    assert in_elements == 1  # the truth; the prediction stands outside of the elements


def test_words_of_long_texts_stay_in_their_row(spark):
    rows = spark.createDataFrame([(1, "The a B b! " * 300_000, "b " * 700_000), (2, None, "x"), (3, "An", ""), (4, "x y", "Y z")], "k int, a string, b string")
    got = O.long_token_f1(rows, ["k"], "a", "b")
    assert {r.k: r.f1 for r in got.collect()} == pytest.approx({1: 2 * 600_000 / 1_300_000, 2: 0.0, 3: 0.0, 4: 0.5})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan  # no token is shuffled


def test_quotes_are_taken_apart_once(spark, monkeypatch):
    """Matches by the column expressions of fuzzy_score, and a text's parts made once for all its pairs."""
    texts = ["", "a b", "Ab", "the cat sat", "The  cat sat.", "the cat", "😀 x", None]
    rows = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)], "i int, j int, a string, b string")
    want = {(r.i, r.j): r.s for r in rows.select("i", "j", O.fuzzy_score(F.col("a"), F.col("b")).alias("s")).collect()}
    for (i, j), s in want.items():
        if None not in (texts[i], texts[j]):
            assert arrow.fuzzy(*(arrow.fuzzy_parts(texts[k].lower()) for k in (i, j))) == s
    made, whole = [], arrow.fuzzy_parts
    monkeypatch.setattr(arrow, "fuzzy_parts", lambda t: made.append(t) or whole(t))
    assert arrow.greedy_count(["abc", "abd", None], ["abd", "abc", "abc"], 0.8) == 2 and len(made) == 5


def test_spans_of_many_texts_are_not_held_at_once():
    """A batch of texts takes little more than its arrays: objects of 40 MB of texts would be 200 MB and more."""
    import tracemalloc

    texts = pa.array([None, "", "A b. C!"] + ["One two. " * 400] * 3000)
    tracemalloc.start()
    found = offsets.listed(texts, offsets.find_sentences)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(texts) and found[:3].to_pylist() == [None, [], [{"start": 0, "end": 4, "text": "A b."}, {"start": 5, "end": 7, "text": "C!"}]]
    assert found[-1].as_py()[-1] == {"start": 399 * 9, "end": 399 * 9 + 8, "text": "One two."} and len(found.flatten()) == 2 + 400 * 3000
    assert peak < 60 << 20


def test_predictions_are_flattened_once(spark):
    assert times(spark, S.choice(F.col("t"), F.col("many")), "{2,}") == 1
    assert times(spark, S.code_debug(F.col("t"), F.col("many")), "{2,}") == 1
    assert times(spark, S.math_find(F.col("t"), F.col("many"), F.lit("int")), "regexp_extract") == 1


def test_contexts_are_made_once(spark):
    """The length limit reads what was made: words are split once for the old length, once for passages, once for the new."""
    rows = spark.createDataFrame([(1, "a b  c d e"), (2, None), (3, "a b c d e f g h i")], "id int, context string")
    made = inference.prepare(rows, 6, 2, 9, 2)
    assert [tuple(r) for r in made.orderBy("id").collect()] == [(2, "", None, 0), (3, "[DOC 0]\na b\n\n[DOC 1]\nc d\n\n", 9, 8)]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") == 3


def test_verdicts_meet_their_sentence_once(spark):
    s = spark.createDataFrame([(1, 0, [0, 1], 3), (1, 1, [2], 3), (1, 2, [5], 3), (2, 0, [], 3), (3, 0, [1, 1, 0, 2], 3)], "item_id int, sent_id int, refs array<int>, n_docs int")
    v = [(1, 0, "0,1", 1), (1, 0, "0", 1), (1, 0, "1", 0), (1, 1, "2", 1), (1, 2, "5", 1), (3, 0, "0,1,1", 1), (3, 0, "0", 1), (3, 0, "1,1", 1)]
    got = cited.citation_scores(s, spark.createDataFrame(v, "item_id int, sent_id int, refs string, verdict int"))
    # of the first, 0 supports alone and 1 is not needed; of the last, 0 supports alone, and without 1 it supports still
    assert {r.item_id: (r.citation_recall, r.citation_precision) for r in got.collect()} == {1: pytest.approx((2 / 3, 2 / 3)), 2: (0, 0), 3: pytest.approx((1, 1 / 3))}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
