"""Training sets: supporting facts, hits and documents to contexts with gold, cleaned, promoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions import context as C
from folioweave.functions import text as T
from folioweave.functions.arrow import near_duplicate_score_from, spread
from folioweave.operators.sampling import shuffled


def supporting_sentences(rows: DataFrame) -> DataFrame:
    """id, ordinal, sentence: the facts' sentences, by title and number; a missing title or number goes.

    rows: id, supporting_facts{title[], sent_id[]}, context{title[], sentences[][]}. Negative numbers name none.
    """
    facts = rows.select("id", F.posexplode(F.arrays_zip(F.col("supporting_facts.title").alias("title"), F.col("supporting_facts.sent_id").alias("n"))).alias("ordinal", "f"))
    texts = rows.select("id", F.inline(F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("s"))))
    met = facts.select("id", "ordinal", "f.title", "f.n").join(texts, ["id", "title"])
    return met.select("id", "ordinal", F.get("s", F.col("n")).alias("sentence")).where("sentence IS NOT NULL AND ordinal >= 0")


def instances(rows: DataFrame, hits: DataFrame, seed: int = 42) -> DataFrame:
    """id, training_context, gold_doc_ids: gold sentences and retrieved chunks, shuffled by id, rendered, gold tagged.

    rows: id and supporting facts; hits: id, chunks. A hit with the text of a gold sentence is gold too.
    """
    gold = supporting_sentences(rows).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "sentence"))).alias("g"))
    both = rows.select("id").join(gold, "id", "left").join(hits.select("id", "chunks"), "id", "left")
    sentences = F.coalesce(F.transform("g", lambda x: x["sentence"]), F.array().cast("array<string>"))
    texts = shuffled(F.concat(sentences, F.coalesce("chunks", F.array().cast("array<string>"))), F.col("id"), seed)
    made = both.select("id", sentences.alias("_g"), C.number(texts).alias("docs"))
    tags = F.transform(F.filter("docs", lambda d: F.array_contains("_g", d["content"])), lambda d: C.tag(d["doc_id"]))
    return made.select("id", C.render(F.col("docs")).alias("training_context"), tags.alias("gold_doc_ids"))


def clean(rows: DataFrame, min_words: int = 10) -> DataFrame:
    """rows with short documents dropped from training_context, but for gold ones; tags follow. Trailing space goes."""
    cleaned = C.clean(C.parse(F.col("training_context")), C.tag_numbers(F.col("gold_doc_ids")), min_words)
    made = rows.withColumn("_c", cleaned)
    text = F.regexp_replace(C.render(F.col("_c.docs")), rf"{T.SPACE}++\z", "")
    return made.withColumns({"training_context": text, "gold_doc_ids": F.transform("_c.gold", C.tag)}).drop("_c")


def clean_statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: instances, documents and gold before and after, and ratios with counts of at least 1 below."""
    def side(rows: DataFrame, name: str) -> DataFrame:
        docs = C.parse(F.col("training_context"))
        return rows.agg(F.count("*").alias(f"{name}_instances"), F.coalesce(F.sum(F.size(docs)), F.lit(0)).alias(f"{name}_docs"), F.coalesce(F.sum(F.size("gold_doc_ids")), F.lit(0)).alias(f"{name}_gold"))

    both = side(before, "before").crossJoin(side(after, "after"))  # one row by one row
    rate = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return both.withColumns({"kept_docs": rate("after_docs", "before_docs"), "kept_gold": rate("after_gold", "before_gold"), "docs_per_instance": rate("after_docs", "after_instances")})


def promote(candidates: DataFrame, threshold: float = 0.6, most: int = 10) -> DataFrame:
    """id, promoted (tags by number): the candidates most like any gold document; id, doc_id, similarity."""
    best = candidates.groupBy("id", "doc_id").agg(F.max("similarity").alias("similarity")).where(F.col("similarity") >= threshold)
    by = Window.partitionBy("id").orderBy(F.desc("similarity"), "doc_id")
    kept = best.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= most)
    return kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("doc_id")), C.tag).alias("promoted"))


def promote_similar(rows: DataFrame, threshold: float = 0.6, most: int = 10) -> DataFrame:
    """rows with promoted_gold_doc_ids: gold tags and those of near-duplicates of gold documents; without gold none."""
    docs = rows.select("id", C.tag_numbers(F.col("gold_doc_ids")).alias("_g"), F.inline(C.parse(F.col("training_context"))))
    is_gold = F.array_contains("_g", F.col("doc_id"))
    gold = docs.where(is_gold).select("id", F.col("content").alias("gold"))
    pairs = spread(docs.where(~is_gold).join(gold, "id"), "id", "doc_id")
    found = promote(pairs.select("id", "doc_id", near_duplicate_score_from(threshold)("content", "gold").alias("similarity")), threshold, most)
    joined = rows.join(found, "id", "left")
    every = C.sort_tags(F.array_union("gold_doc_ids", F.coalesce("promoted", F.array().cast("array<string>"))))
    return joined.withColumn("promoted_gold_doc_ids", every).drop("promoted")


def promotion_statistics(rows: DataFrame) -> DataFrame:
    n = F.greatest(F.count("*"), F.lit(1))
    before, after = F.coalesce(F.sum(F.size("gold_doc_ids")), F.lit(0)), F.coalesce(F.sum(F.size("promoted_gold_doc_ids")), F.lit(0))
    return rows.agg((before / n).alias("gold_before"), (after / n).alias("gold_after"), (after - before).alias("promoted"))


def judged_gold(judge_text: Column, gold: Column) -> Column:
    """Tags of the judge's text after its reasoning, repeats kept, then gold that it lacks; in order of text."""
    said = F.regexp_extract_all(F.coalesce(T.after_reasoning(judge_text), F.lit("")), F.lit(C.TAG), 0)
    return F.array_sort(F.concat(said, F.array_except(gold, said)))
