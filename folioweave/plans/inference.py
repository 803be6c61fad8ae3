"""What stands around generation: context modes, trimming, splitting, lengths. Tokens come as an array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions import context as C
from folioweave.functions import overlap as O
from folioweave.functions import scorers as S
from folioweave.functions import text as T
from folioweave.functions.tokens import Tokens
from folioweave.operators.retrieval import use_hits
from folioweave.operators.runs import percent_means

MODES = ("full", "topk", "none")
MISSING = "XXXXXXXXXX"


def first_of(rows: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the columns that are there, row by row; an error if none is."""
    there = [F.col(n) for n in names if n in rows.columns]
    if not there:
        raise ValueError(f"none of {names} is a column")
    return F.coalesce(*there)


def with_id(rows: DataFrame) -> DataFrame:
    """rows with id: id, else _id; an error in a row that has neither."""
    found = first_of(rows, ("id", "_id")).cast("string")
    return rows.withColumn("id", F.coalesce(found, F.raise_error(F.lit("a row has neither id nor _id")).cast("string")))


def labels(rows: DataFrame) -> Column:
    """The label column that is there, MISSING in rows without one; an error if there is no label column."""
    return F.coalesce(first_of(rows, ("ground_truth", "label", "answer")), F.lit(MISSING))


def predictions(rows: DataFrame) -> Column:
    """The prediction, row by row; an error if there is no such column, or a row has none."""
    found = first_of(rows, ("prediction", "pred", "model_output"))
    return F.coalesce(found, F.raise_error(F.lit("a row has no prediction")).cast("string"))


def contexts(rows: DataFrame, mode: str, hits: DataFrame | None = None, top: int = -1) -> DataFrame:
    """rows with the context of a mode: whole, the retrieved chunks in rank order, or none."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode == "none":
        return rows.drop("context")
    return rows if mode == "full" else use_hits(rows, hits, top)


def prepare(rows: DataFrame, most: int, buffer: int = 512, limit: int | None = None, split_words: int | None = None, vocabulary: str | None = None) -> DataFrame:
    """rows with context trimmed, split into numbered passages if asked, original_ctx_length and final_ctx_length.

    Lengths are of the vocabulary's tokens; without one, of words, its stand-in. Rows over `limit` are left out.
    """
    if vocabulary:
        tokens = Tokens(rows, vocabulary)
        made = rows.withColumn("_c", tokens.truncated(F.col("context"), most, buffer))
        made = made.withColumns({"context": F.col("_c.text"), "original_ctx_length": F.col("_c.before"), "final_ctx_length": F.col("_c.after")}).drop("_c")
        if split_words:
            made = made.withColumn("context", C.render(C.number(T.passages(T.collapse_space(F.col("context")), split_words))))
            made = tokens.counted(made, "context", "final_ctx_length")
        return made if limit is None else made.where(F.col("final_ctx_length") <= limit)

    def trimmed(words: Column) -> Column:
        kept = F.when(F.size(words) > most, F.array_join(T.truncate_tail(words, most, buffer), " ")).otherwise(F.col("context"))
        made = C.render(C.number(T.passages(T.collapse_space(kept), split_words))) if split_words else kept
        whole = lambda t: F.struct(t.alias("context"), F.size(words).alias("original_ctx_length"), T.word_count(t).alias("final_ctx_length"))
        return T.let(made, whole)

    # generated, so that what asks for a length does not make the context again
    made = rows.select("*", F.inline(F.array(T.let(T.words(F.col("context")), trimmed))).alias("_c", "_before", "_after"))
    made = made.withColumns({"context": F.col("_c"), "original_ctx_length": F.col("_before"), "final_ctx_length": F.col("_after")}).drop("_c", "_before", "_after")
    return made if limit is None else made.where(F.col("final_ctx_length") <= limit)


def outputs(rows: DataFrame) -> DataFrame:
    """What is written: rows without the wide columns."""
    return rows.drop("messages", "context", "docs")


def token_range(rows: DataFrame, count: str, least: int = 0, most: int = 32_000) -> DataFrame:
    return rows.where(F.col(count).between(least, most))


def gold_by_passage(ctxs: Column, positive: Column) -> Column:
    """Contexts whose psg_id is one of the positive contexts'."""
    ids = F.filter(F.transform(positive, lambda p: p["psg_id"]), lambda x: x.isNotNull())
    return F.filter(ctxs, lambda c: F.array_contains(ids, c["psg_id"]))


def gold_by_answer(ctxs: Column) -> Column:
    """Contexts with the id of one that holds the answer."""
    ids = F.transform(F.filter(ctxs, lambda c: c["has_answer"]), lambda c: c["id"])
    return F.filter(ctxs, lambda c: F.array_contains(ids, c["id"]))


def retrieved_means(rows: DataFrame) -> DataFrame:
    """One row: means times 100 of the scores of retrieved answers, and of the named documents against gold.

    rows: model_output, answers, gold_doc_ids (tags; rows where it is null have no document scores).
    """
    scored = rows.select(S.retrieved_qa(F.col("model_output"), F.col("answers")).alias("s"), O.set_scores(C.tags_in(F.col("model_output")), F.col("gold_doc_ids")).alias("d"), F.col("gold_doc_ids").isNotNull().alias("has"))
    named = [F.when(F.col("has"), F.col(f"d.{c}")).alias(f"doc_ids_{c}") for c in ("precision", "recall", "f1")]
    return percent_means(scored.select("s.*", *named), [*S.RETRIEVED, "doc_ids_precision", "doc_ids_recall", "doc_ids_f1"])
