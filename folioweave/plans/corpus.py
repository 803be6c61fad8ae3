"""A corpus in passages, batch or stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions import text as T
from folioweave.operators.retrieval import build_index, number_rows


def passages(docs: DataFrame, size: int = 100, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, ordinal, passage: white space collapsed, then windows of `size` words. No shuffle: also for streams."""
    return docs.select(*keep, F.posexplode(T.passages(T.collapse_space(F.col("text")), size)).alias("ordinal", "passage"))


def numbered(parts: DataFrame, order: tuple[str, ...] = ("doc_id", "ordinal")) -> DataFrame:
    """passages with pid from 0 in order."""
    return number_rows(parts, list(order), "pid")


def token_chunks(docs: DataFrame, size: int = 2048, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, ordinal, text: runs of `size` tokens joined to text. docs: tokens, an array of strings that make up the text."""
    runs = F.transform(T.windows(F.col("tokens"), size), lambda w: F.array_join(w, ""))
    return docs.select(*keep, F.posexplode(runs).alias("ordinal", "text"))


def index_long_documents(docs: DataFrame, embed: Callable[[Column], Column], size: int = 2048, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A chunk table (chunk_id, text, embedding) of the documents' token chunks, in order; an error without any chunk."""
    chunks = token_chunks(docs, size, keep)
    return build_index(chunks.withColumn("embedding", embed(F.col("text"))), [*keep, "ordinal"])
