"""What attention picks: overlaps of two rankings, documents against gold, top content. Scores come as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions import context as C
from folioweave.functions import offsets
from folioweave.functions import overlap as O
from folioweave.functions import text as T
from folioweave.operators import ranking, spans


def _top_keys(scored: DataFrame, key: str, k: int, ties: list[str], name: str, score: str | Column = "score") -> DataFrame:
    """instance and the array of the k best keys, best first."""
    best = ranking.top(scored, ["instance"], score, ties, k)
    return best.groupBy("instance").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("key")))), lambda x: x["key"]).alias(name))


def _overlap(full: DataFrame, part: DataFrame, key: str, k: int, ties: list[str], score: str | Column = "score") -> DataFrame:
    both = _top_keys(full, key, k, ties, "top_full", score).join(_top_keys(part, key, k, ties, "top_part", score), "instance", "full")
    none = F.array().cast("array<string>")
    a, b = (F.coalesce(F.col(c).cast("array<string>"), none) for c in ("top_full", "top_part"))
    return both.select("instance", a.alias("top_full"), b.alias("top_part"), O.truncated_overlap(a, b).alias("overlap"))


def token_overlap(full: DataFrame, part: DataFrame, k: int) -> DataFrame:
    """instance, top_full, top_part, overlap of the k best tokens (instance, pos, token, score) of two prompts."""
    return _overlap(full, part, "token", k, ["pos"])


def span_overlap(full: tuple[DataFrame, DataFrame], part: tuple[DataFrame, DataFrame], k: int, serial: bool = False) -> DataFrame:
    """The same for spans, by the hash of their text; each side is (tokens, spans). Null if a side has no span. serial: see gold_scores()."""
    def scored(side: tuple[DataFrame, DataFrame]) -> DataFrame:
        return spans.score_by_text(*side, serial).withColumn("hash", T.short_hash(F.col("text")))

    return _overlap(scored(full), scored(part), "hash", k, ["first"], ranking.by_sum("score", serial))


def sentence_spans(texts: DataFrame) -> DataFrame:
    """Spans of the sentences of (instance, text)."""
    return texts.select("instance", F.posexplode(offsets.sentences(F.col("text"))).alias("span_idx", "s")).select("instance", "span_idx", "s.start", "s.end", "s.text")


def document_spans(texts: DataFrame) -> DataFrame:
    """Spans of the documents of (instance, text), tags included."""
    return texts.select("instance", F.posexplode(C.bounds(F.col("text"))).alias("span_idx", "s")).select("instance", "span_idx", "s.start", "s.end", "s.text")


def gold_scores(tokens: DataFrame, docs: DataFrame, gold: DataFrame, k: int, serial: bool = False) -> DataFrame:
    """instance, precision, recall, f1 of the k best documents (span_idx) against gold (instance, span_idx).

    serial: sums are added by position and ranked as they come out; else equal sums tie, whatever order they were added in.
    """
    rows, score = spans.summed(spans.to_next_span(tokens, docs), ["instance", "span_idx"], "score", "pos", serial)
    sums = rows.groupBy("instance", "span_idx").agg(score.alias("score"), F.min("pos").alias("first"))
    said = _top_keys(sums, "span_idx", k, ["first"], "said", ranking.by_sum("score", serial))
    right = gold.groupBy("instance").agg(F.collect_set("span_idx").alias("gold"))
    s = O.set_scores(F.col("said"), F.coalesce("gold", F.array().cast("array<int>")))
    return said.join(right, "instance", "left").select("instance", s.alias("s")).select("instance", "s.precision", "s.recall", "s.f1")


def top_runs(tokens: DataFrame, texts: DataFrame, k: int, share: float = 0.9, least: int = 3, chars: int = 20, serial: bool = False) -> DataFrame:
    """instance, text, n_tokens, total, rank: the k runs of high tokens with the largest sums whose text has `chars` or more.

    tokens: instance, pos, beg, end, score; texts: instance, text; serial: see gold_scores().
    """
    runs = spans.high_runs(tokens, share, least, serial=serial)
    at = tokens.select("instance", "pos", "beg", "end")
    first, last = at.select("instance", F.col("pos").alias("from_pos"), "beg"), at.select("instance", F.col("pos").alias("to_pos"), "end")
    cut = runs.join(first, ["instance", "from_pos"]).join(last, ["instance", "to_pos"]).join(texts, "instance")
    stripped = T.strip(F.substr("text", F.col("beg") + 1, F.col("end") - F.col("beg")))
    long = cut.select("instance", stripped.alias("text"), "n_tokens", "total", "from_pos").where(F.length("text") >= chars)
    return ranking.top(long, ["instance"], ranking.by_sum("total", serial), ["from_pos"], k).drop("from_pos")


def top_content(tokens: DataFrame, texts: DataFrame, docs: DataFrame, section: Column, k: int = 10, serial: bool = False) -> dict[str, DataFrame]:
    """What holds an instance's attention: its top runs, its k documents by total score, and its sections.

    tokens: instance, pos, beg, end, score; texts: instance, text; docs: spans; serial: see gold_scores().
    """
    stats = spans.document_stats(tokens, docs, serial=serial)
    return {"runs": top_runs(tokens, texts, k, serial=serial), "documents": ranking.top(stats, ["instance"], ranking.by_sum("total", serial), ["span_idx"], k), "sections": spans.sections(tokens, section)}


def within_limit(prompts: DataFrame, tokens: str = "n_tokens", most: int = 64_000) -> DataFrame:
    """Prompts that are not too long to analyse."""
    return prompts.where(F.col(tokens) <= most)


def with_contexts(rows: DataFrame) -> DataFrame:
    """Rows that have documents; the others are left out before anything is counted."""
    return rows.where(F.size("ctxs") > 0)
