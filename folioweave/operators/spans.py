"""Token scores over spans of a text: interval joins, sums, runs, sinks, steps.

Tokens: instance, pos (start relative to the context), score, and step or layer where named. Spans: instance, span_idx,
start, end, text, half-open. Joins have the instance as an equal key, and a bucket of positions so that one instance
with many tokens spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.operators.ranking import by_sum, serial_sum, settled
from folioweave.operators.selection import quantile

#: Positions of a bucket of the interval joins.
BUCKET = 4096


def layer_mean(scores: DataFrame, strategy: str = "all_layers", layers: list[int] | None = None, last: int = 1) -> DataFrame:
    """instance, pos, score: the mean over the layers that the strategy picks (last_layer, specific_layer, all_layers, last_n)."""
    most = scores.groupBy("instance").agg(F.max("layer").alias("_most"))
    if strategy == "all_layers":
        used = scores
    elif strategy == "specific_layer":
        used = scores.where(F.col("layer").isin(*(layers or [])))
    elif strategy in ("last_layer", "last_n"):
        n = 1 if strategy == "last_layer" else last
        used = scores.join(most, "instance").where(F.col("layer") > F.col("_most") - n)
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return used.groupBy("instance", "pos").agg(F.avg("score").alias("score"))


def head_mean(probabilities: DataFrame) -> DataFrame:
    """instance, layer, pos, score from instance, layer, head, query, pos, p: summed over queries, mean over heads."""
    return probabilities.groupBy("instance", "layer", "pos").agg((F.sum("p") / F.count_distinct("head")).alias("score"))


def _joined(tokens: DataFrame, spans: DataFrame, bucket: int) -> DataFrame:
    """tokens with the spans whose _from <= pos < _to; of equally named columns the tokens' stay."""
    first, last = F.floor(F.col("_from") / bucket), F.floor((F.col("_to") - 1) / bucket)
    new = [c for c in spans.columns if c == "instance" or c not in tokens.columns]
    held = spans.where("_to > _from").select(*new, F.explode(F.sequence(first, last)).alias("_b"))
    at = tokens.withColumn("_b", F.floor(F.col("pos") / bucket))
    return at.join(held, ["instance", "_b"]).where("pos >= _from AND pos < _to").drop("_from", "_to", "_b")


def to_next_span(tokens: DataFrame, spans: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """tokens with the first span that ends after them: a token in a gap goes to the next span, past the end to none."""
    before = F.coalesce(F.max("end").over(Window.partitionBy("instance").orderBy("span_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _joined(tokens, spans.withColumns({"_from": before, "_to": F.col("end")}), bucket)


def to_span(tokens: DataFrame, spans: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """tokens with the spans that hold them."""
    return _joined(tokens, spans.withColumns({"_from": F.col("start"), "_to": F.col("end")}), bucket)


def summed(rows: DataFrame, group: list[str], value: str, order: str, serial: bool) -> tuple[DataFrame, Column]:
    """rows, and the aggregate that gives a group's sum; serial: added in the order given, for which a group meets in one task."""
    if not serial:
        return rows, F.sum(value)
    return rows.withColumn("_sum", serial_sum(value, group, [order])), F.first("_sum")


def score_by_text(tokens: DataFrame, spans: DataFrame, serial: bool = False) -> DataFrame:
    """instance, text, score, first: sums per span text (equal texts merge); first is the first token's position."""
    rows, score = summed(to_next_span(tokens, spans), ["instance", "text"], "score", "pos", serial)
    return rows.groupBy("instance", "text").agg(score.alias("score"), F.min("pos").alias("first"))


def document_stats(tokens: DataFrame, docs: DataFrame, group: list[str] | None = None, preview: int = 200, serial: bool = False) -> DataFrame:
    """group, span_idx, total, mean, n_tokens, preview of each document that has tokens."""
    group = group or ["instance"]
    rows, total = summed(to_span(tokens, docs), [*group, "span_idx"], "score", "pos", serial)
    return rows.groupBy(*group, "span_idx").agg(
        total.alias("total"), F.avg("score").alias("mean"), F.count("*").alias("n_tokens"), F.first(F.substring("text", 1, preview)).alias("preview")
    )


def percent_of(part: Column, whole: Column, plain: bool = False) -> Column:
    """part in percent of whole. Of a whole that is not above 0 it is 0; plain: what plain division gives, so 0 / 0 is NaN."""
    if plain:
        return F.when(whole != 0, part / whole).when(whole == 0, part * float("inf")) * 100
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def sections(tokens: DataFrame, section: Column, names: tuple[str, ...] = ("prompt", "context", "other"), group: list[str] | None = None, plain: bool = False) -> DataFrame:
    """group, section, total, percent, n_tokens, mean: a row for every name, also those without tokens. plain: see percent_of()."""
    group = group or ["instance"]
    marked = tokens.withColumn("_s", section)
    sums = marked.groupBy(*group).agg(
        F.sum("score").alias("_all"),
        *[F.coalesce(F.sum(F.when(F.col("_s") == n, F.col("score"))), F.lit(0.0)).alias(f"_t{i}") for i, n in enumerate(names)],
        *[F.count_if(F.col("_s") == n).alias(f"_n{i}") for i, n in enumerate(names)],
    )
    rows = F.array(*[F.struct(F.lit(n).alias("section"), F.col(f"_t{i}").alias("total"), F.col(f"_n{i}").alias("n_tokens")) for i, n in enumerate(names)])
    flat = sums.select(*group, "_all", F.inline(rows))
    return flat.select(
        *group, "section", "total", percent_of(F.col("total"), F.col("_all"), plain).alias("percent"), "n_tokens",
        F.when(F.col("n_tokens") > 0, F.col("total") / F.col("n_tokens")).otherwise(0.0).alias("mean"),
    )


def high_runs(tokens: DataFrame, share: float = 0.9, least: int = 3, block: int = BUCKET, serial: bool = False) -> DataFrame:
    """instance, from_pos, to_pos, n_tokens, total: runs of `least` or more positions above the instance's percentile.

    Runs are found in blocks of positions, so an instance's tokens spread over tasks; only runs that touch the edge of a
    block, two of each block at most, meet by instance to be joined to those of the blocks beside it. serial: a block's part
    of a run is added by position.
    """
    limits = quantile(tokens, ["instance"], "score", share).withColumnRenamed("quantile", "_limit")
    high = tokens.join(limits, "instance").where("score > _limit").withColumn("_b", F.floor(F.col("pos") / block))
    island = F.col("pos") - F.row_number().over(Window.partitionBy("instance", "_b").orderBy("pos"))
    sums = (F.min("from_pos").alias("from_pos"), F.max("to_pos").alias("to_pos"), F.sum("n_tokens").alias("n_tokens"), F.sum("total").alias("total"))
    high, total = summed(high.withColumn("_i", island), ["instance", "_b", "_i"], "score", "pos", serial)
    parts = high.groupBy("instance", "_b", "_i").agg(
        F.min("pos").alias("from_pos"), F.max("pos").alias("to_pos"), F.count("*").alias("n_tokens"), total.alias("total")
    ).drop("_b", "_i")
    at_edge = (F.pmod("from_pos", F.lit(block)) == 0) | (F.pmod(F.col("to_pos") + 1, F.lit(block)) == 0)
    by = Window.partitionBy("instance").orderBy("from_pos")
    starts = F.coalesce((F.col("from_pos") != F.lag("to_pos").over(by) + 1).cast("int"), F.lit(1))
    edges = parts.where(at_edge).withColumn("_new", starts).withColumn("_run", F.sum("_new").over(by))
    runs = parts.where(~at_edge).unionByName(edges.groupBy("instance", "_run").agg(*sums).drop("_run"))
    return runs.where(F.col("n_tokens") >= least)


def mark_sinks(tokens: DataFrame, context_start: Column | int, most_position: int = 1000, percent: float = 5.0, group: list[str] | None = None, plain: bool = False, serial: bool = False) -> DataFrame:
    """tokens with pct (share of the group's score) and is_sink: early, before the context, and of that percent or more.

    plain: see percent_of(); NaN counts as more than any percent. serial: the group's score is added by position, for which its
    tokens meet in one task, and pct is compared as it comes out; else a token of exactly the percentage is a sink.
    """
    group = group or ["instance"]
    # unless serial, sums combine before they are shuffled and are joined back, so a group's tokens need not meet in one task
    totals = tokens.groupBy(*group).agg(F.sum("score").alias("_total"))
    of = tokens.withColumn("_total", serial_sum("score", group, ["pos"])) if serial else tokens.join(totals, group)
    pct = percent_of(F.col("score"), F.col("_total"), plain)
    start = F.lit(context_start) if isinstance(context_start, int) else context_start
    return of.withColumn("pct", pct).drop("_total").withColumn("is_sink", (F.col("pos") >= 0) & (F.col("pos") <= most_position) & (F.col("pos") < start) & (by_sum("pct", serial) >= percent))


def rescale_without_sinks(marked: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Sinks at 0, the others scaled to the old total; unchanged without sinks or if nothing else has a score."""
    group = group or ["instance"]
    sums = marked.groupBy(*group).agg(F.sum("score").alias("_total"), F.sum(F.when(~F.col("is_sink"), F.col("score"))).alias("_rest"), F.bool_or("is_sink").alias("_any"))
    kept = F.when(F.col("is_sink"), 0.0).otherwise(F.col("score") * F.col("_total") / F.col("_rest"))
    scaled = F.when(F.col("_any") & (F.col("_rest") > 0), kept).otherwise(F.col("score"))
    return marked.join(sums, group).withColumn("score", scaled).drop("_total", "_rest", "_any")


def sink_summary(marked: DataFrame, k: int = 10) -> DataFrame:
    """instance, token, n, rank: the k tokens that are sinks most often."""
    n = marked.where("is_sink").groupBy("instance", "token").agg(F.count("*").alias("n"))
    by = Window.partitionBy("instance").orderBy(F.desc("n"), "token")
    return n.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def gold_by_step(tokens: DataFrame, gold: DataFrame) -> DataFrame:
    """instance, step, span_idx, absolute, relative (percent of the step's gold score), n_tokens, coverage (percent of all)."""
    of = to_span(tokens, gold).groupBy("instance", "step", "span_idx").agg(F.sum("score").alias("absolute"), F.count("*").alias("n_tokens"))
    whole = tokens.groupBy("instance", "step").agg(F.sum("score").alias("_all"))
    part = F.sum("absolute").over(Window.partitionBy("instance", "step"))
    return of.join(whole, ["instance", "step"]).select(
        "instance", "step", "span_idx", "absolute", percent_of(F.col("absolute"), part).alias("relative"), "n_tokens", percent_of(F.col("absolute"), F.col("_all")).alias("coverage")
    )


def mean_over_steps(by_step: DataFrame, steps: DataFrame) -> DataFrame:
    """instance, span_idx, absolute, relative, presence: sums over the instance's number of steps; absent steps count 0."""
    n = steps.groupBy("instance").agg(F.count_distinct("step").alias("_n"))
    sums = by_step.groupBy("instance", "span_idx").agg(F.sum("absolute").alias("a"), F.sum("relative").alias("r"), F.count("*").alias("p"))
    return sums.join(n, "instance").select("instance", "span_idx", (F.col("a") / F.col("_n")).alias("absolute"), (F.col("r") / F.col("_n")).alias("relative"), (F.col("p") / F.col("_n")).alias("presence"))


def roll_up_sections(by_step: DataFrame) -> DataFrame:
    """section, percent: means over each instance's steps, then over instances."""
    one = by_step.groupBy("instance", "section").agg(F.avg("percent").alias("percent"))
    return one.groupBy("section").agg(F.avg("percent").alias("percent"))


def sink_rollup(marked: DataFrame) -> DataFrame:
    """instance, steps, sinks, sinks_per_step, percent, presence: sinks in all, a step's mean count, mean percent of the score
    that they hold, and the share of steps that have one. marked: mark_sinks() by instance and step."""
    one = marked.groupBy("instance", "step").agg(F.count_if("is_sink").alias("n"), F.coalesce(F.sum(F.when(F.col("is_sink"), F.col("pct"))), F.lit(0.0)).alias("p"))
    return one.groupBy("instance").agg(
        F.count("*").alias("steps"), F.sum("n").alias("sinks"), F.avg("n").alias("sinks_per_step"), F.avg("p").alias("percent"), F.avg((F.col("n") > 0).cast("int")).alias("presence")
    )


def document_rollup(by_step: DataFrame, steps: DataFrame, k: int = 10, serial: bool = False) -> DataFrame:
    """instance, span_idx, average, appearance, rank: the k documents with the largest sums over steps; absent steps count 0.

    by_step: instance, step, span_idx, total (document_stats by instance and step); steps: instance, step of all steps.
    serial: steps are added in their order, and sums ranked as they come out; else equal sums tie.
    """
    n = steps.groupBy("instance").agg(F.count_distinct("step").alias("_n"))
    by_step, total = summed(by_step, ["instance", "span_idx"], "total", "step", serial)
    sums = by_step.groupBy("instance", "span_idx").agg(total.alias("t"), F.count("*").alias("a"))
    rank = F.row_number().over(Window.partitionBy("instance").orderBy(by_sum("t", serial).desc(), "span_idx"))
    best = sums.withColumn("rank", rank).where(F.col("rank") <= k).join(n, "instance")
    return best.select("instance", "span_idx", (F.col("t") / F.col("_n")).alias("average"), (F.col("a") / F.col("_n")).alias("appearance"), "rank")


def roll_up_documents(rolled: DataFrame, k: int = 10, decimals: int | None = None) -> DataFrame:
    """span_idx, average, instances: the k documents with the largest mean over the instances that have them.

    decimals: means that are equal to so many of them tie.
    """
    means = rolled.groupBy("span_idx").agg(F.avg("average").alias("average"), F.count("*").alias("instances"))
    by = settled(F.col("average")) if decimals is None else F.round("average", decimals)
    return means.orderBy(by.desc(), "span_idx").limit(k)


def chunk_bounds(chunks: DataFrame, separator: int = 1) -> DataFrame:
    """Spans of chunks (instance, span_idx, text) joined by a separator of so many characters."""
    before = F.coalesce(F.sum(F.length("text") + separator).over(Window.partitionBy("instance").orderBy("span_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.withColumn("start", before).withColumn("end", F.col("start") + F.length("text"))


def locate(prompt: Column, context: Column) -> Column:
    """Where the context starts in the prompt; an error if it does not stand there."""
    at = F.instr(prompt, context)
    return F.when(at > 0, at - 1).otherwise(F.raise_error("the context is not in the prompt").cast("int"))


def mean_overlap(overlaps: DataFrame, instances: int | Column) -> Column:
    """Sum of overlaps over the number of instances, those without an overlap included."""
    n = F.lit(instances) if isinstance(instances, int) else instances
    return F.sum("overlap") / n
