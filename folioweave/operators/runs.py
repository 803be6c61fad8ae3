"""Scores of runs: accuracy on shared instances, means by bin, and tables over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Context labels by number of documents, and result kinds in order of precedence.
CONTEXT_LABELS = {20: "4k", 50: "8k", 105: "16k", 220: "32k", 440: "64k", 1000: "128k"}
PRECEDENCE = ("doc_ids", "quote", "doc_ids_and_content")


def last_wins(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row per key: the one of the largest ordinal."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("_r")).select(*keys, "_r.*")


def on_shared_instances(rows: DataFrame) -> DataFrame:
    """rows (run, run_ord, id, ..) of the ids that the smallest run has; of equally small runs, the first."""
    sizes = rows.groupBy("run", "run_ord").agg(F.count_distinct("id").alias("n"))
    least = sizes.agg(F.min_by("run", F.struct("n", "run_ord")).alias("run"))
    ids = rows.join(F.broadcast(least), "run", "left_semi").select("id").distinct()  # one row
    return rows.join(ids, "id", "left_semi")


def accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, total, correct, missing, accuracy (percent) from gold and pred; a null pred is missing."""
    right = F.col("pred").isNotNull() & (F.col("pred") == F.col("gold"))
    sums = rows.groupBy(*by) if by else rows.groupBy()
    out = sums.agg(F.count("*").alias("total"), F.count_if(right).alias("correct"), F.count_if(F.col("pred").isNull()).alias("missing"))
    return out.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") * 100.0 / F.col("total")).otherwise(0.0))


def in_bins(rows: DataFrame, length: str, bins: DataFrame) -> DataFrame:
    """rows with lo and hi of each closed bin that holds their length; edges may belong to two bins, gaps to none.

    bins has a handful of rows that the caller states, so it is sent to every task.
    """
    return rows.join(F.broadcast(bins), F.col(length).between(F.col("lo"), F.col("hi")))


def task_means(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean score per group; yes and no count 1 and 0."""
    return scores.groupBy(*by).agg(F.avg(F.col("score").cast("double")).alias("score"))


def percent_means(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row: the mean of each score times 100, over the rows that have it."""
    return rows.agg(*[(F.avg(F.col(n).cast("double")) * 100).alias(n) for n in names])


def describe_run(path: Column) -> dict[str, Column]:
    """model, modality, lo, hi and curve of a metrics file, from its path."""
    name = F.regexp_extract(path, r"([^/]+)\.json$", 1)
    k = F.nullif(F.regexp_extract(name, r"rag_(\d+)", 1), F.lit("")).cast("long")
    bound = lambda g: F.nullif(F.regexp_extract(name, r"_(\d+)_(\d+)$", g), F.lit("")).cast("long")
    return {
        "model": F.regexp_extract(path, r"([^/]+)/[^/]+\.json$", 1), "lo": bound(1), "hi": bound(2),
        "curve": F.when(k.isNotNull(), F.concat(F.lit("rag_"), F.floor(k / 1000).cast("string"), F.lit("k"))).when(name.contains("rag"), "rag").otherwise("fc"),
    }


def run_table(runs: DataFrame, bins: list[int]) -> DataFrame:
    """model, a column per upper bound, mean: the unweighted mean over bins."""
    wide = runs.groupBy("model").pivot("hi", bins).agg(F.avg("value"))
    mean = runs.groupBy("model", "hi").agg(F.avg("value").alias("v")).groupBy("model").agg(F.avg("v").alias("mean"))
    return wide.join(mean, "model")


def context_table(runs: DataFrame) -> DataFrame:
    """benchmark, model, label, value from runs with kind and docs: of several kinds the first by precedence counts."""
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("kind"))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in CONTEXT_LABELS.items() for x in kv]), F.col("docs"))
    by = Window.partitionBy("benchmark", "model", "docs", "dataset").orderBy(rank)
    best = runs.where(rank > 0).withColumn("_k", F.row_number().over(by)).where("_k = 1")
    return best.withColumn("label", label).groupBy("benchmark", "model", "label").agg(F.avg("value").alias("value"))
