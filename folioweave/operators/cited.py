"""Metrics of cited answers. Verdicts of the entailment model come as a table."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from folioweave.functions import offsets
from folioweave.functions import overlap as O
from folioweave.functions import text as T


def string_match(output: Column, answer_sets: Column) -> Column:
    """struct<em, hit>: share of the answer sets with a member in the output, and whether all have."""
    found = T.let(T.normalize_answer(output), lambda o: F.transform(answer_sets, lambda s: F.exists(s, lambda a: F.contains(o, T.normalize_answer(a))).cast("double")))
    em = O.ratio(F.aggregate(found, F.lit(0.0), lambda s, x: s + x), F.size(found))
    return F.struct(em.alias("em"), (em == 1.0).cast("double").alias("hit"))


def after_colon(output: Column) -> Column:
    """What follows the first colon, empty without one."""
    at = F.instr(output, ":")
    return F.when(at > 0, F.substr(output, at + 1, F.greatest(F.length(output), F.lit(1)))).otherwise("")


def list_scores(output: Column, groups: Column) -> Column:
    """struct<precision, recall, recall_top5, f1, f1_top5> of a comma list against groups of aliases."""
    trimmed = F.rtrim(F.rtrim(F.trim(output), F.lit(".")), F.lit(","))
    said = F.filter(F.transform(F.split(trimmed, ",", -1), T.normalize_answer), lambda x: x != "")
    gold = F.transform(groups, lambda g: F.transform(g, T.normalize_answer))
    five = lambda c: F.least(F.lit(5), c)

    def counts(x: Column, g: Column) -> Column:
        right = T.let(F.flatten(g), lambda every: F.size(F.filter(x, lambda w: F.array_contains(every, w))))
        got = F.size(F.filter(g, lambda aliases: F.arrays_overlap(aliases, x)))
        return F.struct(right.alias("right"), F.size(x).alias("said"), got.alias("got"), F.size(g).alias("n"))

    def shares(c: Column) -> Column:
        return F.struct(O.ratio(c["right"], c["said"]).alias("p"), O.ratio(c["got"], c["n"]).alias("r"), O.ratio(five(c["got"]), five(c["n"])).alias("r5"))

    def scores(c: Column) -> Column:
        p, r, r5 = c["p"], c["r"], c["r5"]
        return F.struct(p.alias("precision"), r.alias("recall"), r5.alias("recall_top5"), O.f1_of(p, r).alias("f1"), O.f1_of(p, r5).alias("f1_top5"))

    # each list is normalised once, not once for every element of the other
    return T.let(said, lambda x: T.let(gold, lambda g: T.let(T.let(counts(x, g), shares), scores)))


def citation_scores(sentences: DataFrame, verdicts: DataFrame, n_docs: str = "n_docs", most: int = 3) -> DataFrame:
    """item_id, citation_recall, citation_precision.

    sentences: item_id, sent_id, refs (array of document numbers), n_docs. verdicts: item_id, sent_id, refs (sorted,
    joined by commas), verdict 0/1, for the joint set, each reference alone, and the set without it. A sentence without
    references, or with one out of range, is not supported; only the first `most` references count. Precision: in a
    supported sentence of several, a reference counts if it alone supports or its removal breaks support; a single one
    counts as the joint verdict.
    """
    key = lambda a: F.concat_ws(",", F.transform(F.array_sort(a), lambda r: r.cast("string")))
    used, known = F.col("used"), F.col("_v")
    said = lambda k: F.coalesce(F.get(F.filter(known, lambda v: v["refs"] == k), 0)["verdict"], F.lit(0))
    useful = lambda r: (said(r.cast("string")) == 1) | (said(key(F.array_remove(used, r))) == 0)
    valid = (F.size("used") > 0) & ~F.exists("refs", lambda r: (r < 0) | (r >= F.col(n_docs)))
    # a sentence's few verdicts meet it once, and are looked up in its row
    held = verdicts.groupBy("item_id", "sent_id").agg(F.collect_list(F.struct("refs", "verdict")).alias("_v"))
    s = sentences.withColumn("used", F.slice("refs", 1, most)).withColumn("ok", valid).join(held, ["item_id", "sent_id"], "left")
    s = s.withColumn("joint", F.when(F.col("ok"), said(key(used))).otherwise(0))
    several = F.col("ok") & (F.col("joint") == 1) & (F.size("used") > 1)
    good = F.when(several, F.size(F.filter(used, useful))).when(F.col("ok"), F.col("joint")).otherwise(0)
    s = s.select("item_id", "joint", good.alias("good"), F.when(F.col("ok"), F.size("used")).otherwise(0).alias("t"))
    sums = s.groupBy("item_id").agg(F.avg("joint").alias("citation_recall"), F.sum("good").alias("g"), F.sum("t").alias("t"))
    return sums.select("item_id", "citation_recall", F.when(F.col("t") > 0, F.col("g") / F.col("t")).otherwise(0.0).alias("citation_precision"))


def citation_positions(outputs: DataFrame) -> DataFrame:
    """ref, n: how often each document number is cited."""
    return outputs.select(F.explode(T.citation_refs(F.col("output"))).alias("ref")).groupBy("ref").agg(F.count("*").alias("n"))


def extractive_scores(answers: DataFrame) -> DataFrame:
    """item_id, qa_em, qa_f1, qa_hit (percent) from item_id, predictions and short_answers (array per question)."""
    pairs = F.arrays_zip(F.col("predictions").alias("p"), F.col("short_answers").alias("a"))
    best = lambda metric: F.transform(pairs, lambda z: F.array_max(F.transform(z["a"], lambda t: metric(z["p"], t))))
    em, f1 = best(lambda p, t: O.exact_match(p, t).cast("double")), best(O.no_answer_f1)
    mean = lambda a: O.ratio(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a)) * 100
    return answers.select("item_id", mean(em).alias("qa_em"), mean(f1).alias("qa_f1"), (F.forall(em, lambda x: x == 1.0).cast("double") * 100).alias("qa_hit"))


# Modulus, power and steps of the resampling hash; the power is a permutation modulo that prime.
PRIME, POWER, SLOPE, SHIFT = (1 << 31) - 1, 5, 48_271, 69_621


def poisson_steps() -> list[int]:
    """Hash values from which a row is drawn once, twice and so on: Poisson(1), as far as 31 bits tell apart."""
    steps, below, term = [], 0.0, math.exp(-1)
    while (step := math.ceil((below := below + term) * PRIME)) < PRIME:
        steps.append(step)
        term /= len(steps)
    return steps


def _round_terms(rounds: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    return 1 + SLOPE * (rounds + 7_919 * seed) % (PRIME - 1), SHIFT * (rounds + 104_729 * seed) % PRIME


def _draws(hashes: np.ndarray, rounds: np.ndarray, seed: int) -> np.ndarray:
    """How often each row (hash below 2^28) is drawn in each round."""
    a, b = _round_terms(rounds, seed)
    x = (hashes[:, None] * a + b) % PRIME
    square = x * x % PRIME
    return np.searchsorted(poisson_steps(), square * square % PRIME * x % PRIME, "right")


def draws(key: str, r: int, seed: int) -> int:
    """How often the row of that key is drawn in round r."""
    return int(_draws(np.array([int(hashlib.md5(key.encode()).hexdigest()[:7], 16)]), np.array([r]), seed)[0, 0])


def bootstrap_mean(rows: DataFrame, column: str, by: str, keys: list[str], rounds: int = 1000, seed: int = 1) -> DataFrame:
    """by, mid: the median of means of `rounds` resamples. keys: columns that tell rows apart.

    Resampling is by Poisson weights from a hash of a row's keys and the round, so the rows of a group stay where they are
    and reruns agree. A task adds up each group's weighted values and weights by round; rows are not copied for rounds, and
    sums meet by group and round. Rounds that draw nothing have no mean. Null values do not count.
    """
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in keys])
    source = rows.where(F.col(column).isNotNull()).select(by, F.col(column).cast("double").alias("_v"), F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long").alias("_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(1, rounds + 1)
        sums: dict = {}

        def out() -> pa.RecordBatch:
            groups = pa.array(list(sums), pa_type)
            totals, weights = (pa.array([x[k].tolist() for x in sums.values()], pa.list_(t)) for k, t in ((0, pa.float64()), (1, pa.int64())))
            sums.clear()
            return pa.RecordBatch.from_arrays([groups, totals, weights], names=[by, "totals", "weights"])

        pa_type = None
        for batch in batches:
            pa_type = batch.column(by).type
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = _draws(np.asarray(part.column("_h")), every, seed)
                coded = part.column(by).dictionary_encode()
                codes = np.asarray(coded.indices.fill_null(len(coded.dictionary)))
                for c in np.unique(codes).tolist():
                    group = coded.dictionary[c].as_py() if c < len(coded.dictionary) else None
                    mine = codes == c
                    total, weight = sums.setdefault(group, [np.zeros(rounds), np.zeros(rounds, np.int64)])
                    total += np.asarray(part.column("_v"))[mine] @ n[mine]
                    weight += n[mine].sum(0)
                if len(sums) > 1024:
                    yield out()
        if sums:
            yield out()

    like = StructType([rows.schema[by], StructField("totals", ArrayType(DoubleType())), StructField("weights", ArrayType(LongType()))])
    parts = source.mapInArrow(run, like).select(by, F.posexplode(F.arrays_zip("totals", "weights")).alias("r", "s"))
    means = parts.groupBy(by, "r").agg((F.sum("s.totals") / F.nullif(F.sum("s.weights"), F.lit(0))).alias("m"))
    return means.groupBy(by).agg(F.percentile("m", F.lit(0.5)).alias("mid"))


def mean_length(outputs: DataFrame, column: str, by: list[str]) -> DataFrame:
    """by, words: the mean number of words of the outputs; null ones have none."""
    return outputs.groupBy(*by).agg(F.avg(T.word_count(F.col(column))).alias("words"))


def claim_recall(verdicts: DataFrame) -> DataFrame:
    """item_id, claim_recall (percent) from a verdict 0/1 per claim."""
    return verdicts.groupBy("item_id").agg((F.avg("verdict") * 100).alias("claim_recall"))


def long_sentences(output: Column, least: int = 5) -> Column:
    """The output's sentences of `least` characters or more."""
    return F.filter(F.transform(offsets.sentences(output), lambda s: s["text"]), lambda t: F.length(t) >= least)
