"""URL verdicts: fixed rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.shared import byte_view, pieces
from folioweave.llm.words import lower

#: Labelled URLs (about, half of each label at most) that the model is fitted on; hash buckets of its features; lengths of its n-grams.
LABELLED, BUCKETS, GRAMS = 4_000, 1 << 15, (2, 3, 4)
Rule = tuple[str, str, str]  # verdict, host, path

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if null or without ://."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: str) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule as host and path together, its verdict) of the longest rule that fits, or nulls."""
    name = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the n-grams of hosts and paths; a row's values have about unit length."""
    rows, buckets = [], []
    n = len(hosts)
    for part, column in enumerate((hosts, paths)):
        data, offsets = byte_view(column)
        # edges count: a mark stands before and after each text
        owner = np.repeat(np.arange(n), np.diff(offsets))
        where = np.arange(len(data)) + 1 + 2 * owner
        marked = np.ones(len(data) + 2 * n, np.uint64)
        marked[where] = lower(data).astype(np.uint64) + np.uint64(2)
        owner = np.repeat(np.arange(n), np.diff(offsets) + 2)
        for size in GRAMS:
            span = max(0, len(marked) - size + 1)
            code = np.full(span, 7 * part + size, np.uint64)
            for k in range(size):
                code = code * np.uint64(0x100000001B3) + marked[k : k + span]
            code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
            whole = owner[:span] == owner[size - 1 : size - 1 + span]
            rows.append(owner[:span][whole])
            buckets.append(code[whole].astype(np.int64))
    row, bucket = np.concatenate(rows), np.concatenate(buckets)
    total = np.bincount(row, minlength=n)
    return row, bucket, 1.0 / np.sqrt(np.maximum(total, 1))[row]


def _sums(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, value, n)


def fit(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, rounds: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression by Nesterov's method; classes weigh alike."""
    row, bucket, value = x
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w = v = np.zeros(BUCKETS + 1)
    for k in range(rounds):
        z = _sums(row, v[bucket] * value, len(y)) + v[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(bucket, g[row] * value, BUCKETS), g.sum()) + decay * v
        new = v - 2.0 * grad
        w, v = new, new + k / (k + 3) * (new - w)
    return w


def train(labelled: DataFrame, bound: int = LABELLED) -> np.ndarray | None:
    """Weights from rows (url, label: block or allow), of each label about half of `bound` drawn by hash; None unless both are there."""
    known = labelled.where("url IS NOT NULL AND label IN ('block', 'allow')").select("url", "label").distinct()
    shares = {r.label: min(1.0, bound / 2 / r["count"]) for r in known.groupBy("label").count().collect()}
    if len(shares) < 2:
        return None
    most = F.lit(0)
    for label, share in shares.items():
        most = F.when(F.col("label") == label, int(share * (1 << 30))).otherwise(most)
    drawn = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < most)
    rows = sorted((r.host, r.path, r.label) for r in drawn.select(host_of("url").alias("host"), path_of("url").alias("path"), "label").collect())
    if len({r[2] for r in rows}) < 2:
        return None
    x = features(pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]))
    return fit(x, np.array([r[2] == "block" for r in rows], float))


def judge(pages: DataFrame, rules: list[Rule], weights: np.ndarray | None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep, host, path, rule, verdict (allow or block), score (the model's probability of block).

    The longest rule that fits decides; else the model, which allows at a score of 0.5 or less. Without a model the
    score is 0. A null url, or one without ://, has an empty host and path and is judged by the model like any other.
    """
    named = pages.select(*keep, host_of("url").alias("host"), path_of("url").alias("path"))
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in pieces(batches, "path", 1 << 18):
            score = np.zeros(batch.num_rows)
            if w is not None:
                row, bucket, value = features(batch.column("host"), batch.column("path"))
                score = 1 / (1 + np.exp(-np.clip(_sums(row, w[bucket] * value, batch.num_rows) + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    scored = named.mapInArrow(run, named.withColumn("score", F.lit(0.0)).schema)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    model = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select(*keep, "host", "path", rule.alias("rule"), F.coalesce(verdict, model).alias("verdict"), "score")


def labelled_by_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(url, label) of the pages that a rule decides: a labelled table where no other is at hand."""
    rule, verdict = matching_rule(host_of("url"), path_of("url"), rules)
    return pages.select("url", verdict.alias("label")).where("label IS NOT NULL")
