"""Samples, splits and shuffles that are the same on every run: rows go by an md5 of seed and key, never by a random state."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in order; all for -1."""
    return rows if n < 0 else rows.orderBy(*order).limit(n)


def _upto(rows: DataFrame, key: str, n: int, seed: int) -> Column:
    """The condition that holds for the n rows that come first by place, ties by key; keys are unique.

    Rows are counted by the first digits of their place, then those of the boundary bucket by more digits, until the
    bucket is small enough to sort: neither the rows nor their keys are sorted as a whole.
    """
    if n <= 0:
        return F.lit(False)
    slim = rows.select(place(F.col(key), seed).alias("p"), F.col(key).alias("k"))
    known, left = "", n
    while len(known) < 32:
        digits = len(known) + 3
        counts = slim.where(F.col("p").startswith(known)).groupBy(F.substring("p", 1, digits).alias("b")).count().collect()
        for b, c in sorted(map(tuple, counts)):
            if left <= c:
                break
            left -= c
        known = b
        if c <= 100_000:
            break
    edge = slim.where(F.col("p").startswith(known)).orderBy("p", "k").limit(left).agg(F.max(F.struct("p", "k")).alias("m")).first().m
    at = place(F.col(key), seed)
    return (at < edge.p) | ((at == edge.p) & (F.col(key) <= edge.k))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement by a unique key; an error if there are fewer."""
    have = rows.count()
    if n > have:
        raise ValueError(f"{n} rows asked for, {have} there")
    return rows.where(_upto(rows, key, n, seed))


def sample_keys(rows: DataFrame, key: str, n: int = 100, seed: int = 42) -> DataFrame:
    """All rows of n of the distinct keys (of all, if fewer)."""
    keys = rows.select(key).distinct()
    return rows if keys.count() <= n else rows.where(_upto(keys, key, n, seed))


def split(rows: DataFrame, key: str, test: float = 0.05, seed: int = 42) -> DataFrame:
    """rows with split: `test` for the first ceil(test * n) by place, `train` for the others. No row is moved."""
    n = ceil(test * rows.count() - 1e-9)
    return rows.withColumn("split", F.when(_upto(rows, key, n, seed), "test").otherwise("train"))


def shuffled(items: Column, key: Column, seed: int = 42) -> Column:
    """An array in an order that its key and positions decide."""
    tagged = F.transform(items, lambda x, i: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), i.cast("string")).cast("binary")).alias("p"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda t: t["x"])
