"""Nearest neighbours by largest inner product: collision counting over sorted single projections."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erf, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.llm.shared import SharedTables

#: Projections; vectors of a block of the index; queries that a task holds at once.
PROJECTIONS, BLOCK, QUERIES = 64, 16_384, 4_096
#: Half-width of a window per unit of distance; how surely a vector within that distance passes the threshold, in
#: standard deviations of its collision count; growth of the distance from one virtual rehashing to the next.
WIDTH, SURE, GROW = 0.7, 1.7, 1.04
#: Bytes of query vectors sent to a task at once; with longer vectors fewer queries go at a time.
QUERY_BYTES = 8 << 20


def usable(vector: str) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def directions(dim: int, count: int = PROJECTIONS, seed: int = 11) -> np.ndarray:
    """(dim, count): unit vectors, orthogonal in runs of dim, so that few of them see most of a distance."""
    rnd = np.random.default_rng(seed)
    parts = []
    while sum(p.shape[1] for p in parts) < count:
        q, r = np.linalg.qr(rnd.normal(size=(dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
    return np.hstack(parts)[:, :count]


def threshold(count: int, dim: int, reach: float = WIDTH, sure: float = SURE) -> int:
    """Collisions that a vector at the target distance reaches but for `sure` standard deviations.

    A projection of a difference of length D is about normal with deviation D / sqrt(dim); it collides within
    reach * D / sqrt(dim). Projections of one orthogonal run share the length, which makes their counts steadier.
    """
    p = erf(reach / sqrt(2))
    density = np.exp(-reach * reach / 2) / sqrt(2 * np.pi)
    spread = p * (1 - p) - (2 * reach * density) ** 2 / 2
    return int(np.floor(count * p - sure * sqrt(count * max(spread, 0.01))))


class Block:
    """Some vectors, lengthened to equal norms, and the sorted array of each of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float):
        self.ids, self.vectors, self.largest = ids, vectors, largest
        share = vectors / largest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (share**2).sum(1)))
        self.long = np.hstack([share, rest[:, None]])
        self.probe = self.long[:: max(1, len(ids) // 256)]
        self.a = directions(self.long.shape[1])
        projected = self.long @ self.a
        self.order = np.argsort(projected, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order.T, axis=0).T.copy()

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, inner products) of the k best rows found, other than those with the query's own id.

        Windows around the query's projections widen from one target distance to the next. A row that falls in
        `threshold` of them is verified. Once k verified rows are within the target distance, the rows that are nearer
        than the k-th have had their chance and the search ends; when the windows hold everything, all are verified.
        """
        n, dim = self.long.shape
        norm = max(float(np.linalg.norm(query)), 1e-300)
        q = np.append(query / norm, 0.0)
        centre = q @ self.a
        need = threshold(self.a.shape[1], dim)
        other = self.ids != own
        most = min(k, int(other.sum()))
        counts = np.zeros(n, np.int64)
        left = other.copy()
        low = [int(s.searchsorted(c)) for s, c in zip(self.sorted, centre, strict=True)]
        high = low.copy()
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        target = self.first_target(q, most / max(1, n))
        while most:
            half = WIDTH * target / sqrt(dim)
            fresh = []
            for j, c in enumerate(centre.tolist()):
                a, b = self.sorted[j].searchsorted((c - half, c + half))
                fresh.append(self.order[j, a : low[j]])
                fresh.append(self.order[j, high[j] : b])
                low[j], high[j] = min(int(a), low[j]), max(int(b), high[j])
            counts += np.bincount(np.concatenate(fresh), minlength=n)
            whole = min(high) == n and max(low) == 0
            new = np.flatnonzero(left if whole else left & (counts >= need))
            if len(new):
                left[new] = False
                rows = np.concatenate([rows, new])
                scores = np.concatenate([scores, self.vectors[new] @ query])
            if whole:
                break
            if len(rows) >= most:
                kth = np.partition(scores, -most)[-most]
                if 2.0 - 2.0 * kth / (norm * self.largest) <= target * target:
                    break
            target *= GROW
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[best], scores[best]

    def first_target(self, q: np.ndarray, share: float) -> float:
        """The distance that about `share` of the rows are within, from the mean and deviation over a few of them."""
        gaps = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * self.probe @ q))
        below = NormalDist().inv_cdf(min(max(share, 1e-9), 0.5))
        return float(max(gaps.mean() + below * gaps.std(), 1e-3))


@dataclass
class Index:
    """rows: vec_id, embedding; blocks: a row per block with its ids and vectors as bytes; the largest norm."""

    rows: DataFrame
    blocks: DataFrame
    largest: float
    dim: int


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    ids, vectors = group["vec_id"].to_numpy(np.int64), np.array(group["embedding"].tolist(), np.float64)
    return pd.DataFrame({"ids": [ids.tobytes()], "vectors": [vectors.tobytes()]})


def build_index(tables: SharedTables, rows: DataFrame, block: int = BLOCK) -> Index:
    """Every usable row, dealt by hash into blocks of about `block` vectors, a block to a task; the one shuffle of the vectors.

    Vectors of different lengths are an error. A block's
    sorted projection arrays are made by the task that searches it: sorting costs less than reading them.
    """
    fine = rows.where(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = tables.write(fine, "vectors")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    about = kept.agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.max(F.size("embedding")).alias("d"), F.min(F.size("embedding")).alias("e")).first()
    if about.n and about.d != about.e:
        raise ValueError(f"embeddings have {about.e} to {about.d} components")
    n = max(1, -(-about.n // block))
    dealt = kept.withColumn("_block", F.pmod(F.xxhash64("vec_id", F.hash("embedding")), F.lit(n)).cast("int"))
    packed = dealt.repartitionById(n, "_block").groupBy("_block").applyInPandas(_pack, "ids binary, vectors binary")
    return Index(kept, tables.write(packed, "index"), float(about.norm or 1.0), int(about.d or 0))


def _searcher(shared, largest: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                own_ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                held = Block(own_ids, np.frombuffer(batch.column("vectors")[i].as_py(), np.float64).reshape(len(own_ids), -1), largest)
                out = []
                for own, q in zip(ids.tolist(), vectors, strict=True):
                    best, scores = held.search(own, q, k)
                    out.append((np.full(len(best), own), held.ids[best], scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in range(3)], names=["query_id", "vec_id", "score"])

    return run


def search(tables: SharedTables, index: Index, is_query: Column, k: int = 20, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that is_query picks.

    Candidates are all rows of the index but those with the query's own id. Queries go in sets of bounded bytes, each
    set against every block where it lies: vectors are not shuffled again. A block's k best meet the others' in a
    window per query. Rows that repeat a vec_id with different vectors are candidates each, and as queries share one ranking.
    """
    spark = index.rows.sparkSession
    picked = tables.write(index.rows.where(is_query).select("vec_id", "embedding").distinct(), "queries")
    many = picked.count()
    if not many:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    step = max(1, min(queries, QUERY_BYTES // (8 * index.dim)))
    sets = max(1, -(-2 * many // step))  # half full on average
    found = None
    for part in range(sets):
        some = picked.where(F.pmod(F.xxhash64("vec_id"), F.lit(sets)) == part).collect()
        if not some:
            continue
        shared = spark.sparkContext.broadcast((np.array([r.vec_id for r in some]), np.array([r.embedding for r in some])))
        one = tables.write(index.blocks.mapInArrow(_searcher(shared, index.largest, k), "query_id long, vec_id long, score double"), "found")
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """search() over all usable rows. Rows without a vec_id, and vectors null, zero or with null or non-finite components take no part."""
    tables = SharedTables(rows.sparkSession)
    return search(tables, build_index(tables, rows), is_query, k)
