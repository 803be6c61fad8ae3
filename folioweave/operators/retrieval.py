"""Exact retrieval by inner product, and the chunk tables that stand for vector indexes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from folioweave.sources.tables import SharedTables

#: Bytes of query vectors that are sent to the chunks at once.
SET_BYTES = 64 << 20
#: Vectors on a side of a block; pairs whose products are summed at once.
SIDE, STEP = 512, 16_384
#: Bytes of chunk vectors, in sets of SET_BYTES, up to which a task that ranks whole queries holds all; its rows in a batch.
WHOLE_SETS, OUT_ROWS = 4, 1 << 16


def inner_product(a: Column, b: Column) -> Column:
    """In double precision, in component order."""
    zipped = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(zipped, F.lit(0.0), lambda s, x: s + x)


def normalized(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(inner_product(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(vector)


def number_rows(rows: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """Rows numbered from `first` in the order of unique columns, without sorting them in one task.

    The rows are dealt into ranges of the order and written once with their place in their range, so that sizes and
    numbers come from one and the same division, however often tasks run again. The number of ranges follows
    spark.sql.shuffle.partitions and what Spark makes of it at run time; the prefix sum is over a row per range.
    """
    place = F.monotonically_increasing_id()  # the partition's number, then the place in it
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)
    written = SharedTables(rows.sparkSession).write(ranged, "ranged")
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = written.groupBy(part.alias("_range")).agg((F.max(within) + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_range", before.alias("_before"))
    at = written.withColumn("_range", part).join(sizes, "_range")
    return at.withColumn(name, F.col("_before") + within + F.lit(first).cast("long")).drop("_range", "_place", "_before")


def top_k(queries: DataFrame, chunks: DataFrame, k: int, on: list[str] | None = None, set_bytes: int = SET_BYTES) -> DataFrame:
    """on, query_id, rank, chunk_id, score of the k largest inner products; all of them for k < 0; ties to smaller chunk_id.

    queries: query_id, embedding; chunks: chunk_id (an integer), embedding; `on` names columns that both have and that must
    agree (an index per instance); queries are told apart by them, too. Without `on` a stated set of queries meets every
    chunk: all of set_bytes of vectors are sent to the chunks at once, which are read once for them, see _in_blocks. Of each
    task only k rows a query are shuffled. Vectors that are null, of another length than the query's or with a component
    that is null or not finite have no score and are left out.

    All scores are ranked where they are made, see _ranked_whole(), and no pair is shuffled, unless `on` is given or the
    chunks have over WHOLE_SETS * set_bytes of vectors: then every pair is sorted by query, with spilling.
    """
    on = on or []
    if k < 0 and not on:
        if queries.isEmpty():
            raise ValueError("there are no queries")
        if _bytes(chunks) <= WHOLE_SETS * set_bytes:
            return _ranked_whole(queries, chunks, -(-max(1, _bytes(queries)) // set_bytes))
    rank = F.row_number().over(Window.partitionBy(*on, "query_id").orderBy(F.desc("score"), "chunk_id"))
    ranked = scores(queries, chunks, on, k, set_bytes).withColumn("rank", rank)
    return (ranked if k < 0 else ranked.where(F.col("rank") <= k)).select(*on, "query_id", "rank", "chunk_id", "score")


def _bytes(rows: DataFrame) -> int:
    """Of the vectors of rows (embedding)."""
    width = 4 if rows.schema["embedding"].dataType.elementType == FloatType() else 8
    return rows.agg(F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0)) * width).first()[0]


def _ranked_whole(queries: DataFrame, chunks: DataFrame, sets: int) -> DataFrame:
    """query_id, rank, chunk_id, score of all chunks for each query; `sets` of queries are the fewest that fit in tasks.

    Queries are dealt over three tasks a core, each of which gets all chunks' vectors: what is shuffled grows with the
    vectors, not with the pairs. A task holds the vectors and one query's scores, ranks these and lets them go.
    """
    kind = queries.schema["query_id"].dataType
    tasks = max(sets, 3 * queries.sparkSession.sparkContext.defaultParallelism)
    asked = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(tasks)).cast("int").alias("_task"), "query_id", F.lit(None).cast("long").alias("chunk_id"), "embedding")
    each = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("_task")
    held = chunks.where("chunk_id IS NOT NULL").select(each, F.lit(None).cast(kind).alias("query_id"), F.col("chunk_id").cast("long").alias("chunk_id"), "embedding")
    fields = [StructField("query_id", kind), StructField("rank", IntegerType()), StructField("chunk_id", LongType()), StructField("score", DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, of_width = [], {}
        for batch in batches:
            if (mine := batch.filter(pc.is_null(batch.column("chunk_id")))).num_rows:
                asks.append(mine)
            batch = batch.filter(pc.is_valid(batch.column("chunk_id")))
            column, ids = batch.column("embedding"), np.asarray(batch.column("chunk_id"))
            for w in pc.unique(pc.list_value_length(column)).drop_null().to_pylist():
                at_rows, c = vectors(column, w, None)
                of_width.setdefault(w, []).append((ids[at_rows], np.ascontiguousarray(c.T)))
        if not asks:
            return
        asked = pa.Table.from_batches(asks)
        names, column = asked.column("query_id").combine_chunks(), asked.column("embedding")
        same = names.dictionary_encode("encode").indices.to_numpy()  # rows of equal ids are ranked together
        found: dict[int, list[tuple[int, np.ndarray]]] = {}
        for w in of_width:
            for row, q in zip(*vectors(column, w), strict=True):
                found.setdefault(int(same[row]), []).append((w, q))
        ids = {w: np.concatenate([i for i, _ in parts]) for w, parts in of_width.items()}
        by_id = {w: np.argsort(i, kind="stable") for w, i in ids.items()}
        ids = {w: i[by_id[w]] for w, i in ids.items()}
        for number, qs in found.items():
            score = np.concatenate([np.concatenate([products_with(q, c) for _, c in of_width[w]])[by_id[w]] for w, q in qs])
            chunk = np.concatenate([ids[w] for w, _ in qs])
            order = np.argsort(-score, kind="stable") if len(qs) == 1 else np.lexsort((chunk, -score))
            order = order[: len(order) - np.isnan(score).sum()]  # sorted last
            name = names.take(pa.array([np.flatnonzero(same == number)[0]]))
            for at in range(0, len(order), OUT_ROWS):
                here = order[at : at + OUT_ROWS]
                columns = [name.take(pa.array(np.zeros(len(here), int))), pa.array(np.arange(at + 1, at + 1 + len(here), dtype=np.int32)), pa.array(chunk[here]), pa.array(score[here])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "rank", "chunk_id", "score"])

    both = asked.union(held).repartitionById(tasks, "_task")
    return both.select("query_id", "chunk_id", "embedding").mapInArrow(run, StructType(fields))


def scores(queries: DataFrame, chunks: DataFrame, on: list[str] | None = None, k: int = -1, set_bytes: int = SET_BYTES) -> DataFrame:
    """on, query_id, chunk_id, score of top_k() without ranks; without `on`, for k >= 0, only what each task's k best are."""
    if queries.isEmpty():
        raise ValueError("there are no queries")
    on = on or []
    total = queries.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)) * 8).first()[0]
    if on and 0 <= k and total <= set_bytes:
        rows = queries.where(" AND ".join(f"`{c}` IS NOT NULL" for c in on)).withColumn("_at", F.struct(*on, "query_id"))
        q = rows.select(F.col("_at").alias("query_id"), "embedding", F.to_json(F.struct(*on)).alias("_on"))
        c = chunks.select("chunk_id", "embedding", F.to_json(F.struct(*on)).alias("_on"))
        return _in_blocks(c, q.toArrow(), k, q.schema["query_id"].dataType).select("query_id.*", "chunk_id", "score")
    if on:
        q, c = (x.select(*on, name, F.col("embedding").alias(v)) for x, name, v in ((queries, "query_id", "_q"), (chunks, "chunk_id", "_c")))
        return q.join(c, on).select(*on, "query_id", "chunk_id", inner_product(F.col("_q"), F.col("_c")).alias("score")).where("abs(score) < double('infinity')")
    held = _held(queries.select("query_id", "embedding"), total, set_bytes)
    return reduce(DataFrame.unionByName, [_in_blocks(chunks, h, k, queries.schema["query_id"].dataType) for h in held])


def _held(queries: DataFrame, total: int, set_bytes: int) -> list[pa.Table]:
    """The queries in sets of about set_bytes of vectors, of which there are `total` bytes."""
    sets = -(-max(1, total) // set_bytes)
    part = F.pmod(F.xxhash64("query_id"), F.lit(sets))
    return [queries.where(part == n).toArrow() for n in range(sets)]


def vectors(column: pa.Array | pa.ChunkedArray, width: int, kind: type | None = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix in double precision; for no kind in the column's own) of the vectors of that width whose components are all finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    whole = column.filter(fits := pc.fill_null(pc.equal(pc.list_value_length(column), width), False))
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    matrix = pc.list_flatten(whole).to_numpy(zero_copy_only=False).astype(kind or column.type.value_type.to_pandas_dtype()).reshape(len(rows), width)
    good = np.isfinite(matrix).all(1)
    return rows[good], matrix[good]


def ordered_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a with rows of b, summed in component order, as inner_product() does."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += x * y
    return total


def products_with(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of q with the columns of c, summed in component order, STEP columns at a time."""
    total, term = np.zeros(c.shape[1]), np.empty(STEP)
    for at in range(0, len(total), STEP):
        part, here = c[:, at : at + STEP], total[at : at + STEP]
        for x, y in zip(q, part, strict=True):
            here += np.multiply(y, x, out=term[: len(here)], dtype=np.float64)
    return total


def best_of_block(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, id): what of a block of chunks can be among the queries' k best, of which the k-th has `least` so far.

    One matrix product finds them, with room for its rounding: twice the bound on the error of a sum of products. Scores
    are then summed in component order, so equal vectors have equal scores wherever they stand.
    """
    near = q @ c.T
    room = 4 * q.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * (np.linalg.norm(c, axis=1).max(initial=0.0))
    if 0 <= k < len(c):
        least = np.maximum(least, np.partition(near, len(c) - k, axis=1)[:, len(c) - k] - room) if k else np.full(len(q), np.inf)
    row, column = np.nonzero(near >= (least - room)[:, None])
    score = np.concatenate([ordered_products(q[row[i : i + STEP]], c[column[i : i + STEP]]) for i in range(0, len(row), STEP)] or [np.zeros(0)])
    return row, score, ids[column]


def _merged(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, smaller ids first among equal scores."""
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], score[place < k], ids[place < k]


def _in_blocks(chunks: DataFrame, held: pa.Table, k: int, query_type: DataType) -> DataFrame:
    """(query_id, chunk_id, score): each task's k best for each held query (all for k < 0), from one pass over the chunks.

    Blocks of chunks are multiplied with blocks of queries; a task keeps k rows a query and the score that the next needs.
    Where both have a column _on, only rows that agree in it meet.
    """
    on = "_on" in held.column_names
    shared = chunks.sparkSession.sparkContext.broadcast(held)
    schema = StructType([StructField("query_id", query_type), StructField("chunk_id", LongType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value.column("query_id").combine_chunks()
        column = shared.value.column("embedding")
        lengths = pc.list_value_length(column)
        owner = shared.value.column("_on") if on else pa.chunked_array([pa.nulls(len(column), pa.string())])
        kinds = pa.table({"w": lengths, "on": owner, "n": pa.array(np.arange(len(column)))}).group_by(["w", "on"]).aggregate([("n", "list")]).to_pylist()
        by_width = {}
        for kind in kinds:
            if kind["w"] is not None:
                mine = np.array(kind["n_list"])
                at_rows, q = vectors(column.take(pa.array(mine)), kind["w"])
                by_width[kind["w"], kind["on"]] = mine[at_rows], q
        widths = list(by_width)

        def rows(query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([names.take(pa.array(query)), pa.array(ids), pa.array(score)], names=["query_id", "chunk_id", "score"])

        best = {w: [(np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64)) for _ in range(0, len(by_width[w][0]), SIDE)] for w in widths}
        for batch in batches:
            for at in range(0, batch.num_rows, SIDE):
                part = batch.slice(at, SIDE)
                every = np.asarray(part.column("chunk_id"))
                groups = np.asarray(part.column("_on")) if on else None
                of_width = {w: vectors(part.column("embedding"), w) for w in {w for w, _ in widths}}
                present = set(groups) if on else {None}
                for w, (number, q) in by_width.items():
                    if w[1] not in present:
                        continue
                    at_rows, c = of_width[w[0]]
                    if on:
                        same = groups[at_rows] == w[1]
                        at_rows, c = at_rows[same], c[same]
                    ids = every[at_rows]
                    for n, kept in enumerate(best[w]):
                        mine = slice(n * SIDE, (n + 1) * SIDE)
                        least = np.full(len(q[mine]), -np.inf)
                        if 0 <= k:
                            full = np.flatnonzero(np.bincount(kept[0], minlength=len(least)) >= k) if k else np.zeros(0, int)
                            least[full] = kept[1][np.searchsorted(kept[0], full, "right") - 1]
                        found = best_of_block(q[mine], c, ids, k, least)
                        if k < 0:
                            yield rows(number[mine][found[0]], found[1], found[2])
                        else:
                            best[w][n] = _merged(*(np.concatenate(x) for x in zip(kept, found, strict=True)), k)
        for w, blocks in best.items():
            for n, (row, score, ids) in enumerate(blocks):
                yield rows(by_width[w][0][n * SIDE :][row], score, ids)

    return chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding", *["_on"] * on).where("chunk_id IS NOT NULL").mapInArrow(run, schema)


def better_than(queries: DataFrame, chunks: DataFrame, set_bytes: int = SET_BYTES) -> DataFrame:
    """query_id, above: how many chunks are nearer to a query than its own chunk `than_id` of score `than`, ties to smaller ids.

    queries: query_id, embedding, than, than_id. Pairs are counted where their blocks are multiplied; a task ships a number a query.
    """
    total = queries.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)) * 8).first()[0]
    spark, kind = chunks.sparkSession, queries.schema["query_id"].dataType
    schema = StructType([StructField("query_id", kind), StructField("above", LongType())])

    def counter(held: pa.Table):  # noqa: ANN202
        shared = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            column = asked.column("embedding")
            than, than_id = (asked.column(c).to_numpy() for c in ("than", "than_id"))
            above = np.zeros(asked.num_rows, np.int64)
            by_width = {w: vectors(column, w) for w in pc.unique(pc.list_value_length(column)).to_pylist() if w is not None}
            for batch in batches:
                for at in range(0, batch.num_rows, SIDE):
                    part = batch.slice(at, SIDE)
                    for w, (number, every) in by_width.items():
                        at_rows, c = vectors(part.column("embedding"), w)
                        ids = np.asarray(part.column("chunk_id"))[at_rows]
                        for first in range(0, len(number), SIDE):
                            mine, q = number[first : first + SIDE], every[first : first + SIDE]
                            apart = q @ c.T - than[mine][:, None]
                            room = 4 * w * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max(initial=0.0)
                            above[mine] += (apart > room[:, None]).sum(1)
                            row, col = np.nonzero(np.abs(apart) <= room[:, None])
                            score, limit = ordered_products(q[row], c[col]), than[mine][row]
                            won = (score > limit) | ((score == limit) & (ids[col] < than_id[mine][row]))
                            above[mine] += np.bincount(row[won], minlength=len(mine))
            yield pa.RecordBatch.from_arrays([asked.column("query_id").combine_chunks(), pa.array(above)], names=["query_id", "above"])

        return run

    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding").where("chunk_id IS NOT NULL")
    counts = [rows.mapInArrow(counter(h), schema) for h in _held(queries.select("query_id", "embedding", "than", F.col("than_id").cast("long").alias("than_id")), total, set_bytes)]
    return reduce(DataFrame.unionByName, counts).groupBy("query_id").agg(F.sum("above").alias("above"))


def texts_of(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with the text of their chunk; ids without one go."""
    return hits.join(chunks.select("chunk_id", "text"), "chunk_id")


def offline_hits(hits: DataFrame) -> DataFrame:
    """(id, chunks): each query's texts in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return hits.groupBy(F.col("query_id").alias("id")).agg(F.transform(ordered, lambda h: h["text"]).alias("chunks"))


def build_index(docs: DataFrame, order: list[str]) -> DataFrame:
    """(chunk_id from 0, text, embedding at length 1); an error if there are no rows."""
    if docs.isEmpty():
        raise ValueError("there are no documents to index")
    numbered = number_rows(docs, order, "chunk_id")
    return numbered.select("chunk_id", "text", normalized(F.col("embedding")).alias("embedding"))


def append_to_index(index: DataFrame | None, docs: DataFrame, order: list[str]) -> DataFrame:
    """The index with more documents, numbered on from its last id; without an index it is built."""
    if index is None:
        return build_index(docs, order)
    most = index.agg(F.coalesce(F.max("chunk_id") + 1, F.lit(0)).alias("n")).first().n
    more = number_rows(docs, order, "chunk_id", int(most))
    return index.unionByName(more.select("chunk_id", "text", normalized(F.col("embedding")).alias("embedding")))


def use_hits(rows: DataFrame, hits: DataFrame, top: int) -> DataFrame:
    """rows (id, context) with the context replaced by their first `top` hits (all if negative); others keep theirs."""
    chunks = F.col("chunks") if top < 0 else F.slice("chunks", 1, top)
    joined = rows.join(hits.select("id", "chunks"), "id", "left")
    return joined.withColumn("context", F.coalesce(F.array_join(chunks, "\n"), F.col("context"))).drop("chunks")
