"""What several operators need: byte views of texts, slices of batches, components of a graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.sources.tables import SharedTables

#: White space of the word contracts: space and \t \n \v \f \r. bytes.split() splits at exactly these.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text that a Python task works on at once; one longer text makes a piece of its own.
PIECE_BYTES = 2 << 20
#: Row numbers that are broadcast at most: 32 MB in a hash table.
SENT_ROWS = 2_000_000


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(name: str, folds: int) -> Column:
    """crc32 of the id as text, by folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and each row's offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(
    batches: Iterator[pa.RecordBatch], name: str, limit: int = PIECE_BYTES, rows: int = 1024
) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about limit bytes of text and at most so many rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = byte_view(batch.column(name))
        at = 0
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to


def rows_of(tables: SharedTables, table: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of a written table whose _row is in the written table chosen.

    Where few enough are left out for their numbers to be sent to every task, wide rows are not shuffled.
    """
    if table.count() - chosen.count() > SENT_ROWS:
        return table.join(chosen, "_row", "left_semi")
    out = tables.write(table.select("_row").join(chosen, "_row", "left_anti"), "left_out")
    return table.join(F.broadcast(out), "_row", "left_anti")


def list_array(flat: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)


def connected_components(tables: SharedTables, edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node reachable.

    Large-star and small-star passes by joins and min aggregates: links never leave the executors. The minima are
    written before the join, so the join is between two scans and Spark can split a hub's rows. A round's tables go
    when the next is there. Ends when a round changes nothing; chains shorten geometrically.
    """

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = tables.write(down, "links")
    was = state(links)
    while was[0]:
        both = links.union(links.select("b", "a"))
        least = tables.write(both.groupBy("a").agg(F.min("b").alias("m")).where("m < a"), "least")
        large = tables.write(
            links.select(F.col("b").alias("u"), "a").join(least.select(F.col("a").alias("u"), "m"), "u", "left")
            .select("a", F.least("u", F.coalesce("m", "u")).alias("b")).distinct(),
            "large",
        )
        low = tables.write(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = tables.write(small.union(low.select("a", "m")).distinct(), "links")
        tables.drop(links, least, large, low)
        links, before = new, was
        if (was := state(links)) == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select("b", "b").distinct()
    )
