"""SimHash fingerprints and near-duplicate components by multi-index hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.shared import SharedTables, connected_components, pieces, rows_of, text_or_empty

REACH = 4
#: Up to so many distinct fingerprints the 64 bits go in three segments, of which one differs by at most one bit; beyond, a
#: segment of 21 bits would hold too many of them, and they go in two, of which one differs by at most two bits.
THREE = 1 << 28
#: A bucket with more fingerprints is not joined pair by pair; they are linked through common centres, of which each has
#: 2081, so pairs are the dearer way in it.
FULL = 1024

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of a text: XXH64 (seed 42) of each run of `words` words, repeats included; a bit is 1 if set in over half.

    A-Z are lower-cased; fewer words make one shingle, none the fingerprint 0.
    """
    parts = text.lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    blanks = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
    starts = [0, *(blanks + 1).tolist()]
    ends = [*blanks.tolist(), len(whole)]
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(whole, 42)
    found = np.array([digest(whole[a:b], 42) for a, b in zip(starts, ends[words - 1 :], strict=False)], np.uint64)
    columns = found.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(sum(1 << k for k, n in enumerate(ones.tolist()) if 2 * n > len(found)))


def with_fingerprint(docs: DataFrame, keep: list[str], words: int = 4) -> DataFrame:
    """The columns keep and _fp, the fingerprint as a signed long."""
    source = docs.select(*keep, text_or_empty("text").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            prints = np.array([fingerprint(t.as_py(), words) for t in batch.column("_text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(prints.view(np.int64))], names=[*keep, "_fp"]
            )

    return source.mapInArrow(run, source.drop("_text").withColumn("_fp", F.lit(0).cast("long")).schema)


def segments(n: int) -> tuple[tuple[int, int], ...]:
    """(low bit, width) of the segments for n fingerprints: a bucket holds few of them at any n."""
    return ((0, 21), (21, 21), (42, 22)) if n <= THREE else ((0, 32), (32, 32))


def _entries(fp: np.ndarray, parts: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, in_table): the segment values that each fingerprint enters the table under, and those it looks up.

    Three segments: it enters under its own values and looks up those with one 0 bit set as well. Two segments: it enters
    under its own values and all that differ in one bit, and looks the same up, so that two meet that differ in two bits.
    """
    low = np.concatenate([np.full(width, low, np.uint64) for low, width in parts])
    mask = np.concatenate([np.full(width, (1 << width) - 1, np.uint64) for _, width in parts])
    tag = np.concatenate([np.full(width, k << 32, np.uint64) for k, (_, width) in enumerate(parts)])
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    row, i = np.nonzero((fp[:, None] & bit) == 0) if len(parts) == 3 else (np.repeat(np.arange(len(fp)), 64), np.tile(np.arange(64), len(fp)))
    looked = (((fp[row] ^ bit[i]) >> low[i]) & mask[i]) | tag[i]
    first = np.array([low for low, _ in parts], np.uint64)
    width = np.array([(1 << width) - 1 for _, width in parts], np.uint64)
    own = ((fp[:, None] >> first) & width) | (np.arange(len(parts), dtype=np.uint64) << np.uint64(32))
    rows = np.concatenate([np.repeat(np.arange(len(fp)), len(parts)), row])
    return rows, np.concatenate([own.ravel(), looked]), (np.arange(len(rows)) < own.size) | (len(parts) == 2)


def _centres(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): all 64-bit values within REACH / 2 bits of each fingerprint."""
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    flips = [np.zeros(1, np.uint64)]
    for k in range(1, REACH // 2 + 1):
        flips.append(np.array([sum(int(bit[i]) for i in c) for c in combinations(range(64), k)], np.uint64))
    all_flips = np.concatenate(flips)
    return np.repeat(np.arange(len(fp)), len(all_flips)), (fp[:, None] ^ all_flips).ravel()


def _expand(prints: DataFrame, columns: str, make: Callable, step: int) -> DataFrame:
    """Rows (_fp, *columns) that make gives for slices of step fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("_fp")).view(np.uint64)
            for at in range(0, len(fp), step):
                row, value, *more = make(fp[at : at + step])
                arrays = [fp[at : at + step][row].view(np.int64), value.view(np.int64), *more]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["_fp", *columns.split()[0::2]])

    fields = ", ".join(" ".join(c) for c in zip(columns.split()[0::2], columns.split()[1::2], strict=True))
    return prints.select("_fp").mapInArrow(run, f"_fp long, {fields}")


def link_fingerprints(tables: SharedTables, prints: DataFrame, full: int = FULL, three: int = THREE) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (column _fp) within REACH bits, enough of them to connect all such pairs.

    Each fingerprint enters a table of each segment and looks up small Hamming balls in it (see segments, _entries). The
    pairs of a bucket are verified by their whole distance in the join's condition. Fingerprints of a bucket with over
    `full` entries of the table are not paired: each names all centres within REACH / 2 bits, and those that share a
    centre, which are within REACH of each other, link to the smallest one. Any two within REACH have such a centre, so
    no link is lost and work stays linear in a crowd.
    """
    parts = segments(prints.count() if three == THREE else three + 1)
    looked = _expand(prints, "bucket long own boolean", lambda fp: _entries(fp, parts), 4096)
    own = looked.where("own").select("bucket", F.col("_fp").alias("a"))
    other = looked.select("bucket", F.col("_fp").alias("b"), F.col("own").alias("_own"))
    crowded = tables.write(own.groupBy("bucket").count().where(F.col("count") > full).select("bucket"), "crowded")
    near = f"(a < b OR NOT _own) AND a <> b AND bit_count(a ^ b) <= {REACH}"
    if crowded.isEmpty():
        return own.join(other, "bucket").where(near).select("a", "b")
    crowd = tables.write(other.join(crowded, "bucket", "left_semi").select(F.col("b").alias("_fp")).distinct(), "crowd")
    own, other = (x.join(crowded, "bucket", "left_anti") for x in (own, other))
    near = own.join(other, "bucket").where(near).select("a", "b")
    around = _expand(crowd, "c long", _centres, 64)
    least = around.groupBy("c").agg(F.min("_fp").alias("b"), F.max("_fp").alias("_most")).where("b < _most")
    stars = around.join(least.select("c", "b"), "c").where("_fp <> b").select(F.col("_fp").alias("a"), "b")
    return near.union(stars.distinct())


def _grouped(tables: SharedTables, docs: DataFrame, names: list[str], words: int) -> tuple[DataFrame, DataFrame]:
    """(a row per row of docs: names, _row, _fp; a row per fingerprint: _fp, _c and the _first doc_id of its component)."""
    numbered = docs.select(*dict.fromkeys(["text", *names]), F.monotonically_increasing_id().alias("_row"))
    printed = tables.write(with_fingerprint(numbered, [*names, "_row"], words), "prints")
    # equal fingerprints meet first, by one aggregation: exact copies cost a row for each task
    groups = tables.write(printed.groupBy("_fp").agg(F.min("doc_id").alias("_first")), "groups")
    parts = connected_components(tables, link_fingerprints(tables, groups.select("_fp")))
    of = groups.join(parts.select(F.col("node").alias("_fp"), "component"), "_fp", "left").select("_fp", "_first", F.coalesce("component", "_fp").alias("_c"))
    of = tables.write(of, "of")
    firsts = tables.write(of.select("_fp", "_c").join(of.groupBy("_c").agg(F.min("_first").alias("_first")), "_c"), "firsts")
    tables.drop(groups, of)
    return printed, firsts


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), words: int = 4) -> DataFrame:
    """keep, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable, itself included).

    One row per row of docs. Null and empty texts have fingerprint zero and are linked like any others. A null doc_id
    is a component's id only if the component has no other.
    """
    names = list(dict.fromkeys(["doc_id", *keep]))
    printed, firsts = _grouped(SharedTables(docs.sparkSession), docs, names, words)
    return (
        printed.join(firsts.select("_fp", "_first"), "_fp")
        .withColumns({"fingerprint": F.lower(F.lpad(F.hex("_fp"), 16, "0")), "component_id": F.col("_first")})
        .select(*names, "fingerprint", "component_id")
    )


def first_of_each(docs: DataFrame, words: int = 4) -> DataFrame:
    """One document of each component, that of the smallest doc_id (of rows with equal ids, one), with docs' columns."""
    tables = SharedTables(docs.sparkSession)
    whole = docs.select("text", "doc_id", F.struct(*docs.columns).alias("_doc"))
    printed, firsts = _grouped(tables, whole, ["doc_id", "_doc"], words)
    of = printed.select("_row", "_fp", "doc_id").join(firsts, "_fp").where(F.col("doc_id").eqNullSafe(F.col("_first")))
    chosen = tables.write(of.groupBy("_c").agg(F.min("_row").alias("_row")).select("_row"), "chosen")
    return rows_of(tables, printed, chosen).select("_doc.*")
