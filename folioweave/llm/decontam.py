"""Benchmark decontamination by winnowing: k-gram fingerprints, joined and extended to whole windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm import words as W
from folioweave.llm.shared import SharedTables, byte_view, pieces, rows_of, text_or_empty

#: Words of a window, and of a k-gram; a window has WINDOW - GRAM + 1 k-grams, of which winnowing keeps the least hash.
WINDOW, GRAM = 13, 6
#: Bits for each fingerprint of the benchmark in the filter that is sent to tasks, and bits of the whole filter at most
#: (16 MB): with more fingerprints than it suits, more of the documents' windows reach the join.
BITS, MOST_BITS = 64, 1 << 27

_INSIDE = W.letters_and_digits()


class Spans:
    """Words of some texts, with hashes of runs of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = W.lower(data)
        self.starts, self.ends, self.first = W.runs(self.data, offsets, _INSIDE)
        self.hashes = W.span_hash(self.data, self.starts, self.ends)
        self.n = np.diff(self.first)

    def grams(self, size: int) -> np.ndarray:
        """Hashes of the runs of `size` words from each word, also those that leave a text."""
        at = np.arange(max(0, len(self.hashes) - size + 1))
        return W.span_hash(self.hashes, at, at + size)

    def prints(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, fingerprints) of the windows of `size` words that stand in one text.

        The fingerprint is the least hash of the window's k-grams; a window shorter than a k-gram is one.
        """
        gram = min(size, GRAM)
        least = W.sliding_min(self.grams(gram), size - gram + 1) if len(self.hashes) >= size else np.zeros(0, np.uint64)
        at = np.arange(len(least))
        whole = at + size <= np.repeat(self.first[1:], self.n)[: len(at)]
        return at[whole], least[whole]

    def words(self, at: int, size: int) -> bytes:
        """The words of a window, parted by single spaces."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[at : at + size].tolist(), self.ends[at : at + size].tolist(), strict=True))


def winnow(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints kept, how many windows in a row each stands for): neighbours mostly share their least hash."""
    if not len(prints):
        return prints, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
    return prints[first], np.diff(np.append(first, len(prints)))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item, print, words, n): the distinct windows of each item (a string) by their words and fingerprint.

    An item of fewer words than WINDOW, but not none, is one window.
    """
    source = benchmark.select(F.col("item_id").cast("string").alias("item"), text_or_empty("text").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            s = Spans(*byte_view(batch.column("_text")))
            size = np.minimum(s.n, WINDOW)
            for n in np.unique(size[size > 0]).tolist():
                at, prints = s.prints(n)
                text = np.searchsorted(s.first, at, "right") - 1
                at, prints, text = (x[size[text] == n] for x in (at, prints, text))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").take(pa.array(text)), pa.array(prints.view(np.int64)), pa.array([s.words(a, n) for a in at.tolist()], pa.binary()), pa.array(np.full(len(at), n, np.int32))],
                    names=["item", "print", "words", "n"],
                )

    return source.mapInArrow(run, "item string, print long, words binary, n int").distinct()


def item_sets(rows: DataFrame) -> DataFrame:
    """(print, words, n, set): the distinct windows; set stands for the items that a window has, by their number and 128 bits.

    A window's items are never gathered: windows with the same items, as those of a passage mostly are, have equal sets. A
    null item is in none.
    """
    a, b = (F.coalesce(F.bit_xor(F.when(F.col("item").isNotNull(), F.xxhash64("item", F.lit(k)))), F.lit(0).cast("long")) for k in (1, 2))
    return rows.groupBy("print", "words", "n").agg(F.struct(F.count("item").alias("k"), a.alias("a"), b.alias("b")).alias("set"))


class Filter:
    """A Bloom filter of the benchmark's fingerprints, of bounded size: lets all of them pass, and few others."""

    def __init__(self, windows: DataFrame, most: int = MOST_BITS):
        known = windows.select("print").distinct()
        many = known.count()
        self.bits = 1 << int(min(most, max(1 << 10, BITS * many))).bit_length() - 1
        low = F.lit(self.bits - 1).cast("long")
        places = known.select(F.explode(F.array(F.col("print").bitwiseAND(low), F.shiftrightunsigned("print", 32).bitwiseAND(low))).alias("p"))
        # a row per 64 bits of the filter: the driver gets its size, not the benchmark's
        held = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b")).toArrow()
        self.table = np.zeros(max(1, self.bits >> 6), np.uint64)
        self.table[held.column("w").to_numpy()] = held.column("b").to_numpy().view(np.uint64)

    def passes(self, prints: np.ndarray) -> np.ndarray:
        out = np.ones(len(prints), bool)
        for place in (prints, prints >> np.uint64(32)):
            p = place & np.uint64(self.bits - 1)
            out &= (self.table[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)) > 0
        return out


def _candidates(source: DataFrame, known: Filter, lengths: list[int]) -> DataFrame:
    """source without _text, with n_words and found: the windows whose fingerprint passes the filter, each once, with
    its words and the places where it stands."""
    shared = source.sparkSession.sparkContext.broadcast(known)
    kind = "array<struct<print:bigint,words:binary,at:array<int>>>"
    arrow = pa.list_(pa.struct([("print", pa.int64()), ("words", pa.binary()), ("at", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            s = Spans(*byte_view(batch.column("_text")))
            found: list[dict[bytes, dict]] = [{} for _ in range(batch.num_rows)]
            for n in lengths:
                at, prints = s.prints(n)
                kept, times = winnow(prints)
                passed = np.repeat(shared.value.passes(kept), times)
                at, prints = at[passed], prints[passed]
                text = np.searchsorted(s.first, at, "right") - 1
                for a, p, t in zip(at.tolist(), prints.view(np.int64).tolist(), text.tolist(), strict=True):
                    one = found[t].setdefault(s.words(a, n), {"print": p, "at": []})
                    one["at"].append(a - int(s.first[t]))
            rows = [[{"words": w, **x} for w, x in f.items()] for f in found]
            kept = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(s.n.astype(np.int64)), pa.array(rows, arrow)], names=[*kept, "n_words", "found"])

    like = source.drop("_text").withColumns({"n_words": F.lit(0).cast("long"), "found": F.array().cast(kind)})
    return source.mapInArrow(run, like.schema)


def _cover(matched: DataFrame) -> DataFrame:
    """_row, hits (ascending), sets (ascending): from the windows of each document and where they stand."""
    kept = "_row long, hits array<int>, sets array<struct<k:bigint,a:bigint,b:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for spans in batch.column("spans").to_pylist():
                mark = np.zeros(max(x["n"] + max(x["at"]) for x in spans) + 1, np.int32)
                for x in spans:
                    at = np.array(x["at"])
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + x["n"], -1)
                hits.append(np.flatnonzero(np.cumsum(mark)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(hits, pa.list_(pa.int32())), batch.column("sets")], names=["_row", "hits", "sets"])

    spans = F.collect_list(F.struct("at", "n")).alias("spans")
    return matched.groupBy("_row").agg(spans, F.array_sort(F.collect_set("set")).alias("sets")).mapInArrow(run, kept)


def _covered(tables: SharedTables, docs: DataFrame, windows: DataFrame, keep: list[str], bits: int) -> tuple[DataFrame, DataFrame]:
    """(_row, _keep, n_words of every document; _row, hits, sets of those with hits).

    The documents are read once, whatever the size of the benchmark: a window whose fingerprint passes the filter is joined
    with the benchmark's windows by fingerprint and words, so a hit is one of words, not of hashes. A frequent window is one
    row of the benchmark's side, so Spark can split the documents' side.
    """
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())
    source = docs.select(F.struct(*keep).alias("_keep"), F.monotonically_increasing_id().alias("_row"), text_or_empty("text").cast("binary").alias("_text"))
    found = tables.write(_candidates(source, Filter(windows, bits), lengths), "found")
    matched = found.select("_row", F.inline("found")).join(windows, ["print", "words"]).select("_row", "at", "n", "set")
    return found.select("_row", "_keep", "n_words"), _cover(matched)


def _items(covered: DataFrame, rows: DataFrame, windows: DataFrame) -> DataFrame:
    """(sets, items): the items (sorted) of each list of sets that some document has; equal lists are worked out once."""
    members = rows.where("item IS NOT NULL").join(windows, ["print", "words"]).select("set", "item").distinct()
    lists = covered.select("sets").distinct()
    return lists.select("sets", F.explode("sets").alias("set")).join(members, "set").groupBy("sets").agg(F.array_sort(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), bits: int = MOST_BITS) -> DataFrame:
    """keep, n_words, hits (positions of the words hit), items (ids of the items with occurring windows, sorted).

    One row per row of docs. Null and empty texts have no words; a null item_id never counts as an item, though its
    words hit. A window of very many items sends none of them with the documents that hold it: documents meet by the sets of
    items, and a document's items come from its sets at the end.
    """
    tables = SharedTables(docs.sparkSession)
    names = list(dict.fromkeys(keep))
    rows = tables.write(benchmark_windows(benchmark), "items")
    windows = tables.write(item_sets(rows), "windows")
    every, covered = _covered(tables, docs, windows, names, bits)
    covered = tables.write(covered, "covered")
    named = covered.join(_items(covered, rows, windows), "sets", "left").drop("sets")
    whole = every.join(named, "_row", "left")
    hits, items = (F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("hits", "array<int>"), ("items", "array<string>")))
    return whole.select(*[F.col("_keep")[c].alias(c) for c in names], "n_words", hits, items)


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """Words of benchmark windows make a twentieth of the document or more."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    tables = SharedTables(docs.sparkSession)
    stored = tables.write(docs.select(F.struct(*docs.columns).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "documents")
    windows = tables.write(item_sets(benchmark_windows(benchmark)), "windows")
    every, covered = _covered(tables, stored.select(F.col("_doc.text").alias("text"), F.col("_row").alias("_at")), windows, ["_at"], MOST_BITS)
    n_hit = F.coalesce(F.size("hits"), F.lit(0))
    found = every.join(covered.select("_row", "hits"), "_row", "left")
    clean = tables.write(found.where(~is_contaminated(n_hit, F.col("n_words"))).select(F.col("_keep._at").alias("_row")), "clean")
    return rows_of(tables, stored, clean).select("_doc.*")
