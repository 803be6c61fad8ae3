"""Repeated passages across documents by level-wise doubling, and their removal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm import words as W
from folioweave.llm.shared import BLANKS, SharedTables, byte_view, list_array, pieces, text_or_empty

_INSIDE = np.ones(256, bool)
_INSIDE[list(BLANKS.encode())] = False


class Words:
    """The words of some texts as hashes, and hashes of runs of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends, self.first = W.runs(data, offsets, _INSIDE)
        self.hashes = W.span_hash(data, self.starts, self.ends)
        self.n = np.diff(self.first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, texts) of the windows of `size` words that stand in one text."""
        text = np.repeat(np.arange(len(self.n)), self.n)
        at = np.flatnonzero(np.arange(len(text)) + size <= self.first[1:][text])
        return at, text[at]


def levels(length: int) -> list[int]:
    """The lengths of the levels: each but the last is half of the next, rounded up; the first is 32 at most."""
    found = [length]
    while found[0] > 32:
        found.insert(0, (found[0] + 1) // 2)
    return found


def _choices(s: Words, short: int, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(at, text, grams, place): the windows of `long` words, the hashes of all runs of `short`, where each window's choice starts.

    A window chooses the run of `short` words in it that has the least hash by its high bits, the first of equal ones; so
    windows with equal words choose equal runs at equal places in them. The low bits hold the place while the least is sought.
    """
    at, text = s.windows(long)
    here = np.arange(max(0, len(s.hashes) - short + 1))
    grams = W.span_hash(s.hashes, here, here + short)
    if not len(at):
        return at, text, grams, at
    low = np.uint64(32)
    least = W.sliding_min((grams >> low << low) | here.astype(np.uint64), long - short + 1)
    return at, text, grams, (least[at] & np.uint64((1 << 32) - 1)).astype(np.int64)


def _first_level(docs: DataFrame, short: int, long: int) -> DataFrame:
    """docs with n_words, w1, w2 (hashes of all words in order), kept_sha256 (of all words), and the choices: grams, places."""
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            s = Words(*byte_view(batch.column("_text")))
            _, text, grams, place = _choices(s, short, long)
            first = np.flatnonzero(np.diff(place, prepend=-1))
            w1 = W.span_hash(s.hashes, s.first[:-1], s.first[1:])
            w2 = W.span_hash(W.mix(s.hashes), s.first[:-1], s.first[1:])
            sha = [hashlib.sha256(b" ".join(t.as_py().split())).hexdigest() for t in batch.column("_text")]
            arrays = [pa.array(s.n.astype(np.int64)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(sha, pa.string()), *_listed(s, text[first], grams, place[first])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=[*kept, *"n_words w1 w2 kept_sha256 grams places".split()])

    long_, hexa = F.lit(0).cast("long"), F.lit("")
    like = docs.withColumns({"n_words": long_, "w1": long_, "w2": long_, "kept_sha256": hexa, "grams": F.array().cast("array<long>"), "places": F.array().cast("array<int>")})
    return docs.mapInArrow(run, like.schema)


def _listed(s: Words, text: np.ndarray, grams: np.ndarray, place: np.ndarray) -> list[pa.Array]:
    """For each text the hashes of the runs at `place`, and the places from the text's first word."""
    count = np.bincount(text, minlength=len(s.n))
    return [list_array(pa.array(grams[place].view(np.int64)), count), list_array(pa.array((place - s.first[text]).astype(np.int32)), count)]


def _where_repeated(tables: SharedTables, at: DataFrame) -> DataFrame:
    """(_row, places): of (gram, doc_id, _row, place), the places whose gram stands in documents of different ids."""
    spread = at.groupBy("gram").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("gram")
    repeated = tables.write(spread, "repeated")
    return at.join(repeated, "gram").groupBy("_row").agg(F.collect_list("place").alias("places"))


def _next_level(survivors: DataFrame, before: int, short: int, long: int) -> DataFrame:
    """(_row, doc_id, grams, places) of a level from the rows (_row, doc_id, _text, places) in which the one before survived.

    before, short, long: words of a window at the level before, at this one, at the next. A window of this level is a
    candidate if what it chose at the level before is repeated; of these, each window of the next level chooses one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            s = Words(*byte_view(batch.column("_text")))
            at, _, _, place = _choices(s, before, short)
            alive = np.zeros(len(s.hashes) + 1, bool)
            alive[at[_marked(s, batch)[place]]] = True
            _, text, grams, place = _choices(s, short, long)
            first = np.flatnonzero(np.diff(place, prepend=-1))
            first = first[alive[place[first]]]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), *_listed(s, text[first], grams, place[first])], names=["_row", "doc_id", "grams", "places"])

    return survivors.mapInArrow(run, "_row long, doc_id long, grams array<long>, places array<int>")


def _marked(s: Words, batch: pa.RecordBatch) -> np.ndarray:
    """Marks of the words at the places that a batch names in each text."""
    mark = np.zeros(len(s.hashes) + 1, bool)
    column = batch.column("places")
    mark[np.asarray(column.flatten()) + np.repeat(s.first[:-1], np.asarray(column.value_lengths()))] = True
    return mark


def _runs(survivors: DataFrame, short: int, long: int) -> DataFrame:
    """(_row, doc_id, gram, run, start, windows): the windows of `long` words whose choice is repeated, by runs with one choice.

    gram: the choice's hash; run: the hash of all words that the run covers; start: its first word; windows: their hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            s = Words(*byte_view(batch.column("_text")))
            at, text, grams, place = _choices(s, short, long)
            keep = _marked(s, batch)[place]
            at, text, place = at[keep], text[keep], place[keep]
            first = np.flatnonzero(np.diff(place, prepend=-1))
            count = np.diff(np.append(first, len(place)))
            start, of = at[first], text[first]
            whole = W.span_hash(s.hashes, start, start + count + long - 1)
            windows = list_array(pa.array(W.span_hash(s.hashes, at, at + long).view(np.int64)), count)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row").take(pa.array(of)), batch.column("doc_id").take(pa.array(of)), pa.array(grams[place[first]].view(np.int64)), pa.array(whole.view(np.int64)), pa.array((start - s.first[of]).astype(np.int32)), windows],
                names=["_row", "doc_id", "gram", "run", "start", "windows"],
            )

    return survivors.mapInArrow(run, "_row long, doc_id long, gram long, run long, start int, windows array<long>")


def _later_windows(tables: SharedTables, runs: DataFrame) -> DataFrame:
    """(_row, start, n): n windows from word `start` that also stand in a document of a smaller id.

    Runs with equal words meet first: a run in a document that is not its first one is removed as a whole. In its first
    document a run's windows can still stand in other runs of the same choice (cut off elsewhere by what is around them):
    where a choice has runs of more than one kind, the windows of each kind's first document are compared one by one.
    """
    kinds = tables.write(runs.groupBy("gram", "run").agg(F.min("doc_id").alias("first")), "kinds")
    several = tables.write(kinds.groupBy("gram").count().where("count > 1").select("gram"), "several")
    placed = runs.join(kinds, ["gram", "run"])
    n = F.size("windows").alias("n")
    whole = placed.where("doc_id > first").select("_row", "start", n)
    apart = tables.write(placed.where("doc_id = first").join(several, "gram", "left_semi").select("_row", "doc_id", "gram", "start", F.posexplode("windows").alias("k", "window")), "apart")
    firsts = tables.write(apart.groupBy("gram", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("gram", "window", "first"), "firsts")
    single = apart.join(firsts, ["gram", "window"]).where("doc_id > first").select("_row", (F.col("start") + F.col("k")).alias("start"), F.lit(1).alias("n"))
    return whole.union(single)


def _cut(found: DataFrame, long: int, texts: bool) -> DataFrame:
    """(_row, n_removed, kept_sha256 and, with texts, kept): from (_row, _text, spans), without the words of the windows in spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            s = Words(*byte_view(batch.column("_text")))
            spans = batch.column("spans")
            text = np.repeat(np.arange(batch.num_rows), np.asarray(spans.value_lengths()))
            start = np.asarray(spans.flatten().field("start")) + s.first[:-1][text]
            edge = np.zeros(len(s.hashes) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + np.asarray(spans.flatten().field("n")) + long - 1, -1)
            gone = np.cumsum(edge) > 0
            before = np.concatenate([[0], np.cumsum(gone)])
            kept = []
            for k in range(batch.num_rows):
                left = s.first[k] + np.flatnonzero(~gone[s.first[k] : s.first[k + 1]])
                kept.append(b" ".join(s.data[x:y].tobytes() for x, y in zip(s.starts[left].tolist(), s.ends[left].tolist(), strict=True)))
            more = [pa.array([k.decode() for k in kept], pa.string())] if texts else []
            arrays = [pa.array((before[s.first[1:]] - before[s.first[:-1]]).astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), *more]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *arrays], names=["_row", "n_removed", "kept_sha256", *["kept"] * texts])

    return found.mapInArrow(run, "_row long, n_removed long, kept_sha256 string" + ", kept string" * texts)


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), length: int = 50, texts: bool = True) -> DataFrame:
    """keep, n_words, n_removed, kept_sha256 and, with texts, kept: documents without passages that ones of smaller ids have.

    A word goes if a window of `length` words covers it whose words also start in a document with a smaller doc_id. Windows
    are judged on the texts as given. kept: the words left, parted by single spaces. One row per row of docs. Null and
    empty texts have no words; a text shorter than the window keeps all. Rows of equal doc_id take nothing from each
    other, and a null doc_id is neither smaller nor larger than another.

    Level-wise doubling: at each level a window of the next length chooses the one of its shorter windows with the least
    hash (windows with equal words choose alike). Only windows whose choice stands in documents of different ids go on to
    twice the length, until the length asked for is reached or none is left. Documents with all words equal meet before:
    the one of the smallest id speaks for them, the others go whole. 64 bits of hash stand for a word, and as many for a
    window among those with one choice.
    """
    tables = SharedTables(docs.sparkSession)
    names = list(dict.fromkeys(keep))
    steps = levels(length)
    pairs = list(zip(steps, [*steps[1:], length], strict=True))[: max(1, len(steps) - 1)]
    source = docs.select(F.struct(*names).alias("_keep"), F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), text_or_empty("text").cast("binary").alias("_text"))
    first = tables.write(_first_level(source, *pairs[0]), "words")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))).alias("least")
    classes = tables.write(first.groupBy("w1", "w2").agg(least).select("w1", "w2", F.col("least.id").alias("_least"), F.col("least.row").alias("_by")), "classes")
    chosen = first.select("_row", "doc_id", "grams", "places").join(classes.where("_least IS NOT NULL").select(F.col("_by").alias("_row")), "_row", "left_semi")
    for k, (short, long) in enumerate(pairs):
        if k:
            chosen = _next_level(survivors, pairs[k - 1][0], short, long)  # noqa: F821
        at = tables.write(chosen.select("_row", "doc_id", F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("places").alias("place")))), "chosen")
        alive = tables.write(_where_repeated(tables, at), "alive")
        tables.drop(at)
        survivors = first.select("_row", "doc_id", "_text").join(alive, "_row")
        if alive.isEmpty():
            break
    runs = tables.write(_runs(survivors, *pairs[-1]), "runs")
    spans = _later_windows(tables, runs).groupBy("_row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    cut = tables.write(_cut(first.select("_row", "_text").join(spans, "_row").select("_row", "_text", "spans"), length, texts), "cut")
    tables.drop(runs)
    of = classes.join(cut.withColumnRenamed("_row", "_by").withColumnsRenamed({"kept_sha256": "_sha", "kept": "_kept"}), "_by", "left").drop("_by")
    copy = (F.col("doc_id") > F.col("_least")) & (F.col("n_words") >= length)
    own = F.col("n_removed").isNotNull() & F.col("doc_id").eqNullSafe(F.col("_least"))
    plain = F.regexp_replace(F.btrim(F.col("_text").cast("string"), F.lit(BLANKS)), r"[\x20\x09-\x0D]+", " ")
    whole = first.select("_keep", "doc_id", "n_words", "w1", "w2", "kept_sha256", *["_text"] * texts).join(of, ["w1", "w2"])
    return whole.select(
        *[F.col("_keep")[c].alias(c) for c in names], "n_words",
        F.when(copy, F.col("n_words")).when(own, F.col("n_removed")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(own, F.col("_sha")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *[F.when(copy, F.lit("")).when(own, F.col("_kept")).otherwise(plain).alias("kept")] * texts,
    )
