"""Ranked lexical search: inverted lists by blocks of documents, MaxScore with the joint maxima of term pairs."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioweave.llm import words as W
from folioweave.llm.shared import SharedTables, byte_view, list_array, pieces, text_or_empty

#: Bytes of item text and items that are searched for at once: what is sent to every task is of their size.
SET_BYTES, SET_ITEMS = 1 << 20, 4096
#: Documents and list entries of a block at most.
BLOCK_DOCS, BLOCK_ENTRIES = 16_384, 1 << 20

_INSIDE = W.letters_and_digits()


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term, first term of each text): maximal runs of letters, digits and non-ASCII, only A-Z lower-cased."""
    data = W.lower(data)
    starts, ends, first = W.runs(data, offsets, _INSIDE)
    return W.span_hash(data, starts, ends), first


@dataclass
class Asked:
    """A set of items: the hashes of their terms in order, and each item's terms (positions in hashes) with their repeats."""

    hashes: np.ndarray
    items: list[list[tuple[int, int]]]

    @classmethod
    def of(cls, texts: list[str | None]) -> Asked:
        hashes, first = terms_of(*byte_view(pa.array(texts, pa.string())))
        known, place = np.unique(hashes, return_inverse=True)
        return cls(known, [sorted(Counter(place[a:b].tolist()).items()) for a, b in zip(first[:-1], first[1:], strict=True)])


@dataclass
class Plan:
    """What a search needs of its set besides the lists: weights by term, each item's units, and all pairs.

    A unit is a pair (a number into pairs) or a single term of an item; pairs: (a, repeats of a, b, repeats of b).
    """

    weights: np.ndarray
    items: list[list[tuple[int, int]]]
    pairs: list[tuple[int, int, int, int]]
    units: list[list[tuple[tuple[tuple[int, int], ...], int]]]

    @classmethod
    def of(cls, asked: Asked, df: np.ndarray, n_docs: int) -> Plan:
        """Terms of like frequency are paired: two rare ones hardly meet, so their joint maximum is about half the sum."""
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
        number: dict[tuple[int, int, int, int], int] = {}
        units, items = [], []
        for terms in asked.items:
            known = sorted((t for t in terms if weights[t[0]] > 0), key=lambda t: (-weights[t[0]], t[0]))
            mine = [((a, b), number.setdefault((*a, *b), len(number))) for a, b in zip(known[::2], known[1::2], strict=False)]
            units.append([*mine, *([((known[-1],), -1)] if len(known) % 2 else [])])
            items.append(known)
        return cls(weights, items, list(number), units)


def _counted(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tf): terms in the text, those of them that are asked for, how often each stands in it."""
    shared = docs.sparkSession.sparkContext.broadcast(hashes)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in pieces(batches, "_text"):
            found, first = terms_of(*byte_view(batch.column("_text")))
            at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
            text = np.repeat(np.arange(batch.num_rows), np.diff(first))
            asked = known[at] == found if len(known) else np.zeros(len(found), bool)
            key, tf = np.unique(text[asked] * max(1, len(known)) + at[asked], return_counts=True)
            text, term = np.divmod(key, max(1, len(known)))
            count = np.bincount(text, minlength=batch.num_rows)
            arrays = [pa.array(np.diff(first).astype(np.int64)), list_array(pa.array(term.astype(np.int32)), count), list_array(pa.array(tf.astype(np.int32)), count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n", "terms", "tf"])

    return source.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


class Block:
    """Inverted lists of some documents: for each term the documents (ascending places in the block) and its impacts in them."""

    def __init__(self, docs: pa.Array, terms: np.ndarray, starts: np.ndarray, at: np.ndarray, impacts: np.ndarray):
        self.docs, self.at, self.impacts = docs, at, impacts
        self.span = {t: (a, b) for t, a, b in zip(terms.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True)}
        self.most = dict(zip(terms.tolist(), np.maximum.reduceat(impacts, starts[:-1]).tolist() if len(terms) else [], strict=True))
        self.size = len(docs)
        self.ids = np.asarray(docs.fill_null(np.iinfo(np.int64).max))

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.span.get(term, (0, 0))
        return self.at[a:b], self.impacts[a:b]

    def add(self, score: np.ndarray, among: np.ndarray, term: int, times: int) -> None:
        """Adds a term's impacts to the scores of the documents `among` (ascending)."""
        at, impacts = self.list_of(term)
        if len(at):
            place = np.minimum(np.searchsorted(at, among), len(at) - 1)
            score += np.where(at[place] == among, impacts[place] * times, 0)


def _pair_lists(block: Block, pairs: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each pair: the joint maximum (most that a document gets from the two), the documents with both, their joint impacts."""
    most, lists, joints = np.zeros(len(pairs), np.int64), [], []
    seen = np.full(block.size, -1, np.int64)
    for k, (a, ca, b, cb) in enumerate(pairs):
        at_a, of_a = block.list_of(a)
        at_b, of_b = block.list_of(b)
        seen[at_a] = of_a
        both = np.flatnonzero(seen[at_b] >= 0)
        joint = seen[at_b[both]] * ca + of_b[both] * cb
        seen[at_a] = -1
        lists.append(at_b[both])
        joints.append(joint)
        most[k] = max(block.most.get(a, 0) * ca, block.most.get(b, 0) * cb, joint.max() if len(joint) else 0)
    return most, lists, joints


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of k highest scores."""
    return np.argpartition(-score, k - 1)[:k] if len(score) > k else np.arange(len(score))


def _blocks(counted: DataFrame, plan: Plan, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """A row per block: its lists, its pairs' joint maxima, and seeds: for each item the scores of documents that its pairs name.

    The seeds are whole scores of different documents, so the k-th of all blocks' is a bound that k documents reach.
    """
    shared = counted.sparkSession.sparkContext.broadcast(plan)
    schema = "docs array<long>, terms array<int>, starts array<int>, at array<int>, impacts array<long>, joint array<long>, seed_item array<int>, seed_score array<long>"

    def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        plan, table = shared.value, pa.Table.from_batches(parts).combine_chunks()
        count = np.asarray(table.column("terms").combine_chunks().value_lengths())
        doc = np.repeat(np.arange(table.num_rows), count)
        term, tf = (np.asarray(table.column(c).combine_chunks().flatten()).astype(np.int64) for c in ("terms", "tf"))
        m = 75 + 25 * np.asarray(table.column("n")) * n_docs // max(1, n_terms)
        impact = plan.weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc])) if len(term) else term
        used = np.flatnonzero(impact > 0)
        order = used[np.argsort(term[used], kind="stable")]
        terms, starts = np.unique(term[order], return_index=True)
        starts = np.append(starts, len(order))
        block = Block(table.column("doc_id").combine_chunks(), terms, starts, doc[order], impact[order])
        most, lists, joints = _pair_lists(block, plan.pairs)
        items, scores = [], []
        for i, units in enumerate(plan.units):
            named = [lists[p][_best(joints[p], k)] for _, p in units if p >= 0]
            among = np.unique(np.concatenate(named)) if named else np.zeros(0, np.int64)
            if len(among):
                score = np.zeros(len(among), np.int64)
                for t, times in plan.items[i]:
                    block.add(score, among, t, times)
                score = -np.sort(-score)[:k]
                items.append(np.full(len(score), i))
                scores.append(score)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (items, scores)]
        values = [table.column("doc_id").combine_chunks(), pa.array(terms.astype(np.int32)), pa.array(starts.astype(np.int32)), pa.array(doc[order].astype(np.int32)), pa.array(impact[order]), pa.array(most), pa.array(flat[0].astype(np.int32)), pa.array(flat[1])]
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.RecordBatch.from_arrays([list_array(v, np.array([len(v)])) for v in values], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, docs, entries = [], 0, 0
        for batch in batches:
            lengths = np.cumsum(np.asarray(batch.column("terms").value_lengths()))
            at = 0
            while at < batch.num_rows:
                before = lengths[at - 1] if at else 0
                to = min(batch.num_rows, at + BLOCK_DOCS - docs, max(at + (not docs), int(np.searchsorted(lengths, before + BLOCK_ENTRIES - entries, "right"))))
                if to > at:
                    parts.append(batch.slice(at, to - at))
                    docs, entries = docs + to - at, entries + int(lengths[to - 1] - before)
                    at = to
                if at < batch.num_rows:
                    yield row(parts)
                    parts, docs, entries = [], 0, 0
        if docs:
            yield row(parts)

    return counted.where("n > 0").mapInArrow(run, schema)


def _search_block(block: Block, joint: np.ndarray, plan: Plan, item: int, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the documents of a block that can be among an item's k best, of which k have scores of `least` or more.

    Units stand by their bounds: a pair's is its joint maximum, tighter than the sum of its terms' maxima. Documents that
    hold only terms of the low units, whose bounds together are under `least`, are never looked at; the others get the
    low units one by one from the highest, and drop out as soon as the units left cannot lift them.
    """
    units = [(int(joint[p]) if p >= 0 else block.most.get(terms[0][0], 0) * terms[0][1], terms) for terms, p in plan.units[item]]
    units = sorted((u for u in units if u[0]), key=lambda u: u[0])
    upto = np.cumsum([b for b, _ in units])
    if not len(upto) or upto[-1] < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = int(np.searchsorted(upto, least, "left"))  # units before have bounds under `least` together
    sums = np.zeros(block.size, np.int64)
    for _, terms in units[low:]:
        for t, times in terms:
            at, impacts = block.list_of(t)
            sums[at] += impacts * times
    rest = int(upto[low - 1]) if low else 0
    among = np.flatnonzero((sums > 0) & (sums + rest >= least))
    score = sums[among]
    for bound, terms in reversed(units[:low]):
        for t, times in terms:
            block.add(score, among, t, times)
        rest -= bound
        stay = score + rest >= least
        among, score = among[stay], score[stay]
    if len(score) > k:
        best = np.lexsort((block.ids[among], -score))[:k]
        among, score = among[best], score[best]
    return among, score


def _search(blocks: DataFrame, plan: Plan, least: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): for each block and item the documents that can be among the item's k best."""
    shared = blocks.sparkSession.sparkContext.broadcast((plan, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, least = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                values = {c: batch.column(c)[r].values for c in ("docs", "terms", "starts", "at", "impacts", "joint")}
                block = Block(values["docs"], *(np.asarray(values[c]) for c in ("terms", "starts", "at", "impacts")))
                joint = np.asarray(values["joint"])
                found = [_search_block(block, joint, plan, i, int(least[i]), k) for i in range(len(plan.units))]
                item = np.repeat(np.arange(len(found)), [len(f[0]) for f in found]).astype(np.int32)
                place, score = (np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(item), values["docs"].take(pa.array(place.astype(np.int64))), pa.array(score)], names=["item", "doc_id", "score"])

    return blocks.select("docs", "terms", "starts", "at", "impacts", "joint").mapInArrow(run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """found with rank: each item's k best, equal scores by doc_id, null last."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_set(tables: SharedTables, docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """search() for one set of items, whose rows fit the driver."""
    spark = docs.sparkSession
    held = items.select("item_id", F.col("text").cast("string").alias("text")).toArrow()
    asked = Asked.of(held.column("text").to_pylist())
    counted = tables.write(_counted(docs, asked.hashes), "counted")
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held_in = counted.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
    df = np.zeros(len(asked.hashes), np.int64)
    df[np.asarray(held_in.column("t"))] = np.asarray(held_in.column("count"))
    plan = Plan.of(asked, df, n_docs)
    blocks = tables.write(_blocks(counted, plan, n_docs, n_terms, k), "blocks")
    tables.drop(counted)
    seeds = blocks.select(F.explode(F.arrays_zip("seed_item", "seed_score")).alias("s")).select(F.col("s.seed_item").alias("item"), F.col("s.seed_score").alias("score"), F.lit(0).alias("doc_id"))
    kth = _ranked(seeds, k).where(F.col("rank") == k).select("item", "score").toArrow()
    least = np.ones(len(plan.units), np.int64)
    least[np.asarray(kth.column("item"))] = np.asarray(kth.column("score"))
    names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(held.num_rows, dtype=np.int32)), "item_id": held.column("item_id")}))
    best = _ranked(_search(blocks, plan, np.maximum(least, 1), k), k)
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) of the highest score for each item (item_id, text), best first.

    The score sums, over the item's terms with repeats, weight * ((10^9 * tf) div (1000 * tf + 12 * m)) with
    m = 75 + (25 * n * N) div L and weight = floor(1000 * ln((2N + 2) / (2 df + 1))): N documents with terms, L terms in
    all, n terms of the document, tf its occurrences, df the documents with the term. Documents of score 0 are not listed.
    Equal scores stand by doc_id, null last. Null and empty texts have no terms; every row of items is an item, every row
    of docs a document, whatever ids repeat. Integers have 64 bits: 25 * n * N has to stay under 2^63. A term is its hash
    of 64 bits.

    Items go in sets of bounded bytes, for each of which the documents are read once. Their terms' lists are kept by
    blocks of documents, with the joint maxima of the items' term pairs. A first pass scores the documents that the
    pairs' lists name best; the k-th of these is what a document needs at least. The second pass searches each block by
    MaxScore with the pairs' bounds.
    """
    tables = SharedTables(docs.sparkSession)
    size, many = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    sets = max(1, -(-size // SET_BYTES), -(-many // SET_ITEMS))
    place = F.pmod(F.xxhash64(F.col("item_id").cast("string"), F.col("text").cast("string")), F.lit(sets))
    found = [_search_set(tables, docs, items.where(place == s) if sets > 1 else items, k) for s in range(sets)]
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    return whole
