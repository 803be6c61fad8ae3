"""The trie of conversations' shared openings, built by truncation peeling from the deepest turn up."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.mixing import word_count
from folioweave.llm.shared import SharedTables, text_or_empty

#: Levels with so many nodes at most, together, are peeled in one step: a few very long conversations cost no job for each
#: of their turns. The bound holds for the step, so for every group in it.
BLOCK = 4096
#: Bytes of joined ids that are handed on in one row.
PIECE = 1 << 16

_TURN = "struct<a:bigint,b:bigint,words:bigint>"
_STATE = f"path array<{_TURN}>, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long"


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): a row per conversation; path has each turn's two hashes of role and text, and its words, by turn.

    Turns without a number stand first; turns of equal number stand by their hashes. A null role or text is empty. Turns
    without a conv_id belong to no conversation. Texts stay where they are: 24 bytes a turn are gathered.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").isNotNull().alias("_known"), F.coalesce("turn", F.lit(0)).alias("_turn"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), word_count("text").alias("words"),
    )
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_known", "_turn", "a", "b", "words"))).alias("_turns"))
    return listed.select("conv_id", F.transform("_turns", lambda t: F.struct(t.a.alias("a"), t.b.alias("b"), t.words.alias("words"))).alias("path"))


def share_openings(found: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """paths() of conversations that open as the one whose id is theirs rounded down to a multiple of `every`.

    The first h turns of that one (all if it has fewer, none if there is no such conversation) stand before a
    conversation's own turns but its first h, with h = crc32(conv_id as text) modulo `most`.
    """
    own = found.withColumns({"_from": F.col("conv_id") - F.col("conv_id") % every, "_h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")})
    heads = found.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_from"), F.slice("path", 1, most - 1).alias("_head"))
    head = F.slice(F.coalesce("_head", F.array().cast(f"array<{_TURN}>")), F.lit(1), F.col("_h"))
    tail = F.filter("path", lambda _, i: i >= F.col("_h"))
    return own.join(heads, "_from", "left").select("conv_id", F.concat(head, tail).alias("path"))


def _finished(partial: DataFrame) -> DataFrame:
    """Nodes from what was gathered of each: a node without children is a leaf, and its own turn saves its repeats."""
    words = F.coalesce(F.try_element_at("path", F.lit(-1)).getField("words"), F.lit(0).cast("long"))
    return partial.select(
        "path", "n_convs", "conv_id", "n_children", F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * words).alias("saved_tokens"),
    )


def _regroup(rows: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    return rows.groupBy("path").agg(sums[0], F.min("conv_id").alias("conv_id"), *sums[1:])


def _stripped(nodes: DataFrame) -> DataFrame:
    """What nodes tell their parents."""
    parent = F.filter("path", lambda _, i: i < F.size("path") - 1)
    return nodes.select(parent.alias("path"), "n_convs", "conv_id", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")


def _peel_block(rows: DataFrame, low: int) -> DataFrame:
    """The nodes deeper than low, from rows of all of them: each group, the rows under one node of depth low, is peeled whole."""

    def peel(group: pa.Table) -> pa.Table:
        levels: dict[int, dict[tuple, list[int]]] = defaultdict(dict)

        def add(path: tuple, n: int, conv: int, children: int, leaves: int, saved: int) -> None:
            node = levels[len(path)].setdefault(path, [0, conv, 0, 0, 0])
            node[:] = [node[0] + n, min(node[1], conv), node[2] + children, node[3] + leaves, node[4] + saved]

        for row in group.to_pylist():
            path = tuple((t["a"], t["b"], t["words"]) for t in row["path"])
            add(path, *(row[c] for c in ("n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens")))
        done = []
        for depth in range(max(levels), low, -1):
            for path, (n, conv, children, leaves, saved) in levels[depth].items():
                leaves, saved = leaves if children else 1, saved + (n - 1) * path[-1][2]
                done.append(([dict(zip(("a", "b", "words"), t, strict=True)) for t in path], n, conv, children, leaves, saved))
                if depth > low + 1:
                    add(path[:-1], n, conv, 1, leaves, saved)
        columns = list(zip(*done, strict=True))
        turn = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("words", pa.int64())])
        return pa.table(
            [pa.array(columns[0], pa.list_(turn)), *(pa.array(c, pa.int64()) for c in columns[1:])],
            names=["path", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens"],
        )

    return rows.groupBy(F.xxhash64(F.slice("path", 1, low)).alias("_under")).applyInArrow(peel, _STATE)


def _steps(ended: dict[int, int], block: int) -> list[tuple[int, int]]:
    """(high, low): the steps of the descent, each from depth high to just above low.

    ended: distinct conversations by their length. The conversations of length d or more bound the nodes of depth d; levels
    are taken together while their bounds add up to a block, the last two levels by themselves.
    """
    steps, high, open_ = [], max(ended), 0
    while high >= 0:
        open_ += ended.get(high, 0)
        low, total = high - 1, open_
        while low > 1 and total + (more := open_ + ended.get(low, 0)) <= block:
            total, open_, low = total + more, more, low - 1
        steps.append((high, low))
        high = low
    return steps


def _digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) from (k1, k2, conv_id): SHA-256 of each node's ids, ascending and parted by commas.

    Ids are sorted by ranges, so a node with very many spreads over tasks; each joins its part into long strings, and only
    those, in order, meet where the node's digest is taken. No list of a node's ids stands in memory.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, ids = (np.asarray(batch.column(c)) for c in ("k1", "k2", "conv_id"))
            edges = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
            cuts = np.unique(np.concatenate([edges, np.arange(0, len(ids), PIECE // 16)]))
            text = [",".join(map(str, part.tolist())) for part in np.split(ids, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(k1[cuts]), pa.array(k2[cuts]), pa.array(ids[cuts]), pa.array(text)], names=["k1", "k2", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if at == (k1, k2):
                    sha.update(b",")
                else:
                    if at:
                        done.append((*at, sha.hexdigest()))
                    at, sha = (k1, k2), hashlib.sha256()
                sha.update(ids.encode())
            yield _digest_rows(done)
        if at:
            yield _digest_rows([(*at, sha.hexdigest())])

    spread = ends.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    pieces = spread.mapInArrow(join, "k1 long, k2 long, first long, ids string")
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    k1, k2, sha = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sha, pa.string())], names=["k1", "k2", "ends_sha256"])


def _keys(path: str, names: tuple[str, str], cut: int = 0) -> list:
    """Two hashes of a path but its last `cut` turns."""
    kept = F.filter(path, lambda _, i: i < F.size(path) - cut) if cut else F.col(path)
    return [F.xxhash64(F.lit(k), kept).alias(n) for k, n in enumerate(names)]


def prefix_trie(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per node of the trie of paths(): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a sequence of d turns (128 bits of hash stand for each role and text) that a conversation opens with; conv_id
    is the smallest of those conversations, n_convs their number. The descent starts at the deepest turn: the conversations
    that end at a depth meet the nodes that survive from below, strip of their last turn and regrouped by what is left,
    so every node is found and its subtree is summed in the same pass. Equal conversations meet before the descent, sums
    combine before each shuffle: a common opening is a row for each task. Conversations without turns are at the root;
    without conversations there is no node. The root has no parent.
    """
    tables = SharedTables(found.sparkSession)
    found = tables.write(found, "paths")
    none = [F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    ended = tables.write(
        found.groupBy("path").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).select("path", "n_convs", "conv_id", *none, F.size("path").alias("depth")), "ended"
    )
    lengths = {r.depth: r["count"] for r in ended.groupBy("depth").count().collect()}
    levels = []
    for high, low in _steps(lengths, block) if lengths else []:
        rows = ended.where(F.col("depth").between(low + 1, high)).drop("depth")
        if levels:
            rows = rows.unionByName(_stripped(levels[-1].where(F.size("path") == high + 1)))
        peeled = _finished(_regroup(rows)) if low == high - 1 else _peel_block(rows, low)
        levels.append(tables.write(peeled, f"level{high}"))
    nodes = ended.drop("depth")  # empty, if no level is there
    for k, level in enumerate(levels):
        nodes = nodes.unionByName(level) if k else level
    nodes = nodes.withColumn("depth", F.size("path").cast("long"))
    nodes = tables.write(nodes.select(*_keys("path", ("k1", "k2")), *_keys("path", ("p1", "p2"), 1), *[c for c in nodes.columns if c != "path"]), "nodes")
    tables.drop(*levels)
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    ends = _digests(found.select(*_keys("path", ("k1", "k2")), "conv_id"))
    return (
        nodes.join(parents, ["p1", "p2", "depth"], "left").join(ends, ["k1", "k2"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    )
