"""Lengths and cuts of texts in a model's byte-pair tokens: merges by rank, with the characters that each token ends at."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: A file with a line per token: its bytes in base64, and its rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that parts a text before its bytes are merged, for that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Where the tokens of a piece end: the neighbours of the lowest rank are merged first, of equal ones the left.

    A heap holds the pairs; one that a merge has changed is passed over. Time is that of a sort, however long the piece.
    """
    n = len(piece)
    if piece in ranks or n < 2:
        return [n]
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (rank := ranks.get(piece[i : end[after[i]]])) is not None:
            heap.append((rank, i, end[after[i]]))

    for i in range(n - 1):
        offer(i)
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, upto = heapq.heappop(heap)
        if gone[i] or after[i] < 0 or end[after[i]] != upto:
            continue
        j = after[i]
        gone[j], end[i], after[i] = 1, upto, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] >= 0 and (rank := ranks.get(piece[k : end[after[k]]])) is not None:
                heapq.heappush(heap, (rank, k, end[after[k]]))
    return [end[i] for i in range(n) if not gone[i]]


class Encoder:
    """A vocabulary's ranks and pattern; pieces that come often are merged once."""

    def __init__(self, content: bytes, pattern: str = PATTERN):
        ranks, self.pattern = read_ranks(content), regex.compile(pattern)
        self.merged = lru_cache(1 << 17)(lambda piece: merge(piece, ranks))

    def counts(self, text: str) -> int:
        return sum(len(self.merged(p) if len(p) < 64 else self.merged.__wrapped__(p)) for p in (m[0].encode() for m in self.pattern.finditer(text)))

    def cut(self, text: str, most: int) -> str:
        """The whole characters of the text's first `most` tokens."""
        n = 0
        for m in self.pattern.finditer(text):
            piece = m[0].encode()
            ends = self.merged(piece)
            if n + len(ends) > most:
                return text[: m.start()] + piece[: ends[most - n - 1] if most > n else 0].decode(errors="ignore")
            n += len(ends)
        return text


_encoders: dict[tuple[int, str], Encoder] = {}


def _encoder(content: bytes, pattern: str) -> Encoder:
    """Made once in a process."""
    key = hash(content), pattern
    if key not in _encoders:
        _encoders[key] = Encoder(content, pattern)
    return _encoders[key]


class Tokens:
    """Columns by a vocabulary that the driver reads and sends to the tasks (its size is a file's)."""

    def __init__(self, rows: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        with open(vocabulary, "rb") as f:
            self.shared = rows.sparkSession.sparkContext.broadcast((f.read(), pattern))

    def count(self, text: Column) -> Column:
        """Number of tokens; null for null."""
        shared = self.shared

        @F.arrow_udf(LongType())
        def run(texts: pa.Array) -> pa.Array:
            e = _encoder(*shared.value)
            return pa.array([None if t is None else e.counts(t) for t in texts.to_pylist()], pa.int64())

        return run(text)

    def counted(self, rows: DataFrame, text: str, name: str) -> DataFrame:
        """rows with count() of a column that is itself made of a Python column, which Spark does not chain."""
        shared = self.shared
        kept = rows.drop(name)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            e = _encoder(*shared.value)
            for batch in batches:
                n = [None if t is None else e.counts(t) for t in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, name])

        return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(name, LongType())]))

    def truncated(self, text: Column, most: int, buffer: int = 512) -> Column:
        """struct<before, text, after>: tokens before; the text, of more than `most` tokens cut to the characters of its first
        most - buffer; the tokens of what is left."""
        shared = self.shared

        @F.arrow_udf(StructType([StructField("before", LongType()), StructField("text", StringType()), StructField("after", LongType())]))
        def run(texts: pa.Array) -> pa.Array:
            e = _encoder(*shared.value)
            out = []
            for t in texts.to_pylist():
                n = None if t is None else e.counts(t)
                kept = t if n is None or n <= most else e.cut(t, most - buffer)
                out.append((n, kept, n if kept == t else e.counts(kept)))
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64()), strict=True)]
            return pa.StructArray.from_arrays(arrays, names=["before", "text", "after"], mask=pa.array(np.array([o[1] is None for o in out], bool)))

        return run(text)
