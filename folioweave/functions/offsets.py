"""Where the pieces of a text stand: one pass over the text, in Arrow batches, in time of its length.

Offsets are code points, end exclusive. A text has any number of pieces; none is copied to add another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: What each function gives: array<struct<start, end, text>>.
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("text", StringType())]))

_SENTENCE = re.compile(r"([^.!?\n]*[.!?]?)\s*")
_BOUND = re.compile(r"\[DOC\s+\w+\]")

Span = tuple[int, int, str]


def find_sentences(text: str) -> Iterator[Span]:
    """Parted after . ! ? or before a line break; text is stripped, and what strips to nothing is no sentence."""
    for m in _SENTENCE.finditer(text):
        if body := m[1].strip():
            yield m.start(), m.end(1), body


def find_documents(text: str) -> Iterator[Span]:
    """From each tag to the next one; without a tag the whole text is one."""
    at = [m.start() for m in _BOUND.finditer(text)] or [0]
    for a, b in zip(at, [*at[1:], len(text)], strict=True):
        yield a, b, text[a:b]


#: Characters of texts whose spans are held as Python objects at once.
HELD = 1 << 18


def listed(texts: pa.Array, find: Callable[[str], Iterator[Span]]) -> pa.Array:
    """A list of spans for each text, null for null. Spans go to flat arrays before many texts' are held as objects."""
    parts, upto, n, held = [], [0], 0, 0
    starts, ends, bodies = [], [], []

    def flush() -> None:
        parts.append(pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(bodies, pa.string())], names=["start", "end", "text"]))
        for x in (starts, ends, bodies):
            x.clear()

    for text in texts:
        if (t := text.as_py()) is not None:
            for a, b, body in find(t):
                starts.append(a)
                ends.append(b)
                bodies.append(body)
                n += 1
            held += len(t)
            if held > HELD:
                flush()
                held = 0
        upto.append(n)
    flush()
    return pa.ListArray.from_arrays(pa.array(np.array(upto, np.int32)), pa.concat_arrays(parts), mask=texts.is_null() if texts.null_count else None)


@arrow_udf(SPANS)
def _sentences(texts: pa.Array) -> pa.Array:
    return listed(texts, find_sentences)


@arrow_udf(SPANS)
def _documents(texts: pa.Array) -> pa.Array:
    return listed(texts, find_documents)


def sentences(text: Column) -> Column:
    """array<struct<start, end, text>> of the sentences, see find_sentences."""
    return _sentences(text)


def documents(text: Column) -> Column:
    """array<struct<start, end, text>> of the documents with their tags, see find_documents."""
    return _documents(text)
