"""Token counts of the sections of documents: one encoding per document, tokens mapped by their offsets."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.shared import pieces, text_or_empty

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: To which section a token goes that stands in several: that of its first byte, of its last, or of most of its bytes
#: (of equal ones the first).
RULES = ("first", "last", "most")

#: White space of that pattern, in runs that its matcher had better not see: it takes a run back character by character.
_BLANK_RUN = re.compile("[\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")

_encoders: dict[tuple[int, str], tuple] = {}


def encoder(ranks_file: bytes, pattern: str = PATTERN):
    """(encode: text -> tokens, bytes of each token) of a vocabulary file's content, made once in a process."""
    key = zlib.crc32(ranks_file), pattern
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, k in ranks.items():
            size[k] = len(piece)
        encoding = tiktoken.Encoding("folioweave", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _encoders[key] = partial(encode_whole, encoding, pattern == PATTERN), size
    return _encoders[key]


def encode_whole(encoding, cut: bool, text: str) -> list[int]:
    """The text's tokens. With `cut` (PATTERN), runs of 10,000 blanks or more are taken out of the matcher's hands.

    Such a run is a piece of its own but for its last character, which goes with what follows it; at the end of the text
    all of it is one piece. No piece of the pattern has a blank after another character, so the parts can be encoded apart.
    """
    if not cut:
        return encoding.encode_ordinary(text)
    out, at = [], 0
    for m in _BLANK_RUN.finditer(text):
        end = m.end() - (m.end() < len(text))
        out += encoding.encode_ordinary(text[at : m.start()])
        out += encoding._encode_single_piece(text[m.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing) of each section. Sections are [bounds[i], bounds[i + 1]); tokens [starts, ends), in bytes.

    An interval join of two sorted lists, by binary search. crossing counts the section's tokens that stand in others too.
    """
    n = len(bounds) - 1
    first = np.clip(np.searchsorted(bounds, starts, "right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(bounds, ends - 1, "right") - 1, 0, n - 1)
    home = first if rule == "first" else last
    if rule == "most":
        home = first.copy()
        for t in np.flatnonzero(first < last).tolist():
            parts = np.minimum(bounds[first[t] + 1 : last[t] + 2], ends[t]) - np.maximum(bounds[first[t] : last[t] + 1], starts[t])
            home[t] += int(parts.argmax())
    return np.bincount(home, minlength=n), np.bincount(home[first < last], minlength=n)


def lines(data: np.ndarray) -> np.ndarray:
    """Bounds of the lines of a text, each with its line break; an empty text is one empty line."""
    ends = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))])


def section_tokens(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rule: str = "first", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """keep, section (from 0), start and end (code points, end exclusive), n_tokens, n_crossing: a row per line.

    Each whole document is encoded once, so the sections' tokens sum to the document's. A token of several lines goes
    to one by `rule`. A null or empty text is one empty section without tokens.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    source = docs.select(*keep, text_or_empty("text").alias("_text"))
    with open(vocabulary, "rb") as ranks:  # the driver's file, under a megabyte; executors get its content
        shared = docs.sparkSession.sparkContext.broadcast(ranks.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = encoder(shared.value, pattern)
        for batch in pieces(batches, "_text"):
            at, columns = [], [[], [], [], [], []]
            for i, t in enumerate(batch.column("_text").to_pylist()):
                data = np.frombuffer(t.encode(), np.uint8)
                ends = np.cumsum(size[np.array(encode(t), np.int64)]) if t else np.zeros(0, np.int64)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                bounds = lines(data)
                counts, crossing = attribute(starts, ends, bounds, rule)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
                at.append(np.full(len(counts), i))
                for c, v in zip(columns, (np.arange(len(counts)), chars[:-1], chars[1:], counts, crossing), strict=True):
                    c.append(v)
            take = pa.array(np.concatenate(at))
            arrays = [pa.array(np.concatenate(c).astype(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in keep), *arrays],
                names=[*keep, "section", "start", "end", "n_tokens", "n_crossing"],
            )

    zero = F.lit(0).cast("long")
    like = source.drop("_text").withColumns({c: zero for c in ("section", "start", "end", "n_tokens", "n_crossing")})
    return source.mapInArrow(run, like.schema)
