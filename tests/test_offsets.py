"""Offsets, tags and sections against plain Python, on random texts and on very long ones."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioweave.functions import context as C
from folioweave.functions import offsets
from folioweave.functions import rewards as R
from folioweave.functions import text as T


def plain_sentences(text):
    out, at = [], 0
    for piece in re.findall(r"(?:[^.!?\n]*[.!?\n]|[^.!?\n]+\Z)\s*", text):
        core = re.match(r"[^.!?\n]*[.!?]?", piece)[0]
        if core.strip():
            out.append((at, at + len(core), core.strip()))
        at += len(piece)
    return out


def plain_documents(text):
    at = [m.start() for m in re.finditer(r"\[DOC\s+(?:\d+|\w+)\]", text)]
    return [(a, b, text[a:b]) for a, b in zip(at, [*at[1:], len(text)], strict=True)] if at else [(0, len(text), text)]


def texts(parts, seed, n=400):
    rnd = random.Random(seed)
    return ["", *("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(n))]


def values(spark, rows, *columns):
    frame = spark.createDataFrame(list(enumerate(rows)), "k int, t string").repartition(3)
    return [tuple(r)[1:] for r in frame.select("k", *columns).orderBy("k").collect()]


SAID = [" ", "\n", ".", "!?", "a", "é", "😀", " ", "\xa0", "\x1c", "[DOC 1]", "[DOC\xa02]", "[DOC x_y]", "[DOC ]", "b c", "\t"]


def test_pieces_equal_plain_python(spark):
    rows = [*texts(SAID, 1), None]
    for found, t in zip(values(spark, rows, offsets.sentences(F.col("t")), offsets.documents(F.col("t"))), rows, strict=True):
        if t is None:
            assert found == (None, None)
        else:
            assert [tuple(s) for s in found[0]] == plain_sentences(t) and [tuple(s) for s in found[1]] == plain_documents(t), t


@pytest.mark.parametrize("find, piece", [(offsets.find_sentences, "So it is. "), (offsets.find_documents, "[DOC 7] x ")])
def test_a_million_pieces_in_one_text(find, piece):
    found = offsets.listed(pa.array([piece * 1_000_000, None, "x"]), find)
    assert found.value_lengths().to_pylist() == [1_000_000, None, 1]
    assert found[0].values[999_999].as_py()["start"] == 10 * 999_999


def test_numbers_of_any_length(spark):
    """A number that is no 32 bits long is null where a document is numbered; tags keep it, order goes by it."""
    big = "99999999999"
    text = f"[DOC {big}] a b [DOC 7] c [DOC {'9' * 60}] d [20240101123456] [{'9' * 60}] [3]"
    row = values(spark, [text], C.parse(F.col("t")), C.tag_number(F.lit(f"[DOC {big}]")), T.citation_refs(F.col("t")))[0]
    assert [d.doc_id for d in row[0]] == [None, 7, None] and row[0][0].content == "a b" and row[1] is None
    assert row[2] == [20240101123455, 2**63 - 2, 2]
    tags = [f"[DOC {'9' * 60}]", "[DOC 10]", f"[DOC {big}]", "[DOC 9]", "none", "[DOC 0009]"]
    found = values(spark, [""], C.sort_tags(F.array(*map(F.lit, tags))))[0][0]
    assert found == sorted(tags, key=lambda t: int((re.search(r"\d+", t) or ["0"])[0]))


SECTION = ["Relevant documents:", "relevant Documents:\n", " ", "\n", " ", "\xa0", "[DOC 1]", "[DOC\xa02]", "[DOC  03]", "[DOC 99999999999]", "[DOC ٣]", "[doc 4]", "x y", "AD", "The answer is:", "the answer is: z.", "\r", "Quote 1: 'a b'", "Document 2:\xa0\"cd\"", "Relevant Document IDs:"]


def plain_section(text):
    m = re.search(r"Relevant documents:\s*(.*?)(?=The answer is:|$)", text, re.DOTALL | re.IGNORECASE)
    section = m[1] if m else ""
    parts = re.split(r"\[DOC\s+(\d+)\]\s*", section)
    docs = [(f"[DOC {int(n)}]", body.strip()) for n, body in zip(parts[1::2], parts[2::2], strict=True) if body.strip()]
    has = lambda p, s, f=0: bool(re.search(p, s, f))
    form = [has("Relevant documents:", text, re.I), has(r"\[DOC\s+\d+\]", section), has(r"\[DOC\s+\d+\]\s*\S", section), has("The answer is:", text, re.I)]
    quoted = [has(r"(?:Quote|Passage|Document|Extract|Reference)\s+\d+:\s*[\"'][^\"']+[\"']", text, re.I), has(r"Relevant Document IDs?:", text, re.I), form[3]]
    return docs, sum(form) / 4, sum(quoted) / 4


@pytest.mark.parametrize("seed", range(3))
def test_sections_equal_plain_python(spark, seed):
    rows = texts(SECTION, seed, 1500)
    none = F.array().cast("array<string>")
    found = values(spark, rows, R.section_docs(F.col("t")), R.document_format(F.col("t")), R.quote_format(F.col("t"), none))
    for (docs, form, quoted), t in zip(found, rows, strict=True):
        assert ([tuple(d) for d in docs], form, quoted) == plain_section(t), repr(t)


@pytest.mark.parametrize("seed", range(2))
def test_tags_equal_plain_python(spark, seed):
    rows = texts([*SAID, "[doc 5]", "[DOC 5", "]", "[DOC 5]"], seed, 1500)
    for (found,), t in zip(values(spark, rows, C.tags_in(F.col("t"))), rows, strict=True):
        assert found == list(dict.fromkeys(m[0] for m in re.finditer(r"\[DOC\s+[^\]]+?\]", t, re.I))), repr(t)
