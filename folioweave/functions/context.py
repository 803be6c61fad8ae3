"""Numbered document contexts: `[DOC i]` blocks as text, and as arrays of struct<doc_id, content>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioweave.functions import offsets
from folioweave.functions.text import DIGIT, SPACE, ascii_digits, let, strip, word_count

# How a document is marked.
MARKER = rf"\[DOC ({DIGIT}+)\]{SPACE}*"
TAG = rf"(?i)\[DOC{SPACE}+[^\]]+?\]"
DOCS = "array<struct<doc_id:int,content:string>>"


def tag(doc_id: Column) -> Column:
    return F.concat(F.lit("[DOC "), doc_id.cast("string"), F.lit("]"))


def render(docs: Column) -> Column:
    """struct<doc_id, content> array to text: tag, line break, content, blank line."""
    return F.array_join(F.transform(docs, lambda d: F.concat(tag(d["doc_id"]), F.lit("\n"), d["content"], F.lit("\n\n"))), "")


def number(texts: Column) -> Column:
    """An array of texts as documents from 0."""
    return F.transform(texts, lambda t, i: F.struct(i.alias("doc_id"), t.alias("content"))).cast(DOCS)


def numbered_bodies(context: Column) -> Column:
    """array<struct<number, content>>: each document's number as it is written, in ASCII digits, and its stripped text."""
    ids = F.regexp_extract_all(context, F.lit(MARKER), 1)
    bodies = F.slice(F.split(context, MARKER, -1), F.lit(2), F.size(F.split(context, MARKER, -1)))
    return F.transform(F.arrays_zip(ids.alias("i"), bodies.alias("b")), lambda z: F.struct(ascii_digits(z["i"]).alias("number"), strip(z["b"]).alias("content")))


def parse(context: Column) -> Column:
    """The documents of a context; empty ones stay, text before the first marker goes. Linear: ids and bodies zipped.

    A number of 2^31 or more, which no context of ours has, is null; its document stays.
    """
    return F.transform(numbered_bodies(context), lambda z: F.struct(z["number"].try_cast("int").alias("doc_id"), z["content"])).cast(DOCS)


def bounds(text: Column) -> Column:
    """array<struct<start, end, text>> of the documents with their tags; without a tag the whole text is one."""
    return offsets.documents(text)


def gold_span(text: Column, doc_id: Column, content: Column) -> Column:
    """struct<start, end> of a rendered document: its exact block, else from its tag to the next one; null if absent."""
    block = F.concat(tag(doc_id), F.lit("\n"), content)
    exact, head = F.instr(text, block), F.instr(text, tag(doc_id))
    rest = F.substr(text, head + F.length(tag(doc_id)), F.length(text))
    upto = F.coalesce(F.nullif(F.regexp_instr(rest, F.lit(r"\[DOC ")), F.lit(0)) - 1, F.length(rest))
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return F.when(exact > 0, span(exact - 1, exact - 1 + F.length(block))).when(head > 0, span(head - 1, head - 1 + F.length(tag(doc_id)) + upto))


def tag_number(value: Column) -> Column:
    """The number of a `[DOC n]` tag, null for anything else and for 2^31 or more."""
    return ascii_digits(F.regexp_extract(value, rf"\A\[DOC ({DIGIT}+)\]", 1)).try_cast("int")


def tag_numbers(tags: Column) -> Column:
    """Numbers of the tags, others dropped; order and repeats stay."""
    return F.filter(F.transform(tags, tag_number), lambda n: n.isNotNull())


def tags_in(text: Column) -> Column:
    """Every tag in a text, each once, in order; any case, numeric or not."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TAG), 0))


def sort_tags(tags: Column) -> Column:
    """By number, of any length; tags without one count as 0."""
    digits = lambda t: F.ltrim(ascii_digits(F.regexp_extract(t, f"({DIGIT}+)", 1)), F.lit("0"))
    n = lambda t: let(digits(t), lambda d: F.struct(F.length(d).alias("n"), d.alias("d")))
    return F.array_sort(tags, lambda a, b: F.when(n(a) < n(b), -1).when(n(a) > n(b), 1).otherwise(0))


def clean(docs: Column, gold: Column, min_words: int = 10) -> Column:
    """struct<docs, gold>: documents of min_words or more, and all gold ones, numbered anew; gold numbers follow.

    gold is an array of document numbers whose order and repeats stay; numbers of no document go.
    """
    def made(kept: Column, tags: Column) -> Column:
        old = F.transform(kept, lambda d: d["doc_id"])
        new = let(old, lambda o: F.filter(F.transform(tags, lambda g: F.array_position(o, g).cast("int") - 1), lambda n: n >= 0))
        return F.struct(number(F.transform(kept, lambda d: d["content"])).alias("docs"), new.alias("gold"))

    stays = lambda d, tags: (word_count(d["content"]) >= min_words) | F.array_contains(tags, d["doc_id"])
    return let(gold, lambda tags: let(F.filter(docs, lambda d: stays(d, tags)), lambda kept: made(kept, tags)))
