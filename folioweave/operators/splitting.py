"""Sentences whose periods are told from those of abbreviations, numbers and initials by what the corpus shows of each word."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from folioweave.functions import offsets
from folioweave.sources.tables import SharedTables

#: From which score a word is an abbreviation, and how likely one is followed by a period; from which
#: log-likelihood ratios a word starts sentences, and two words around a period belong together.
LEAST, PERIOD, STARTS, TOGETHER = 0.3, 0.99, 30.0, 7.88

_BARE = r"[^\s.!?,;:()\"']+(?:\.[^\s.!?,;:()\"']+)*"
#: A word (it may hold periods) with the period after it, if one is there; or a mark that may part sentences.
_PIECE = re.compile(_BARE + r"\.?|[.!?\n]")
_MARKS = frozenset(".!?\n")
_LETTER = re.compile(r"[^\W\d_]")
#: What stands for a word without a letter.
NUMBER = "##"
#: How a word begins: without case, in lower case, in upper case.
NONE, LOWER, UPPER = 0, 1, 2
#: Distinct words, and counts, that a task holds before it lets them go.
HELD = 500_000


def _kind(word: str) -> str:
    return word.lower() if _LETTER.search(word) else NUMBER


def _case(word: str) -> int:
    return {"Lu": UPPER, "Ll": LOWER}.get(unicodedata.category(word[0]), NONE)


class _Types(dict):
    """(type, case, whether a period follows) of each piece of a text that was met; None for a mark."""

    def __missing__(self, piece: str) -> tuple[str, int, bool] | None:
        if piece in _MARKS:
            found = None
        else:
            ends = piece.endswith(".")
            found = (_kind(piece[:-1] if ends else piece), _case(piece), ends)
        if len(self) >= HELD:
            self.clear()
        self[piece] = found
        return found


def _walk(text: str, types: _Types, words: list, pairs: list) -> None:
    """Adds (type, case, inside) of each word, and (type, next type, its case) of each word before a period.

    A word is inside a sentence where no period, mark or line break stands before it. The end of a text is the empty type.
    """
    inside, before = False, None
    for piece in _PIECE.findall(text):
        found = types[piece]
        if found is None:
            inside = False
            continue
        kind, case, ends = found
        words.append((kind, case, inside))
        if before is not None:
            pairs.append((before, kind, case))
        before, inside = (kind, False) if ends else (None, True)
    if before is not None:
        pairs.append((before, "", NONE))


def _around(pieces: list[str], types: _Types) -> list[tuple[str, str, int]]:
    """(type, next type, its case) of each word before a period, as in _walk(); looks at no other words."""
    out, last = [], len(pieces)
    for k in [k for k, piece in enumerate(pieces) if piece[-1] == "." and len(piece) > 1]:
        after = k + 1
        while after < last and pieces[after] in _MARKS:
            after += 1
        out.append((types[pieces[k]][0], *(types[pieces[after]][:2] if after < last else ("", NONE))))
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(a, b, case, inside, n): how often words and pairs stand in docs (text), counted in one pass; tasks sum first.

    Rows without b count a word type a by how it begins and whether it stands inside a sentence; the others count the pairs
    of a word before a period and the next word b (empty at the end of a text), by how b begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, words, pairs = _Types(), Counter(), Counter()

        def flush() -> pa.RecordBatch:
            a, case, inside = zip(*words, strict=True) if words else ((), (), ())
            first, b, follows = zip(*pairs, strict=True) if pairs else ((), (), ())
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([*a, *first], pa.string()), pa.array([*[None] * len(a), *b], pa.string()), pa.array([*case, *follows], pa.int32()),
                    pa.array([*inside, *[None] * len(first)], pa.bool_()), pa.array([*words.values(), *pairs.values()], pa.int64()),
                ],
                names=["a", "b", "case", "inside", "n"],
            )
            words.clear()
            pairs.clear()
            return out

        for batch in batches:
            for t in batch.column("text"):
                if text := t.as_py():
                    met: tuple[list, list] = [], []
                    _walk(text, types, *met)
                    words.update(met[0])
                    pairs.update(met[1])
                    if len(words) + len(pairs) > HELD:
                        yield flush()
        yield flush()

    rows = docs.select("text").mapInArrow(run, "a string, b string, case int, inside boolean, n long")
    return rows.groupBy("a", "b", "case", "inside").agg(F.sum("n").alias("n"))


def abbreviations(counted: DataFrame, least: float = LEAST) -> DataFrame:
    """(word, score): the word types of word_counts() that are abbreviations by how they stand before periods.

    The score is the log-likelihood ratio of a period after the word against the corpus's share of periods, weighed by the
    word's shortness, its inner periods and the times it stands without one.
    """
    every = F.sum(F.when(F.col("b").isNull(), F.col("n")).otherwise(0))
    ended = F.sum(F.when(F.col("b").isNotNull(), F.col("n")).otherwise(0))
    words = counted.where(f"a <> '{NUMBER}'").groupBy(F.col("a").alias("word")).agg(every.alias("n"), ended.alias("k"))
    whole = words.agg(F.sum("n").alias("_all"), F.sum("k").alias("_periods"))
    p = F.col("_periods") / F.col("_all")
    out, k = F.col("n") - F.col("k"), F.col("k")
    ratio = 2 * (k * (F.log(F.lit(PERIOD)) - F.log(p)) + out * (F.log(F.lit(1 - PERIOD)) - F.log(1 - p)))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - inner + 1
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -out)
    held = words.where("k > 0").crossJoin(whole).where("_periods < _all")  # one row
    return held.select("word", score.alias("score")).where(F.col("score") >= least)


def association(a: Column, b: Column, both: Column, every: Column) -> Column:
    """The log-likelihood ratio of b's share among a against its share elsewhere; 0 where it is not larger among a.

    a, b, both, every: how often the first stands, the second stands, they stand together, anything stands.
    """

    def log(k: Column, n: Column, p: Column) -> Column:
        part = F.when(k > 0, k * F.log(F.when(p > 0, p))).otherwise(0.0)
        return part + F.when(n - k > 0, (n - k) * F.log(F.when(p < 1, 1 - p))).otherwise(0.0)

    b = F.greatest(b, both)
    rest, out = every - a, b - both
    p, inside = b / every, both / a
    outside = F.when(rest > 0, out / rest).otherwise(0.0)
    ratio = 2 * (log(both, a, inside) + log(out, rest, outside) - log(both, a, p) - log(out, rest, p))
    return F.when(inside > p, ratio).otherwise(0.0)


def continuing(counted: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, case): the pairs of word_counts() around a period that ends no sentence, by how the next word begins.

    A word is bound to start a sentence where it begins in upper case though the corpus has it in lower case, and never in
    upper case inside a sentence; it is bound to go on where it begins in lower case though the corpus has it in upper case,
    or never has it in lower case after a plain word's period. found: abbreviations (word). What ends no sentence is a period

    * between an abbreviation or a number and a word that stands with it far more often than apart from it, and starts no
      sentences: it follows plain words' periods no more often than it stands elsewhere;
    * after an abbreviation that is no initial (one letter), unless the next word is bound to start a sentence, or begins in
      upper case and starts sentences; after an initial that is an abbreviation, always;
    * after an initial or a number, if the next word is bound to go on; after an initial also if it begins in upper case and
      the corpus never has it in lower case.

    A frequent word is one row when it meets its counts.
    """
    single = counted.where("b IS NULL").groupBy("a").agg(
        F.sum("n").alias("n"),
        F.max(F.col("case") == LOWER).alias("lower"),
        F.max(F.col("case") == UPPER).alias("upper"),
        F.max((F.col("case") == UPPER) & F.col("inside")).alias("inner"),
    )
    total = single.agg(F.sum("n").alias("_all"))
    pairs = counted.where("b IS NOT NULL").join(found.select(F.col("word").alias("a"), F.lit(True).alias("_short")), "a", "left")
    pairs = pairs.withColumns({"_short": F.coalesce("_short", F.lit(False)), "_number": F.col("a") == NUMBER, "_initial": F.length("a") == 1})
    breaks = pairs.where("NOT (_short OR _number OR _initial) AND b <> ''").groupBy("b").agg(F.sum("n").alias("both"), F.max(F.col("case") == LOWER).alias("begins"))
    ends = breaks.agg(F.sum("both").alias("_ends"))
    following = single.select(F.col("a").alias("b"), F.col("n").alias("nb"), "lower", "upper", "inner")
    # one row each: all words, all ends of sentences
    next_words = following.join(breaks, "b", "left").crossJoin(total).crossJoin(ends)
    starts = F.coalesce(association(F.col("_ends"), F.col("nb"), F.col("both"), F.col("_all")) >= STARTS, F.lit(False)) & (F.col("b") != NUMBER)
    next_words = next_words.select("b", "nb", "lower", "upper", "inner", F.coalesce("begins", F.lit(False)).alias("begins"), starts.alias("_starts"))
    candidates = pairs.where("_short OR _number OR _initial").groupBy("a", "b", "_short", "_number", "_initial").agg(F.sum("n").alias("both"), F.collect_set("case").alias("cases"))
    named = candidates.join(single.select("a", F.col("n").alias("na")), "a").join(next_words, "b", "left").crossJoin(total)
    together = F.coalesce(association(F.col("na"), F.col("nb"), F.col("both"), F.col("_all")) >= TOGETHER, F.lit(False))
    named = named.withColumn("_together", together & F.expr("(_short OR _number) AND b <> '' AND NOT _starts"))
    # the end of a text is no word: nothing is known of it
    known = {c: F.coalesce(c, F.lit(False)) for c in ("lower", "upper", "inner", "begins", "_starts")}
    named = named.withColumns(known).withColumn("case", F.explode("cases"))
    up, low = f"case = {UPPER}", f"case = {LOWER}"
    first, later = f"({up} AND lower AND NOT inner)", f"({low} AND (upper OR NOT begins))"
    goes_on = f"""_together OR (_short AND (_initial OR NOT ({first} OR ({up} AND _starts))))
        OR ((_initial OR _number) AND ({later} OR (_initial AND {up} AND NOT lower)))"""
    return named.where(goes_on).select("a", "b", "case")


#: A line break before the next word; the next word; what stands before the last one and the periods before that.
_BREAK = re.compile(r"[^\S\n]*\n")
_NEXT = re.compile(_BARE)
_UPTO = re.compile(r"(?s:.*)[\s!?,;:()\"']")
#: Characters after a period in which the next word is looked for, and of the longest word before one.
AHEAD, BEHIND = 200, 201


def _goes_on(text: str, start: int, at: int, held: frozenset[tuple[str, str, int]]) -> bool:
    """Whether the period that ends at `at`, in a sentence from start, stands in a held pair; one after no word does not."""
    if not held:
        return False
    start = max(start, at - BEHIND)
    before = _UPTO.match(text, start, at - 1)
    word = text[before.end() if before else start : at - 1].rsplit("..", 1)[-1].lstrip(".")
    if not word or word.endswith(".") or len(word) == BEHIND - 1:
        return False
    found = _NEXT.search(text, at, at + AHEAD)
    if not found and len(text) - at > AHEAD:
        return False
    return (_kind(word), *((_kind(found[0]), _case(found[0])) if found else ("", NONE))) in held


def _joined(text: str, held: frozenset[tuple[str, str, int]]) -> Iterator[offsets.Span]:
    """Sentences, put together where a period stands in a word, or before no line break in one of the held pairs."""
    start = end = None
    for a, b, body in offsets.find_sentences(text):
        start, end = a if start is None else start, b
        if body.endswith("."):
            if not text[b : b + 1].isspace() or (not _BREAK.match(text, b) and _goes_on(text, start, b, held)):
                continue
        yield start, end, text[start:end].strip()
        start = None
    if start is not None:
        yield start, end, text[start:end].strip()


_PAIRS = ArrayType(StructType([StructField("a", StringType()), StructField("b", StringType()), StructField("case", IntegerType())]))


@arrow_udf(_PAIRS)
def _pairs(texts: pa.Array) -> pa.Array:
    types, out = _Types(), []
    for t in texts:
        pairs = set(_around(_PIECE.findall(t.as_py() or ""), types))
        out.append([{"a": a, "b": b, "case": case} for a, b, case in pairs])
    return pa.array(out, pa.list_(pa.struct([("a", pa.string()), ("b", pa.string()), ("case", pa.int32())])))


@arrow_udf(offsets.SPANS)
def _spans(texts: pa.Array, held: pa.Array) -> pa.Array:
    sets = (frozenset((p["a"], p["b"], p["case"]) for p in h or ()) for h, t in zip(held.to_pylist(), texts, strict=True) if t.is_valid)
    return offsets.listed(texts, lambda t: _joined(t, next(sets)))


def learned_sentences(docs: DataFrame, key: str, found: DataFrame | None = None) -> DataFrame:
    """key, span_idx, start, end, text: sentences of docs (key, text); the periods of continuing() end none.

    found: abbreviations (word), by default those that docs show. A document gets the pairs that stand in it by a join, so
    there may be any number; a null key is one like any other. A period whose next word is over AHEAD characters away, or
    whose word has BEHIND - 1 or more, ends a sentence.
    """
    tables = SharedTables(docs.sparkSession)
    counted = tables.write(word_counts(docs), "counted")
    found = tables.write(abbreviations(counted) if found is None else found, "abbreviations")
    known = tables.write(continuing(counted, found), "continuing")
    own = docs.select(F.col(key).alias("_key"), F.explode(_pairs("text")).alias("p")).select("_key", "p.*").join(known, ["a", "b", "case"], "left_semi")
    sets = own.groupBy("_key").agg(F.collect_set(F.struct("a", "b", "case")).alias("_held"))
    spans = docs.select(key, "text").join(sets, F.col(key).eqNullSafe(F.col("_key")), "left")
    spans = spans.select(key, F.posexplode(_spans("text", "_held")).alias("span_idx", "s"))
    return spans.select(key, "span_idx", "s.start", "s.end", "s.text")
