"""Rewards of model outputs, as columns. The contract of a reward: (output, truth, gold arrays) to double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioweave.functions import arrow
from folioweave.functions import context as C
from folioweave.functions import overlap as O
from folioweave.functions import text as T

# Weights, thresholds and section patterns of the rewards.
QUOTE_WEIGHTS = {"quote": 1.0, "coverage": 1.0, "id": 1.0, "answer": 1.0, "format": 0.2, "length": 0.1}
CONTENT_WEIGHTS = {"id": 1.5, "content": 1.0, "answer": 2.0, "format": 0.3, "irrelevant": 0.3}
MATCH, LONG_QUOTE, MOST_QUOTES = 0.8, 30, 10
SECTION = rf"(?isud)Relevant documents:{T.SPACE}*(.*?)(?=The answer is:|$)"
QUOTED = rf"(?iu)(?:Quote|Passage|Document|Extract|Reference){T.SPACE}+{T.DIGIT}+:{T.SPACE}*[\"'][^\"']+[\"']"
TAGGED = rf"\[DOC{T.SPACE}+({T.DIGIT}+)\]"


def _answered(output: Column, truth: Column) -> Column:
    return F.coalesce(O.substring_match(T.last_answer(output), truth), F.lit(False)).cast("double")


def answer_only(output: Column, truth: Column) -> Column:
    """1 if the last stated answer holds the truth."""
    return _answered(output, truth)


def answer_and_ids(output: Column, truth: Column, gold_tags: Column) -> Column:
    """Answer plus F1 of the tags named; 0 without a stated answer."""
    both = _answered(output, truth) + O.set_scores(C.tags_in(output), gold_tags)["f1"]
    return F.when(T.last_answer(output).isNull(), 0.0).otherwise(both)


def greedy_matches(left: Column, right: Column, threshold: float = MATCH) -> Column:
    """Number of pairs of the one-to-one matching that takes the best fuzzy scores first; ties go by position.

    Only pairs at or above the threshold are taken. What a text is compared by is made once, not for every pair.
    """
    return arrow.greedy_pairs(threshold)(*(F.transform(texts, F.lower) for texts in (left, right)))


def quote_format(output: Column, quotes: Column) -> Column:
    """A quarter each: quoted quotes, a header of ids, an answer, one to ten quotes."""
    checks = [output.rlike(QUOTED), output.rlike("(?iu)Relevant Document IDs?:"), output.rlike("(?iu)The answer is:"), F.size(quotes).between(1, MOST_QUOTES)]
    return sum((c.cast("double") * 0.25 for c in checks[1:]), checks[0].cast("double") * 0.25)


def quote_reward(output: Column, truth: Column, gold_docs: Column, gold_tags: Column) -> Column:
    quotes = T.quotes(output, MOST_QUOTES)
    both = F.struct(quotes.alias("quotes"), greedy_matches(quotes, gold_docs).alias("matched"))
    return T.let(both, lambda s: _quote_reward(output, truth, gold_docs, gold_tags, s["quotes"], s["matched"]))


def _quote_reward(output: Column, truth: Column, gold_docs: Column, gold_tags: Column, quotes: Column, matched: Column) -> Column:
    w = QUOTE_WEIGHTS
    over = F.transform(quotes, lambda q: F.size(T.words(q)))
    penalty = F.aggregate(over, F.lit(0.0), lambda s, n: s + F.when(n > LONG_QUOTE, 0.1 + 0.02 * (n - LONG_QUOTE)).otherwise(0.0))
    ids = F.when(matched > 0, O.set_scores(C.tags_in(output), gold_tags)["f1"]).otherwise(0.0)
    total = (
        w["quote"] * O.ratio(matched, F.size(quotes)) + w["coverage"] * O.ratio(matched, F.size(gold_docs)) + w["id"] * ids
        + w["answer"] * _answered(output, truth) + w["format"] * quote_format(output, quotes) - w["length"] * F.least(penalty, F.lit(1.0))
    )
    return F.greatest(F.lit(0.0), total)


def section_docs(output: Column) -> Column:
    """struct<tag, content> array of the `Relevant documents:` section; documents without content are left out.

    Tags have their number without leading zeros; it may be of any length.
    """
    spaced = F.regexp_replace(F.regexp_extract(output, SECTION, 1), TAGGED, "[DOC $1]")
    tag = lambda n: F.concat(F.lit("[DOC "), F.regexp_replace(n, r"\A0+(?=.)", ""), F.lit("]"))
    return F.filter(F.transform(C.numbered_bodies(spaced), lambda d: F.struct(tag(d["number"]).alias("tag"), d["content"].alias("content"))), lambda d: d["content"] != "")


def document_format(output: Column) -> Column:
    """Mean of: the header, tags in the section, content after them, an answer."""
    section = F.regexp_extract(output, SECTION, 1)
    body = rf"{TAGGED}{T.SPACE}*[^{T.SPACE[1:]}"
    checks = [output.rlike("(?iu)Relevant documents:"), section.rlike(TAGGED), section.rlike(body), output.rlike("(?iu)The answer is:")]
    return sum((c.cast("double") for c in checks[1:]), checks[0].cast("double")) / 4


def content_reward(output: Column, truth: Column, gold_docs: Column, gold_tags: Column) -> Column:
    return T.let(section_docs(output), lambda docs: _content_reward(output, truth, gold_docs, gold_tags, docs))


def _content_reward(output: Column, truth: Column, gold_docs: Column, gold_tags: Column, docs: Column) -> Column:
    w = CONTENT_WEIGHTS
    tags = F.array_distinct(F.transform(docs, lambda d: d["tag"]))
    gold = F.transform(F.arrays_zip(gold_tags.alias("t"), gold_docs.alias("d")), lambda z: z)
    both = F.filter(gold, lambda z: F.array_contains(tags, z["t"]) & z["d"].isNotNull() & z["t"].isNotNull())
    said = lambda z: F.get(F.filter(docs, lambda d: d["tag"] == z["t"]), 0)["content"]
    scores = F.transform(both, lambda z: O.fuzzy_score(said(z), z["d"]))
    content = O.ratio(F.aggregate(scores, F.lit(0.0), lambda s, x: s + x), F.size(scores))
    total = (
        w["id"] * O.set_scores(tags, gold_tags)["f1"] + w["content"] * content + w["answer"] * _answered(output, truth)
        + w["format"] * document_format(output) - w["irrelevant"] * F.size(F.array_except(tags, gold_tags))
    )
    return F.greatest(F.lit(0.0), total)


def judge_reward(response: Column) -> Column:
    return T.boxed_score(response)


REWARDS: dict[str, Callable[..., Column]] = {
    "answer_only": answer_only, "answer_and_ids": answer_and_ids, "quote": quote_reward, "ids_and_content": content_reward, "judge": judge_reward,
}
