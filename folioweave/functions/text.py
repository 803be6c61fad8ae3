"""Text columns: cleaning, chunking, answer and rating extraction. All built-ins, so plans stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and word characters of the text contracts, Unicode's too: Java's own classes are ASCII's or larger.
_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{_SPACES}]"
_WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
START, END = f"(?<!{_WORD})", f"(?!{_WORD})"

# Patterns and word lists whose matches decide scores. (?u): case of all letters; (?d): only a line break
# ends a line. Repeats of groups, which take a stack frame each in Java, are possessive or written as character runs:
# FIRST_ANSWER is The answer is\s*:?\s*((?:[A-Za-z]+\.\s+)*[^.,]+?)[.,] with the ways back spelled out, and
# (?:\s+\w+)* of LOOSE_ANSWER is a run of both that starts with one and ends with the other.
_SHORT = rf"[A-Za-z]++\.{SPACE}++"
FIRST_ANSWER = (
    rf"(?iu)The answer is{SPACE}*:?{SPACE}*("
    rf"(?:{_SHORT})*+[^.,]+?(?=[.,])|(?:{_SHORT})++(?<={SPACE}{SPACE})(?=[.,])|(?:{_SHORT}(?=[A-Za-z]++\.{SPACE}))*+[A-Za-z]++(?=\.{SPACE}))"
)
LOOSE_ANSWER = rf"(?iu){START}(?:the{SPACE}+)?answer(?:{SPACE}[{_SPACES}\p{{L}}\p{{N}}_]*{_WORD})?{SPACE}*[:\-]?{SPACE}*([^\.,\n]+)"
PREFIX_ANSWER = r"(?iu)Answer:([^\n]*)(?:\n|\z)"
LAST_ANSWER = rf"(?iu)The answer is:{SPACE}*([^\n\.]+)"
LETTER_FIRST = rf"(?iu)The{SPACE}+correct{SPACE}+answer{SPACE}+is{SPACE}*\(?([A-D])\)?"
LETTER_SECOND = rf"(?iu){START}(?:answer|option){SPACE}*(?:is|:){SPACE}*\(?([A-D])\)?"
QUOTE = (
    rf"(?isu)(?:Quote|Passage|Document|Extract|Reference){SPACE}+\d+:{SPACE}*(.*?)"
    rf"(?=(?:Quote|Passage|Document|Extract|Reference){SPACE}+\d+:|Relevant Document IDs?:|The answer is:|\z)"
)
RATING = rf"(?i)Rating:{SPACE}*\[\[?{SPACE}*({DIGIT}{{1,3}}){SPACE}*\]\]?"
CRITERION = r"(?i)\\boxed\{\{?Criterion\s+\d+:\s*([01])(?:/[01])?\}?\}"
BOXED = r"(?i)\\boxed\{\{?([01])(?:/[01])?\}?\}"
CJK_PUNCTUATION = "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏."
BLANKED = "\n:\"'.,?!{}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: an expression inside a lambda is otherwise computed for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """No white space at the ends. Each run of it is looked at once."""
    return F.regexp_replace(text, rf"\A{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def collapse_space(text: Column) -> Column:
    """Runs of white space, Unicode's too, become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}++", " "))


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, f"{SPACE}++"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.when(text.isNull(), 0).otherwise(F.size(words(text)))


def windows(items: Column, size: int) -> Column:
    """An array in runs of `size`; the last may be shorter. An empty array gives none."""
    def cut(held: Column) -> Column:
        n = F.ceil(F.size(held) / F.lit(size)).cast("int")
        runs = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(held, k * size + 1, size))
        return F.when(n >= 1, runs).otherwise(F.array().cast("array<array<string>>"))

    return let(items, cut)


def passages(text: Column, size: int = 100) -> Column:
    """The text's passages of `size` words, words parted at single spaces; an empty text is one empty passage."""
    return F.transform(windows(F.split(text, " ", -1), size), lambda w: F.array_join(w, " "))


def truncate_tail(tokens: Column, most: int, buffer: int = 512) -> Column:
    """More than `most` tokens are cut to most - buffer."""
    return F.when(F.size(tokens) > most, F.slice(tokens, 1, most - buffer)).otherwise(tokens)


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.regexp_replace(F.lower(text), r"\p{Punct}", "")
    return collapse_space(F.regexp_replace(plain, f"{START}(?:a|an|the){END}", " "))


def normalize_cjk_answer(text: Column) -> Column:
    """Lower case, no ASCII or CJK punctuation, no white space."""
    plain = F.translate(F.regexp_replace(F.lower(text), r"\p{Punct}", ""), CJK_PUNCTUATION, "")
    return F.regexp_replace(plain, f"{SPACE}++", "")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null without a match or with an empty group."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def answer_or_all(text: Column) -> Column:
    """What stands after `The answer is` up to a period or comma; without that the whole text."""
    found = _group(text, FIRST_ANSWER)
    return F.coalesce(strip(found), text)


def parsed_answer(text: Column) -> Column:
    """The first of: a loose `answer …`, `Answer: …`, the first line. Greedy, so `The answer is X.` gives X's last letter."""
    first_line = F.regexp_extract(text, r"\A([^\n]*)", 1)
    found = F.coalesce(_group(text, LOOSE_ANSWER), F.when(text.rlike(PREFIX_ANSWER), F.regexp_extract(text, PREFIX_ANSWER, 1)), first_line)
    return strip(F.regexp_replace(strip(found), r"(?iu)\AAnswer:", ""))


def last_answer(text: Column) -> Column:
    """The last `The answer is: …` up to a period or line end; null without one."""
    found = F.regexp_extract_all(text, F.lit(LAST_ANSWER), 1)
    return strip(F.try_element_at(found, F.lit(-1)))


def choice_letter(text: Column) -> Column:
    """A to D from one of two phrasings; null if neither stands there."""
    return F.upper(F.coalesce(_group(text, LETTER_FIRST), _group(text, LETTER_SECOND)))


def quotes(text: Column, most: int = 10) -> Column:
    """Labelled quotes of more than 5 characters, each once, the first `most`."""
    found = F.transform(F.regexp_extract_all(text, F.lit(QUOTE), 1), strip)
    return F.slice(F.array_distinct(F.filter(found, lambda q: F.length(q) > 5)), 1, most)


def without_citations(text: Column) -> Column:
    r"""Drops ` [n` and `[n`, ` |`, `]`."""
    bare = F.regexp_replace(F.regexp_replace(text, rf" \[{DIGIT}+", ""), rf"\[{DIGIT}+", "")
    return F.replace(F.replace(bare, F.lit(" |"), F.lit("")), F.lit("]"), F.lit(""))


def citation_refs(text: Column) -> Column:
    """Zero-based references of all `[n`; a number over 64 bits counts as the largest, as no text has so many documents."""
    most = F.lit((1 << 63) - 1)
    return F.transform(F.regexp_extract_all(text, F.lit(rf"\[({DIGIT}+)"), 1), lambda n: F.coalesce(ascii_digits(n).try_cast("bigint"), most) - 1)


def clean_output(text: Column, end_marker: str = "<|im_end|>") -> Column:
    """Runs of line breaks become a space; the end-of-turn marker goes."""
    return F.replace(F.regexp_replace(text, r"\n+", " "), F.lit(end_marker), F.lit(""))


def ascii_digits(number: Column) -> Column:
    """Full-width, Arabic, Persian and Devanagari digits as 0 to 9."""
    return F.translate(number, "０１２３４５６７８９٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९", "0123456789" * 4)


def short_hash(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def first_integer(text: Column) -> Column:
    """The first run of digits as text, else empty."""
    return F.regexp_extract(text, r"[0-9]+", 0)


def words_after_blanking(text: Column, marks: str = BLANKED) -> Column:
    """Words, with some punctuation read as space."""
    return words(F.translate(text, marks, " " * len(marks)))


def judge_rating(text: Column) -> Column:
    """The number of `Rating: [[n]]`; null if there is none."""
    return ascii_digits(_group(text, RATING)).try_cast("int")


def boxed_score(text: Column) -> Column:
    r"""Sum of the 0/1 of `\boxed{Criterion n: s}`, else of the first three `\boxed{s}`; at most 3."""
    named = F.regexp_extract_all(text, F.lit(CRITERION), 1)
    plain = F.slice(F.regexp_extract_all(text, F.lit(BOXED), 1), 1, 3)
    used = F.when(F.size(named) > 0, named).otherwise(plain)
    return F.least(F.aggregate(used, F.lit(0.0), lambda s, x: s + x.cast("double")), F.lit(3.0))


def after_reasoning(text: Column, marker: str = "</think>") -> Column:
    """The text between the first marker and the next, if any; null without one."""
    return F.get(F.split(text, marker, -1), 1)
