"""Task scorers: prediction and labels to a score column. Labels are array<string>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioweave.functions import arrow
from folioweave.functions import overlap as O
from folioweave.functions import text as T

# Prefixes before an answer, in the order in which they are tried.
CODE_PREFIXES = ("answer is:", "is:", "answer:", "correct option is:")
CHOICE_PREFIXES = ("answer is:", "answer:", "answer is", "answer is ", "option is")
#: The last standalone letter of the first line that has one.
LAST_CODE_LETTER, LAST_CHOICE_LETTER = (rf"(?d){T.START}[A-{x}]{T.END}(?!.*{T.START}[A-{x}]{T.END})" for x in "JD")


def kv_retrieval(pred: Column, labels: Column) -> Column:
    return F.array_contains(T.words_after_blanking(pred), F.get(labels, 0))


def passkey(pred: Column, labels: Column) -> Column:
    """Also for number strings: the first run of digits is the label."""
    return T.first_integer(pred) == F.get(labels, 0)


def code_run(pred: Column, labels: Column) -> Column:
    """The last word is the label as an integer."""
    last = F.try_element_at(T.words_after_blanking(T.strip(pred), "\n.`'\":"), F.lit(-1))
    return F.coalesce(last.try_cast("bigint") == F.get(labels, 0).try_cast("bigint"), F.lit(False))


def _after_prefix(pred: Column, prefixes: tuple[str, ...], fits: Callable[[Column], Column], other: Column) -> Column:
    """What follows the first prefix that occurs decides; `other` if none does."""
    out = other
    for p in reversed(prefixes):
        at = F.locate(p, pred)
        rest = F.substr(pred, at + len(p) + 1, F.greatest(F.length(pred), F.lit(1)))
        out = F.when(at > 0, (F.length(pred) >= at + len(p)) & fits(rest)).otherwise(out)
    return out


def code_debug(pred: Column, labels: Column) -> Column:
    """labels: function name, letter."""
    name, letter = F.get(labels, 0), F.get(labels, 1)
    starts = lambda t: F.startswith(t, letter) | F.startswith(t, name)

    def fits(p: Column) -> Column:
        flat = p
        for mark in ("\n", "`", "'", '"', "-", "*", "Option", "option"):
            flat = F.replace(flat, F.lit(mark), F.lit(" "))
        by_flat = T.let(F.regexp_replace(flat, " {2,}", " "), lambda t: starts(t) | _after_prefix(t, CODE_PREFIXES, starts, F.lit(False)))
        return (F.regexp_extract(p, LAST_CODE_LETTER, 0) == letter) | by_flat

    return T.let(T.strip(pred), fits)


def choice(pred: Column, labels: Column) -> Column:
    """The last letter, the first character, the whole, what follows a prefix, or the first word that is a letter."""
    fits = lambda t: F.exists(labels, lambda s: F.startswith(t, s))

    def by_flat(flat: Column) -> Column:
        word = F.get(F.filter(T.words(flat), lambda w: F.lit("ABCD").contains(w)), 0)
        by_word = F.coalesce(F.array_contains(labels, word), F.lit(False))
        return _after_prefix(flat, CHOICE_PREFIXES, fits, by_word)

    def right(p: Column) -> Column:
        last = T.let(F.regexp_extract(p, LAST_CHOICE_LETTER, 0), lambda x: F.nullif(x, F.lit("")))
        head = F.substring(p, 1, 1)
        flat = F.regexp_replace(F.translate(p, "\n\"'.,?!{}", " " * 9), " {2,}", " ")
        return (
            F.when(F.coalesce(F.array_contains(labels, last), F.lit(False)), True)
            .when(p == "", False)
            .when(head.isin("A", "B", "C", "D"), F.array_contains(labels, head))
            .when(F.array_contains(labels, p), True)
            .otherwise(T.let(flat, by_flat))
        )

    # what is stripped and flattened is so once, not for each prefix that is looked for
    return T.let(T.strip(pred), right)


def math_find(pred: Column, labels: Column, kind: Column) -> Column:
    """The first number is the label; kind is int or float. A decimal prediction never equals an int label."""
    label = F.get(labels, 0)

    def equal(found: Column) -> Column:
        number = F.nullif(found, F.lit(""))
        as_int = number.try_cast("bigint") == label.try_cast("bigint")
        as_float = number.try_cast("double") == label.try_cast("double")
        whole = F.when(number.contains("."), False).otherwise(as_int)
        return F.coalesce(F.when(kind == "int", whole).when(kind == "float", as_float).otherwise(F.raise_error("label kind is int or float").cast("boolean")), F.lit(False))

    return T.let(F.regexp_extract(pred, r"\d+\.\d+|\d+", 0), equal)


def math_calc(pred: Column, labels: Column) -> Column:
    """Length of the matching prefix of integers over the number of labels."""
    found = F.transform(F.regexp_extract_all(pred, F.lit("[0-9]+"), 0), lambda n: n.try_cast("bigint"))
    same = F.transform(F.arrays_zip(labels.alias("l"), found.alias("p")), lambda z: F.coalesce(z["l"].try_cast("bigint") == z["p"], F.lit(False)))
    run = lambda s: F.coalesce(F.nullif(F.array_position(s, F.lit(False)), F.lit(0)) - 1, F.size(s))
    return O.ratio(F.least(T.let(same, run), F.size(labels)), F.size(labels))


def dialogue(pred: Column, labels: Column) -> Column:
    up = F.upper(T.strip(pred))
    return F.exists(labels, lambda s: F.contains(up, F.upper(s)))


def qa_english(pred: Column, labels: Column) -> Column:
    """struct<f1, sub_em>: F1 of the extracted answer, substring match of the raw or the parsed one."""
    def scores(truths: Column) -> Column:
        f1 = O.best_of(lambda a, t: O.token_f1(a, T.words(t))["f1"], T.words(T.normalize_answer(T.answer_or_all(pred))), truths)
        sub = lambda p: O.best_of(lambda x, t: F.contains(x, t).cast("double"), T.normalize_answer(p), truths)
        return F.struct(f1.alias("f1"), F.greatest(sub(pred), sub(T.parsed_answer(pred))).alias("sub_em"))

    return T.let(F.transform(labels, T.normalize_answer), scores)


def qa_chinese(pred: Column, labels: Column) -> Column:
    chars = lambda t: T.characters(T.normalize_cjk_answer(t))
    return O.best_of(lambda p, t: O.token_f1(p, chars(t))["f1"], chars(pred), labels)


def summary(pred: Column, labels: Column) -> Column:
    """ROUGE-Lsum F1 against the first label."""
    return arrow.rouge_lsum_score(pred, F.slice(labels, 1, 1))["f1"]


def retrieved_qa(pred: Column, answers: Column) -> Column:
    """struct of exact_match, f1, substring_exact_match, and F1 and recall of ROUGE-L and Lsum: of each the better of the
    raw and the parsed prediction."""
    def seven(p: Column) -> list[Column]:
        plain = [O.best_of(lambda x, t: O.exact_match(x, t).cast("double"), p, answers), O.best_of(O.guarded_answer_f1, p, answers), O.best_of(lambda x, t: O.substring_match(x, t).cast("double"), p, answers)]
        both = arrow.rouge_l_score(p, answers), arrow.rouge_lsum_score(p, answers)
        return plain + [r[c] for r in both for c in ("f1", "recall")]

    return F.struct(*[F.greatest(a, b).alias(n) for a, b, n in zip(seven(pred), seven(T.parsed_answer(pred)), RETRIEVED, strict=True)])


RETRIEVED = ("exact_match", "f1", "substring_exact_match", "rougeL_f1", "rougeL_recall", "rougeLsum_f1", "rougeLsum_recall")

#: task -> score column of (prediction, labels)
SCORERS: dict[str, Callable[[Column, Column], Column]] = {
    "kv_retrieval": kv_retrieval, "kv_retrieval_prefix": kv_retrieval, "kv_retrieval_both": kv_retrieval,
    "passkey": passkey, "number_string": passkey, "code_run": code_run, "code_debug": code_debug,
    "longdialogue_qa_eng": dialogue, "longbook_qa_eng": qa_english, "longbook_sum_eng": summary, "longbook_choice_eng": choice,
    "longbook_qa_chn": qa_chinese, "math_find": lambda pred, labels: math_find(pred, labels, F.lit("int")), "math_calc": math_calc,
}


def score(task: str, pred: Column, labels: Column) -> Column:
    """The task's score as a double, yes and no as 1 and 0; longbook_qa_eng has a struct of two, f1 and sub_em."""
    if task not in SCORERS:
        raise ValueError(f"no scorer for {task}; there are {sorted(SCORERS)}")
    found = SCORERS[task](pred, labels)
    return found if task == "longbook_qa_eng" else found.cast("double")


def answer_range(letters: list[str], options: Column) -> Column:
    """array<struct<letter, text>> of the options that are there."""
    zipped = F.arrays_zip(F.array(*map(F.lit, letters)).alias("letter"), options.alias("text"))
    return F.filter(zipped, lambda z: z["text"].isNotNull() & z["letter"].isNotNull())


def letter_of(range_: Column, answer: Column) -> Column:
    """The answer's letter: itself if it is one, else that of the option with its text; an error if neither."""
    as_letter = F.filter(range_, lambda z: z["letter"] == F.upper(F.trim(answer)))
    as_text = F.filter(range_, lambda z: z["text"] == answer)
    found = F.coalesce(F.get(as_letter, 0)["letter"], F.get(as_text, 0)["letter"])
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no option for "), answer)).cast("string"))
