"""Overlaps of arrays and strings. Arrays of a row stay in the row: these are for answers, not for whole corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions import arrow
from folioweave.functions import text as T


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole, or `empty` if whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(empty))


def f1_of(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, F.lit(2.0) * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def multiset_common(a: Column, b: Column) -> Column:
    """Number of elements that the two arrays share, repeats counted.

    Both are sorted together, each element with its side, and folded once: at the end of a run of equal elements the
    smaller of its two counts is added. Time follows the sort, whatever repeats.
    """
    side = lambda items, n: F.transform(items, lambda v: F.struct(v.alias("v"), F.lit(n).alias("s")))
    row = lambda v, x, y, n: F.struct(v.alias("v"), x.alias("x"), y.alias("y"), n.alias("n"))

    def step(s: Column, e: Column) -> Column:
        x, y = (F.when(e["s"] == k, 1).otherwise(0) for k in (0, 1))
        same = s["v"].eqNullSafe(e["v"])
        more, begun = row(s["v"], s["x"] + x, s["y"] + y, s["n"]), row(e["v"], x, y, s["n"] + F.least(s["x"], s["y"]))
        return F.when(same, more).otherwise(begun)

    def fold(items: Column) -> Column:
        start = F.struct(F.get(items, 0)["v"].alias("v"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("n"))
        return F.aggregate(items, start, step, lambda s: s["n"] + F.least(s["x"], s["y"]))

    return T.let(F.sort_array(F.concat(side(a, 0), side(b, 1))), fold)


def token_f1(a: Column, b: Column) -> Column:
    """struct<f1, precision, recall> of the token arrays a (prediction) and b."""
    def scores(x: Column, y: Column, same: Column) -> Column:
        p, r = ratio(same, F.size(x)), ratio(same, F.size(y))
        return F.struct(f1_of(p, r).alias("f1"), p.alias("precision"), r.alias("recall"))

    return T.let(a, lambda x: T.let(b, lambda y: T.let(multiset_common(x, y), lambda n: scores(x, y, n))))


def answer_f1(prediction: Column, truth: Column) -> Column:
    """Token F1 of normalised answers."""
    return token_f1(T.words(T.normalize_answer(prediction)), T.words(T.normalize_answer(truth)))["f1"]


def guarded_answer_f1(prediction: Column, truth: Column) -> Column:
    """answer_f1, but 0 where one of them is yes, no or noanswer and they differ."""
    a, b = T.normalize_answer(prediction), T.normalize_answer(truth)
    fixed = a.isin("yes", "no", "noanswer") | b.isin("yes", "no", "noanswer")
    return F.when(fixed & (a != b), 0.0).otherwise(answer_f1(prediction, truth))


def no_answer_f1(prediction: Column, truth: Column) -> Column:
    """answer_f1, but if either has no tokens 1 for equal and 0 for different."""
    a, b = T.words(T.normalize_answer(prediction)), T.words(T.normalize_answer(truth))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (a == b).cast("double")).otherwise(token_f1(a, b)["f1"])


def exact_match(prediction: Column, truth: Column) -> Column:
    return T.normalize_answer(prediction) == T.normalize_answer(truth)


def substring_match(prediction: Column, truth: Column) -> Column:
    """The normalised truth stands in the normalised prediction; an empty truth does."""
    return F.contains(T.normalize_answer(prediction), T.normalize_answer(truth))


def best_of(metric, prediction: Column, truths: Column) -> Column:
    """The best score over an array of truths; null if there is none."""
    return T.let(prediction, lambda p: F.array_max(F.transform(truths, lambda t: metric(p, t))))


def best_answer_f1(prediction: Column, truths: Column) -> Column:
    """best_of() of answer_f1, the prediction normalised once."""
    return best_of(lambda a, t: token_f1(a, T.words(T.normalize_answer(t)))["f1"], T.words(T.normalize_answer(prediction)), truths)


def any_present(answers: Column, context: Column) -> Column:
    return T.let(T.normalize_answer(context), lambda c: F.exists(answers, lambda a: F.contains(c, T.normalize_answer(a))))


def set_scores(found: Column, gold: Column) -> Column:
    """struct<precision, recall, f1> of two sets; 0 if either is empty."""
    def scores(a: Column, b: Column) -> Column:
        same = F.size(F.array_intersect(a, b))
        p, r = ratio(same, F.size(a)), ratio(same, F.size(b))
        return F.struct(p.alias("precision"), r.alias("recall"), f1_of(p, r).alias("f1"))

    return T.let(F.array_distinct(found), lambda a: T.let(F.array_distinct(gold), lambda b: scores(a, b)))


def truncated_overlap(a: Column, b: Column) -> Column:
    """Distinct common elements of both, cut to the shorter, over its length; null for length 0."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, F.size(F.array_intersect(F.slice(a, 1, n), F.slice(b, 1, n))) / n.cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; both empty 1, one empty 0."""
    share = lambda x, y: ratio(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)), 1.0)
    return T.let(a, lambda x: T.let(b, lambda y: share(x, y)))


def _despaced(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit(""))


def char_f1(a: Column, b: Column) -> Column:
    """F1 of characters without spaces; both empty 1."""
    # a character's count is what its removal takes off: no array of characters is searched
    times = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))

    def score(x: Column, y: Column) -> Column:
        n, m = F.length(x), F.length(y)
        same = F.aggregate(F.array_intersect(T.characters(x), T.characters(y)), F.lit(0), lambda s, c: s + F.least(times(x, c), times(y, c)))
        f1 = T.let(same, lambda k: f1_of(ratio(k, n), ratio(k, m)))
        return F.when((n == 0) & (m == 0), 1.0).otherwise(f1)

    return T.let(_despaced(a), lambda x: T.let(_despaced(b), lambda y: score(x, y)))


def ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams without spaces."""
    def grams(chars: Column) -> Column:
        many = F.greatest(F.size(chars) - (n - 1), F.lit(0))
        out = F.slice(chars, F.lit(1), many)
        for k in range(1, n):
            out = F.zip_with(out, F.slice(chars, F.lit(k + 1), many), lambda g, c: F.concat(g, c))
        return F.array_distinct(out)

    return T.let(T.characters(_despaced(text)), grams)


def ngram_jaccard(a: Column, b: Column, n: int) -> Column:
    return jaccard(ngrams(a, n), ngrams(b, n))


def word_jaccard(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(T.words(F.lower(a))), F.array_distinct(T.words(F.lower(b))))


def fuzzy_score(a: Column, b: Column) -> Column:
    """The largest of character F1, bigram, trigram and word Jaccard."""
    return F.greatest(char_f1(a, b), ngram_jaccard(a, b, 2), ngram_jaccard(a, b, 3), word_jaccard(a, b))


def long_token_f1(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """key, f1 for long texts; a text without words, or null, has 0. key names a pair."""
    return pairs.select(*key, arrow.words_f1(*(T.normalize_answer(F.col(c)) for c in (a, b))).alias("f1"))
