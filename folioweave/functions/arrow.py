"""What built-ins cannot say: edit-like ratios, ROUGE, Unicode forms. Arrow batches, never row by row over the wire."""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from folioweave.functions.stem import stem


def lcs(a, b) -> int:
    """Length of the longest common subsequence, bit-parallel over Python's long integers."""
    if not a or not b:
        return 0
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """2 LCS / (len a + len b), in 0 to 100; two empty texts 100."""
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Places of the grids' edges that are held together where pairs are compared side by side.
EDGES = 200_000


def window_origins(pairs: list[tuple[str, str]]) -> list[np.ndarray]:
    """For each pair (a, b) and place q of b a place p <= q or less than 0: LCS(a, b[s:e]) is e - s less the number of s <= p, q < e.

    Strands enter a grid of a's rows and b's columns from its left side and from above, and turn where characters match;
    two that have crossed before turn as well. q is where one leaves below, p where it came from above. All windows of b
    are so compared in one pass, by diagonals, whose cells do not depend on each other. The pairs' grids stand side by side:
    rows below a's last and columns after b's last match nothing, so no strand turns there that leaves below b.
    """
    m, n = (max(len(p[k]) for p in pairs) for k in (0, 1))
    up, across = np.full((m, len(pairs)), -1, np.int64), np.full((n, len(pairs)), -2, np.int64)
    for k, (a, b) in enumerate(pairs):
        up[m - len(a) :, k], across[: len(b), k] = codes(a)[::-1], codes(b)
    letters, ids = np.unique(np.concatenate([up, across]), return_inverse=True)
    ids = ids.reshape(m + n, len(pairs)).astype(np.uint16 if len(letters) < 1 << 16 else np.int32)
    up, across = ids[:m], ids[m:]
    kind = np.int16 if max(m, n) < 1 << 15 else np.int32
    side, top = (np.repeat(np.arange(x, y, dtype=kind)[:, None], len(pairs), 1) for x, y in ((-m, 0), (0, n)))
    for d in range(m + n - 1):
        x, j = max(0, m - 1 - d), max(0, d - m + 1)
        w = min(m - x, n - j)
        h, v = side[x : x + w], top[j : j + w]
        # a match turns both; else the larger goes below. Bits in place of where(), which is slower by far
        turn = -(up[x : x + w] == across[j : j + w]).astype(kind)
        less, more = np.minimum(h, v), np.maximum(h, v)
        side_, top_ = less ^ ((less ^ v) & turn), more ^ ((more ^ h) & turn)
        side[x : x + w], top[j : j + w] = side_, top_
    return [top[: len(b), k] for k, (_, b) in enumerate(pairs)]


def _best_window(n: int, p: np.ndarray) -> float:
    """The best indel ratio of a text of n characters with a window of one, cut windows at both ends included; p: its window_origins()."""
    m, q = len(p), np.flatnonzero(p >= 0)
    p = p[q].astype(np.int64)
    # lost[s]: pairs inside the window of n characters from s, which are those of s between q - n + 1 and p
    near = q - p < n
    lost = np.cumsum(np.bincount(np.maximum(q[near] - n + 1, 0), minlength=m + 1) - np.bincount(p[near] + 1, minlength=m + 1))[: m - n + 1]
    cut = np.arange(1, n)
    head = cut - np.cumsum(np.bincount(q, minlength=m))[cut - 1]
    tail = cut - np.cumsum(np.bincount(p, minlength=m)[::-1])[cut - 1]
    ends = np.maximum(head, tail) / (n + cut)
    return 200.0 * max((n - int(lost.min())) / (2 * n), float(ends.max(initial=0.0)))


def partials(pairs: list[tuple[str, str]]) -> list[float]:
    """Of each pair the best indel ratio of the shorter text with a window of the longer, cut windows at both ends included.

    Pairs of like lengths are compared side by side, as many as EDGES lets be; a longer pair is by itself.
    """
    found, left = [0.0] * len(pairs), []
    for k, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        if a and a not in b:
            left.append((k, a, b))
        elif a or not b:
            found[k] = 100.0
    left.sort(key=lambda x: (len(x[1]) // 32, len(x[2])))
    sets, m, n = [], 0, 0
    for one in left:
        m, n = max(m, len(one[1])), max(n, len(one[2]))
        if not sets or (len(sets[-1]) + 1) * (m + n) > EDGES:
            sets.append([])
            m, n = len(one[1]), len(one[2])
        sets[-1].append(one)
    for some in sets:
        for (k, a, _), p in zip(some, window_origins([x[1:] for x in some]), strict=True):
            found[k] = _best_window(len(a), p)
    return found


def partial(a: str, b: str) -> float:
    """partials() of one pair."""
    return partials([(a, b)])[0]


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best of the common words, and those with either text's other words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    same, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if same and (not only_a or not only_b):
        return 100.0
    one, two = (" ".join(filter(None, (same, s))) for s in (only_a, only_b))
    pairs = [(one, two)] + ([(same, one), (same, two)] if same else [])
    return max(indel(p, q) for p, q in pairs)


def near_duplicates(pairs: list[tuple[str, str]]) -> list[float]:
    """Of each pair 0.4 token-sort, 0.3 partial, 0.3 token-set ratio of the lower-cased texts, in 0 to 1."""
    low = [(a.lower(), b.lower()) for a, b in pairs]
    return [(0.4 * token_sort(*x) + 0.3 * y + 0.3 * token_set(*x)) / 100 for x, y in zip(low, partials(low), strict=True)]


def near_duplicate(a: str, b: str) -> float:
    """near_duplicates() of one pair."""
    return near_duplicates([(a, b)])[0]


def common_characters(a: str, b: str) -> int:
    """Characters that both have, repeats counted: no common subsequence is longer."""
    return (Counter(a) & Counter(b)).total()


def partial_bound(a: str, b: str) -> float:
    """No less than partial(a, b): a window has at most the common characters, and as many characters as it shares at least."""
    n, c = min(len(a), len(b)), common_characters(a, b)
    return 200.0 * c / (n + c) if n else 100.0 * (not a and not b)


def token_set_bound(a: str, b: str) -> float:
    """No less than token_set(a, b): of its pairs, those of the common words with more words are exact."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    same, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if same and (not only_a or not only_b):
        return 100.0
    one, two = (" ".join(filter(None, (same, s))) for s in (only_a, only_b))
    whole = 200.0 * common_characters(one, two) / (len(one) + len(two))
    return max(whole, *(200.0 * len(same) / (len(same) + len(p)) for p in (one, two))) if same else whole


def near_duplicates_from(pairs: list[tuple[str, str]], least: float) -> list[float | None]:
    """near_duplicates() where it is `least` or more, else None.

    Bounds from lengths and character counts go first, in time of the texts' length; then the two ratios that are compared
    by whole words of bits; the windows, in time of the product of lengths, are compared only if the pair can still pass.
    """
    room = 1e-9  # sums are rounded
    found, left = [None] * len(pairs), []
    for k, (a, b) in enumerate(pairs):
        a, b = a.lower(), b.lower()
        sort = 200.0 * common_characters(*("".join(t.split()) + " " * max(0, len(t.split()) - 1) for t in (a, b)))
        sort = min(100.0, sort / max(1, sum(len(" ".join(t.split())) for t in (a, b)))) if a.split() or b.split() else 100.0
        ends = partial_bound(a, b)
        if (0.4 * sort + 0.3 * ends + 0.3 * token_set_bound(a, b)) / 100 < least - room:
            continue
        words = 0.4 * token_sort(a, b), 0.3 * token_set(a, b)
        if (words[0] + 0.3 * ends + words[1]) / 100 >= least - room:
            left.append((k, words, (a, b)))
    for (k, words, _), ends in zip(left, partials([x[2] for x in left]), strict=True):
        score = (words[0] + 0.3 * ends + words[1]) / 100
        found[k] = score if score >= least else None
    return found


def near_duplicate_from(a: str, b: str, least: float) -> float | None:
    """near_duplicates_from() of one pair."""
    return near_duplicates_from([(a, b)], least)[0]


#: Characters whose words are held as a list at once.
PIECE = 1 << 20


def word_counts(text: str | None) -> Counter:
    """How often each word stands in a text; null has none. Only different words are held, so long texts may be counted."""
    found, at = Counter(), 0
    while text and at < len(text):
        upto = text.find(" ", at + PIECE)
        upto = len(text) if upto < 0 else upto
        found.update(text[at:upto].split())
        at = upto
    return found


def f1_of_words(a: str | None, b: str | None) -> float:
    """F1 of the words of two texts, repeats counted; 0 if they share none."""
    x, y = word_counts(a), word_counts(b)
    same = sum(min(n, y[w]) for w, n in x.items() if w in y)
    if not same:
        return 0.0
    p, r = same / x.total(), same / y.total()
    return 2.0 * p * r / (p + r)


@arrow_udf(DoubleType())
def words_f1(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array((f1_of_words(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)), pa.float64())


def rouge_l(prediction: str, reference: str, stems: bool = True) -> tuple[float, float]:
    """(F, recall) of the longest common subsequence of words."""
    p, r = rouge_words(prediction, stems), rouge_words(reference, stems)
    n = lcs(p, r)
    return (0.0, 0.0) if not n else (2 * n / (len(p) + len(r)), n / len(r))


def rouge_words(text: str, stems: bool = True) -> list[str]:
    """Runs of ASCII letters and digits in lower case, those of four or more by their stems."""
    found = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return [stem(w) if len(w) > 3 else w for w in found] if stems else found


def lcs_places(a: list[str], b: list[str]) -> set[int]:
    """Places in a of one longest common subsequence with b: of equally long ones that which leaves out late words of a.

    The table of lengths is kept as its steps, a bit per cell: bit j of row i is 0 where the length grows from b's first j
    words to one more. 20,000 words a side take 50 MB.
    """
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        row, hit = rows[-1], rows[-1] & at.get(x, 0)
        rows.append(((row + hit) | (row - hit)) & full)
    out, i, j = set(), len(a), len(b)
    here = j - rows[i].bit_count()  # the length for a's first i and b's first j words
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j, here = i - 1, j - 1, here - 1
            out.add(i)
            continue
        left = here - (not rows[i] >> (j - 1) & 1)
        above = j - (rows[i - 1] & ((1 << j) - 1)).bit_count()
        if left > above:
            j, here = j - 1, left
        else:
            i, here = i - 1, above
    return out


def rouge_lsum(prediction: str, reference: str, stems: bool = True) -> tuple[float, float]:
    """(F, recall) by lines: each reference line's words that a common subsequence with any predicted line has.

    A word counts as often as both texts have it.
    """
    p, r = ([w for line in t.split("\n") if (w := rouge_words(line, stems))] for t in (prediction, reference))
    left = Counter(w for x in p for w in x), Counter(w for x in r for w in x)
    n = 0
    for line in r:
        for i in sorted(set().union(*(lcs_places(line, x) for x in p))):
            if all(side[line[i]] > 0 for side in left):
                n += 1
                for side in left:
                    side[line[i]] -= 1
    sizes = sum(map(len, p)), sum(map(len, r))
    return (0.0, 0.0) if not n else (2 * n / sum(sizes), n / sizes[1])


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt by key over all tasks of a shuffle: few bytes that are dear to compare are not put together for their size."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


#: Pairs that are scored together.
PAIRS = 1024


def _scored(metric, a: pd.Series, b: pd.Series) -> pd.Series:
    """metric (of a list of pairs) of the rows that have both texts, so many at once; else null."""
    found = np.full(len(a), np.nan)
    both = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    for at in range(0, len(both), PAIRS):
        rows = both[at : at + PAIRS]
        found[rows] = np.array(metric(list(zip(a.iloc[rows], b.iloc[rows], strict=True))), dtype=float)
    return pd.Series(found)


@F.pandas_udf(DoubleType())
def near_duplicate_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return _scored(near_duplicates, a, b)


def near_duplicate_score_from(least: float):
    """near_duplicate_score where it is `least` or more, else null; most pairs below it are never aligned."""

    @F.pandas_udf(DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return _scored(lambda pairs: near_duplicates_from(pairs, least), a, b)

    return score


def fuzzy_parts(text: str) -> tuple[int, Counter, list[set]]:
    """What a lower-case text is compared by: characters without spaces, and its sets of bigrams, trigrams and words."""
    x = text.replace(" ", "")
    return len(x), Counter(x), [*({x[i : i + n] for i in range(len(x) - n + 1)} for n in (2, 3)), set(text.split())]


def fuzzy(a: tuple, b: tuple) -> float:
    """overlap.fuzzy_score() of two texts' fuzzy_parts()."""
    (n, x, sets), (m, y, others) = a, b
    same = sum(min(k, y[c]) for c, k in x.items() if c in y)
    p, r = same / n if n else 0.0, same / m if m else 0.0
    best = 1.0 if not n and not m else 2.0 * p * r / (p + r) if same else 0.0
    for u, v in zip(sets, others, strict=True):
        both = len(u & v)
        best = max(best, both / (len(u) + len(v) - both) if u or v else 1.0)
    return best


def greedy_count(left: list[str | None], right: list[str | None], threshold: float) -> int:
    """How many pairs are taken, best scores first, ties by position; no text twice. Null ones have no score."""
    a, b = ([None if t is None else fuzzy_parts(t) for t in side] for side in (left, right))
    scored = sorted((-fuzzy(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y)
    taken: tuple[set, set] = set(), set()
    for s, i, j in scored:
        if s <= -threshold and i not in taken[0] and j not in taken[1]:
            taken[0].add(i)
            taken[1].add(j)
    return len(taken[0])


def greedy_pairs(threshold: float):
    """greedy_count() of two arrays of lower-case texts as a column; null if either is null."""

    @arrow_udf(IntegerType())
    def count(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = ((x.as_py(), y.as_py()) for x, y in zip(left, right, strict=True))
        return pa.array([None if x is None or y is None else greedy_count(x, y, threshold) for x, y in pairs], pa.int32())

    return count


def _best_of_each(metric, prediction: pd.Series, references: pd.Series) -> pd.DataFrame:
    rows = [[metric(p, t) for t in r] if p is not None and r is not None and len(r) else [(np.nan, np.nan)] for p, r in zip(prediction, references, strict=True)]
    return pd.DataFrame([(max(x[0] for x in r), max(x[1] for x in r)) for r in rows], columns=["f1", "recall"])


_TWO = StructType([StructField("f1", DoubleType()), StructField("recall", DoubleType())])


@F.pandas_udf(_TWO)
def rouge_l_score(prediction: pd.Series, references: pd.Series) -> pd.DataFrame:
    """The best of each over an array of references."""
    return _best_of_each(rouge_l, prediction, references)


@F.pandas_udf(_TWO)
def rouge_lsum_score(prediction: pd.Series, references: pd.Series) -> pd.DataFrame:
    """The best of each over an array of references."""
    return _best_of_each(rouge_lsum, prediction, references)


@F.pandas_udf(StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """Unicode form NFD."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))
