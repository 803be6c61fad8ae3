"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.shared import byte_view, fold, pieces, text_or_empty

#: Documents per language (about) that the classifier is fitted on; of all languages together.
SAMPLE, SAMPLE_OF_ALL = 400, 4_000
#: Languages whose counts are broadcast at most.
SENT_LANGUAGES = 10_000
#: Hash buckets of the features: bytes, and runs of 2 and 3 bytes, of the lower-cased UTF-8 text.
BUCKETS = 1 << 12
UND = "und"
#: Texts of so many letters or more with a lower score are in none of the learned languages.
SURE_LETTERS, LEAST_SCORE = 200, 1 / 3

#: Language families by ISO 639-1 code. A language that stands in none is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "celtic": ("br", "cy", "ga", "gd"),
    "baltic": ("lt", "lv"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
    "sinitic": ("yue", "zh"),
}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per text of hashed byte n-gram counts, as square roots of shares (rows have length 1, or 0 if empty)."""
    low = _LOWER[data].astype(np.uint32)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    out = np.zeros(n * BUCKETS, np.float32)
    code = np.zeros(len(low), np.uint32)
    for size in (1, 2, 3):
        span = max(0, len(low) - size + 1)
        code = code[:span] * np.uint32(257) + low[size - 1 :][:span] + np.uint32(1)
        bucket = (code * np.uint32(2654435761)) >> np.uint32(20)
        whole = owner[:span] == owner[size - 1 :][:span]  # not across texts
        out += np.bincount((owner[:span] * BUCKETS + bucket)[whole], minlength=n * BUCKETS).astype(np.float32)
    out = np.sqrt(out.reshape(n, BUCKETS))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def linear_svms(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 200) -> np.ndarray:
    """Weights (the last row is the bias) of squared-hinge SVMs, one for each column of y in -1, 1, by Nesterov's method.

    x has rows of length 1 in single precision and is neither copied nor decomposed: the step follows from the bound
    that rows of length 1 and their bias, with weights that sum to 1, give for the largest singular value.
    """
    weight = np.where(y > 0, 0.5 / np.maximum(1, (y > 0).sum(0)), 0.5 / np.maximum(1, (y <= 0).sum(0))).astype(np.float32)
    y = y.astype(np.float32)
    step = np.float32(1.0 / (1.0 + 2 * cost * 2.0))
    w = v = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    for k in range(rounds):
        slack = weight * y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        new = v - step * (v - np.float32(2 * cost) * np.vstack([x.T @ slack, slack.sum(0)]))
        w, v = new, new + np.float32(k / (k + 3)) * (new - w)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """Family weights (one against the rest) and, for each pair of languages of a family, a separating SVM."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        home = {code: name for name, codes in FAMILIES.items() for code in codes}
        self.langs = sorted(set(langs))
        of = np.array([home.get(v.lower(), v) for v in langs], object)
        self.families = sorted(set(of))
        self.members = [[v for v in self.langs if home.get(v.lower(), v) == f] for f in self.families]
        if len(self.families) > 1:
            self.family = linear_svms(x, np.where(of[:, None] == np.array(self.families, object)[None], 1, -1))
        labels = np.array(langs, object)
        self.pairs = {}
        for group in self.members:
            for a, b in combinations(group, 2):
                here = (labels == a) | (labels == b)
                self.pairs[a, b] = linear_svms(x[here], np.where(labels[here] == a, 1, -1)[:, None])[:, 0]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score): the winner of most pairs in the best family; ties go by the sum of the pairs' scores."""
        if len(self.families) > 1:
            share = sigmoid(2 * (x @ self.family[:-1] + self.family[-1]).astype(np.float64))
            best = share.argmax(1)
            score = share[np.arange(len(x)), best]
        else:
            best, score = np.zeros(len(x), int), np.ones(len(x))
        out = np.empty(len(x), object)
        for k, group in enumerate(self.members):
            rows = np.flatnonzero(best == k)
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(group)))
            sums = np.zeros_like(votes)
            for i, j in combinations(range(len(group)), 2):
                w = self.pairs[group[i], group[j]]
                p = sigmoid(2 * (x[rows] @ w[:-1] + w[-1]).astype(np.float64))
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                sums[:, i] += p
                sums[:, j] += 1 - p
            won = (votes + sums / (len(group) + 1)).argmax(1)
            out[rows] = np.array(group, object)[won]
            if len(group) > 1:
                score[rows] *= sums[np.arange(len(rows)), won] / (len(group) - 1)
        return out, score


def fit(docs: DataFrame, folds: int = 3, held: int | None = 1, sample: int = SAMPLE) -> Model | None:
    """A model from about `sample` documents of each language, drawn by hash from the folds that are not held out.

    Only text and non-null lang of those documents are used, and texts with a letter; None if there are none. held
    None holds no fold out. Languages are counted over all rows, in a table of a row per language; the sample's features
    (BUCKETS floats each, of about SAMPLE_OF_ALL documents however many languages there are) are what the driver gets.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(held is None) | (fold("doc_id", folds) != (held or 0))))
    sizes = known.groupBy("lang").count()
    if not (many := sizes.count()):
        return None
    share = F.lit(min(sample, SAMPLE_OF_ALL / many)) / F.col("count")
    place = F.pmod(F.xxhash64(F.lit(9), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    placed = known.select("lang", "text", place.alias("_place"))
    # a row per language: sent to every task while there are few of them
    drawn = placed.join(F.broadcast(sizes) if many <= SENT_LANGUAGES else sizes, "lang").where(F.col("_place") < share).select("lang", F.col("text").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            rows = [i for i, t in enumerate(batch.column("_text")) if _has_letter(t.as_py().decode())]
            if rows:
                part = batch.take(pa.array(rows))
                x = features(*byte_view(part.column("_text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"]
                )

    rows = drawn.mapInArrow(run, "lang string, x binary").toArrow().sort_by([("lang", "ascending"), ("x", "ascending")])
    if not rows.num_rows:
        return None
    data, _ = byte_view(rows.column("x"))
    return Model(data.view(np.float32).reshape(rows.num_rows, BUCKETS), rows.column("lang").to_pylist())


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """keep, lang_pred and score of each row; only the text is looked at.

    Null texts and texts without a letter, and all texts if there is no model, are `und` with score 0.
    """
    source = docs.select(*keep, text_or_empty("text").cast("binary").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in pieces(batches, "_text"):
            ok = np.array([known is not None and _has_letter(t.as_py().decode()) for t in batch.column("_text")])
            lang, score = np.full(batch.num_rows, UND, object), np.zeros(batch.num_rows)
            if ok.any():
                lang[ok], score[ok] = known.predict(features(*byte_view(batch.column("_text").filter(pa.array(ok)))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score)],
                names=[*keep, "lang_pred", "score"],
            )

    like = source.drop("_text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)})
    return source.mapInArrow(run, like.schema)


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), folds: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """keep, held_out (the document was not learned from for its fold), lang_pred, score (0 to 1)."""
    found = predict(docs.withColumn("_held", fold("doc_id", folds) == held), fit(docs, folds, held, sample), [*keep, "_held"])
    return found.withColumnRenamed("_held", "held_out").select(*keep, "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents in which a language is found, with their own columns; lang, where it is null, is that language.

    All labelled documents may be learned from. No language is found in a text without a letter, nor in one of
    SURE_LETTERS letters or more with a score under LEAST_SCORE: long enough to be sure that no learned language fits.
    With nothing to learn from, texts with a letter stay and their lang stays null. An empty table gives an empty result.
    """
    model = fit(docs, held=None)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    whole = docs.select("text", F.struct(*docs.columns).alias("_doc"))
    short = F.length(F.regexp_replace(F.col("_doc.text"), r"\P{L}", "")) < SURE_LETTERS
    found = predict(whole, model, ["_doc"]).where((F.col("lang_pred") != UND) & ((F.col("score") >= LEAST_SCORE) | short))
    return found.select(*(F.coalesce(F.col("_doc")[c], "lang_pred").alias(c) if c == "lang" else F.col("_doc")[c].alias(c) for c in docs.columns))
