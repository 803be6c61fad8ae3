import math
import zlib

import numpy as np

from folioweave.llm import langid, queries
from folioweave.llm.shared import fold


def test_features_match_brute_force():
    texts = ["", "Ab\tc", "é", "aaa b"]
    data = b"".join(t.encode() for t in texts)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    x = langid.features(np.frombuffer(data, np.uint8), offsets)
    for row, t in zip(x, texts, strict=True):
        b = [32 if c in (9, 10, 11, 12, 13) else c for c in t.encode().lower()]
        want = np.zeros(langid.BUCKETS)
        for n in (1, 2, 3):
            for i in range(len(b) - n + 1):
                code = 0
                for c in b[i : i + n]:
                    code = (code * 257 + c + 1) % 2**32
                want[(code * 2654435761 % 2**32) >> 20] += 1
        want = np.sqrt(want / max(1, want.sum()))
        assert np.allclose(row, want, atol=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, ("doc_id", "lang")).where("held_out AND lang_pred <> 'und'").collect()
    assert len(found) > 200
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_edges(spark):
    rows = [(None, "le la les", "fr", 1), (1, None, "en", 2), (2, "12 !?", "en", 3), (3, "", None, 4), (4, "the of", None, 5)]
    rows += [(k, "the and of " * 9, "en", 0) for k in range(10, 16)] + [(k, "le et la des " * 9, "fr", 0) for k in range(20, 26)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    found = langid.identify(docs, ("doc_id", "text")).collect()
    assert len(found) == len(rows)
    by = {r.text: r for r in found}
    assert (by[None].lang_pred, by["12 !?"].lang_pred, by[""].lang_pred) == ("und",) * 3
    assert (by["the of"].lang_pred, by["le la les"].lang_pred) == ("en", "fr")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 5
    assert all(r.lang_pred == "und" and r.score == 0 for r in langid.identify(docs.where("lang IS NULL")).collect())
    assert langid.identify(docs.where("false")).collect() == []


def test_fold(spark):
    ids = [0, 1, 2, 77, 10**12, None]
    found = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(fold("doc_id", 3).alias("f")).collect()
    assert [r.f for r in found] == [zlib.crc32(str("" if i is None else i).encode()) % 3 for i in ids]


def test_nothing_to_learn_from_keeps_documents_with_letters(spark):
    held = [i for i in range(99) if zlib.crc32(str(i).encode()) % 3 == 1][:4]
    for lang in (None, "en"):
        rows = [(held[0], "the cat and the dog", lang), (held[1], "12 !? 34", lang), (held[2], None, lang), (held[3], "", lang)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert langid.fit(docs) is None
        assert [tuple(r) for r in langid.keep_identified(docs).collect()] == rows[:1]


def test_kept_documents_get_the_language_found(spark):
    rows = [(k, "the and of " * 9, "en") for k in range(10, 26)] + [(k, "le et la des " * 9, "fr") for k in range(30, 46)]
    asked = [(1, "the and of the", None), (2, "le et la des le", None), (3, "12 !?", None), (4, "the and of", "de")]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.lang for r in langid.keep_identified(docs).collect()}
    assert kept == {r[0]: r[2] for r in rows} | {1: "en", 2: "fr", 4: "de"}


def test_long_texts_in_no_language_go_and_others_stay(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    asked = [(-1, "0X7FQ9ZK#!" * 60, None), (-2, "qz", "en"), (-3, "the and of with " * 200_000, "en"), (-4, "of" * 1_000_000, None)]
    kept = {r.doc_id for r in langid.keep_identified(real.union(spark.createDataFrame(asked, real.schema))).select("doc_id").collect()}
    assert {-2, -3} <= kept and -1 not in kept
    assert real.count() - sum(d >= 0 for d in kept) <= 3
    assert langid.keep_identified(real.where("false")).collect() == []


def test_many_languages_keep_the_sample_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_OF_ALL", 300)
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('word ', id % 60, ' ', md5(cast(id AS string))) AS text", "concat('l', id % 60) AS lang")
    model = langid.fit(docs, held=None)
    assert len(model.langs) > 50 and len(model.families) == len(model.langs) and not model.pairs


def plain_prediction(x, model):
    """The best family, then the language that wins most of its pairs; one row, with plain sums."""
    value = lambda w: 1 / (1 + math.exp(-2 * (float(np.dot(x.astype(np.float64), w[:-1].astype(np.float64))) + float(w[-1]))))
    shares = [value(model.family[:, k]) for k in range(len(model.families))]
    k = max(range(len(shares)), key=shares.__getitem__)
    group, score = model.members[k], shares[k]
    votes, sums = dict.fromkeys(group, 0), dict.fromkeys(group, 0.0)
    for (a, b), w in model.pairs.items():
        if a in votes and b in votes:
            p = value(w)
            votes[a if p >= 0.5 else b] += 1
            sums[a] += p
            sums[b] += 1 - p
    best = max(group, key=lambda v: votes[v] + sums[v] / (len(group) + 1))
    return best, score * (sums[best] / (len(group) - 1) if len(group) > 1 else 1)


def test_whole_query_against_a_plain_recomputation(spark):
    """Every document's row of the registered query; only the fitted model is taken over."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs)
    found = {r.doc_id: r for r in queries.op9_hierarchical_language(spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(found) == len(rows) > 100
    for r in rows:
        got = found[r.doc_id]
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if not any(map(str.isalpha, r.text or "")):
            assert (got.lang_pred, got.score) == ("und", 0)
            continue
        data = r.text.encode()
        lang, score = plain_prediction(langid.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0], model)
        assert got.lang_pred == lang and abs(got.score - score) < 1e-4, r.doc_id
