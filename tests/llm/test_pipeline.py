"""The pipeline against a plain version of its five stages, on planted documents."""

import hashlib
import random

import corpus_pipeline
from test_decontam import slow as slow_contamination
from test_pii import slow_base
from test_simhash import slow_components, slow_fingerprint


def plain_mix(docs, weights=(5, 2, 1), cap=3):
    """doc rows (doc_id, text, source) -> {row index: words taken}"""
    size = [len([w for w in (t or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]) for _, t, _ in docs]
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, d in zip(size, docs, strict=True) if d[2] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, open_, rest = {}, set(sources), sum(size)
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * total[s]]
        if not over:
            break
        for s in over:
            target[s] = float(cap * total[s])
            open_.remove(s)
            rest -= cap * total[s]
    target |= share
    taken = {}
    for s in sources:
        rows = [i for i, d in enumerate(docs) if d[2] == s]
        copies, within = divmod(int(target[s] + 1e-9), total[s]) if total[s] else (0, 0)
        place = {i: hashlib.md5(f"{'' if docs[i][0] is None else docs[i][0]}:{docs[i][1] or ''}".encode()).hexdigest()[:15] for i in rows}
        for p in sorted(set(place.values())):
            same = [i for i in rows if place[i] == p]
            n = sum(size[i] for i in same)
            for i in same:
                taken[i] = size[i] * copies + (size[i] if n <= within else size[i] * max(0, within) // n if n else 0)
            within -= n
    return target, taken, size


def fixture():
    rnd = random.Random(11)
    words = {"en": "the of and that which these there were with from over under".split(), "fr": "le la les des une dans avec pour sur qui être où".split()}
    prose = lambda lang, n: " ".join(rnd.choice(words[lang]) + rnd.choice(["", "s", "er"]) for _ in range(n))
    bench = [(k, prose("en", 20)) for k in range(3)]
    docs = [(i, prose(lang := rnd.choice(["en", "fr"]), rnd.randint(20, 90)), lang, f"s{i % 4}") for i in range(60)]
    docs += [(100 + i, docs[i][1], docs[i][2], "copy") for i in range(8)]
    docs += [(200 + i, docs[i][1] + " end", docs[i][2], "copy") for i in range(5)]
    docs += [(300, f"{bench[0][1]} {prose('en', 30)}", "en", "s1"), (301, prose("en", 500) + " " + bench[1][1], "en", "s1")]
    docs += [(400, "Write me@site.org or +1 (784) 555-9263 from 10.1.2.3 on " + prose("en", 40), "en", None)]
    docs += [(500, "123 456", "en", "s2"), (501, None, None, "s3"), (502, "", "fr", "s0"), (None, prose("fr", 33), "fr", "s0")]
    return docs, bench


def test_against_the_plain_stages(spark, tmp_path):
    docs, bench = fixture()
    frame = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [d for d in docs if d[1] and any(map(str.isalpha, d[1]))]
    parts = slow_components([d[0] for d in left], [slow_fingerprint(d[1]) for d in left])
    left = [d for d, p in zip(left, parts, strict=True) if d[0] == p]
    hit = {(d, str(h)): 20 * len(h) >= n for d, n, h, _ in slow_contamination([d[:2] for d in left], bench) if h}
    bad = {d for (d, _), over in hit.items() if over}
    left = [d for d in left if d[0] not in bad]
    assert bad == {300}
    clean = []
    for d in left:
        text = d[1]
        for k, a, b in sorted(slow_base(text), key=lambda s: -s[1]):
            text = text[:a] + f"[{('EMAIL', 'IP', 'CARD', 'PHONE')[k]}]" + text[b:]
        clean.append((d[0], text, d[3]))
    target, taken, size = plain_mix(clean)
    want = sorted(
        (str(d[0]), d[1], copy + 1, min(size[i], taken[i] - size[i] * copy))
        for i, d in enumerate(clean)
        for copy in range(-(-taken[i] // max(1, size[i])))
    )

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text, r.copy, r.taken) for r in got) == want
    by = {}
    for r in got:
        by[r.source] = by.get(r.source, 0) + r.taken
    for s, t in target.items():
        assert abs(by.get(s, 0) - t) <= 2
    assert all(r.n_chars == len(r.text) for r in got)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "benchmark decontamination":
            assert stage(spark, docs, "").columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "simhash near-dedup", "benchmark decontamination", "personal data", "source mixing"]


def test_no_documents(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some words of a benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.collect() == [] and got.columns[:5] == [n.split()[0] for n in names.split(", ")]


def test_documents_without_a_text(spark, tmp_path):
    spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_personal_data_stage_keeps_clean_words(spark):
    """Words and part numbers that look like an entity's parts stay; true repeats go, however many."""
    plain = "Write to support@example.com for help. Our support is good and customer support is open. Part 17845559263 in stock."
    rows = [(1, plain, "en", "a", len(plain)), (2, "Call +1 (784) 555-9263" + " or 7845559263 then" * 1000, "en", "a", 0), (3, "Our support editor", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    kept = {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, docs, "").collect()}
    assert kept == {1: plain.replace("support@example.com", "[EMAIL]"), 2: "Call [PHONE]" + " or [PHONE] then" * 1000, 3: rows[2][1]}
