import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from folioweave.llm import hmm


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + ["</s>"]


def small():
    rnd = np.random.default_rng(2)
    start, move, emit = rnd.random(3), rnd.random((3, 3)), rnd.random((5, 3))
    model = hmm.Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return model, [rnd.integers(0, 5, n) for n in (1, 4, 2, 4, 3)]


def paths(model, s):
    """(probability of state path and symbols) for every path."""
    for z in np.ndindex(*[3] * len(s)):
        p = model.start[z[0]] * model.emit[s[0], z[0]]
        for t in range(1, len(s)):
            p *= model.move[z[t - 1], z[t]] * model.emit[s[t], z[t]]
        yield z, p


def test_forward_is_the_sum_over_paths():
    model, seqs = small()
    assert np.allclose(hmm.forward(model, seqs), [math.log10(sum(p for _, p in paths(model, s))) for s in seqs])


def test_expected_counts_are_posterior_sums():
    model, seqs = small()
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in seqs:
        total = sum(p for _, p in paths(model, s))
        for z, p in paths(model, s):
            start[z[0]] += p / total
            for t in range(len(s)):
                emit[s[t], z[t]] += p / total
                if t:
                    move[z[t - 1], z[t]] += p / total
    counts = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    log = hmm.expected(model, seqs, counts)
    assert np.isclose(log, hmm.forward(model, seqs).sum())
    assert np.allclose(counts[0], start) and np.allclose(counts[1] * model.move, move) and np.allclose(counts[2], emit)


def test_expected_counts_do_not_depend_on_what_is_held():
    model, seqs = small()
    rnd = np.random.default_rng(5)
    seqs = seqs + [rnd.integers(0, 5, 400), rnd.integers(0, 5, 90)]
    own = [np.where(s > 2, s - 3, -1) for s in seqs]
    out = []
    for held in (1, 7, 100, 10**9):
        counts, rows = (np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))), np.zeros((2, 3))
        log = hmm.expected(model, seqs, counts, own, rows, held)
        out.append(np.concatenate([[log], *(c.ravel() for c in counts), rows.ravel()]))
    assert all(np.allclose(x, out[-1]) for x in out)


def plain_scores(rows, states, passes, letters):
    """{row index: score} by Baum-Welch and the forward recursion one text and token at a time."""
    first, of_class = len(letters.known), lambda w: zlib.crc32(w[-3:]) % hmm.CLASSES
    texts = [hmm.tokens((t or "").encode()) for _, t in rows]
    folds = [zlib.crc32(str("" if d is None else d).encode()) % 7 for d, _ in rows]
    symbol = lambda w: letters.known[w][0] if w in letters.known else first + of_class(w)

    def posteriors(model, seq):
        a = [model.start * model.emit[seq[0]]]
        for s in seq[1:]:
            a.append(a[-1] / a[-1].sum() @ model.move * model.emit[s])
        a = [x / x.sum() for x in a]
        b = [np.ones(states)]
        for s in reversed(seq[1:]):
            b.insert(0, model.move @ (model.emit[s] * b[0]))
            b[0] /= b[0].sum()
        g = [x * y / (x * y).sum() for x, y in zip(a, b, strict=True)]
        pairs = [np.outer(a[t], model.emit[seq[t + 1]] * b[t + 1]) * model.move for t in range(len(seq) - 1)]
        return g, [p / p.sum() for p in pairs]

    def count(model, chosen):
        start, move, emit, rare = np.zeros(states), np.zeros((states, states)), np.zeros((letters.size, states)), {}
        for i in chosen:
            g, pairs = posteriors(model, [symbol(w) for w in texts[i]])
            start += g[0]
            move += sum(pairs, np.zeros((states, states)))
            for w, x in zip(texts[i], g, strict=True):
                emit[symbol(w)] += x
                if w not in letters.known:
                    rare[w] = rare.get(w, 0) + x
        return start, move, emit, rare

    model, sums, step = hmm.Hmm.first(letters.mass, states), None, 0
    for k in [k for k in range(7) if k != 2]:
        chosen = [i for i, f in enumerate(folds) if f == k]
        if chosen:
            new = count(model, chosen)[:3]
            rate = (step + 1) ** -0.6
            sums = new if sums is None else [(1 - rate) * a + rate * b for a, b in zip(sums, new, strict=True)]
            model = hmm.Hmm.of(*sums, letters.mass)
        step += 1
    every = [i for i, f in enumerate(folds) if f != 2]
    for _ in range(passes):
        *sums, rare = count(model, every)
        model = hmm.Hmm.of(*sums, letters.mass)
    share = np.array([c / c.sum() if c.sum() else np.ones(states) for c in sums[2][first:]]) + hmm.FLOOR
    out = []
    for words_ in texts:
        p, log = None, 0.0
        for w in words_:
            e = model.emit[symbol(w)]
            if w not in letters.known:
                n = rare.get(w, np.zeros(states))
                e = e * ((n + hmm.FLOOR * n.sum()) / share[of_class(w)] + 1) / 10 ** letters.class_log[of_class(w)]
            p = (model.start if p is None else p @ model.move) * e
            log += math.log10(p.sum())
            p = p / p.sum()
        out.append(log)
    return out


def test_scores_against_a_plain_recomputation(spark):
    rnd = np.random.default_rng(9)
    groups = [["sun", "sky", "x1", "y2", "The"], ["moon", "sea", "z3", "of"]]
    rows = [(i, " ".join(rnd.choice(groups[i % 2], rnd.integers(0, 12))) + (f" odd{i % 9}" if i % 3 else "")) for i in range(60)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    letters = hmm.alphabet(hmm.count_words(docs).cache(), 6)
    got = {r.doc_id: r.score for r in hmm.score_documents(docs, states=3, words=6, passes=2).collect()}
    want = plain_scores(rows, 3, 2, letters)
    assert all(abs(got[d] - w) < 1e-3 for (d, _), w in zip(rows, want, strict=True))


def test_tokens_of_many_texts_are_those_of_each():
    """Edges, odd bytes, long words, no texts, and slices, which Arrow's own lower-casing misreads."""
    odd = [b"", b" ", b"A b", b" \x0bX\x1cy\xc2\x85Z  \xff ", b"W" * 100 + b" z " + b"W" * 100, b"\n\n", b"v" * 65 + b"q", b"v" * 64]
    rows = pa.array(odd + [b"%d Some  Words\t%d\n" % (i, i % 7) * (i % 50) for i in range(3_000)], pa.binary())
    for part in (rows, rows[1:7], rows[900:2_100], rows[:0]):
        for texts in (part, part.cast(pa.large_binary())):
            words_, at = hmm.tokens_of(texts)
            words_ = words_.to_pylist()
            assert [words_[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == [hmm.tokens(t) for t in part.to_pylist()]


def test_encoded_texts_are_their_words(spark):
    rows = [(i, f"the sea {'Sun ' * (i % 4)}w{i % 11} w{i % 7} w{i % 11} {'z' * (60 + i % 9)}") for i in range(80)] + [(None, None), (99, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    letters = hmm.alphabet(hmm.count_words(docs).cache(), 4)
    first = len(letters.known)
    assert 0 < first <= 4
    for r, (_, text) in zip(hmm.encode(docs, letters, ["doc_id"]).collect(), rows, strict=True):
        said = hmm.tokens((text or "").encode())
        rare, known = [w for w in said if w not in letters.known], [letters.known[w] for w in said if w in letters.known]
        assert np.frombuffer(r.symbols, "<u2").tolist() == [letters.known[w][0] if w in letters.known else first + zlib.crc32(w[-3:]) % hmm.CLASSES for w in said]
        assert [bytes(r.words[k]) for k in np.frombuffer(r.odd, "<u4")] == rare and len(r.words) == len(set(rare))
        assert (r.n_tokens, r.n_known) == (len(said), len(known))
        assert math.isclose(r.log_known, sum(math.log10(c + 1) for _, c in known), abs_tol=1e-9)
        assert math.isclose(r.log_class, sum(letters.class_log[zlib.crc32(w[-3:]) % hmm.CLASSES] for w in rare), abs_tol=1e-9)


def test_likelihood_rises_from_pass_to_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    letters = hmm.alphabet(hmm.count_words(docs).cache(), 300)
    encoded = hmm.encode(docs.withColumn("_fold", hmm.fold("doc_id", 7)), letters, ["_fold"]).cache()
    _, seen = hmm.train(encoded, letters, 4, 4)
    assert len(seen) == 3 and seen == sorted(seen)


def test_long_words_count_as_others(spark):
    long, other = "w" * 3_000 + "end", "v" * 3_000 + "end"
    rows = [(i, f"{long} a {long} b{i % 3}" + f" {other}" * (i == 5)) for i in range(30)]
    counts = hmm.count_words(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    letters = hmm.alphabet(counts, 4)
    kept = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    [key] = [w for w in letters.known if len(w) > 1 and w[-3:] == b"end"]
    assert letters.known[key][1] == 2 * len(kept) and len(key) < hmm.LONGEST
    assert len(set(hmm.tokens(f"{long} {other} {long}".encode()))) == 3  # two words and the end
    assert letters.distinct == len({w for t in kept for w in words(t)})


def test_forward_does_not_depend_on_what_is_held():
    model, seqs = small()
    seqs = [*seqs, np.arange(300) % 5, np.arange(40) % 3]
    own, times = [np.where(s > 2, s - 3, -1) for s in seqs], np.array([[0.5, 2, 1], [3, 1, 0.1]])
    out = [hmm.forward(model, seqs, own, times, held) for held in (1, 7, 100, 10**9)]
    assert all(np.allclose(x, out[-1]) for x in out)
    changed = hmm.Hmm(model.start, model.move, np.vstack([model.emit[:3], model.emit[3:] * times]))
    assert np.allclose(out[0], hmm.forward(changed, seqs))


def test_very_long_texts_and_words(spark):
    docs = spark.createDataFrame([(1, "a b c " * 150_000), (2, "w" * 1_000_000 + " a b"), (3, "long" * 100 + " a"), (4, "long" * 100)], "doc_id long, text string")
    got = {r.doc_id: r for r in hmm.score_documents(docs, states=2, passes=1).collect()}
    assert got[1].n_tokens == 450_001 and got[2].n_tokens == 4 and all(math.isfinite(r.score) for r in got.values())


def test_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, None), (7, ""), (7, ""), (9, "\x0bNEVER\x1cseen é")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    got = hmm.score_documents(frame, words=300).collect()
    train = Counter(w for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2 for w in words(t))
    n, v = sum(train.values()), len(train)
    want = sorted((str(d), len(words(t)), sum(train[w] > 0 for w in words(t)), round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 10 and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sorted((r.doc_id, r.score) for r in got if r.n_tokens == 1 and r.doc_id)[0][1] == max(r.score for r in got)


def test_starts_moves_and_symbols_are_distributions(spark):
    docs = spark.createDataFrame([(k, "a b c a xx yy zz " * 3) for k in range(12)], "doc_id long, text string")
    letters = hmm.alphabet(hmm.count_words(docs).cache(), 3)
    model = hmm.train(hmm.encode(docs.withColumn("_fold", hmm.fold("doc_id", 7)), letters, ["_fold"]), letters, 2)[0]
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1)


def test_empty(spark):
    assert hmm.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = spark.createDataFrame([(9, "held out"), (9, None)], "doc_id long, text string")
    assert {r.train_tokens for r in hmm.score_documents(only).collect()} <= {0, 2, 4}


def test_a_word_below_the_cap_has_emissions_of_its_own(spark):
    """Two words of one class and count that stand in different contexts are told apart."""
    train = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2][:40]
    held = [i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    text = {0: "sun sky sun xaaaa sun sky " * 300, 1: "moon sea moon yaaaa moon sea " * 300}
    rows = [(i, text[k % 2]) for k, i in enumerate(train)]
    asked = ["sun sky sun xaaaa sun sky", "sun sky sun yaaaa sun sky", "moon sea moon yaaaa moon sea", "moon sea moon xaaaa moon sea"]
    docs = spark.createDataFrame(rows + list(zip(held, asked, strict=True)), "doc_id long, text string")
    for words in (4, 100):
        letters = hmm.alphabet(hmm.count_words(docs).cache(), words)
        assert (b"xaaaa" in letters.known) == (words == 100)
        got = {r.doc_id: r for r in hmm.score_documents(docs, states=2, words=words).collect()}
        at = [got[i] for i in held]
        assert all(r.held_out for r in at) and at[0].base_score == at[1].base_score
        assert at[0].score > at[1].score + 0.3 and at[2].score > at[3].score + 0.3


def test_own_emissions_fill_their_class():
    """In each state the words' factors and one unseen word's add up to the class's tokens, words and one."""
    n = np.random.default_rng(3).gamma(0.3, 1.0, (50, 4)) * [1, 1, 5, 0]
    share = n.sum(0) / n.sum() + hmm.FLOOR
    times = hmm.own_times(n, np.repeat(share[None], 50, 0))
    assert np.allclose(times.sum(0) + 1, n.sum() + 50 + 1)
    spread = hmm.own_times(3 * (share - hmm.FLOOR)[None], share[None])
    assert np.allclose(spread, 4)
    assert np.allclose(hmm.own_times(np.zeros((1, 4)), share[None]), 1)


def test_every_infrequent_training_word_has_a_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150)
    counts = hmm.count_words(docs).cache()
    letters = hmm.alphabet(counts, 300)
    encoded = hmm.encode(docs.withColumn("_fold", hmm.fold("doc_id", 7)), letters, ["_fold"]).cache()
    counted = hmm.count_states(encoded, letters, hmm.Hmm.first(letters.mass, 4)).cache()
    rows = {bytes(r.word): r for r in counted.where("row = -1").collect()}
    want = {bytes(r.word): r.c for r in counts.collect() if bytes(r.word) not in letters.known}
    assert {w: r.c for w, r in rows.items()} == want
    assert all(np.isclose(sum(r.n), r.c, rtol=1e-4) for r in rows.values())
    assert np.allclose(hmm.collected(counted, letters, 4)[5:].sum(1), letters.mass, rtol=1e-4)


def test_training_folds_count_alike(spark):
    """Equally frequent words of the first and the last fold are as probable; with one state counts alone decide."""
    of = lambda f, n: [i for i in range(500) if zlib.crc32(str(i).encode()) % 7 == f][:n]
    rows = [(i, "early " * 50) for i in of(0, 10)] + [(i, "later " * 50) for i in of(6, 10)]
    rows += list(zip(of(2, 2), ["early " * 3, "later " * 3], strict=True))
    got = {r.doc_id: r for r in hmm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), states=1).collect()}
    early, later = (got[i] for i in of(2, 2))
    assert early.held_out and later.held_out and early.base_score == later.base_score
    assert abs(early.score - later.score) < 1e-6


def test_states_do_not_depend_on_the_steps_that_are_scaled(monkeypatch):
    """Nor do likely paths through very unlikely symbols vanish between two scalings."""
    model, seqs = small()
    rnd = np.random.default_rng(6)
    seqs = [*seqs, rnd.integers(0, 5, 90), rnd.integers(0, 5, 91)]
    faint = hmm.Hmm(model.start, model.move, model.emit * 1e-20)
    out = []
    for scaled in (1, 3, hmm.SCALED):
        monkeypatch.setattr(hmm, "SCALED", scaled)
        counts = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
        log = hmm.expected(faint, seqs, counts, held=40)
        out.append(np.concatenate([[log + 20 * sum(map(len, seqs))], *(c.ravel() for c in counts), hmm.forward(model, seqs, held=40)]))
    assert all(np.allclose(x, out[0]) for x in out)
    assert np.isclose(out[0][0], hmm.forward(model, seqs).sum()) and np.isclose(out[0][-len(seqs) :].sum(), out[0][0])


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    """Documents meet what their infrequent words have a block at a time: no list of them is gathered for each document."""
    rows = [(i, f"the sea w{i % 11} w{i % 7} w{i % 11} only{i}" * (i % 3)) for i in range(60)] + [(None, None), (99, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    out = []
    for block in (2, 4096):
        monkeypatch.setattr(hmm, "BLOCK", block)
        out.append(sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in hmm.score_documents(docs, states=2, words=4, passes=1).collect()))
    assert out[0] == out[1] and len(out[0]) == len(rows)
