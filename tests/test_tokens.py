"""Tokens against another implementation, learned sentences against a plain recomputation, on whole tables."""

import base64
import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import tiktoken

from folioweave.functions import tokens as K
from folioweave.operators import splitting
from folioweave.plans import inference, score_queries

SF_DIR = "/root/testdata/sf0.001"


def other_encoder():
    with open(K.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_another_encoder():
    with open(K.VOCABULARY, "rb") as f:
        mine = K.Encoder(f.read())
    other, rnd = other_encoder(), random.Random(1)
    parts = ["the", " The", "ing", "é", "😀", " ", "\n", "\xa0", "1", "23", "...", "'s", "ß", "xq", "  ", "日本語", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20)))
        ids = other.encode_ordinary(text)
        assert mine.counts(text) == len(ids), text
        for most in (0, 1, 3, 100):
            assert mine.cut(text, most) == other.decode_bytes(ids[:most]).decode(errors="ignore"), (text, most)
    for text in ("a" * 200_000, "ab" * 50_000 + " " * 5_000 + "x", "é" * 40_000):
        assert mine.counts(text) > 0
    assert mine.counts("a" * 3_000) == len(other.encode_ordinary("a" * 3_000))


def test_truncate_tokens_on_the_whole_table(spark):
    other = other_encoder()
    want = {}
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect():
        ids = other.encode_ordinary(r.text)
        kept = r.text if len(ids) <= 400 else other.decode_bytes(ids[:300]).decode(errors="ignore")
        want[r.doc_id] = (len(ids), len(other.encode_ordinary(kept)), hashlib.md5(kept.encode()).hexdigest())
    got = {r.doc_id: (r.original_ctx_length, r.final_ctx_length, r.context) for r in score_queries.truncate_tokens(spark, SF_DIR).collect()}
    assert got == want
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six")], "id int, context string")
    held = {r.id: (r.original_ctx_length, r.context, r.final_ctx_length) for r in inference.prepare(rows, 4, 1, vocabulary=K.VOCABULARY).collect()}
    assert held == {1: (None, None, None), 2: (0, "", 0), 3: (6, "one two three", 3)}
    split = inference.prepare(rows.where("id = 3"), 400, 1, split_words=3, vocabulary=K.VOCABULARY).first()
    assert split.context == "[DOC 0]\none two three\n\n[DOC 1]\nfour five six\n\n"
    assert inference.prepare(rows, 400, 1, limit=3, vocabulary=K.VOCABULARY).count() == 1


def plain_abbreviations(texts):
    counts, ended = Counter(), Counter()
    for t in texts:
        for w in re.findall(r"[^\s.!?,;:()\"']+(?:\.[^\s.!?,;:()\"']+)*\.?", t.lower()):
            if re.search(r"[^\W\d_]", w):
                counts[w.rstrip(".")] += 1
                ended[w.rstrip(".")] += w.endswith(".")
    n, p = sum(counts.values()), sum(ended.values()) / max(1, sum(counts.values()))
    out = set()
    for w, k in ended.items():
        if k and p < 1:
            off, letters = counts[w] - k, len(w) - w.count(".") + 1
            ratio = 2 * (k * (math.log(0.99) - math.log(p)) + off * (math.log(0.01) - math.log(1 - p)))
            if ratio * math.exp(-letters) * (w.count(".") + 1) * float(letters) ** -off >= 0.3:
                out.add(w)
    assert n == sum(counts.values())
    return out


PLAIN_WORD = r"[^\s.!?,;:()\"']+(?:\.[^\s.!?,;:()\"']+)*"


def plain_kind(word):
    return word.lower() if re.search(r"[^\W\d_]", word) else "##"


def plain_association(a, b, both, every):
    log = lambda k, n, p: (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n > k else 0)
    inside, p, outside = both / a, b / every, (b - both) / (every - a) if every > a else 0
    if inside <= p:
        return 0
    return 2 * (log(both, a, inside) + log(b - both, every - a, outside) - log(both, a, p) - log(b - both, every - a, p))


def plain_case(word):
    return {"Ll": 1, "Lu": 2}.get(unicodedata.category(word[0]), 0)


def plain_continuing(texts, held):
    """Every rule in plain Python, a period at a time."""
    single, pairs, cases, inner = Counter(), Counter(), set(), set()
    for t in texts:
        found = list(re.finditer(PLAIN_WORD + r"\.?", t))
        for k, m in enumerate(found):
            w, gap = m[0], t[found[k - 1].end() : m.start()] if k else "\n"
            kind = plain_kind(w.removesuffix("."))
            single[kind] += 1
            cases.add((kind, plain_case(w)))
            if k and not found[k - 1][0].endswith(".") and not set(gap) & set(".!?\n"):
                inner.add((kind, plain_case(w)))
            if w.endswith("."):
                x = found[k + 1][0] if k + 1 < len(found) else ""
                pairs[kind, plain_kind(x.removesuffix(".")) if x else "", plain_case(x) if x else 0] += 1
    every, ends, both, begins = sum(single.values()), Counter(), Counter(), set()
    odd = lambda a: a in held or a == "##" or len(a) == 1
    for (a, b, case), n in pairs.items():
        both[a, b] += n
        if not odd(a) and b:
            ends[b] += n
            begins |= {b} if case == 1 else set()
    starts = {b for b, n in ends.items() if b != "##" and plain_association(sum(ends.values()), single[b], n, every) >= 30}
    together = {(a, b) for (a, b), n in both.items() if b and b not in starts and (a in held or a == "##") and plain_association(single[a], single[b], n, every) >= 7.88}

    def goes_on(a, b, case):
        if (a, b) in together:
            return True
        must_start = case == 2 and (b, 1) in cases and (b, 2) not in inner
        must_go_on = case == 1 and ((b, 2) in cases or b not in begins)
        if a in held and (len(a) == 1 or not (must_start or (case == 2 and b in starts))):
            return True
        return (a == "##" or len(a) == 1) and (must_go_on or (len(a) == 1 and case == 2 and (b, 1) not in cases))

    return {p for p in pairs if goes_on(*p)}, starts, together


def plain_sentences(text, known):
    out, start, at = [], None, 0
    for piece in re.findall(r"(?:[^.!?\n]*[.!?\n]|[^.!?\n]+\Z)\s*", text):
        core = re.match(r"[^.!?\n]*[.!?]?", piece)[0]
        begin, at = at, at + len(piece)
        if not core.strip():
            continue
        start = begin if start is None else start
        end = begin + len(core.rstrip())
        words = [m for m in re.finditer(PLAIN_WORD + r"\.?", text[max(start, end - 250) : end])]
        word = words[-1][0] if words and words[-1].end() == end - max(start, end - 250) else ""
        after = re.search(PLAIN_WORD, text[begin + len(core) :][:200])
        pair = word and plain_kind(word[:-1]), plain_kind(after[0]) if after else "", plain_case(after[0]) if after else 0
        joins = core.strip().endswith(".") and (len(piece) == len(core) or (pair in known and (after or len(text) - begin - len(core) <= 200) and "\n" not in piece[len(core) :]))
        if not joins or not text[at:].strip():
            out.append((start, begin + len(core), text[start : begin + len(core)].strip()))
            start = None
    return out


TALK = ["Dr. Smith met Mr. Jones. They spoke.", "Ask Dr. Who, Mr. X and Mrs. Y. Then go home. We met Dr. No", "See e.g. this one. It was e.g. that. Mr.\nSplit here. All good now.", "They met at home. Home is good. Now go. Here we go. So it is good. It was home. No one said that, that one did; here they go now and spoke again."] * 30


def test_abbreviations_of_the_corpus_end_no_sentence(spark):
    rows = [*enumerate(TALK), (900, None), (901, ""), (902, " \n ")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "k int, text string, start int").repartition(3)
    counted = splitting.word_counts(docs)
    held = {r.word for r in splitting.abbreviations(counted).collect()}
    assert held == plain_abbreviations(TALK) and {"dr", "mr", "e.g"} <= held and not {"home", "good", "now"} & held
    found = {}
    for r in splitting.learned_sentences(docs, "k").orderBy("span_idx").collect():
        found.setdefault(r.k, []).append((r.start, r.end, r.text))
    known, _, _ = plain_continuing(TALK, held)
    assert {tuple(r) for r in splitting.continuing(counted, splitting.abbreviations(counted)).collect()} == known
    assert found == {k: s for k, t in rows if t and (s := plain_sentences(t, known))}
    assert [s[2] for s in found[0]] == ["Dr. Smith met Mr. Jones.", "They spoke."] and [s[2] for s in found[2]] == ["See e.g. this one.", "It was e.g. that.", "Mr.", "Split here.", "All good now."]
    assert splitting.learned_sentences(docs.limit(0), "k").collect() == []


FIRMS = ["We like Acme Inc. The firm is old. The staff is kind. The pay is low.", "He left Acme Inc. in spring. They all said so there. The end was near.",
         "On the 3. October it rained. The sun came late. It was 1999. The year was cold.", "They met on 4. October here. All of it was fine by 7. The rest came too."] * 25


def test_next_words_tell_where_abbreviations_and_numbers_end_sentences(spark):
    docs = spark.createDataFrame(list(enumerate(FIRMS)), "k int, text string").repartition(3)
    held = plain_abbreviations(FIRMS)
    known, starts, together = plain_continuing(FIRMS, held)
    assert "inc" in held and "the" in starts and ("##", "october") in together
    found = {}
    for r in splitting.learned_sentences(docs, "k").orderBy("span_idx").collect():
        found.setdefault(r.k, []).append((r.start, r.end, r.text))
    assert found == {k: plain_sentences(t, known) for k, t in enumerate(FIRMS)}
    assert [s[2] for s in found[0]][:2] == ["We like Acme Inc.", "The firm is old."]
    assert found[1][0][2] == "He left Acme Inc. in spring."
    # a number ends a sentence before a word that starts them, and none before the month that goes with it
    assert found[2][0][2] == "On the 3. October it rained." and found[2][-1][2] == "The year was cold."


NAMES = ["We read J. Kafka, and R. Musil gladly. The book is by J. Kafka. It is lengthy.", "Plan B. The rest is familiar. We know plan B and b or B, and the rest is the same.",
         "The flight took 5. hours and more. It was in room 7. The door was shut. The hours went by, and it rained."] * 20


def test_initials_and_cases_tell_where_sentences_end(spark):
    docs = spark.createDataFrame([*enumerate(NAMES), (None, NAMES[0])], "k int, text string").repartition(3)
    texts = [*NAMES, NAMES[0]]
    held = plain_abbreviations(texts)
    known, _, _ = plain_continuing(texts, held)
    found = {}
    for r in splitting.learned_sentences(docs, "k").orderBy("span_idx").collect():
        found.setdefault(r.k, []).append((r.start, r.end, r.text))
    assert found == {k: plain_sentences(t, known) for k, t in [*enumerate(NAMES), (None, NAMES[0])]}
    # a name goes with its initial, a word that is in lower case elsewhere does not
    assert [s[2] for s in found[0]] == ["We read J. Kafka, and R. Musil gladly.", "The book is by J. Kafka.", "It is lengthy."]
    assert [s[2] for s in found[1]][:2] == ["Plan B.", "The rest is familiar."]
    # a number goes on before a lower-case word that starts no sentence
    assert found[2][0][2] == "The flight took 5. hours and more."


def test_random_texts_split_as_the_plain_rules_do(spark):
    rnd = random.Random(3)
    parts = ["Dr.", "dr.", "A.", "b.", "The", "the", "3.", "17", "home.", "Home", "e.g.", "ß.", "Ü", "\u01c5ab.", "x\u00b2.", "...", "!", "?", "\n", "(", "\"", ",", "\xa0", "日本.", "İs.", "No", "no."]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(4)
    counted = splitting.word_counts(docs)
    held = {r.word for r in splitting.abbreviations(counted).collect()}
    known, _, _ = plain_continuing(texts, held)
    assert {tuple(r) for r in splitting.continuing(counted, splitting.abbreviations(counted)).collect()} == known
    found = {}
    for r in splitting.learned_sentences(docs, "k").orderBy("span_idx").collect():
        found.setdefault(r.k, []).append((r.start, r.end, r.text))
    assert found == {k: s for k, t in enumerate(texts) if (s := plain_sentences(t, known))}


def test_a_next_word_far_away_or_none(spark):
    texts = [*TALK, "Ask Dr. " + "( " * 150 + "Who", "He saw the Dr.", "Dr. " * 5_000, "5. " * 5_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    known, _, _ = plain_continuing(texts, plain_abbreviations(texts))
    found = {}
    for r in splitting.learned_sentences(docs, "k").orderBy("span_idx").collect():
        found.setdefault(r.k, []).append((r.start, r.end, r.text))
    assert found == {k: plain_sentences(t, known) for k, t in enumerate(texts)}


def test_learned_sentences_on_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    known, _, _ = plain_continuing([t for t in texts.values() if t], plain_abbreviations([t for t in texts.values() if t]))
    want = {(d, k, a, b, hashlib.md5(s.encode()).hexdigest()[:16]) for d, t in texts.items() if t for k, (a, b, s) in enumerate(plain_sentences(t, known))}
    got = {(r.doc_id, r.span_idx, r.start, r.end, r.hash) for r in score_queries.learned_sentences(spark, SF_DIR).collect()}
    assert got == want


def test_pairs_around_periods_are_those_of_the_walk():
    """The short ways of the second pass say the same: pairs without a look at other words, the last word without a search for it."""
    rnd = random.Random(4)
    for _ in range(2_000):
        text = "".join(rnd.choice(["a", "B", "1", " ", ". ", ".", "..", "!", "?", "\n", ",", ")", '"', "é", "\x85", "Mr."]) for _ in range(rnd.randrange(60)))
        pairs, types = [], splitting._Types()
        splitting._walk(text, types, [], pairs)
        assert splitting._around(splitting._PIECE.findall(text), types) == pairs
        for at in [k + 1 for k, c in enumerate(text) if c == "."]:
            start = rnd.randrange(at)
            word = re.search(r"[^\s!?,;:()\"']*\Z", text[start : at - 1])[0].rsplit("..", 1)[-1].lstrip(".")
            found = splitting._NEXT.search(text, at)
            pair = (splitting._kind(word or "a"), *((splitting._kind(found[0]), splitting._case(found[0])) if found else ("", splitting.NONE)))
            assert splitting._goes_on(text, start, at, frozenset([pair])) == bool(word and not word.endswith("."))
            assert not splitting._goes_on(text, start, at, frozenset())
