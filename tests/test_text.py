"""Literal cases for the text, context, overlap and scorer columns."""

import pytest
from pyspark.sql import functions as F

from folioweave.functions import context as C
from folioweave.functions import overlap as O
from folioweave.functions import rewards as R
from folioweave.functions import scorers as S
from folioweave.functions import offsets
from folioweave.functions import text as T


@pytest.fixture(scope="module")
def one(spark):
    frame = spark.range(1)

    def value(column):
        return frame.select(column.alias("v")).first().v

    return value


CASES = [
    (T.answer_or_all, "The answer is Paris.", "Paris"),
    (T.answer_or_all, "The answer is: Paris", "The answer is: Paris"),
    (T.answer_or_all, "The answer is Mr. Smith.", "Mr. Smith"),
    (T.answer_or_all, "The answer is 3.5 km.", "3"),
    (T.parsed_answer, "The answer is Paris.", "s"),
    (T.parsed_answer, "The answer is: Paris.", "Paris"),
    (T.parsed_answer, "Rome\nor not", "Rome"),
    (T.last_answer, "The answer is: a. the answer is: b c\nd", "b c"),
    (T.last_answer, "none", None),
    (T.choice_letter, "The correct answer is (b)", "B"),
    (T.choice_letter, "option: c", "C"),
    (T.choice_letter, "hm", None),
    (T.without_citations, "Foo [1][2]. Bar [3] | x", "Foo. Bar x"),
    (T.citation_refs, "a [1][12] b", [0, 11]),
    (T.clean_output, "a\n\nb<|im_end|>", "a b"),
    (T.normalize_answer, "The  “Cat”, a dog!", "“cat” dog"),
    (T.normalize_answer, "ça an et", "ça et"),
    (T.normalize_cjk_answer, "你 好，A!", "你好a"),
    (T.passages, "", [""]),
    (T.first_integer, "ab 12c3", "12"),
    (T.first_integer, "ab", ""),
    (T.judge_rating, "Rating: [[7]]", 7),
    (T.judge_rating, "none", None),
    (T.boxed_score, r"\boxed{Criterion 1: 1/0} \boxed{{Criterion 2: 1}} \boxed{0}", 2.0),
    (T.boxed_score, r"\boxed{1} \boxed{1} \boxed{1} \boxed{1}", 3.0),
    (T.after_reasoning, "x</think>y", "y"),
    (T.after_reasoning, "x", None),
    (T.word_count, " \n", 0),
    (T.quotes, 'Quote 1: "long one" Quote 2: ab Quote 3: "long one" The answer is: x', ['"long one"']),
    (C.tags_in, "[DOC 1] [doc x] [DOC 1]", ["[DOC 1]", "[doc x]"]),
    (C.tag_number, "[DOC 12] x", 12),
    (C.tag_number, "DOC 12", None),
]


@pytest.mark.parametrize("f, text, want", CASES)
def test_text(one, f, text, want):
    assert one(f(F.lit(text))) == want


def test_sentences(one):
    got = [(s.start, s.end, s.text) for s in one(offsets.sentences(F.lit(" Ab c. D!  E  \nf ")))]
    assert got == [(0, 6, "Ab c."), (7, 9, "D!"), (11, 14, "E"), (15, 17, "f")]


def test_long_answer_does_not_overflow(one):
    assert one(F.length(T.parsed_answer(F.lit("the answer " + "word " * 20_000 + ": x")))) > 0


def test_contexts(one):
    text = "lead [DOC 0]\nab\n\n[DOC 1]\n\n[DOC 2]\nx"
    assert [(d.doc_id, d.content) for d in one(C.parse(F.lit(text)))] == [(0, "ab"), (1, ""), (2, "x")]
    docs = F.array(*map(F.lit, ["a b c", " ".join("w" * 1 for _ in range(20)), "x y"]))
    again = one(C.parse(C.render(C.number(docs))))
    assert [d.content for d in again] == ["a b c", " ".join(["w"] * 20), "x y"]
    c = one(C.clean(C.number(docs), F.array(F.lit(2), F.lit(2), F.lit(0), F.lit(9))))
    assert [d.content for d in c.docs] == ["a b c", " ".join(["w"] * 20), "x y"] and list(c.gold) == [2, 2, 0]
    c = one(C.clean(C.number(docs), F.array(F.lit(2))))
    assert len(c.docs) == 2 and list(c.gold) == [1]
    assert one(C.sort_tags(F.array(F.lit("[DOC 10]"), F.lit("[DOC 2]"), F.lit("z")))) == ["z", "[DOC 2]", "[DOC 10]"]
    b = one(C.bounds(F.lit("hi [DOC 1] a [DOC x]b")))
    assert [(x.start, x.end, x.text) for x in b] == [(3, 13, "[DOC 1] a "), (13, 21, "[DOC x]b")]
    assert [(x.start, x.end) for x in one(C.bounds(F.lit("plain")))] == [(0, 5)]
    spans = one(F.array(C.gold_span(F.lit("q [DOC 1]\nab\n\n[DOC 2]\nc"), F.lit(1), F.lit("ab")), C.gold_span(F.lit("q [DOC 1] zz [DOC 2]"), F.lit(1), F.lit("ab")), C.gold_span(F.lit("q"), F.lit(1), F.lit("ab"))))
    assert [s and (s.start, s.end) for s in spans] == [(2, 12), (2, 13), None]


def arr(*x):
    return F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")


def test_overlaps(one):
    assert one(O.multiset_common(arr(*"xxy"), arr(*"xyyx"))) == 3
    assert one(O.truncated_overlap(arr(*"aab"), arr(*"aab"))) == pytest.approx(2 / 3)
    assert one(O.truncated_overlap(arr(), arr("a"))) is None
    assert one(O.jaccard(arr(), arr())) == 1.0 and one(O.jaccard(arr(), arr("a"))) == 0.0
    assert one(O.guarded_answer_f1(F.lit("yes"), F.lit("yes it is"))) == 0.0
    assert one(O.no_answer_f1(F.lit("the"), F.lit("a"))) == 1.0
    assert one(O.char_f1(F.lit(" "), F.lit(""))) == 1.0 and one(O.char_f1(F.lit("Ab a"), F.lit("aab"))) == 1.0
    assert one(O.ngram_jaccard(F.lit("a b c"), F.lit("abd"), 2)) == pytest.approx(1 / 3)
    assert one(O.ngram_jaccard(F.lit("a"), F.lit("b"), 2)) == 1.0
    assert one(O.substring_match(F.lit("x"), F.lit("the"))) is True
    s = one(O.set_scores(arr("a", "a", "b"), arr("b")))
    assert (s.precision, s.recall) == (0.5, 1.0)


def test_fuzzy_against_plain_python(one):
    from collections import Counter

    def slow(a, b):
        x, y = a.lower().replace(" ", ""), b.lower().replace(" ", "")
        same = sum((Counter(x) & Counter(y)).values())
        scores = [1.0 if not x and not y else 2 * same / (len(x) + len(y)) if x and y else 0.0]
        for one_, two in [({t[i : i + n] for i in range(len(t) - n + 1)} for t in (x, y)) for n in (2, 3)] + [(set(a.lower().split()), set(b.lower().split()))]:
            scores.append(1.0 if not one_ and not two else len(one_ & two) / len(one_ | two))
        return max(scores)

    for a, b in [("Hello world", "hello there"), ("", ""), ("ab", ""), ("été à", "a été"), ("x" * 30, "xy")]:
        assert one(O.fuzzy_score(F.lit(a), F.lit(b))) == pytest.approx(slow(a, b))


SCORES = [
    (S.kv_retrieval, "key: 'abc'.", ["abc"], True),
    (S.passkey, "it is 0123!", ["0123"], True),
    (S.code_run, "so: -5.", ["-5"], True),
    (S.code_run, "", ["5"], False),
    (S.code_debug, "A then B\nC", ["fn", "B"], True),
    (S.code_debug, "A then B\nC", ["fn", "C"], False),
    (S.code_debug, "fn is wrong", ["fn", "J"], True),
    (S.code_debug, "the answer is: other", ["fn", "D"], False),
    (S.code_debug, "the answer is: fn", ["fn", "D"], True),
    (S.choice, "A then B\nC", ["B"], True),
    (S.choice, "Dog", ["D"], True),
    (S.choice, "", ["A"], False),
    (S.choice, "the answer is x", ["x"], True),
    (S.choice, "he said BC twice", ["BC"], True),
    (S.dialogue, "well, JOHN", ["john"], True),
]


@pytest.mark.parametrize("f, pred, labels, want", SCORES)
def test_scorers(one, f, pred, labels, want):
    assert one(f(F.lit(pred), arr(*labels))) is want


def test_math(one):
    assert one(S.math_find(F.lit("is 3.5"), arr("3"), F.lit("int"))) is False
    assert one(S.math_find(F.lit("is 3.5"), arr("3.5"), F.lit("float"))) is True
    assert one(S.math_calc(F.lit("1, -2, 4"), arr("1", "2", "3", "4"))) == 0.5
    assert one(S.math_calc(F.lit(""), arr("1"))) == 0.0
    q = one(S.qa_english(F.lit("The answer is: Paris."), arr("the Paris!", "x")))
    assert (q.f1, q.sub_em) == (1.0, 1.0)
    assert one(S.qa_chinese(F.lit("你好。"), arr("你好"))) == 1.0
    r = one(S.retrieved_qa(F.lit("Answer: Rome"), arr("rome")))
    assert (r.exact_match, r.f1, r.substring_exact_match) == (1.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        S.score("nothing", F.lit(""), arr("a"))
    assert one(S.letter_of(S.answer_range(["A", "B"], arr("x", "y")), F.lit("y"))) == "B"


def test_rewards(one):
    said = "Quote 1: 'alpha beta gamma' Relevant Document IDs: [DOC 1] The answer is: ok."
    full = one(R.quote_reward(F.lit(said), F.lit("OK"), arr("alpha beta gamma"), arr("[DOC 1]")))
    assert full == pytest.approx(4.2)
    assert one(R.greedy_matches(arr("abcdef", "abcdeg"), arr("abcdef"))) == 1
    body = "Relevant documents: [DOC 1] alpha beta [DOC 2] junk The answer is: ok."
    got = one(R.content_reward(F.lit(body), F.lit("ok"), arr("alpha beta"), arr("[DOC 1]")))
    assert got == pytest.approx(1.5 * 2 / 3 + 1.0 + 2.0 + 0.3 - 0.3)
    assert one(R.answer_and_ids(F.lit("[DOC 1]"), F.lit("x"), arr("[DOC 1]"))) == 0.0
    assert one(R.content_reward(F.lit(""), F.lit("ok"), arr(), arr())) == 0.0


def random_text(rnd, parts, most):
    return "".join(rnd.choice(parts) for _ in range(rnd.randint(0, most)))


def test_patterns_against_the_plain_ones(spark):
    """The patterns as another language's engine reads them; ours avoid its repeats of groups, which would take a stack."""
    import random
    import re

    rnd = random.Random(7)
    parts = ["The answer is", "the answer", "answer", " ", "  ", ":", "Mr.", "Mr. ", "Dr.  ", "x", "für", "\r", "\n", ".", ",", "A", " B ", "C", " ", "Answer:", "-", "a1", "\x85", "É", "_"]
    texts = [random_text(rnd, parts, 12) for _ in range(3000)] + ["The answer is " + "Mr. " * 3000 + "X.", "The answer is " + "Mr. " * 3000, "the answer " + "für " * 3000 + "is X."]
    first = re.compile(r"The answer is\s*:?\s*((?:[A-Za-z]+\.\s+)*[^.,]+?)[.,]", re.I)
    loose = re.compile(r"(?:\b(?:the\s+)?answer(?:\s+\w+)*\s*[:\-]?\s*)([^\.,\n]+)", re.I)
    prefix, line = re.compile("(?:Answer:)(.*)(?:\n|$)", re.I), re.compile("(?:^)(.*)(?:\n|$)")

    def parsed(t):
        found = next(m[1] for p in (loose, prefix, line) if (m := p.search(t)))
        return re.sub("^Answer:", "", found.strip(), flags=re.I).strip()

    last = lambda x, t: (re.search(rf"\b[A-{x}]\b(?!.*\b[A-{x}]\b)", t.strip()) or [""])[0]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    got = frame.select(
        "t", T.answer_or_all(t).alias("a"), T.parsed_answer(t).alias("p"), F.regexp_extract(T.strip(t), S.LAST_CODE_LETTER, 0).alias("j"), F.regexp_extract(T.strip(t), S.LAST_CHOICE_LETTER, 0).alias("d"),
        T.words(t).alias("w"), T.collapse_space(t).alias("s"),
    ).collect()
    for r in got:
        m = first.search(r.t)
        assert r.a == (m[1].strip() if m else r.t), r.t[:80]
        assert r.p == parsed(r.t), r.t[:80]
        assert (r.j, r.d) == (last("J", r.t), last("D", r.t))
        assert r.w == r.t.split() and r.s == " ".join(r.t.split())
