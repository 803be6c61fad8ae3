import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioweave.llm import tokencounts


def slow(text, rule, whole):
    """Sections and counts from the offsets of another library's tokenizer of the same vocabulary."""
    bounds = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
    if bounds[-1] != len(text) or len(bounds) == 1:
        bounds.append(len(text))
    counts = [0] * (len(bounds) - 1)
    for a, b in whole.encode(text, add_special_tokens=False).offsets:
        inside = [k for k in range(len(counts)) if max(a, bounds[k]) < min(b, bounds[k + 1])]
        share = [min(b, bounds[k + 1]) - max(a, bounds[k]) for k in inside]
        counts[inside[0] if rule == "first" else inside[-1] if rule == "last" else inside[share.index(max(share))]] += 1
    return [(k, bounds[k], bounds[k + 1], c) for k, c in enumerate(counts)]


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_against_offsets_of_another_library(spark, rule):
    whole = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    rnd = random.Random(3)
    parts = ["the ", "Ünder", "\n", "\n\n", " \n  \n", "42", "x" * 40, "é", " it's", "\t", "…"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(60)] + ["", "\n", "a\nb"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, section int").repartition(3)
    got = tokencounts.section_tokens(docs, rule=rule).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.section, r.start, r.end, r.n_tokens) for r in got if r.doc_id == i)
        assert mine == slow(t, rule, whole), t


def test_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, " " * 200_000 + "a" * 200_000)], "doc_id long, text string")
    got = tokencounts.section_tokens(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in got) == [("1", False), ("1", False), ("2", True), ("None", False)]
    assert tokencounts.section_tokens(docs.where("false")).collect() == []


def test_a_split_character_and_most():
    starts, ends = np.array([0, 1, 4, 6]), np.array([1, 4, 6, 9])
    bounds = np.array([0, 3, 8, 9])
    assert [tokencounts.attribute(starts, ends, bounds, r)[0].tolist() for r in tokencounts.RULES] == [[2, 2, 0], [1, 2, 1], [2, 2, 0]]
    assert tokencounts.attribute(starts, ends, bounds)[1].tolist() == [1, 1, 0]


def test_millions_of_blanks_and_letters_against_the_other_library():
    whole = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    with open(tokencounts.VOCABULARY, "rb") as ranks:
        encode, _ = tokencounts.encoder(ranks.read())
    for text in [" " * 3_000_000, "\n" * 3_000_000, "x" + " " * 2_000_000 + "y z", "a" * 1_000_000, " \n\t" * 500_000 + "x", "the \n" * 400_000]:
        assert len(encode(text)) > 0
    rnd = random.Random(6)
    for _ in range(60):
        text = "".join(rnd.choice(["a", " ", "\n", "é", "'s", "\u3000", " b", "12", "\t", "\x1c", "\x85"]) * rnd.choice([1, 1, 2, 12_000]) for _ in range(rnd.randint(1, 8)))
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids


def test_names_that_clash_and_millions_of_line_breaks(spark):
    docs = spark.createDataFrame([(1, "\n" * 300_000, 5, 6), (2, "a b", 5, 6)], "doc_id long, text string, n_tokens int, start int")
    got = tokencounts.section_tokens(docs)
    assert got.columns == ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]
    assert {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()} == {1: 300_000, 2: 1}
