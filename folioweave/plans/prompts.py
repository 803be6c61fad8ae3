"""Prompts as columns: templates, chat messages, training rows."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.functions import context as C
from folioweave.operators.sampling import shuffled

#: Fixed value: how a response states its documents and answer.
RESPONSE = "Relevant documents: {tags}\n\nThe answer is: {answer}."
_SLOT = re.compile(r"\{\{|\}\}|\{([A-Za-z_][A-Za-z_0-9]*)?\}")


def fill(template: str, values: dict[str, Column] | list[Column]) -> Column:
    """The template with {name} (or, for a list, each {} in turn) replaced; {{ and }} are braces.

    Parts are joined, so braces in values stay. Unused values are ignored, a missing one is a KeyError.
    """
    parts, at, turn = [], 0, 0
    for m in _SLOT.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[0] in ("{{", "}}"):
            parts.append(F.lit(m[0][0]))
        elif m[1]:
            parts.append(values[m[1]].cast("string"))
        else:
            parts.append(values[turn].cast("string"))
            turn += 1
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def load_prompt(spark: SparkSession, path: str, split: str, required: tuple[str, ...] = ("system", "user_template")) -> dict[str, str]:
    """The first object of a JSON prompt file for the split; an error that names the keys it lacks, sorted."""
    text = spark.read.option("wholetext", True).text(path).first()[0]
    found = json.loads(text)
    one = next((p for p in (found if isinstance(found, list) else [found]) if p.get("split") == split), None)
    if one is None:
        raise ValueError(f"no prompt for split {split}")
    if lacking := sorted(set(required) - set(one)):
        raise ValueError(f"prompt lacks {', '.join(lacking)}")
    return one


def task_values(split: str, c: dict[str, Column]) -> dict[str, Column]:
    """Values of the placeholders of a task split, from context, input and options columns."""
    out = dict(c)
    question = c.get("input")
    if split in ("longbook_choice_eng", "code_debug"):
        letters = "abcd"
        out |= {f"choice_{x}": F.get(c["options"], i) for i, x in enumerate(letters)}
        out |= {f"OPTION_{x.upper()}": F.get(c["options"], i) for i, x in enumerate(letters)}
    if split == "math_find":
        asked = F.lower(F.regexp_extract(question, r"The .+ of", 0))
        target = F.substr(asked, F.lit(1), F.length(asked) - 3)
        wrong = F.raise_error(F.lit("the question names no target number")).cast("string")
        out["prefix"] = F.when(asked == "", wrong).otherwise(F.concat(F.lit("What is "), target, F.lit(" in the following list?")))
    if split == "code_run":
        lacks = F.raise_error(F.lit("the question calls no function")).cast("string")
        for name, pattern in (("func_call", r"(func_\d+\(-?\d+\))"), ("func", r"(func_\d+)\(")):
            found = F.regexp_extract(question, pattern, 1)
            out[name] = F.when(found == "", lacks).otherwise(found)
    if question is not None:
        out |= {"question": c.get("question", question), "input": question}
    return out


def messages(system: Column, user: Column, assistant: Column | None = None) -> Column:
    """array<struct<role, content>>; with an assistant column that turn is begun."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", system), turn("user", user), *([turn("assistant", assistant)] if assistant is not None else []))


def gold_prefill(tags: Column, docs: Column) -> Column:
    """The assistant's begun answer: the gold documents by tag and content."""
    each = F.transform(F.arrays_zip(tags.alias("t"), docs.alias("d")), lambda z: F.concat(z["t"], F.lit("\n"), z["d"], F.lit("\n\n")))
    return F.concat(F.lit("Relevant documents:\n"), F.array_join(each, ""), F.lit("\n\n"))


def demonstrations(demos: Column, n: int, separator: str = "\n\n\n", key: Column | None = None, seed: int = 42) -> Column:
    """n demonstrations as text: the first, or with a key those that seed and key draw."""
    return F.array_join(F.slice(demos if key is None else shuffled(demos, key, seed), 1, n), separator)


def docs_in_name(name: str, default: int) -> int:
    """Number of documents that a data set's name states after `top`."""
    found = re.search(r"top(\d+)", name)
    return int(found[1]) if found else default


def sft_rows(rows: DataFrame, template: str) -> DataFrame:
    """prompt, response: the filled template, and the gold tags with the answer."""
    return rows.select(
        fill(template, {"context": F.col("training_context"), "question": F.col("question")}).alias("prompt"),
        fill(RESPONSE, {"tags": F.array_join("gold_doc_ids", ", "), "answer": F.col("answer")}).alias("response"),
    )


def rl_rows(rows: DataFrame, template: str, variant: str = "ids", source: str = "folioweave", ability: str = "long-context-qa") -> DataFrame:
    """data_source, prompt, ability, reward_model, extra_info of a variant: ids, answer_only, quote, content, judge.

    rows: ordinal, split, question, answer, training_context, gold_doc_ids, and for quote, content and judge
    relevant_gold_doc_ids, whose documents are found by number.
    """
    extra = [F.col("split"), F.col("ordinal").cast("long").alias("index"), F.col("answer"), F.col("question")]
    if variant != "answer_only":
        extra.append(F.col("gold_doc_ids"))
    if variant in ("quote", "content", "judge"):
        docs = C.parse(F.col("training_context"))
        ids = C.sort_tags(F.col("relevant_gold_doc_ids"))
        body = lambda t: F.get(F.filter(docs, lambda d: d["doc_id"] == C.tag_number(t)), 0)["content"]
        extra += [ids.alias("relevant_gold_doc_ids"), F.transform(ids, body).alias("relevant_gold_docs")]
    if variant == "judge":
        extra.append(F.col("training_context"))
    user = fill(template, {"context": F.col("training_context"), "question": F.col("question")})
    turn = F.struct(F.lit("user").alias("role"), user.alias("content"))
    return rows.select(
        F.lit(source).alias("data_source"), F.array(turn).alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("answer").alias("ground_truth")).alias("reward_model"), F.struct(*extra).alias("extra_info"),
    )


def judge_prompt(template: str, question: Column, answer: Column, prediction: Column, kind: Column, docs: Column) -> Column:
    """The judge's prompt; {docs} is empty unless the instance is of type paper."""
    shown = F.when(kind == "paper", docs).otherwise("")
    return fill(template, {"question": question, "answer": answer, "prediction": prediction, "docs": shown})
