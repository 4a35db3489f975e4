"""Taking prompts and instruction records apart again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopframe.functions.text import strip, token_count


def prompt_sections(
    df: DataFrame, col: str = "prompt", counter: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Examples, facts and question part of a prompt, with the length of each.

    The examples reach from ``Examples:`` to ``Facts:``, the facts to the
    ``Question:`` behind them, the question to the end.  A missing part is ''.
    """
    counter = counter or token_count
    text = F.col(col)
    # columns of their own: each place is sought once, however often the parts refer to it
    placed = df.withColumns({"__examples": F.locate("Examples:", text), "__facts": F.locate("Facts:", text)})
    at_examples, at_facts = F.col("__examples"), F.col("__facts")
    tail = F.when(at_facts > 0, F.substring(text, at_facts, F.length(text))).otherwise(text)
    work = placed.withColumn("__tail", tail).withColumn("__q", F.locate("Question:", F.col("__tail")))
    empty = F.lit("")
    examples = F.when(
        (at_examples > 0) & (at_facts > at_examples),
        F.substring(text, at_examples, at_facts - at_examples),
    ).otherwise(empty)
    facts = (
        F.when((at_facts > 0) & (F.col("__q") > 0), F.substring("__tail", F.lit(1), F.col("__q") - 1))
        .when(at_facts > 0, F.col("__tail"))
        .otherwise(empty)
    )
    question = F.when(F.col("__q") > 0, F.substring(F.col("__tail"), F.col("__q"), F.length("__tail"))).otherwise(empty)
    out = work.withColumns({
        "examples_part": strip(examples), "facts_part": strip(facts), "question_part": strip(question),
    }).drop("__tail", "__q", "__examples", "__facts")
    return out.withColumns({
        f"{p}_tokens": counter(F.col(f"{p}_part")) for p in ("examples", "facts", "question")
    })


def parse_instances(df: DataFrame) -> DataFrame:
    """Evidence sentences, question and answer of instruction records.

    Line 0 is the question text, line 3 the explanation.  All their sentences
    are evidences but the last one of the question text, which is the question.
    """
    lines = F.split("input", "\n")
    asked = F.split(F.replace(F.get(lines, F.lit(0)), F.lit("Question: "), F.lit("")), r"\.")
    told = F.split(F.replace(F.get(lines, F.lit(3)), F.lit("Explanation: "), F.lit("")), r"\.")
    told = F.when(F.element_at(told, -1) == "", F.slice(told, F.lit(1), F.size(told) - 1)).otherwise(told)
    return df.withColumns({"__all": F.concat(told, asked)}).withColumns({
        "evidences": F.slice("__all", F.lit(1), F.size("__all") - 1),
        "question": F.element_at("__all", -1),
        "answer": F.get("output", F.lit(0)),
    }).drop("__all")
