"""Prompt and target assembly: one declarative table of dataset x strategy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopframe.functions.text import strip_lines, token_count, yes_no
from hopframe.functions.tokens import measure
from hopframe.operators.evaluate import udf_inputs
from hopframe.operators.facts import context_block, facts_block, shuffle_facts
from hopframe.operators.rationale import default_entity_type, sub_questions, thoughts
from hopframe.session import ship_helpers

# Instruction and marker lines of the templates.
REASON_FIRST = "First break the reasoning down into intermediate questions, then provide an answer."
ANSWER_FIRST = "First provide an answer, then break the reasoning down into intermediate questions."
FOLLOW_UPS = "Are follow up questions needed here:"

DEFAULT_TOKEN_LIMIT = 130


def _say(template: str, **columns: Column) -> Column:
    """Column version of a brace template: ``_say('{q}?', q=col)``."""
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if brace:
            name, _, rest = tail.partition("}")
            parts.append(columns[name])
        else:
            rest = ""
    return F.concat(*parts)


def _steps(asked: str, items: Column) -> Column:
    """``{asked}: ...`` / ``Intermediate answer: ...`` line pairs."""
    return F.array_join(
        F.transform(
            items,
            lambda s: _say(
                asked + ": {q}\nIntermediate answer: {a}\n", q=s["question"], a=s["answer"]
            ),
        ),
        "",
    )


def _chain(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda t: _say(" {t}.", t=t)), "")


def _wiki_self_ask(answer_first: bool) -> tuple[Column, Column]:
    facts = facts_block("facts", 1)
    steps = _steps("Intermediate question", F.col("sub_questions"))
    if answer_first:
        prompt = _say("{f}\nQuestion: {q}\n" + ANSWER_FIRST + "\n", f=facts, q=F.col("question"))
        target = _say("The answer is {a}. Here are the intermediate steps:\n{s}", a=F.col("answer"), s=steps)
    else:
        prompt = _say("{f}\nQuestion: {q}\n" + REASON_FIRST + "\n", f=facts, q=F.col("question"))
        target = _say("{s}So the final answer is {a}.\n", a=F.col("answer"), s=steps)
    return prompt, target


def _direct(base: int) -> Callable[[bool], tuple[Column, Column]]:
    def build(answer_first: bool) -> tuple[Column, Column]:
        prompt = _say("{f}\nQuestion: {q}\nAnswer:", f=facts_block("facts", base), q=F.col("question"))
        return prompt, F.col("answer")

    return build


def _squad(answer_first: bool) -> tuple[Column, Column]:
    return _say("question: {q} {c}", q=F.col("question"), c=context_block("facts")), F.col("answer")


def _wiki_chain(answer_first: bool) -> tuple[Column, Column]:
    prompt = _say("{f}\nQuestion: {q}\nAnswer:", f=facts_block("facts", 1), q=F.col("question"))
    chain = _chain(F.col("thoughts"))
    if answer_first:
        target = _say(" The answer is {a}.\n{c}\n", a=F.col("answer"), c=chain)
    else:
        target = _say("{c} So the answer is {a}.\n", a=F.col("answer"), c=chain)
    return prompt, target


def _follow_up_target() -> Column:
    return _say(
        "Yes.\n{s}So the final answer is {a}.\n",
        s=_steps("Follow up", F.col("sub_questions")),
        a=F.col("answer"),
    )


def _celebrity_self_ask(answer_first: bool) -> tuple[Column, Column]:
    return _say("Question: {q}\n" + FOLLOW_UPS + "\n", q=F.col("question")), _follow_up_target()


def _hotpot_self_ask(answer_first: bool) -> tuple[Column, Column]:
    prompt = _say(
        "{f}\nQuestion: {q}\n" + FOLLOW_UPS + "\n", f=facts_block("facts", 0), q=F.col("question")
    )
    return prompt, _follow_up_target()


def _strategy_self_ask(answer_first: bool) -> tuple[Column, Column]:
    prompt = _say(
        "{f}\nQuestion: {q}\n" + FOLLOW_UPS + "\n", f=facts_block("facts", 0), q=F.col("question")
    )
    return prompt, F.col("answer")


def _strategy_direct(answer_first: bool) -> tuple[Column, Column]:
    prompt = _say("{f}\nQuestion: {q}\nAnswer:\n", f=facts_block("facts", 0), q=F.col("question"))
    return prompt, F.col("answer")


# (dataset, strategy) -> builder(answer_first) of (prompt, target)
EXAMPLE_BUILDERS: dict[tuple[str, str], Callable[[bool], tuple[Column, Column]]] = {
    ("wiki", "direct"): _direct(1),
    ("wiki", "self_ask"): _wiki_self_ask,
    ("wiki", "squad"): _squad,
    ("wiki", "chain_of_thought"): _wiki_chain,
    ("celebrities", "self_ask"): _celebrity_self_ask,
    ("hotpot", "self_ask"): _hotpot_self_ask,
    ("hotpot", "direct"): _direct(0),
    ("strategyqa", "self_ask"): _strategy_self_ask,
    ("strategyqa", "direct"): _strategy_direct,
    ("strategyqa", "squad"): _squad,
}


def _wiki_self_ask_exemplar(answer_first: bool) -> Column:
    steps = _steps("Intermediate question", F.col("sub_questions"))
    if answer_first:
        return _say(
            "Question: {q}\n" + ANSWER_FIRST + "\nThe answer is {a}. Here are the intermediate steps:\n{s}",
            q=F.col("question"), a=F.col("answer"), s=steps,
        )
    return _say(
        "Question: {q}\n" + REASON_FIRST + "\n{s}So the answer is {a}.\n",
        q=F.col("question"), a=F.col("answer"), s=steps,
    )


def _wiki_chain_exemplar(answer_first: bool) -> Column:
    chain = _chain(F.col("thoughts"))
    if answer_first:
        return _say("Question: {q}\nAnswer: The answer is {a}.\n{c}\n", q=F.col("question"), a=F.col("answer"), c=chain)
    return _say("Question: {q}\nAnswer:{c} So the answer is {a}.\n", q=F.col("question"), a=F.col("answer"), c=chain)


def _follow_up_exemplar(answer_first: bool) -> Column:
    return _say("Question: {q}\n" + FOLLOW_UPS + " {t}", q=F.col("question"), t=_follow_up_target())


EXEMPLAR_BUILDERS: dict[tuple[str, str], Callable[[bool], Column]] = {
    ("wiki", "self_ask"): _wiki_self_ask_exemplar,
    ("wiki", "chain_of_thought"): _wiki_chain_exemplar,
    ("celebrities", "self_ask"): _follow_up_exemplar,
    ("hotpot", "self_ask"): _follow_up_exemplar,
}


def _pick(table: dict, dataset: str, strategy: str):
    if (dataset, strategy) not in table:
        raise NotImplementedError(f"strategy {strategy!r} is not available for dataset {dataset!r}")
    return table[(dataset, strategy)]


def prepare(
    df: DataFrame,
    dataset: str,
    strategies: list[str],
    entities: DataFrame | None = None,
    classifier: Callable[[Column], Column] = default_entity_type,
) -> DataFrame:
    """Add the working columns the strategies need: sub-questions, thoughts, answers."""
    if dataset == "celebrities":
        return df.withColumns({
            "answer": F.get("answers", F.lit(0)),
            "sub_questions": F.array(
                F.struct(F.col("q1").alias("question"), F.get("a1", F.lit(0)).alias("answer")),
                F.struct(F.col("q2").alias("question"), F.get("a2", F.lit(0)).alias("answer")),
            ),
        })
    if dataset == "strategyqa":
        return df.withColumn("answer", yes_no("answer"))
    if "self_ask" in strategies:
        df = sub_questions(df, dataset, entities, classifier)
    if "chain_of_thought" in strategies:
        df = df.withColumn("thoughts", thoughts("evidences"))
    return df


def _measured(df: DataFrame) -> DataFrame:
    """Add ``__prompt`` and ``__target``: tokens and line ends where the text is plain ASCII, from one Arrow pass.

    The texts must come from behind a boundary the optimizer does not merge them across (see ``udf_inputs``).
    """
    ship_helpers()

    def look(texts: pa.Array) -> pa.Array:
        return measure(texts)

    look.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(look, "tokens int, bare boolean")
    return df.withColumns({"__prompt": udf("prompt"), "__target": udf("target")})


def _counted(df: DataFrame, count: Callable[[str], Column]) -> DataFrame:
    return df.withColumns({
        "num_prompt_tokens": count("prompt").cast("int"),
        "num_target_tokens": count("target").cast("int"),
    }).withColumn("num_tokens", F.col("num_prompt_tokens") + F.col("num_target_tokens"))


def _from_measure(name: str) -> Column:
    return F.coalesce(F.col(f"__{name}.tokens"), token_count(name))


def with_token_counts(df: DataFrame, counter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Token counts of prompt and target and their sum; null where not countable."""
    if counter is not None:
        return _counted(df, lambda name: counter(F.col(name)))
    work = _measured(udf_inputs(df, prompt=F.col("prompt"), target=F.col("target")))
    return _counted(work, _from_measure).drop("__prompt", "__target")


def _finished(df: DataFrame, counter: Callable[[Column], Column] | None) -> DataFrame:
    """Strip the lines of prompt and target and count their tokens.

    Where the Arrow pass saw that no line has a blank at its ends, the text stays as it is.
    """
    if counter is not None:
        return with_token_counts(df.withColumns({c: strip_lines(c) for c in ("prompt", "target")}), counter)
    stripped = _measured(df).withColumns({
        c: F.when(F.col(f"__{c}.bare"), F.col(c)).otherwise(strip_lines(c)) for c in ("prompt", "target")
    })
    return _counted(stripped, _from_measure).drop("__prompt", "__target")


def _metadata(df: DataFrame) -> dict[str, Column]:
    none = F.lit(None)
    refs = "supporting_facts" in df.columns
    return {
        "hops": F.size("supporting_facts") if refs else none.cast("int"),
        "type": F.col("type") if "type" in df.columns else none.cast("string"),
        "relationships": (
            F.col("evidences.relation") if "evidences" in df.columns else none.cast("array<string>")
        ),
    }


def make_examples(
    df: DataFrame,
    dataset: str,
    strategy: str | Sequence[str],
    answer_first: bool = False,
    random_facts: bool = False,
    seed: int = 42,
    entities: DataFrame | None = None,
    classifier: Callable[[Column], Column] = default_entity_type,
    counter: Callable[[Column], Column] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Prompt, target and answer of every row under one strategy.

    ``df`` has resolved ``facts`` (see ``resolve_facts``) where the dataset has
    facts.  No row leaves its partition.  Under several strategies each row is
    read once and leaves once per strategy, named in the column ``strategy``.
    """
    strategies = [strategy] if isinstance(strategy, str) else list(strategy)
    builders = {s: _pick(EXAMPLE_BUILDERS, dataset, s) for s in strategies}
    work = prepare(df, dataset, strategies, entities, classifier)
    if random_facts and "facts" in work.columns:
        work = work.withColumn("facts", shuffle_facts("facts", "id", seed))
    forms = []
    for name, build in builders.items():
        prompt, target = build(answer_first)
        named = [] if isinstance(strategy, str) else [F.lit(name).alias("strategy")]
        forms.append(F.struct(*named, prompt.alias("prompt"), target.alias("target")))
    out = work.select(
        "id",
        *[F.col(k) for k in keep],
        F.inline(F.array(*forms)),
        "answer",
        *[c.alias(name) for name, c in _metadata(work).items()],
    )
    return _finished(out, counter)


def make_exemplars(
    df: DataFrame,
    dataset: str,
    strategy: str,
    answer_first: bool = False,
    entities: DataFrame | None = None,
    classifier: Callable[[Column], Column] = default_entity_type,
) -> DataFrame:
    """Worked examples to put in front of a prompt: ``(id, text)``."""
    build = _pick(EXEMPLAR_BUILDERS, dataset, strategy)
    work = prepare(df, dataset, [strategy], entities, classifier)
    return work.select("id", strip_lines(build(answer_first)).alias("text"))


def qa_split(df: DataFrame, triple: bool = False) -> DataFrame:
    """(prompt, target) or (prompt, target, answer) beside the id."""
    return df.select("id", "prompt", "target", *(["answer"] if triple else []))


def causal_input(df: DataFrame) -> DataFrame:
    """Prompt and target as one text."""
    return df.withColumn("input", F.concat("prompt", "target"))
