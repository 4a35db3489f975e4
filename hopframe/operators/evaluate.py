"""Scoring of responses, run averages, resuming and completeness."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopframe import schemas
from hopframe.functions import text as T
from hopframe.functions.sequence import overlap_batch
from hopframe.functions.stemming import stem_word
from hopframe.session import ship_helpers

METRICS = ("bleu_1", "bleu_2", "rouge_1", "rouge_2", "rouge_l", "f1_1", "f1_2")


def _overlap_udf(use_stemmer: bool, with_lcs: bool):
    ship_helpers()

    def compare(truth: pd.Series, response: pd.Series) -> pd.DataFrame:
        return overlap_batch(truth, response, stem_word if use_stemmer else None, with_lcs)

    schema = "n_truth int, n_response int, shared_1 int, shared_2 int, lcs int"
    compare.__annotations__ = {"truth": pd.Series, "response": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(compare, schema)


def udf_inputs(df: DataFrame, **inputs: Column) -> DataFrame:
    """Add columns a Python UDF can take.

    Spark cannot run a Python UDF whose argument has a lambda inside a lambda,
    and would merge such an argument into the call; a one-element explode is a
    boundary it does not merge across.
    """
    row = F.struct(*[c.alias(n) for n, c in inputs.items()])
    out = df.withColumn("__in", F.explode(F.array(row)))
    return out.withColumns({n: F.col("__in")[n] for n in inputs}).drop("__in")


def judge(df: DataFrame, fallback: str = "none") -> DataFrame:
    """Add the extracted answer, the self-ask mark and correctness."""
    return df.withColumns({
        "model_answer": T.extract_answer("response", "response", fallback),
        "self_ask": T.is_self_ask("response"),
    }).withColumn("correct", T.is_correct("model_answer", "answer"))


def rouge(
    df: DataFrame,
    truth: str = "target",
    response: str = "response",
    use_stemmer: bool = True,
    with_lcs: bool = True,
) -> DataFrame:
    """N-gram and subsequence overlap of each row's truth and response.

    Precision of 1- and 2-grams is named bleu_1/2, recall rouge_1/2, the
    longest-common-subsequence recall rouge_l.  Texts are lower-cased in the JVM,
    their words cut and compared in one Arrow pass, linear in the text length.
    """
    compare = _overlap_udf(use_stemmer, with_lcs)
    words = udf_inputs(df, __t=F.lower(truth), __r=F.lower(response))
    compared = words.withColumn("__o", compare("__t", "__r")).drop("__t", "__r")
    get = lambda name: F.col("__o")[name]
    pairs = lambda name: F.greatest(get(name) - 1, F.lit(0))
    out = compared.withColumns({
        "bleu_1": T.safe_div(get("shared_1"), get("n_response")),
        "rouge_1": T.safe_div(get("shared_1"), get("n_truth")),
        "bleu_2": T.safe_div(get("shared_2"), pairs("n_response")),
        "rouge_2": T.safe_div(get("shared_2"), pairs("n_truth")),
    })
    if with_lcs:
        out = out.withColumn("rouge_l", T.safe_div(get("lcs"), get("n_truth")))
    return out.withColumns({
        "f1_1": T.f_measure(F.col("bleu_1"), F.col("rouge_1")),
        "f1_2": T.f_measure(F.col("bleu_2"), F.col("rouge_2")),
    }).drop("__o")


def score(df: DataFrame, use_stemmer: bool = True, fallback: str = "none") -> DataFrame:
    """Per-example scores of rows with answer, target and response."""
    return rouge(judge(df, fallback), use_stemmer=use_stemmer)


def macro(scores: DataFrame, by: str | list[str] = "run_id", digits: int = 4) -> DataFrame:
    """Means of all metrics per run, rounded."""
    by = [by] if isinstance(by, str) else by
    present = [m for m in METRICS if m in scores.columns]
    return scores.groupBy(*by).agg(
        F.round(F.avg(F.col("correct").cast("double")), digits).alias("accuracy"),
        *[F.round(F.avg(m), digits).alias(m) for m in present],
    )


def pending(examples: DataFrame, responses: DataFrame, on: tuple[str, ...] = ("run_id", "id")) -> DataFrame:
    """Examples not answered yet; what a resumed evaluation still has to do."""
    return examples.join(responses.select(*on), list(on), "left_anti")


def append_new(old: DataFrame, new: DataFrame, on: tuple[str, ...] = ("run_id", "id")) -> DataFrame:
    """Earlier responses and those new ones that are not among them; of new rows that share a key the least stays."""
    rest = [c for c in new.columns if c not in on]
    once = new.groupBy(*on).agg(F.min(F.struct(*rest)).alias("__row")).select(*on, "__row.*") if rest else new.distinct()
    return old.unionByName(once.join(old.select(*on), list(on), "left_anti"))


def completeness(expected: DataFrame, responses: DataFrame, on: tuple[str, ...] = ("run_id", "id")) -> DataFrame:
    """Per run: expected, answered, missing, unknown and repeated rows."""
    want = expected.groupBy(*on).agg(F.count(F.lit(1)).alias("want"))
    have = responses.groupBy(*on).agg(F.count(F.lit(1)).alias("have"))
    both = want.join(have, list(on), "full_outer")
    run = on[0]
    return both.groupBy(run).agg(
        F.count("want").alias("expected"),
        F.count("have").alias("answered"),
        F.count_if(F.col("have").isNull()).alias("missing"),
        F.count_if(F.col("want").isNull()).alias("unknown"),
        F.count_if(F.col("have") > 1).alias("repeated"),
    ).withColumn(
        "complete",
        (F.col("missing") == 0) & (F.col("unknown") == 0) & (F.col("repeated") == 0),
    )


def require_complete(report: DataFrame) -> DataFrame:
    """The report, failing at run time on the first run that is not complete."""
    return report.withColumn(
        "complete",
        F.when(F.col("complete"), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("responses do not match the test set of "), F.col("run_id").cast("string"))).cast("boolean")
        ),
    )


def normalize(
    df: DataFrame, cols: list[str], fn: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Bring text columns into the form responses have, for a fair comparison.

    ``fn`` is the tokenizer round trip of the evaluated model as a Column
    function or pandas UDF; by default white space is collapsed.
    """
    fn = fn or (lambda c: T.strip(F.regexp_replace(c, r"\s+", " ")))
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def generate(
    df: DataFrame,
    predict: Callable[[pd.Series], pd.Series],
    prompt: str = "prompt",
    out: str = "response",
    batch_size: int = 100,
) -> DataFrame:
    """Ask a user-supplied batch function for a response to every prompt.

    The function runs in the tasks on Arrow batches of at most ``batch_size``
    rows; loading a model once per worker is its own affair.
    """
    def ask(batch: pd.Series) -> pd.Series:
        parts = [predict(batch.iloc[i:i + batch_size]) for i in range(0, len(batch), batch_size)]
        return pd.concat(parts) if parts else batch

    ask.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    asked = udf_inputs(df, __p=F.col(prompt))
    return asked.withColumn(out, F.pandas_udf(ask, "string")("__p")).drop("__p")


def evaluate(examples: DataFrame, responses: DataFrame, use_stemmer: bool = True, fallback: str = "none") -> DataFrame:
    """Scores of responses ``(run_id, id, response)`` against their examples."""
    keys = ["run_id", "id"] if "run_id" in examples.columns else ["id"]
    truth = examples.select(*keys, "answer", "target")
    return score(responses.select("run_id", "id", "response").join(truth, keys), use_stemmer, fallback)


def evaluate_on(
    examples: DataFrame, responses: DataFrame, use_stemmer: bool = True, fallback: str = "none", with_rouge: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Scores of responses ``(run_id, test_set, id, response)`` against the examples of the set they answer, and rejects.

    ``examples`` (test_set, id, answer, target) hold each set's own answers and
    targets, so one question may have several.  A response whose set lacks its
    question is no score and no silent loss: it is returned as a reject.
    """
    truth = examples.select("test_set", "id", "answer", "target", F.lit(True).alias("__known"))
    met = responses.select("run_id", "test_set", "id", "response").join(truth, ["test_set", "id"], "left")
    known = met.where("__known").drop("__known")
    scored = score(known, use_stemmer, fallback) if with_rouge else judge(known, fallback)
    return scored, met.where("__known IS NULL").select("run_id", "test_set", "id", "response")


RESPONSE_SCHEMA = schemas.RESPONSE
