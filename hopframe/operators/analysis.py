"""Statistics over corpora and scores."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopframe.functions.text import safe_corr
from hopframe.operators.evaluate import METRICS
from hopframe.session import ship_helpers

SIZE_COLUMNS = ("num_prompt_tokens", "num_target_tokens", "num_tokens")


def token_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Only the count columns, for statistics."""
    return df.select(*(by or []), *SIZE_COLUMNS)


def token_stats(df: DataFrame, by: list[str] | None = None, cols: tuple[str, ...] = SIZE_COLUMNS) -> DataFrame:
    """count, mean, std, min, quartiles, max and sum of each column in long form.

    One aggregation over all columns; the quartiles are exact and keep one
    counter per distinct value, which for token counts is a small number.
    """
    by = by or []

    def stats(c: str) -> Column:
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        return F.struct(
            F.count(c).alias("count"),
            F.round(F.avg(c), 2).alias("mean"),
            F.round(F.stddev_samp(c), 2).alias("std"),
            F.min(c).cast("double").alias("min"),
            F.round(F.get(q, F.lit(0)), 2).alias("p25"),
            F.round(F.get(q, F.lit(1)), 2).alias("p50"),
            F.round(F.get(q, F.lit(2)), 2).alias("p75"),
            F.max(c).cast("double").alias("max"),
            F.sum(c).cast("double").alias("sum"),
        ).alias(c)

    wide = df.groupBy(*by).agg(*[stats(c) for c in cols])
    named = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in cols])
    return wide.select(*by, F.explode(named).alias("r")).select(*by, "r.column", "r.s.*")


def context_corr(
    df: DataFrame, size_col: str = "num_prompt_tokens", by: str | None = "run_id", metrics: tuple[str, ...] = METRICS
) -> DataFrame:
    """Correlation of a size column with correctness and all metrics."""
    size = F.col(size_col).cast("double")
    cols = [safe_corr(size, F.col("correct").cast("double")).alias("correct")]
    cols += [safe_corr(size, F.col(m)).alias(m) for m in metrics]
    return df.groupBy(*([by] if by else [])).agg(*cols)


def runs_wide(scores: DataFrame, runs: list[str], value: str = "correct", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per question, one column per run.

    One aggregation by question: a task passes on one narrow row per question,
    where grouping by question and run would shuffle every response with the run's name.
    """
    of_run = lambda r: F.first(F.when(F.col("run_id") == r, F.col(value)), ignorenulls=True).alias(r)
    return scores.groupBy("id", *extra).agg(*[of_run(r) for r in runs])


def _run_pairs(runs: list[str], ordered: bool) -> list[tuple[str, str]]:
    return [(a, b) for a in runs for b in runs if (a < b or (not ordered and a != b))]


def run_corr(wide: DataFrame, runs: list[str]) -> DataFrame:
    """Correlation of every pair of runs, in one aggregation, long form."""
    def one(a: str, b: str) -> Column:
        value = safe_corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double"))
        return F.struct(F.lit(a).alias("run_a"), F.lit(b).alias("run_b"), value.alias("corr"))

    pairs = [one(a, b).alias(f"p{i}") for i, (a, b) in enumerate(_run_pairs(runs, True))]
    row = wide.agg(*pairs)
    return row.select(F.inline(F.array(*[f"p{i}" for i in range(len(pairs))])))


def conditional_agreement(wide: DataFrame, runs: list[str]) -> DataFrame:
    """How run b fares given that run a is right or wrong: counts and shares.

    Each question is a set of the runs that are right and one of those that are
    wrong; a task adds up all pairs of its questions as one product of matrices
    and passes on a count per pair of runs and outcomes.  So what is shuffled
    depends on the number of runs and tasks, and not on the number of questions.
    A question counts for the pairs of runs that both answered it.
    """
    size = len(runs)

    def run(batches):
        total = np.zeros((2 * size, 2 * size), dtype=np.int64)
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            # right in the first half, wrong in the second; neither where the run has no answer
            marks = np.stack([c == v for v in (True, False) for c in columns], axis=1).astype(np.float32)
            total += (marks.T @ marks).astype(np.int64)  # exact: a batch has far fewer rows than 2**24
        a, b = np.nonzero(total)
        use = a % size != b % size
        a, b = a[use], b[use]
        yield pa.RecordBatch.from_arrays(
            [pa.array(a % size, pa.int32()), pa.array(b % size, pa.int32()), pa.array(a < size), pa.array(b < size), pa.array(total[a, b])],
            ["a", "b", "a_correct", "b_correct", "n"],
        )

    ship_helpers()
    cells = wide.select(*[F.col(f"`{r}`").cast("boolean").alias(f"r{i}") for i, r in enumerate(runs)]).mapInArrow(
        run, "a int, b int, a_correct boolean, b_correct boolean, n long"
    )
    name = lambda i: F.get(F.array(*map(F.lit, runs)), F.col(i))
    counts = cells.groupBy("a", "b", "a_correct", "b_correct").agg(F.sum("n").alias("questions")).select(
        name("a").alias("run_a"), name("b").alias("run_b"), "a_correct", "b_correct", "questions"
    )
    given = Window.partitionBy("run_a", "run_b", "a_correct")
    return counts.withColumn("share", F.col("questions") / F.sum("questions").over(given))


def accuracy_by_type(df: DataFrame, by: tuple[str, ...] = ("run_id", "type")) -> DataFrame:
    """Wrong, right and all questions and both shares per group."""
    right, all_rows = F.count_if(F.col("correct")), F.count(F.lit(1))
    return df.groupBy(*by).agg(
        (all_rows - right).alias("wrong"), right.alias("right"), all_rows.alias("total"),
    ).withColumns({
        "share_wrong": F.try_divide("wrong", "total"), "share_right": F.try_divide("right", "total"),
    })


def type_corr(df: DataFrame, runs: list[str]) -> DataFrame:
    """Correlation between runs of their accuracies per question type."""
    by_type = accuracy_by_type(df).groupBy("type").pivot("run_id", runs).agg(F.first("share_right"))
    return run_corr(by_type, runs)


def self_ask_rate(df: DataFrame) -> DataFrame:
    return df.groupBy("run_id").agg(F.avg(F.col("self_ask").cast("double")).alias("self_ask_rate"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Occurrences and share of every value."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("occurrences"))
    total = counts.agg(F.sum("occurrences").alias("n")).scalar()
    return counts.withColumn("share", F.col("occurrences") / total)


def relation_freq(df: DataFrame) -> DataFrame:
    """Occurrences of each evidence relation over the corpus."""
    return (
        df.select(F.explode("evidences.relation").alias("relation"))
        .groupBy("relation").agg(F.count(F.lit(1)).alias("occurrences"))
    )


def first_per_relation(df: DataFrame, order_col: str = "pos") -> DataFrame:
    """First triple of each relation in corpus order."""
    return (
        df.select(order_col, F.posexplode("evidences").alias("idx", "e"))
        .groupBy(F.col("e.relation").alias("relation"))
        .agg(F.min_by(F.col("e"), F.struct(order_col, "idx")).alias("e"))
        .select("relation", F.col("e.subject").alias("subject"), F.col("e.object").alias("object"))
    )


def context_hist(
    df: DataFrame, size_col: str = "num_prompt_tokens", bins: int = 20, by: tuple[str, ...] = ("run_id", "correct")
) -> DataFrame:
    """Histogram of context sizes with equal-width bins per group, and the group mean.

    The last bin is closed; a group with a single size has one bin.  The rows are
    read once, for their counts by size: bounds and mean are those of the counts.
    A group with a null in ``by`` has no bins.
    """
    by = list(by)
    sizes = df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in by])).groupBy(*by, size_col).agg(F.count(F.lit(1)).alias("n"))
    group, size = Window.partitionBy(*by), F.col(size_col)
    known = F.when(size.isNotNull(), F.col("n"))
    sizes = sizes.withColumns({
        "lo": F.min(size_col).over(group).cast("double"),
        "hi": F.max(size_col).over(group).cast("double"),
        "mean_size": F.try_divide(F.sum(size.cast("double") * known).over(group), F.sum(known).over(group)),
    })
    place = F.least(
        F.coalesce(F.width_bucket(F.col(size_col).cast("double"), F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(1)),
        F.lit(bins),
    )
    return (
        sizes.groupBy(*by, place.cast("int").alias("bin"))
        .agg(F.sum("n").alias("rows"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
             F.first("mean_size").alias("mean_size"))
    )


def model_means(leaderboard: DataFrame, metrics: tuple[str, ...] = ("accuracy",) + METRICS) -> DataFrame:
    """Mean of the run metrics per model."""
    present = [m for m in metrics if m in leaderboard.columns]
    return leaderboard.groupBy("model").agg(
        F.count(F.lit(1)).alias("runs"), *[F.avg(m).alias(m) for m in present]
    )


def mark_best(leaderboard: DataFrame, by: str = "strategy") -> DataFrame:
    """Add ``is_best`` to the most accurate run of each strategy; ties go to the smaller run id."""
    order = Window.partitionBy(by).orderBy(F.col("accuracy").desc(), F.col("run_id").asc())
    return leaderboard.withColumn("is_best", F.row_number().over(order) == 1)


def best_run(leaderboard: DataFrame, by: str = "strategy") -> DataFrame:
    """Only the best run of each strategy."""
    return mark_best(leaderboard, by).where("is_best").drop("is_best")


def leaderboard(macro_scores: DataFrame, runs: DataFrame) -> DataFrame:
    """Run configuration beside its averages."""
    return runs.join(macro_scores, "run_id")


def stage_counts(df: DataFrame, limit: int, by: list[str] | None = None) -> DataFrame:
    """Rows left after each filter stage of the example builder, in one pass."""
    from hopframe.functions.text import extract_answer

    found = extract_answer("target", "target")
    short = F.col("num_prompt_tokens") <= limit
    present = F.contains(F.lower("prompt"), F.lower(found)) | found.isin("yes", "no")
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("built"),
        F.count_if(short).alias("short_enough"),
        F.count_if(short & present).alias("verified"),
        F.count_if(~short).alias("dropped_long"),
        F.count_if(short & ~present).alias("dropped_unverified"),
    )


def compositionality_gap(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Among questions with all sub-questions right, the share answered wrongly.

    ``steps(id, is_sub, correct)`` has one row per sub-question and one per
    composed question.
    """
    by = by or []
    per_question = steps.groupBy(*by, "id").agg(
        F.bool_and(F.when(F.col("is_sub"), F.col("correct"))).alias("subs_right"),
        F.bool_or(F.when(~F.col("is_sub"), F.col("correct"))).alias("main_right"),
    )
    solved = F.coalesce(F.col("subs_right"), F.lit(False))
    missed = solved & ~F.coalesce(F.col("main_right"), F.lit(False))
    return per_question.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(solved).alias("subs_right"),
        F.count_if(missed).alias("composed_wrong"),
    ).withColumn("gap", F.try_divide("composed_wrong", "subs_right"))


def align(scores: DataFrame, responses: DataFrame, examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores, responses and question columns side by side by key.

    The second result counts, per run, keys that are missing on one side.
    """
    both = (
        scores.withColumn("__s", F.lit(1))
        .join(responses.withColumn("__r", F.lit(1)), ["run_id", "id"], "full_outer")
    )
    aligned = both.where(F.col("__s").isNotNull() & F.col("__r").isNotNull()).drop("__s", "__r").join(examples, "id")
    report = both.groupBy("run_id").agg(
        F.count_if(F.col("__s").isNull()).alias("without_score"),
        F.count_if(F.col("__r").isNull()).alias("without_response"),
    )
    return aligned, report


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
