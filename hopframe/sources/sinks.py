"""Writers.  None overwrites what it reads; partial writes can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe import schemas
from hopframe.operators.filters import filter_tokens, merge_ids
from hopframe.operators.ordering import extremes, with_chunk
from hopframe.sources.prepared import PARTITIONS


def write_examples(df: DataFrame, root: str, partition_cols: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Prepared examples, one directory per combination of the flags the table has."""
    cols = partition_cols or [c for c in PARTITIONS if c in df.columns]
    df.write.mode(mode).partitionBy(*cols).parquet(root)


def write_filtered(df: DataFrame, root: str, max_tokens: int) -> None:
    """A copy of the examples within a token limit, kept apart by that limit; writing it again replaces its partitions."""
    kept = filter_tokens(df, max_tokens).withColumn("max_tokens", F.lit(max_tokens))
    _replace_partitions(kept, root, ["max_tokens"] + [c for c in PARTITIONS if c in df.columns])


def _replace_partitions(df: DataFrame, root: str, cols: list[str]) -> None:
    """Write partitions in place of those of the same values; all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cols).parquet(root)


def write_chunks(df: DataFrame, root: str, chunks: int = 15, key: str = "pos", keep_remainder: bool = False) -> None:
    with_chunk(df, chunks, key, keep_remainder).write.mode("errorifexists").partitionBy("chunk").parquet(root)


def write_exemplars(pool: DataFrame, path: str) -> None:
    """Exemplars as they are, closing newline included, and a newline after each: a blank line stands between them.

    The pool is a handful of rows, so it goes into one file to keep its order.
    """
    pool.orderBy("id").select("text").coalesce(1).write.mode("errorifexists").option("lineSep", "\n").text(path)


def accumulate_ids(spark: SparkSession, root: str, new: DataFrame, version: int) -> DataFrame:
    """Write the union of version ``version - 1`` and new ids as ``version``."""
    existing = spark.read.parquet(f"{root}/version={version - 1}") if version > 0 else None
    merge_ids(existing, new).write.mode("errorifexists").parquet(f"{root}/version={version}")
    return spark.read.parquet(f"{root}/version={version}")


def write_run(scores: DataFrame, macro: DataFrame, root: str) -> None:
    """Scores and averages as Parquet tables, partitioned by run; writing a run again replaces only that run."""
    for df, name in ((scores, "scores"), (macro, "macro")):
        _replace_partitions(df, f"{root}/{name}", ["run_id"])


def nested_results(scores: DataFrame, macro: DataFrame, runs: DataFrame) -> DataFrame:
    """Result documents as other tools read them: lists per metric, one row per run.

    A document holds a whole run, so use this for export of runs of a size a
    single JSON document can have; analyses read the flat tables.
    """
    names = {"correct": "correct", **schemas.METRICS}
    ordered = F.array_sort(F.collect_list(F.struct("pos", *names)))
    lists = scores.groupBy("run_id").agg(ordered.alias("rows")).select(
        "run_id", F.struct(*[F.col(f"rows.{new}").alias(old) for new, old in names.items()]).alias("micro_results")
    )
    means = {"accuracy": "accuracy", **schemas.METRICS}
    macros = macro.select("run_id", F.struct(*[F.col(new).alias(old) for new, old in means.items()]).alias("macro_results"))
    return (
        runs.select("run_id", "model", "strategy", "answer_first", "random_facts", "examplars")
        .join(lists, "run_id").join(macros, "run_id")
    )


def append_responses(df: DataFrame, root: str, batch_id: int) -> None:
    """One directory per batch; writing a batch again replaces only that batch."""
    df.write.mode("overwrite").partitionBy("run_id").parquet(f"{root}/batch={batch_id}")


def start_attempt(spark: SparkSession, root: str, df: DataFrame, attempt: int) -> None:
    """Responses of a fresh start: earlier attempts stay, readers take the latest."""
    df.write.mode("errorifexists").parquet(f"{root}/attempt={attempt}")


def latest_attempt(spark: SparkSession, root: str) -> DataFrame:
    attempts = spark.read.parquet(root)
    return attempts.where(F.col("attempt") == attempts.agg(F.max("attempt")).scalar())


def write_csv(df: DataFrame, path: str, cols: list[str] | None = None) -> None:
    (df.select(*cols) if cols else df).write.mode("errorifexists").option("header", True).csv(path)


def sample_report(
    df: DataFrame, title: str, metric: str = "f1_2", n: int = 5, seed: int = 0, by: tuple[str, ...] = ()
) -> DataFrame:
    """Markdown lines of the top, bottom and random examples, in order, one report for each combination of ``by``.

    ``df`` has id, pos, prompt, target, response and the metrics.
    """
    headings = {"top": "Top", "bottom": "Bottom", "random": "Random"}
    words = {5: "Five"}
    rows = extremes(df, metric, n, seed, by=by)
    order = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(headings) for x in (s, i)]), F.col("section"))
    head = F.concat(
        F.element_at(F.create_map(*[F.lit(x) for p in headings.items() for x in p]), F.col("section")),
        F.lit(f" {words.get(n, n)} Examples\n"),
    )
    scores = F.concat_ws(
        ", ", *[F.concat(F.lit(f"{old}: "), F.round(F.col(new), 5).cast("string")) for new, old in schemas.METRICS.items()]
    )
    body = F.concat(
        F.lit("### Example "), (F.col("pos") + 1).cast("string"),
        F.lit("\nPrompt:\n```\n"), "prompt", F.lit("```\nTarget:\n```\n"), "target",
        F.lit("```\nResponse:\n```\n"), "response", F.lit("\n```\n"),
        F.when(F.col("section") == "random", scores).otherwise(F.lit("")),
    )
    text = F.concat(
        F.when((F.col("section") == "top") & (F.col("rank") == 1), F.lit(f"# {title}\n")).otherwise(F.lit("")),
        F.when(F.col("rank") == 1, F.concat(F.lit("## "), head)).otherwise(F.lit("")),
        body,
    )
    return rows.withColumn("section_no", order).select(*by, "section_no", "section", "rank", text.alias("text"))


def write_report(report: DataFrame, path: str) -> None:
    """The report as one text file; it has three sections of n rows."""
    report.orderBy("section_no", "rank").select("text").coalesce(1).write.mode("errorifexists").text(path)
