"""Readers of raw dataset files.

A file that is one JSON array cannot be split: read it once with these
functions and land it as Parquet (``land``); everything else reads that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe import schemas


def _array_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _positioned(df: DataFrame) -> DataFrame:
    # one file is one partition here, so ids rise in file order
    return df.withColumn("pos", F.monotonically_increasing_id())


def _fact_refs(c: str) -> Column:
    return F.transform(
        c, lambda x: F.struct(F.get(x, F.lit(0)).alias("title"), F.get(x, F.lit(1)).cast("int").alias("sent_id"))
    )


def _paragraphs(c: str) -> Column:
    # the inner list arrives as JSON text because the outer array mixes types
    return F.transform(
        c,
        lambda x: F.struct(
            F.get(x, F.lit(0)).alias("title"),
            F.from_json(F.get(x, F.lit(1)), "array<string>").alias("sentences"),
        ),
    )


def _triples(c: str) -> Column:
    return F.transform(
        c,
        lambda x: F.struct(
            F.get(x, F.lit(0)).alias("subject"), F.get(x, F.lit(1)).alias("relation"),
            F.get(x, F.lit(2)).alias("object"),
        ),
    )


def _first(df: DataFrame, n: int) -> DataFrame:
    return df if n < 1 else df.orderBy("pos").limit(n)


def read_wiki(spark: SparkSession, root: str, split: str = "train", n: int = -1) -> DataFrame:
    raw = _positioned(_array_file(spark, f"{root}/{split}.json", schemas.RAW_WIKI))
    return _first(raw.select(
        F.col("_id").alias("id"), "pos", "question", "answer", "type", "entity_ids",
        _fact_refs("supporting_facts").alias("supporting_facts"),
        _paragraphs("context").alias("context"), _triples("evidences").alias("evidences"),
    ), n)


def read_hotpot(spark: SparkSession, root: str, split: str = "train", n: int = -1) -> DataFrame:
    raw = _positioned(_array_file(spark, f"{root}/{split}.json", schemas.RAW_HOTPOT))
    return _first(raw.select(
        F.col("_id").alias("id"), "pos", "question", "answer", "type", "level",
        _fact_refs("supporting_facts").alias("supporting_facts"),
        _paragraphs("context").alias("context"),
    ), n)


def read_celebrities(spark: SparkSession, path: str, n: int = -1) -> DataFrame:
    """There is one file for all splits; rows get their position as id."""
    rows = _array_file(spark, path, schemas.RAW_CELEBRITIES).select(F.posexplode("data").alias("pos", "d"))
    return _first(rows.select(
        F.col("pos").cast("string").alias("id"), F.col("pos").cast("long").alias("pos"),
        F.col("d.Question").alias("question"), F.col("d.Answer").alias("answers"),
        F.col("d.Q1").alias("q1"), F.col("d.A1").alias("a1"),
        F.col("d.Q2").alias("q2"), F.col("d.A2").alias("a2"),
    ), n)


def read_strategyqa(spark: SparkSession, root: str, split: str = "train", n: int = -1) -> DataFrame:
    """Boolean answers are read as text, 'true' or 'false'."""
    raw = _positioned(_array_file(spark, f"{root}/{split}.json", schemas.RAW_STRATEGY))
    return _first(raw.select(
        F.col("qid").alias("id"), "pos", "term", "description", "question", "answer", "facts", "decomposition"
    ), n)


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """Instruction-task file: one row per entry of its instance list."""
    return _array_file(spark, path, schemas.RAW_INSTANCES).select(
        F.posexplode("Instances").alias("pos", "i")
    ).select(F.col("pos").cast("string").alias("id"), "pos", "i.input", "i.output")


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.RAW_QUARTZ) -> DataFrame:
    """Line-delimited JSON; splittable."""
    return spark.read.schema(schema).json(path)


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """Passages with nested questions: one row per question beside its passage."""
    return _array_file(spark, path, schemas.RAW_PASSAGES).select(
        "title", "text", F.posexplode("questions").alias("question_no", "q")
    ).select(
        "title", "text", "question_no", F.col("q.question").alias("question"),
        F.col("q.answer.answer_value").alias("answer"), F.col("q.answer.type").alias("answer_type"),
        F.col("q.context.text").alias("context"),
    )


def land(df: DataFrame, path: str) -> DataFrame:
    """Write once as Parquet and read back: the splittable form of a raw file."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
