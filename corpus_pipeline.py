"""A corpus pipeline of five operators: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and
read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.llm import decontam, mixing, resemblance, sharding, simhash, toxicity
from hopframe.llm._store import fold, scratch, stored, table, way

# Two stages learn a classifier or compare hashed shingles, which SQL does not have.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows outside its holdout, does not call toxic."""
    model = toxicity.learn(docs.where(fold("doc_id", 3) != 1), table(spark, sf_dir, "labels"))
    return toxicity.add_scores(docs, model, column="__score").where(F.col("__score") < toxicity.CUT).drop("__score")


def linked_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id) over both links: SimHash fingerprints, and the exact Jaccard similarity that follows."""
    with scratch(docs.sparkSession) as keep:
        marked = stored(simhash.near_duplicates(docs, key, text).groupBy(key).agg(F.min("component_id").alias("print")), "pipeline-prints")
        alike = resemblance.similar_texts(docs, key, text).groupBy(key).agg(F.min("component_id").alias("alike"))
        classes = stored(marked.join(alike.hint("merge"), key).select(key, "print", "alike"), "pipeline-classes")
        # fingerprint classes meet in the class of similar texts they share, at the least of them
        least = classes.groupBy("alike").agg(F.min("print").alias("least"))
        meet = classes.join(least.hint("merge"), "alike").where(F.col("print") != F.col("least")).select("print", "least").distinct()
        edges = stored(meet.select(F.inline(F.array(
            F.struct(F.col("print").alias("a"), F.col("least").alias("b")), F.struct(F.col("least").alias("a"), F.col("print").alias("b")),
        ))).distinct(), "pipeline-edges")
        joined = simhash.components(edges).select(F.col("node").alias("print"), F.col("component"))
        return keep(classes.join(joined.hint(way(joined)), "print", "left").select(key, F.coalesce("component", "print").alias("component_id")), "pipeline-links")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash, as `op2` links, or by a Jaccard similarity of 0.8 and more over shingles of five words."""
    return simhash.keep_one(docs, grouped=linked_texts)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard and slot."""
    return sharding.shard(docs, (1,) * 8, (1,) * 9, keep=docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
