"""Progress of an evaluation in batches: responses, processed targets and a manifest.

A batch counts once its manifest is whole.  What a killed writer left of a
batch is neither read nor counted, and writing the batch again replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.session import complete_folders

RESPONSES = "run_id string, id string, response string"
TARGETS = "run_id string, id string, answer string, target string"
KEYS = ["run_id", "id"]


class Progress:
    """Batches below ``root``; rows are keyed by run and example."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, responses: DataFrame, targets: DataFrame, batch_id: int) -> None:
        """Responses (run_id, id, response) and processed targets (run_id, id, answer, target), then their counts."""
        self.write("responses", responses.select(*KEYS, "response"), batch_id)
        self.write("targets", targets.select(*KEYS, "answer", "target"), batch_id)
        marked = self._marked(self._read("responses", [batch_id]), self._read("targets", [batch_id]))
        self.write("manifest", marked.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("responses", "answers", "targets")]), batch_id)

    def write(self, kind: str, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{kind}/batch={batch_id}")

    def batches(self) -> list[int]:
        """Numbers of the batches with a whole manifest."""
        return complete_folders(self.spark, f"{self.root}/manifest", "batch")

    def _read(self, kind: str, batches: list[int]) -> DataFrame:
        schema = RESPONSES if kind == "responses" else TARGETS
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{kind}/batch={k}" for k in batches])

    def responses(self) -> DataFrame:
        return self._read("responses", self.batches())

    def targets(self) -> DataFrame:
        return self._read("targets", self.batches())

    def remaining(self, examples: DataFrame) -> DataFrame:
        """Examples (run_id, id, ...) that no counted batch answers."""
        return examples.join(self.responses().select(*KEYS), KEYS, "left_anti")

    @staticmethod
    def _marked(responses: DataFrame, targets: DataFrame) -> DataFrame:
        """One row per stored row, with ones for what it holds."""
        one = lambda c: F.col(c).isNotNull().cast("long")
        nothing = F.lit(0).cast("long")
        return responses.select(*KEYS, F.lit(1).cast("long").alias("responses"), nothing.alias("answers"), nothing.alias("targets")).unionByName(
            targets.select(*KEYS, nothing.alias("responses"), one("answer").alias("answers"), one("target").alias("targets"))
        )

    def completeness(self, examples: DataFrame) -> DataFrame:
        """Per run: expected examples, stored responses, answers and targets, examples without a response (missing),
        and keys whose response and processed target do not stand beside each other (unaligned)."""
        stored = self._marked(self.responses(), self.targets()).withColumn("expected", F.lit(0).cast("long"))
        none = [F.lit(0).cast("long").alias(c) for c in ("responses", "answers", "targets")]
        both = stored.unionByName(examples.select(*KEYS, *none, F.lit(1).cast("long").alias("expected")))
        per_key = both.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("expected", "responses", "answers", "targets")])
        return per_key.groupBy("run_id").agg(
            *[F.sum(c).alias(c) for c in ("expected", "responses", "answers", "targets")],
            F.count_if((F.col("expected") > 0) & (F.col("responses") == 0)).alias("missing"),
            F.count_if((F.col("responses") != F.col("answers")) | (F.col("responses") != F.col("targets"))).alias("unaligned"),
        )
