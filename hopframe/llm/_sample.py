"""Bounded samples of labelled rows, for fitting classifiers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopframe.llm._store import join_small, stored


def sample_per_class(rows: DataFrame, label: str, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows of each class, by a hash of the key.

    Classes are counted, then a hash thins each to about twice the bound, and
    only those are ranked, so that a large class is never ordered as a whole.
    """
    counts = stored(rows.groupBy(label).agg(F.count("*").alias("__n")), "sample-classes")
    drawn = rows.withColumn("__draw", F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(17)), 1).cast("double") / float(1 << 63))
    thin = join_small(drawn, counts, [label], "inner").where(F.col("__draw") * F.col("__n") < 2.0 * bound + 50)
    place = Window.partitionBy(label).orderBy("__draw", key)
    return thin.withColumn("__place", F.row_number().over(place)).where(F.col("__place") <= bound).drop("__draw", "__n", "__place")
