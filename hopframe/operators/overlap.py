"""Overlap of two datasets: exact, by shared answer, and by edit similarity.

The similarity of two texts is 200 * LCS / (len a + len b), rounded to a whole
number.  Texts meet in blocks of similar length, where counts of characters and
of neighbouring pairs put out those no qualifying pair can miss.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopframe.functions.sequence import similar_in_blocks
from hopframe.session import ship_helpers

# Texts, and characters of texts, of one side that meet in one block.
KEY_ROWS, KEY_CHARS = 8_192, 2_000_000


def exact_overlap(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Number of distinct values both sides have."""
    return a.select(col).intersect(b.select(col)).agg(F.count(F.lit(1)).alias("shared"))


def shared_answer_pairs(
    a: DataFrame, b: DataFrame, n: int = 11, answer: str = "answer", question: str = "question", order: str = "pos"
) -> DataFrame:
    """For the first n shared answers, the first question of either side."""
    def first(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(answer).agg(F.min_by(question, order).alias(name))

    return first(a, "question_a").join(first(b, "question_b"), answer).orderBy(answer).limit(n)


class _Bounds:
    """What a score of at least ``threshold`` implies.

    With r = (threshold - 0.5) / 100, S the sum of both lengths and L the LCS:
    L >= r*S/2, and the shorter text has at least r/(2-r) of the longer one's
    length.  At most S - 2L characters are unmatched, and each breaks at most
    one adjacent matched pair, so the texts share at least 3L - S - 1 character
    pairs, counted with repeats.
    """

    def __init__(self, threshold: float):
        self.r = (threshold - 0.5) / 100.0
        if not 0 < self.r < 1:
            raise ValueError("the threshold must lie between 1 and 100")
        self.shorter = self.r / (2 - self.r)

    def band(self, length: Column) -> Column:
        """Lengths in bands so wide that partners lie in the same band or the next ones."""
        return F.floor(F.log(length.cast("double")) / F.lit(-math.log(self.shorter) + 1e-6)).cast("int")


def _side(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-empty texts with their length."""
    return df.select(F.col(col).alias("text")).where(F.length("text") > 0).distinct().withColumn("len", F.length("text"))


def _parts(df: DataFrame) -> Column:
    """Into how many parts the texts of the column ``band`` are dealt; there are few bands, lengths being their logarithm."""
    sizes = df.groupBy("band").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / F.lit(KEY_ROWS)), F.ceil(F.sum("len") / F.lit(KEY_CHARS)),
    ).cast("int").alias("parts"))
    known = sizes.agg(F.map_from_entries(F.collect_list(F.struct("band", "parts")))).scalar()
    return F.try_element_at(known, F.col("band"))


def fuzzy_pairs(a: DataFrame, b: DataFrame, col: str, threshold: int = 80) -> DataFrame:
    """All pairs of distinct texts of both sides with a similarity of at least ``threshold``.

    Lossless: texts are de-duplicated and banded by length, a text of ``b``
    goes to the bands its partners may lie in, and a band's texts are dealt into
    parts of bounded size on either side.  Each two parts meet once, in one
    task, so no task holds more than two parts whatever the bands' sizes.  The
    work is a scan of the pairs of similar length, a few bounds each.
    """
    bounds = _Bounds(threshold)
    left, right = _side(a, col), _side(b, col)
    # without texts no partner of the other side can be long or short enough for
    left, right = _within_reach(left, right, bounds), _within_reach(right, left, bounds)
    left = left.withColumn("band", bounds.band(F.col("len")))
    right = right.withColumn("band", F.explode(F.array(*[bounds.band(F.col("len")) + k for k in (-1, 0, 1)])))
    parts_a, parts_b = _parts(left), _parts(right)
    # bands only one side has are dropped here: their number of parts is null on the other
    part = lambda parts: F.pmod(F.xxhash64("text"), parts).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    keys = ["band", "part_a", "part_b"]
    # the steps behind this are heavy on a small input, so its partitions are not left to be merged by size
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks_a = left.where(parts_b.isNotNull()).select("band", part(parts_a).alias("part_a"), each(parts_b).alias("part_b"), "text").repartition(tasks, *keys)
    blocks_b = right.where(parts_a.isNotNull()).select("band", each(parts_a).alias("part_a"), part(parts_b).alias("part_b"), "text").repartition(tasks, *keys)
    ship_helpers()
    r = bounds.r

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        text_a, text_b = ours.column("text"), theirs.column("text")
        i, j, score = similar_in_blocks(text_a.to_pylist(), text_b.to_pylist(), threshold, r)
        return pa.table({
            "text_a": text_a.take(pa.array(i, pa.int64())), "text_b": text_b.take(pa.array(j, pa.int64())), "score": pa.array(score, pa.int32()),
        })

    met = blocks_a.groupBy(*keys).cogroup(blocks_b.groupBy(*keys))
    return met.applyInArrow(meet, "text_a string, text_b string, score int")


def _within_reach(df: DataFrame, other: DataFrame, bounds: _Bounds) -> DataFrame:
    span = other.agg(F.min("len").alias("lo"), F.max("len").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    return df.where(
        (F.col("len") >= lo * F.lit(bounds.shorter) - 1) & (F.col("len") <= hi / F.lit(bounds.shorter) + 1)
    )


def fuzzy_top(a: DataFrame, b: DataFrame, col: str, k: int = 5, floor: int = 80) -> DataFrame:
    """The k most similar texts of b for every text of a, from ``floor`` upwards.

    Without a floor a top-k has no lossless bound, so a floor is part of the
    operator; ties go to the alphabetically smaller text.
    """
    order = Window.partitionBy("text_a").orderBy(F.col("score").desc(), F.col("text_b").asc())
    return (
        fuzzy_pairs(a, b, col, floor)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )
