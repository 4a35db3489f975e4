"""Prompt variants for robustness checks, and how often they flip the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopframe.functions.text import seeded_key

KINDS = ("add_fact", "replace_fact", "alter_word", "swap_options")

# 'Who ..., A or B?' and 'Are A and B ...?'
OPTIONS = r"^(.*(?:, |^Are ))(.+?) (or|and) (.+?)(\?| from .*\?)$"

# Hex digits of a digest by which rows are dealt to buckets: 65,536 of them.
PREFIX = 4


def _with_next_fact(df: DataFrame, seed: int) -> DataFrame:
    """Add ``other_fact`` and ``other_id``: the first fact of the next row in digest order that has one.

    Only buckets of a digest prefix are ordered; the last row of a bucket takes
    the first fact of the buckets after it, and the very last that of the first.
    """
    digest = seeded_key(seed, "id")
    fact = F.get("facts", F.lit(0))
    rows = df.withColumns({
        "__digest": digest,
        "__bucket": F.substring(digest, 1, PREFIX),
        "__own": F.when(fact.isNotNull(), F.struct(fact.alias("fact"), F.col("id").alias("id"))),
    })
    after = Window.orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = (
        rows.groupBy("__bucket")
        .agg(F.min_by("__own", F.when(F.col("__own").isNotNull(), F.col("__digest"))).alias("head"))
        .withColumn("__next", F.coalesce(
            F.last("head", ignorenulls=True).over(after),
            F.min_by("head", F.when(F.col("head").isNotNull(), F.col("__bucket"))).over(every),
        ))
        .drop("head")
    )
    later = Window.partitionBy("__bucket").orderBy(F.desc("__digest"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("__later", F.last("__own", ignorenulls=True).over(later))
        .join(heads, "__bucket")
        .withColumn("__later", F.coalesce("__later", "__next"))
        .withColumns({"other_fact": F.col("__later.fact"), "other_id": F.col("__later.id")})
        .drop("__digest", "__bucket", "__own", "__later", "__next")
    )


def perturb(df: DataFrame, kind: str, seed: int = 7) -> DataFrame:
    """A variant of every row ``(id, question, facts)`` it applies to, with ``changed``.

    Distractor facts come from the next row in digest order, so every row has
    one as soon as two rows with facts exist.
    """
    if kind in ("add_fact", "replace_fact"):
        joined = _with_next_fact(df, seed)
        usable = F.col("other_fact").isNotNull() & (F.col("other_id") != F.col("id"))
        if kind == "add_fact":
            new = F.concat("facts", F.array("other_fact"))
        else:
            new = F.concat(F.slice("facts", F.lit(1), F.greatest(F.size("facts") - 1, F.lit(0))), F.array("other_fact"))
        return (
            joined.withColumns({"facts": F.when(usable, new).otherwise(F.col("facts")), "changed": usable})
            .drop("other_fact", "other_id")
        )
    if kind == "alter_word":
        # a typo: the two middle letters of the first fact change places
        first = F.get("facts", F.lit(0))
        mid = F.floor(F.length(first) / 2).cast("int")
        typo = F.concat(
            F.substring(first, F.lit(1), mid - 1), F.substring(first, mid + 1, F.lit(1)),
            F.substring(first, mid, F.lit(1)), F.substring(first, mid + 2, F.length(first)),
        )
        usable = F.coalesce(F.length(first) >= 4, F.lit(False))
        rest = F.slice("facts", F.lit(2), F.greatest(F.size("facts") - 1, F.lit(0)))
        return df.withColumns({
            "facts": F.when(usable, F.concat(F.array(typo), rest)).otherwise(F.col("facts")),
            "changed": usable,
        })
    if kind == "swap_options":
        return df.withColumns({
            "question": F.regexp_replace("question", OPTIONS, "$1$4 $3 $2$5"),
            "changed": F.col("question").rlike(OPTIONS),
        })
    raise ValueError(f"unknown kind {kind!r}; choose from {KINDS}")


def flip_rate(base: DataFrame, variants: DataFrame) -> DataFrame:
    """Per kind: rows compared, and the share whose correctness changed.

    ``base(id, correct)``, ``variants(id, kind, correct)``.
    """
    joined = variants.join(base.select("id", F.col("correct").alias("base_correct")), "id")
    flipped = F.col("correct") != F.col("base_correct")
    return joined.groupBy("kind").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(flipped).alias("flipped"),
        F.count_if(flipped & F.col("base_correct")).alias("lost"),
        F.count_if(flipped & F.col("correct")).alias("gained"),
        F.avg(flipped.cast("double")).alias("flip_rate"),
    )
