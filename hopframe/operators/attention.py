"""Attention tables: phrase windows, softmax, whole words and top words.

Weights are one row per (id, layer, head, out_pos, in_pos); tokens one row per
(id, side, pos).  All groups are inside one text, so they stay short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD_START = "▁"  # fixed value: the mark of a word's first piece
HEAD = ["id", "layer", "head"]


def select_slice(att: DataFrame, layer: int | None = None, head: int | None = None, kind: str | None = None) -> DataFrame:
    """Weights of one layer, head or kind (cross, encoder, decoder)."""
    for name, value in (("layer", layer), ("head", head), ("kind", kind)):
        if value is not None:
            att = att.where(F.col(name) == value)
    return att


def phrase_window(tokens: Column | str, phrase: list[str]) -> Column:
    """0-based start of the first window equal to the phrase, null without one."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    k = len(phrase)
    wanted = F.array(*[F.lit(p) for p in phrase])
    starts = F.when(
        F.size(tokens) >= k, F.sequence(F.lit(1), F.size(tokens) - k + 1)
    ).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(starts, lambda i: F.slice(tokens, i, k) == wanted), F.lit(0)) - 1


def phrase_attention(att: DataFrame, tokens: DataFrame, phrase: list[str]) -> DataFrame:
    """Weights whose output position lies in the first occurrence of a phrase.

    ``tokens(id, tokens)`` holds the output tokens as arrays.
    """
    windows = tokens.select("id", phrase_window("tokens", phrase).alias("__start")).where(F.col("__start").isNotNull())
    return (
        att.join(windows, "id")
        .where((F.col("out_pos") >= F.col("__start")) & (F.col("out_pos") < F.col("__start") + len(phrase)))
        .drop("__start")
    )


def sum_over_window(att: DataFrame) -> DataFrame:
    """Total weight of every input position over the selected output positions."""
    return att.groupBy(*HEAD, "in_pos").agg(F.sum("weight").alias("weight"))


def softmax_by(df: DataFrame, keys: list[str], col: str = "weight") -> DataFrame:
    """Softmax inside each group, shifted by the group's maximum."""
    group = Window.partitionBy(*keys)
    shifted = df.withColumn("__e", F.exp(F.col(col) - F.max(col).over(group)))
    return shifted.withColumn(col, F.col("__e") / F.sum("__e").over(group)).drop("__e")


def merge_words(df: DataFrame) -> DataFrame:
    """Sub-word pieces to words with summed weights.

    ``df`` has id, layer, head, in_pos, token and weight.  A piece starts a word
    if it carries the mark or is the first of the text.
    """
    order = Window.partitionBy(*HEAD).orderBy("in_pos")
    starts = F.col("token").startswith(WORD_START).cast("int")
    first = F.row_number().over(order) == 1
    numbered = df.withColumn("word_no", F.sum(F.when(first, 1).otherwise(starts)).over(order))
    return (
        numbered.groupBy(*HEAD, "word_no")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("in_pos", "token"))), lambda s: s["token"]), ""
            ).alias("word"),
            F.sum("weight").alias("weight"),
        )
    )


def top_words(words: DataFrame, n: int = 5) -> DataFrame:
    """n heaviest words per head, earlier words first among equals."""
    order = Window.partitionBy(*HEAD).orderBy(F.col("weight").desc(), F.col("word_no").asc())
    return words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
