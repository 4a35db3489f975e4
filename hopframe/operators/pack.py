"""Fixed-length model inputs from token-id arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopframe.functions.text import TOKEN_PATTERN


def hashed_ids(text: Column, vocabulary: int = 32000) -> Column:
    """Stand-in tokenizer: ids from 2 up by the position-weighted bytes of each token.

    Real runs pass their own tokenizer as a pandas UDF instead.
    """
    return F.transform(
        F.regexp_extract_all(text, F.lit(f"({TOKEN_PATTERN})"), F.lit(1)),
        lambda t: (F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("int") % (vocabulary - 2) + 2),
    )


def pad_to(ids: Column, length: int, pad_id: int = 0) -> Column:
    """Cut to ``length`` or fill up with ``pad_id``."""
    kept = F.slice(ids, 1, length)
    return F.concat(kept, F.array_repeat(F.lit(pad_id), F.lit(length) - F.size(kept)))


def shift_right(labels: Column, start_id: int = 0) -> Column:
    """Decoder input: labels moved by one, the start id in front."""
    return F.concat(F.array(F.lit(start_id)), F.slice(labels, F.lit(1), F.size(labels) - 1))


def pack(
    df: DataFrame,
    max_length: int = 512,
    pad_id: int = 0,
    start_id: int = 0,
    tokenizer: Callable[[Column], Column] = hashed_ids,
) -> DataFrame:
    """input_ids, attention_mask, labels and decoder_input_ids of each prompt/target."""
    ids = df.withColumns({"__p": tokenizer(F.col("prompt")), "__t": tokenizer(F.col("target"))})
    used = F.least(F.size("__p"), F.lit(max_length))
    return ids.withColumns({
        "input_ids": pad_to(F.col("__p"), max_length, pad_id),
        "attention_mask": F.concat(
            F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(max_length) - used)
        ),
        "labels": pad_to(F.col("__t"), max_length, pad_id),
    }).withColumn("decoder_input_ids", shift_right(F.col("labels"), start_id)).drop("__p", "__t")
