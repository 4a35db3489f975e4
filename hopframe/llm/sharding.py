"""Rendezvous hashing of stable record keys over weighted shards.

Each record draws one number per shard from a digest of its key and the
shard's number, and goes where ``-ln(u) / weight`` is least.  A record's draw
for a shard does not depend on the other shards, so one more shard takes
records only into itself, about its share of the weight.

Slots number the records of a shard from 0 without gaps: counts per shard and
hash bucket give each bucket's first slot, and only buckets are ordered.

Nulls: a null key counts as the text ``null``; a null text has no bytes and
the checksum of an empty text.  Repeated keys share a shard and have slots of
their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopframe.llm._store import stored

BUCKET_ROWS = 4096
COMPUTED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _draw(key: Column, shard: int, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13)
    return -F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)) / F.lit(float(weight))


def shard_of(key: str, weights: Sequence[float]) -> Column:
    """The shard with the least draw; shards of weight 0 take nothing, ties go to the lower number."""
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a positive weight")
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    draws = [F.struct(_draw(text, i, w).alias("d"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def number_slots(records: DataFrame, order: Sequence[str], spread: str) -> DataFrame:
    """Add ``slot``: gapless from 0 in each shard.

    ``records`` is a stored table with ``shard`` and a uniform 31-bit number
    ``spread``.  Buckets are as many as keep each near ``BUCKET_ROWS`` rows,
    whatever the shard's size.
    """
    rows = records.count()
    buckets = 1
    while buckets * BUCKET_ROWS < rows and buckets < 1 << 30:
        buckets *= 2
    dealt = records.withColumn("__bucket", (F.col(spread) % buckets).cast("int"))
    upto = Window.partitionBy("shard", "__part").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "__bucket").agg(F.count("*").alias("n")).withColumn("__part", F.shiftright("__bucket", 10))
    parts = counts.groupBy("shard", "__part").agg(F.sum("n").alias("n")).withColumn("head", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    firsts = counts.withColumn("inner", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(parts.drop("n"), ["shard", "__part"]).select(
        "shard", "__bucket", (F.col("head") + F.col("inner")).alias("__first")
    )
    within = Window.partitionBy("shard", "__bucket").orderBy(spread, *order)
    return (
        dealt.withColumn("__place", F.row_number().over(within) - 1)
        .join(firsts, ["shard", "__bucket"])
        .withColumn("slot", F.col("__first") + F.col("__place"))
        .drop("__bucket", "__place", "__first")
    )


def shard(docs: DataFrame, weights: Sequence[float] = (1,) * 8, grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Id, size in bytes plus one, checksum, shard, slot and, for ``grown`` weights, the shard then; ``keep`` names more columns to carry, except those computed here."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    id_text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    records = docs.select(
        key,
        *[c for c in keep if c != key and c not in COMPUTED],
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, weights).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.shiftrightunsigned(F.xxhash64(id_text, body), 33).alias("__spread"),
    )
    return number_slots(stored(records, "shard"), [key, "text_crc32"], "__spread").drop("__spread")


def write_shards(records: DataFrame, path: str) -> None:
    """One folder per shard; a rerun replaces it."""
    records.write.mode("overwrite").partitionBy("shard").parquet(path)


def expected_shares(weights: Sequence[float]) -> list[float]:
    total = reduce(lambda a, b: a + b, weights)
    return [w / total for w in weights]
