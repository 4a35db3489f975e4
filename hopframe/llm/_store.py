"""Written tables in the shared folder, and joins on small tables of a checked size."""

from __future__ import annotations

import os
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.session import shared_dir

SMALL_ROWS = 100_000


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table below ``spark.checkpoint.dir`` and read it again: lineage ends there and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, purpose)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored inside go when the block ends; yields a function that stores a table to stay."""
    _scopes.append([])
    kept: list[str] = []

    def keep(df: DataFrame, purpose: str) -> DataFrame:
        out = stored(df, purpose)
        kept.append(_scopes[-1].pop())
        return out

    try:
        yield keep
    finally:
        paths = _scopes.pop()
        if _scopes:
            _scopes[-1].extend(kept)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once in a row and hand it to ``use``; plain nesting would evaluate it at every mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def way(rows: DataFrame, bound: int = SMALL_ROWS) -> str:
    """The hint for joins with a stored table of narrow rows, or with one of no more rows than it has.

    Spark goes by the size of the packed files and takes the rows an explode or
    a task makes of them for as few, so it would send tables to all executors
    that fit no driver.  Here the rows are counted.
    """
    return "broadcast" if rows.limit(bound + 1).count() <= bound else "merge"


def join_small(left: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", bound: int = SMALL_ROWS, salts: int = 32) -> DataFrame:
    """Join with a stored table of one row per key.

    Up to ``bound`` rows, which are counted, the table goes to all executors.
    Beyond, the rows of each key are dealt over ``salts`` copies of its entry,
    so that a key with a third of all rows is no single task either.
    """
    keys = list(keys)
    hint = way(small, bound)
    if hint == "broadcast":
        return left.join(F.broadcast(small), keys, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    return left.join(salted.hint(hint), [*keys, "__salt"], how).drop("__salt")


def source_key(column: str) -> Column:
    """A key that tells a null from every text."""
    return F.when(F.col(column).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(column)))


def fold(column: str, modulus: int) -> Column:
    """Remainder of the CRC-32 of an id written as text; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def read_bytes(path: str) -> bytes:
    with open(os.fspath(path), "rb") as file:
        return file.read()
