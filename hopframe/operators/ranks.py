"""Ranks over tables of any size: bounded best rows, sampled ranges, and the n-th row.

``best_rows`` keeps a few best rows per order in every task and merges them, so
a table is read once whatever the number of orders.  ``sampled_bounds`` cuts a
table into ranges of about even size from a sample of fixed size; counts per
range then say where any rank lies, and ``nth_row`` narrows a table to the one
range that holds it until few rows are left.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping, Sequence
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from hopframe.session import ship_helpers

# Sampled keys per range, and ranges at most: what the driver holds at once.
SAMPLE, MOST_RANGES = 16, 4096

# Rows that one task may order: state of a task in ``best_rows``, remainder in ``nth_row``.
FEW = 1000


def missing(df: DataFrame, column: str) -> Column:
    """1 for a null or not-a-number, else 0."""
    empty = F.col(column).isNull()
    if isinstance(df.schema[column].dataType, (DoubleType, FloatType)):
        empty = empty | F.isnan(column)
    return empty.cast("int")


def best_rows(df: DataFrame, orders: Mapping[str, tuple[int, Sequence[tuple[Column, bool]]]], by: Sequence[str] = ()) -> DataFrame:
    """The first n rows of several orders in one pass, with ``section`` (the order's name) and a 1-based ``rank``.

    An order is its n and its terms, each with whether it ascends; nulls come
    last in every term.  With ``by``, columns of few values such as runs, each
    combination has its own.  A task holds n rows per order and combination.
    """
    ship_helpers()
    terms = {f"__{name}_{i}": column for name, (_, order) in orders.items() for i, (column, _) in enumerate(order)}
    plan = [
        (name, n, [(f"__{name}_{i}", "ascending" if up else "descending") for i, (_, up) in enumerate(order)])
        for name, (n, order) in orders.items()
    ]
    keyed = df.withColumns(terms)
    schema = StructType([StructField(f.name, f.dataType) for f in keyed.schema.fields] + [StructField("section", StringType())])

    def pick(table, n, keys):
        return table.take(pc.select_k_unstable(table.select([k for k, _ in keys]), options=pc.SelectKOptions(n, keys))) if table.num_rows else table

    def groups(table):
        if not by:
            return [((), table)]
        keys = list(zip(*[table.column(c).to_pylist() for c in by], strict=True))
        places: dict = {}
        for i, key in enumerate(keys):
            places.setdefault(key, []).append(i)
        return [(key, table.take(pa.array(at))) for key, at in places.items()]

    def run(batches):
        held: dict = {}
        for batch in batches:
            for group, table in groups(pa.Table.from_batches([batch])):
                for name, n, keys in plan:
                    few, at = pick(table, n, keys), (name, group)
                    held[at] = pick(pa.concat_tables([held[at], few]), n, keys) if at in held else few
        for (name, _), table in held.items():
            yield from table.append_column("section", pa.array([name] * table.num_rows, pa.string())).to_batches()

    order, limit = [], F.lit(None).cast("int")
    for name, n, keys in plan:
        own = F.col("section") == name
        limit = F.when(own, n).otherwise(limit)
        for key, way in keys:
            term = F.when(own, F.col(key))
            order.append(term.asc_nulls_last() if way == "ascending" else term.desc_nulls_last())
    rank = F.row_number().over(Window.partitionBy("section", *by).orderBy(*order))
    return keyed.mapInArrow(run, schema).withColumn("rank", rank).where(F.col("rank") <= limit).drop(*terms)


def sampled_bounds(df: DataFrame, keys: Sequence[str], ranges: int, repeated: bool = False) -> list[tuple]:
    """At most ``ranges - 1`` ascending key tuples that part the rows about evenly.

    The sample are the keys of smallest hash: the same for every partitioning,
    and bounded by ``SAMPLE`` keys per range.  ``repeated`` keys are made
    distinct first, so that a common key does not fill the sample.
    """
    if ranges < 2:
        return []
    rows = df.select(*keys)
    sample = (rows.distinct() if repeated else rows).withColumn("__hash", F.xxhash64(*keys)).orderBy("__hash", *keys).limit(SAMPLE * ranges)
    found = [tuple(r) for r in sample.select(*keys).distinct().orderBy(*keys).collect()]
    step = max(1, len(found) // ranges)
    return found[step::step][: ranges - 1]


def range_of(df: DataFrame, keys: Sequence[str], bounds: Sequence[tuple]) -> Column:
    """The number of bounds at or below a row's keys, by binary search; nulls sort first."""
    if not bounds:
        return F.lit(0)
    kinds = [df.schema[k].dataType for k in keys]
    table = F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(row, kinds, strict=True))]) for row in bounds])
    own = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    steps = [1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= own, at + step).otherwise(at)
    )


def range_starts(df: DataFrame, place: Column, ranges: int) -> tuple[list[int], int]:
    """Rows before each range, and all rows; one count per range comes to the driver."""
    counts = {r["place"]: r["n"] for r in df.select(place.alias("place")).groupBy("place").agg(F.count("*").alias("n")).collect()}
    upto = [0, *accumulate(counts.get(i, 0) for i in range(ranges))]
    return upto[:-1], upto[-1]


def nth_row(df: DataFrame, keys: Sequence[str], n: int, ranges: int = 64) -> DataFrame:
    """The row at 0-based place ``n`` of the ascending order by ``keys``, or none.

    Every turn reads the keys of the rest for a sample and a count per range and
    goes on with the range that holds the row, until few rows or one key are left.
    """
    while True:
        bounds = sampled_bounds(df, keys, ranges, repeated=True)
        place = range_of(df, keys, bounds)
        starts, total = range_starts(df, place, len(bounds) + 1)
        if not 0 <= n < total:
            return df.limit(0)
        if not bounds:
            return df.limit(1)  # one key only
        if total <= FEW:
            return df.orderBy(*keys).offset(n).limit(1)
        at = bisect_right(starts, n) - 1
        df, n = df.where(place == at), n - starts[at]
