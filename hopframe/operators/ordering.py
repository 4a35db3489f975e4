"""Positions, exact splits, chunks, batches and ranked rows without global windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopframe.functions.text import seeded_key
from hopframe.operators import ranks
from hopframe.session import materialized

# Hex digits of a digest that form a bucket: 16**5 buckets of even size.
DIGEST_BUCKET = 5

# Digests a task keeps to find the last one drawn; for more, counts per bucket say where it is.
FEW_DRAWN = 5000

# Rows that an ordered limit may gather; more are cut by their index.
FEW_ROWS = 100_000


def head_n(df: DataFrame, n: int, order: str | list[str] = "pos") -> DataFrame:
    """First n rows in an order; a negative n means all.

    Many rows are not gathered: they are those whose row index is below n, and
    stay where they are.
    """
    order = [order] if isinstance(order, str) else order
    if n < 0:
        return df
    if n <= FEW_ROWS:
        return df.orderBy(*order).limit(n)
    return with_row_index(df, order, "__index").where(F.col("__index") < n).drop("__index")


def with_row_index(
    df: DataFrame,
    key: str | Sequence[str] = "pos",
    out: str = "row_index",
    ranges: int | None = None,
    total: str | None = None,
) -> DataFrame:
    """0-based rank of each row by its keys, of any type and spread, and the row count as ``total``.

    Bounds from a sample of the keys part the rows into ranges of about even
    size, a count per range gives where each starts, and rows are numbered
    inside their range: one shuffle, no join, and no window over the whole
    table.  The sample and the counts are taken at once (two narrow passes); the
    driver holds a bounded number of keys.  Nulls come first.  Rows that are
    equal in all keys are numbered in any order, in one task: name enough keys.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = ranks.sampled_bounds(df, keys, min(ranges, ranks.MOST_RANGES))
    place = ranks.range_of(df, keys, bounds)
    starts, rows = ranks.range_starts(df, place, len(bounds) + 1)
    inside = Window.partitionBy("__range").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    numbered = (
        df.withColumn("__range", place)
        .withColumn("__rank", F.row_number().over(inside))
        .withColumn(out, F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("__range")) + F.col("__rank") - 1)
        .drop("__range", "__rank")
    )
    return numbered.withColumn(total, F.lit(rows).cast("long")) if total else numbered


def _digest_cut(df: DataFrame, digest: Column, n: int) -> Column:
    """The n-th smallest digest as a scalar subquery.

    For a small n every task passes on its n smallest digests.  Otherwise counts per digest prefix find the bucket of the n-th row; only that bucket,
    about one millionth of the rows, is ordered.  Nothing is moved but counts.
    """
    if n <= FEW_DRAWN:
        least = df.select(digest.alias("digest")).orderBy("digest").limit(n)
        return least.agg(F.count(F.lit(1)).alias("n"), F.max("digest").alias("digest")).where(F.col("n") == n).select("digest").scalar()
    keyed = df.select(digest.alias("digest")).withColumn("bucket", F.substring("digest", 1, DIGEST_BUCKET))
    counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        counts.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .where((F.col("before") < n) & (F.col("before") + F.col("size") >= n))
        .select("bucket", (F.lit(n) - F.col("before")).alias("rank_in_bucket"))
    )
    in_bucket = Window.partitionBy("bucket").orderBy("digest")
    nth = (
        keyed.join(cut, "bucket")
        .withColumn("rank", F.row_number().over(in_bucket))
        .where(F.col("rank") == F.col("rank_in_bucket"))
        .agg(F.max("digest").alias("digest"))
    )
    return nth.scalar()


def drawn(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> Column:
    """Whether a row of ``df`` is among the n drawn by seed; ``key`` is unique.

    A comparison with one digest.  With fewer than n rows everything is drawn.
    """
    if n <= 0:
        return F.lit(False)
    digest = seeded_key(seed, key)
    return digest <= F.coalesce(_digest_cut(df, digest, n), F.lit("g"))  # 'g' sorts behind every digest


def split_exact(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """n rows drawn by seed, and the rest; both are plain filters, no row is moved."""
    chosen = drawn(df, n, seed, key)
    return df.where(chosen), df.where(~chosen)


def with_chunk(df: DataFrame, chunks: int = 15, key: str | Sequence[str] = "pos", keep_remainder: bool = False) -> DataFrame:
    """1-based chunk of equal size in key order.

    As the size is rounded down, up to ``size - 1`` rows are left at the end;
    they are dropped, or kept as one more chunk.
    """
    if chunks < 1:
        raise ValueError("chunks must be positive")
    sized = with_row_index(df, key, total="__total")
    size = F.floor(F.col("__total") / F.lit(chunks))
    checked = sized.withColumn(
        "__size",
        F.when(size > 0, size).otherwise(
            F.raise_error(F.lit("fewer rows than chunks")).cast("long")
        ),
    )
    out = checked.withColumn("chunk", (F.floor(F.col("row_index") / F.col("__size")) + 1).cast("int"))
    if not keep_remainder:
        out = out.where(F.col("chunk") <= F.floor(F.col("__total") / F.col("__size")))
    return out.drop("__size", "__total")


def with_batch(
    df: DataFrame, size: int, first: int = 0, key: str | Sequence[str] = "pos", keep_tail: bool = True
) -> DataFrame:
    """0-based batch of a fixed size; ``first`` resumes, a partial tail may be dropped."""
    out = with_row_index(df, key, total="__total")
    out = out.withColumn("batch_id", F.floor(F.col("row_index") / size))
    if first:
        out = out.where(F.col("batch_id") >= first)
    if not keep_tail:
        out = out.where(F.col("batch_id") < F.floor(F.col("__total") / F.lit(size)))
    return out.drop("__total")


def _orders(df: DataFrame, metric: str, key: str) -> tuple[list, list]:
    """The descending order of a metric and its reverse; rows without a metric are worst, ties go by key."""
    none, k = ranks.missing(df, metric), F.col(key)
    m = F.when(none == 0, F.col(metric))
    return [(none, True), (m, False), (k, True)], [(none, False), (m, True), (k, False)]


def extremes(
    df: DataFrame, metric: str = "f1_2", n: int = 5, seed: int = 0, key: str = "id", by: Sequence[str] = ()
) -> DataFrame:
    """Top n, bottom n and n random rows stacked, with section and rank, in one pass over ``df``.

    The bottom is ranked as the tail of the descending order.  With ``by`` every
    combination of those few-valued columns has its own rows.
    """
    down, up = _orders(df, metric, key)
    chance = [(seeded_key(seed, key), True), (F.col(key), True)]
    rows = ranks.best_rows(df, {"top": (n, down), "bottom": (n, up), "random": (n, chance)}, by)
    size = F.count(F.lit(1)).over(Window.partitionBy("section", *by))
    tail = F.when(F.col("section") == "bottom", size - F.col("rank") + 1).otherwise(F.col("rank"))
    return rows.withColumn("rank", tail.cast("int"))


def ranked_rows(df: DataFrame, metric: str, places: Sequence[int], key: str = "id") -> DataFrame:
    """The rows at 0-based places of the descending order, with ``place``; negative places count from the worst, -1.

    Places near either end come from one pass.  For places further inside, the
    rows are written once and each place is narrowed down by counts per range.
    """
    down, up = _orders(df, metric, key)
    near = [k for k in places if -ranks.FEW <= k < ranks.FEW]
    parts = []
    if near:
        sections = {"top": (max(near) + 1, down)} if max(near) >= 0 else {}
        if min(near) < 0:
            sections["bottom"] = (-min(near), up)
        place = F.when(F.col("section") == "top", F.col("rank") - 1).otherwise(-F.col("rank"))
        found = ranks.best_rows(df, sections).withColumn("place", place.cast("int"))
        parts.append(found.where(F.col("place").isin(*near)).drop("section", "rank"))
    if len(near) < len(places):
        none = ranks.missing(df, metric)
        terms = {"__none": none, "__minus": F.when(none == 0, -F.col(metric)), "__key": F.col(key)}
        rows = materialized(df.withColumns(terms), "ranked-rows")
        total = rows.count()
        for k in places:
            if k not in near:
                at = k if k >= 0 else total + k
                parts.append(ranks.nth_row(rows, ["__none", "__minus", "__key"], at).drop(*terms).withColumn("place", F.lit(k)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nth_ranked(df: DataFrame, metric: str, k: int, key: str = "id") -> DataFrame:
    """The row at 0-based rank k of the descending order; k = -1 is the worst row."""
    return ranked_rows(df, metric, [k], key).drop("place")
