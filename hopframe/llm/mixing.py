"""Mixing sources to target weights by nested hash thresholds.

Every document has a 60-bit hash.  A source whose target is q times its size
and a rest takes each document q times, and once more those whose hash lies
below a threshold.  The threshold is found without sorting: sizes are summed
by source and the first 12 bits, the bucket in which the sum crosses the rest
is refined by the next 12 bits, and so on for five levels.  Only sums move.

A document whose inclusion brings the source nearer to its target is taken.
Where the threshold falls among documents of one hash (equal id and text), it
goes on inside them by the place of their rows in a stored table: counts by
file find the file, and only that file's rows are numbered.  Null and
empty texts have size 0, a null source is a source of its own and comes last,
an empty table gives an empty result.  A source of total size 0 has target 0.
The table of sources is taken as small; it is pre-aggregated and its size is
counted before it goes to all executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopframe.llm._store import join_small, scratch, source_key, stored

WEIGHTS = (5, 2, 1)
MOST = 3
BITS, LEVELS = 12, 5


def word_count(text: str = "text") -> Column:
    """Words parted by blanks and the controls 9 to 13; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw_hash(key: str = "doc_id", text: str = "text") -> Column:
    """60 bits of a digest of id and text."""
    body = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(body), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Target of each source from rows (source, key, source_size).

    Weights repeat in code-point order of the sources.  Shares above ``most``
    times a source are cut and reshared: sources are ordered by cap per
    weight, and the level of the others follows from the sums up to there.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    by_level = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        weighed.withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_level), F.lit(0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(by_level), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("used")))
        .withColumn("settled", F.col("level") <= F.col("ratio"))
    )
    final = levels.withColumn("level", F.min(F.when(F.col("settled"), F.struct("ratio", "rank", "level"))).over(whole)["level"])
    return final.select(
        "key", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target")
    )


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source: whole copies of each document, the hash below which one more is taken, and of how many at that hash (spare).

    ``sized`` is a stored table (key, size, h).
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    state = stored(
        wanted.withColumn("copies", copies)
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
        .select("key", "source_size", "target", "copies", "rest", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("below")),
        "mix-targets",
    )
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = sized if level == 0 else join_small(sized, state.select("key", "low"), ["key"], "inner").where(
            F.shiftright("h", shift + BITS) == F.shiftright("low", shift + BITS)
        )
        sums = inside.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
        run = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        crossed = (
            sums.withColumn("upto", F.sum("s").over(run))
            .join(state.select("key", "rest", "below"), "key")
            .withColumn("before", F.col("below") + F.col("upto") - F.col("s"))
        )
        last = level == LEVELS - 1
        # The last level decides a hash by the nearer sum; the others find the first bucket that may be cut in two.
        each = F.col("s") / F.col("n")
        nearer = F.col("before") * 2 + (F.col("n") * 2 - 1) * each <= F.col("rest") * 2
        goes_in = nearer if last else F.col("before") + F.col("s") <= F.col("rest")
        some = F.floor((F.try_divide((F.col("rest") - F.col("before")) * 2, each) + 1) / 2)
        spare = F.least(F.greatest(F.coalesce(some, F.lit(0)), F.lit(0)), F.col("n") - 1).cast("long").alias("spare")
        edge = crossed.groupBy("key").agg(
            F.min(F.when(~goes_in, F.struct("bucket", "before", spare))).alias("cut"), F.max("bucket").alias("top")
        )
        state = stored(
            state.drop("low", "below").join(edge, "key", "left").select(
                *[c for c in state.columns if c not in ("low", "below")],
                F.coalesce(F.shiftleft(F.coalesce(F.col("cut.bucket"), F.col("top") + (1 if last else 0)), shift), F.lit(0)).alias("low"),
                F.coalesce(F.col("cut.before"), F.lit(0)).cast("long").alias("below"),
                F.coalesce(F.col("cut.spare"), F.lit(0)).cast("long").alias("spare"),
            ) if last else _descend(state, edge, crossed, shift),
            f"mix-level-{level}",
        )
    return state


def _descend(state: DataFrame, edge: DataFrame, crossed: DataFrame, shift: int) -> DataFrame:
    """The bucket to refine: the one that crosses the rest, or the last where all fit."""
    last = crossed.groupBy("key").agg(F.max(F.struct("bucket", "before")).alias("final"))
    chosen = F.when(F.col("cut").isNotNull(), F.struct("cut.bucket", "cut.before")).otherwise(F.col("final"))
    return state.drop("low", "below").join(edge.join(last, "key"), "key", "left").select(
        *[c for c in state.columns if c not in ("low", "below")],
        F.coalesce(F.shiftleft(chosen["bucket"], shift), F.lit(0)).alias("low"),
        F.coalesce(chosen["before"], F.lit(0)).cast("long").alias("below"),
    )


def plan_mix(docs: DataFrame, key: str = "doc_id", weights=WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The sized documents (id, key, size, h) and the thresholds of their sources, both stored."""
    sized = stored(
        docs.select(key, "source", source_key("source").alias("key"), word_count().alias("size"), draw_hash(key).alias("h")), "mix-sizes"
    )
    sizes = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    return sized.drop("source"), thresholds(sized, targets(sizes, weights, most))


def with_place(table: DataFrame) -> DataFrame:
    """A stored table with the file and the number of each row, which stay the same when a task is run again."""
    return table.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def last_places(placed: DataFrame, state: DataFrame) -> DataFrame:
    """Per source with spare rows: the place of the last row at the threshold's hash that is taken.

    ``placed`` has key, h, __file and __row.  Files are counted; the rows of one file are numbered.
    """
    edge = join_small(
        placed.select("key", "h", "__file", "__row"), state.where("spare > 0").select("key", "low", "spare"), ["key"], "inner"
    ).where("h = low")
    upto = Window.partitionBy("key").orderBy("__file").rowsBetween(Window.unboundedPreceding, 0)
    files = edge.groupBy("key", "spare", "__file").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(upto))
    chosen = files.where("upto - n < spare AND spare <= upto").select("key", "__file", (F.col("spare") - F.col("upto") + F.col("n")).alias("nth"))
    numbered = edge.join(chosen, ["key", "__file"]).withColumn("no", F.row_number().over(Window.partitionBy("key").orderBy("__row")))
    return numbered.where("no = nth").select("key", F.col("__file").alias("last_file"), F.col("__row").alias("last_row"))


def _not_after(file: str, row: str, last_file: str, last_row: str) -> Column:
    return (F.col(file) < F.col(last_file)) | ((F.col(file) == F.col(last_file)) & (F.col(row) <= F.col(last_row)))


def take_count() -> Column:
    """Copies of a row, and one more below the threshold or, at it, up to the last place."""
    at_edge = F.coalesce((F.col("h") == F.col("low")) & _not_after("__file", "__row", "last_file", "last_row"), F.lit(False))
    return F.col("copies") + ((F.col("h") < F.col("low")) | at_edge).cast("int")


def mix_table(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """How often each document is taken, with its size and the source's figures."""
    sized, state = plan_mix(docs, key)
    placed = with_place(sized)
    whole = stored(state.join(last_places(placed, state), "key", "left"), "mix-places")
    return join_small(placed, whole, ["key"], "inner").select(
        key, "size", "source_size", "target", take_count().alias("times"), (take_count() * F.col("size")).cast("long").alias("taken")
    )


def mix(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mixed corpus: each document as often as it is taken, decided in its own row.

    Rows at the hash of a threshold that falls among them are stored first, as their places decide.
    """
    names = {"key": "__mix_key", "h": "__mix_hash", "low": "__mix_low", "copies": "__mix_copies", "spare": "__mix_spare"}
    marked = docs.withColumns({"__mix_key": source_key("source"), "__mix_hash": draw_hash(key)})
    with scratch(docs.sparkSession) as keep:
        state = keep(plan_mix(docs, key)[1], "mix-thresholds")
        found = state.select(*[F.col(old).alias(new) for old, new in names.items() if old != "h"])
        joined = join_small(marked, found, ["__mix_key"], "inner")
        divided = (F.col("__mix_spare") > 0) & (F.col("__mix_hash") == F.col("__mix_low"))
        taken = joined.where(~divided).withColumn("__mix_times", F.col("__mix_copies") + (F.col("__mix_hash") < F.col("__mix_low")).cast("int"))
        if not state.where("spare > 0").isEmpty():
            edge = keep(joined.where(divided), "mix-edge")
            placed = edge.select("*", F.col("_metadata.file_name").alias("__mix_file"), F.col("_metadata.row_index").alias("__mix_row"))
            places = placed.select(*[F.col(new).alias(old) for old, new in {**names, "__file": "__mix_file", "__row": "__mix_row"}.items()])
            last = keep(last_places(places, state), "mix-places").toDF("__mix_key", "__mix_last_file", "__mix_last_row")
            inside = _not_after("__mix_file", "__mix_row", "__mix_last_file", "__mix_last_row")
            more = join_small(placed, last, ["__mix_key"], "inner").withColumn("__mix_times", F.col("__mix_copies") + inside.cast("int"))
            taken = taken.unionByName(more.select(*taken.columns))
    times = F.col("__mix_times")
    return taken.withColumn("__mix_copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array()))).select(*docs.columns)
