"""Supporting facts: lookup in the nested context, ordering, text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopframe.functions.text import seeded_key


def lookup_facts(refs: Column | str = "supporting_facts", context: Column | str = "context") -> Column:
    """Sentence of each (title, sent_id) reference, null where there is none.

    Where a title occurs twice in the context the later paragraph counts.  The
    arrays hold a handful of items per row, so the lookup stays inside the row.
    """
    refs = F.col(refs) if isinstance(refs, str) else refs
    context = F.col(context) if isinstance(context, str) else context
    return F.transform(
        refs,
        lambda ref: F.get(
            F.try_element_at(
                F.filter(context, lambda par: par["title"] == ref["title"]), F.lit(-1)
            )["sentences"],
            ref["sent_id"],
        ),
    )


def resolve_facts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``facts``; rows with a reference to nowhere become rejects.

    Rejects carry the 0-based number of the first bad reference.  The lookup
    leaves through a one-element explode: a boundary the optimizer does not
    copy the expression across, so every row is looked up once however often
    later columns and filters use its facts.
    """
    looked_up = df.withColumn("facts", F.explode(F.array(lookup_facts())))
    bad = F.exists("facts", lambda f: f.isNull())
    resolved = looked_up.where(~bad)
    numbered = F.transform("facts", lambda f, i: F.when(f.isNull(), i))
    rejects = looked_up.where(bad).withColumn("bad_ref", F.array_min(numbered)).drop("facts")
    return resolved, rejects


def resolve_facts_from_corpus(df: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Same result where the sentences are a table ``(id, title, sent_id, sentence)``.

    References are exploded, joined on the whole key and regrouped per row.
    Grouping is by row id, so no group is larger than one row's references.
    """
    refs = df.select("id", F.posexplode("supporting_facts").alias("ord", "ref")).select(
        "id", "ord", F.col("ref.title").alias("title"), F.col("ref.sent_id").alias("sent_id")
    )
    found = refs.join(corpus, ["id", "title", "sent_id"], "left")
    per_row = found.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "sentence"))).alias("hits")
    )
    joined = df.join(per_row, "id", "left").withColumn(
        "facts", F.coalesce(F.col("hits.sentence"), F.array().cast("array<string>"))
    ).drop("hits")
    bad = F.exists("facts", lambda f: f.isNull())
    numbered = F.transform("facts", lambda f, i: F.when(f.isNull(), i))
    rejects = joined.where(bad).withColumn("bad_ref", F.array_min(numbered)).drop("facts")
    return joined.where(~bad), rejects


def shuffle_facts(facts: Column | str, id_col: Column | str, seed: int) -> Column:
    """Facts of a row in an order that depends only on seed, id and position."""
    facts = F.col(facts) if isinstance(facts, str) else facts
    keyed = F.transform(
        facts, lambda f, i: F.struct(seeded_key(seed, id_col, i).alias("k"), i.alias("i"), f.alias("f"))
    )
    return F.transform(F.array_sort(keyed), lambda s: s["f"])


def facts_block(facts: Column | str, base: int) -> Column:
    """``Facts:`` and one numbered line per fact, each line closed by a newline."""
    facts = F.col(facts) if isinstance(facts, str) else facts
    lines = F.transform(
        facts,
        lambda f, i: F.concat(F.lit("Fact #"), (i + base).cast("string"), F.lit(": "), f, F.lit("\n")),
    )
    return F.concat(F.lit("Facts:\n"), F.array_join(lines, ""))


def context_block(facts: Column | str) -> Column:
    """Unnumbered facts in one line, every fact followed by a space."""
    facts = F.col(facts) if isinstance(facts, str) else facts
    return F.concat(
        F.lit("context: "), F.array_join(F.transform(facts, lambda f: F.concat(f, F.lit(" "))), "")
    )
