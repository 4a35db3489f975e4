"""Rationales: entity types, sub-questions and chain-of-thought sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentence per relation; EVIDENCE_0 subject, _1 relation, _2 object.
THOUGHT_TEMPLATES = {
    "director": "EVIDENCE_2 directed EVIDENCE_0",
    "country of citizenship": "EVIDENCE_0 is a EVIDENCE_2 citizen",
    "date of birth": "EVIDENCE_0 was born on EVIDENCE_2",
    "father": "EVIDENCE_2 is the EVIDENCE_1 of EVIDENCE_0",
    "composer": "EVIDENCE_2 composed EVIDENCE_0",
    "publication date": "EVIDENCE_0 was published in EVIDENCE_2",
    "place of birth": "EVIDENCE_0 was born in EVIDENCE_2",
    "country": "EVIDENCE_0 is in EVIDENCE_2",
    "country of origin": "EVIDENCE_0 is from EVIDENCE_2",
    "performer": "EVIDENCE_2 performed EVIDENCE_0",
    "place of burial": "EVIDENCE_0 is buried in EVIDENCE_2",
    "spouse": "EVIDENCE_0 is married to EVIDENCE_2",
    "date of death": "EVIDENCE_0 died in EVIDENCE_2",
    "founded by": "EVIDENCE_2 founded EVIDENCE_0",
    "cause of death": "EVIDENCE_0 died from a EVIDENCE_2",
    "mother": "EVIDENCE_2 is the EVIDENCE_1 of EVIDENCE_0",
    "place of death": "EVIDENCE_0 died in EVIDENCE_2",
    "sibling": "EVIDENCE_0 and EVIDENCE_2 are siblings",
    "educated at": "EVIDENCE_0 attended the EVIDENCE_2",
    "publisher": "EVIDENCE_2 was the publisher of EVIDENCE_0",
    "employer": "EVIDENCE_0 is employed by EVIDENCE_2",
    "child": "EVIDENCE_2 is EVIDENCE_0's child",
    "award received": "EVIDENCE_0 received the EVIDENCE_2 award",
    "inception": "EVIDENCE_0 started in EVIDENCE_2",
    "place of detention": "EVIDENCE_0 was detained in the EVIDENCE_2",
    "occupation": "EVIDENCE_0 worked as a EVIDENCE_2",
    "editor": "EVIDENCE_2 was the editor of EVIDENCE_0",
    "producer": "EVIDENCE_2 produced EVIDENCE_0",
    "creator": "EVIDENCE_2 created EVIDENCE_0",
    "presenter": "EVIDENCE_2 presented EVIDENCE_0",
    "student of": "EVIDENCE_0 was the student of EVIDENCE_2",
    "has part": "EVIDENCE_2 was part of EVIDENCE_0",
    "doctoral advisor": "EVIDENCE_2 was the doctoral advisor of EVIDENCE_0",
    "manufacturer": "EVIDENCE_2 manufactured of EVIDENCE_0",
}

# Question word per entity type; any other type asks 'What'.
QUESTION_WORDS = {"PERSON": "Who", "DATE": "When"}
UNKNOWN_TYPE = "PERSON"

# What the default classifier takes for a date and for a plain number.
DATE_PATTERN = (
    r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2} (?:January|February|March|April|May|June|July|August|"
    r"September|October|November|December),? \d{4}|(?:January|February|March|April|May|June|"
    r"July|August|September|October|November|December) \d{1,2},? \d{4}|(?:1\d|20)\d{2})$"
)
NUMBER_PATTERN = r"^[-+]?\d[\d,]*(?:\.\d+)?$"

# An entity table up to this size travels with the plan as one map; a larger one is joined.
MAP_LIMIT = 500

# Copies of a joined entity among which the rows that name it are dealt.
SALTS = 16


def default_entity_type(name: Column) -> Column:
    """Type of a name by its form alone; null where the form says nothing."""
    return F.when(name.rlike(DATE_PATTERN), F.lit("DATE")).when(
        name.rlike(NUMBER_PATTERN), F.lit("CARDINAL")
    )


def _classify(name: Column, listed: Column | None, classifier: Callable[[Column], Column]) -> Column:
    options = ([listed] if listed is not None else []) + [classifier(name), F.lit(UNKNOWN_TYPE)]
    return F.coalesce(*options)


def with_entity_types(
    df: DataFrame,
    names: Column,
    out: str,
    entities: DataFrame | None = None,
    classifier: Callable[[Column], Column] = default_entity_type,
    map_limit: int = MAP_LIMIT,
) -> DataFrame:
    """Add ``out``: the entity type of every element of the array ``names``.

    ``entities(name, type)`` lists known names and wins over the classifier.  A
    table of at most ``map_limit`` rows is looked up inside the row.  A larger
    one is joined with the names of each distinct array, dealt over copies of
    its entries so that a frequent name is no single task, and the types come
    back by the array, which alone decides them.  Both ways give the same: a
    null name has the unknown type, a null array stays null, and rows that
    share an id keep their own types.
    """
    if entities is None:
        return df.withColumn(out, F.transform(names, lambda x: _classify(x, None, classifier)))
    listed = entities.where(F.col("name").isNotNull()).groupBy("name").agg(F.min("type").alias("type"))
    if listed.limit(map_limit + 1).count() <= map_limit:
        table = listed.agg(F.map_from_entries(F.collect_list(F.struct("name", "type")))).scalar()
        return (
            df.withColumn("__entities", table)
            .withColumn(
                out,
                F.transform(
                    names, lambda x: _classify(x, F.try_element_at("__entities", x), classifier)
                ),
            )
            .drop("__entities")
        )
    copies = listed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    typed = (
        df.select(names.alias("__names")).distinct()
        .select("__names", F.pmod(F.xxhash64("__names"), F.lit(SALTS)).cast("int").alias("__salt"),
                F.posexplode("__names").alias("ord", "name"))
        .join(copies, ["name", "__salt"], "left")
        .groupBy("__names")
        .agg(F.array_sort(F.collect_list(
            F.struct("ord", _classify(F.col("name"), F.col("type"), classifier).alias("type")))).alias("hits"))
        .select("__names", F.col("hits.type").alias("__found"))
    )
    found = F.when(F.col("__names").isNotNull(), F.coalesce("__found", F.array().cast("array<string>")))
    return (
        df.withColumn("__names", names).join(typed, "__names", "left")
        .withColumn(out, found).drop("__names", "__found")
    )


def question_word(entity_type: Column) -> Column:
    word = F
    for kind, text in QUESTION_WORDS.items():
        word = word.when(entity_type == kind, F.lit(text))
    return word.otherwise(F.lit("What"))


def triple_questions(evidences: Column | str, types: Column | str) -> Column:
    """One (question, answer) per evidence triple."""
    evidences = F.col(evidences) if isinstance(evidences, str) else evidences
    types = F.col(types) if isinstance(types, str) else types
    return F.zip_with(
        evidences,
        types,
        lambda e, t: F.struct(
            F.concat(
                question_word(t), F.lit(" is the "), e["relation"], F.lit(" of "), e["subject"], F.lit("?")
            ).alias("question"),
            e["object"].alias("answer"),
        ),
    )


def title_questions(refs: Column | str, facts: Column | str, types: Column | str) -> Column:
    """One (question, answer) per supporting fact: the title is asked, the sentence answers."""
    refs = F.col(refs) if isinstance(refs, str) else refs
    facts = F.col(facts) if isinstance(facts, str) else facts
    types = F.col(types) if isinstance(types, str) else types
    asked = F.zip_with(
        refs, types, lambda r, t: F.concat(question_word(t), F.lit(" is "), r["title"], F.lit("?"))
    )
    return F.zip_with(asked, facts, lambda q, f: F.struct(q.alias("question"), f.alias("answer")))


def sub_questions(
    df: DataFrame,
    source: str = "wiki",
    entities: DataFrame | None = None,
    classifier: Callable[[Column], Column] = default_entity_type,
    map_limit: int = MAP_LIMIT,
) -> DataFrame:
    """Add ``sub_questions``; ``source`` is 'wiki' (triples) or 'hotpot' (titles)."""
    if source == "wiki":
        names, build = F.col("evidences.object"), lambda: triple_questions("evidences", "__types")
    elif source == "hotpot":
        names = F.col("supporting_facts.title")
        build = lambda: title_questions("supporting_facts", "facts", "__types")
    else:
        raise ValueError(f"no sub-questions for source {source!r}")
    typed = with_entity_types(df, names, "__types", entities, classifier, map_limit)
    return typed.withColumn("sub_questions", build()).drop("__types")


def thoughts(evidences: Column | str = "evidences", templates: dict[str, str] | None = None) -> Column:
    """One sentence per triple, by relation; unlisted relations get the general one."""
    evidences = F.col(evidences) if isinstance(evidences, str) else evidences
    quoted = ['"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
              for pair in (templates or THOUGHT_TEMPLATES).items() for x in pair]
    lookup = F.expr(f"map({', '.join(quoted)})")

    def sentence(e: Column) -> Column:
        text = F.try_element_at(lookup, e["relation"])
        for token, field in (("EVIDENCE_0", "subject"), ("EVIDENCE_1", "relation"), ("EVIDENCE_2", "object")):
            text = F.replace(text, F.lit(token), e[field])
        general = F.concat(e["object"], F.lit(" is the "), e["relation"], F.lit(" of "), e["subject"])
        return F.coalesce(text, general)

    return F.transform(evidences, sentence)
