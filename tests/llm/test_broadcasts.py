"""Joins send a table to all executors by its counted rows, not by what Spark takes an explode for."""

from pyspark.sql import functions as F

from hopframe.llm import resemblance, simhash
from hopframe.llm._store import join_small, stored, way


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_fingerprints_are_never_sent_whole(spark):
    prints = stored(spark.createDataFrame([(0,), (1,), (7,), (3 << 50,)], "fp long"), "prints")
    found = simhash.links(prints)
    assert "BroadcastHashJoin" not in _plan(found)
    assert {tuple(r) for r in found.distinct().collect()} == {
        (a, b) for a in (0, 1, 7, 3 << 50) for b in (0, 1, 7, 3 << 50) if a != b and bin(a ^ b).count("1") <= 2}


def test_a_dealt_table_is_not_sent_whole(spark):
    small = stored(spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "small")
    left = spark.range(200).select((F.col("id") % 60).alias("k"), "id")
    joined = join_small(left, small, ["k"], bound=10)
    assert way(small) == "broadcast" and way(small, 10) == "merge"
    assert "BroadcastHashJoin" not in _plan(joined)
    assert {tuple(r) for r in joined.collect()} == {(i % 60, i, i % 60 * 2 if i % 60 < 50 else None) for i in range(200)}
    semi = join_small(left, small.select("k"), ["k"], "left_semi", bound=10)
    assert "BroadcastHashJoin" not in _plan(semi) and semi.count() == sum(i % 60 < 50 for i in range(200))


def test_parts_are_found_whichever_way_the_joins_go(spark, monkeypatch):
    texts = [(str(i), f"one two three four five six seven eight nine word{i % 7} " * 3) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    parts = []
    for bound in (100, 1):
        for module in (simhash, resemblance):
            monkeypatch.setattr(module, "way", lambda rows, bound=bound: way(rows, bound))
        near = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
        alike = {tuple(r) for r in resemblance.similar_texts(docs, "doc_id").collect()}
        parts.append((near, alike))
    assert parts[0] == parts[1] and len(parts[0][0]) == len(parts[0][1]) == 40
