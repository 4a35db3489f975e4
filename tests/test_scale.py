"""Steps that cost one pass, a text's length or a narrow row where they cost more before."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from hopframe.functions import text as T
from hopframe.functions.sequence import overlap_batch
from hopframe.operators import analysis as an
from hopframe.operators import exemplars as exm
from hopframe.operators import facts as fa
from hopframe.operators import ordering as od
from hopframe.operators import sections as se
from hopframe.operators.examples import make_examples, with_token_counts
from hopframe.plans import builds, registry


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_histogram_reads_its_rows_once(spark):
    df = spark.createDataFrame(
        [("a", True, 1), ("a", True, 3), ("a", True, 3), ("a", True, None), ("a", False, 7), (None, True, 2)],
        "run_id string, correct boolean, num_prompt_tokens int")
    hist = an.context_hist(df, bins=2)
    got = {(r.run_id, r.correct, r.bin): (r.rows, r.lo, r.hi, round(r.mean_size, 6)) for r in hist.collect()}
    mean = round(7 / 3, 6)
    assert got == {("a", True, 1): (2, 1.0, 3.0, mean), ("a", True, 2): (2, 1.0, 3.0, mean), ("a", False, 1): (1, 7.0, 7.0, 7.0)}
    assert _plan(hist).count("LogicalRDD") == 1


def test_answers_of_long_texts_without_one_take_linear_time(spark):
    long = "an answer is given " + "word " * 40_000
    rows = spark.createDataFrame([(long,), ("so the answer is a. b. c\nthe answer is d.",)], "v string")
    rows.count()
    begin = time.monotonic()
    found = [r[0] for r in rows.select(T.extract_answer("v")).collect()]
    assert found == ["", "a. b"] and time.monotonic() - begin < 10


def test_lines_lose_blanks_of_any_kind(spark):
    row = spark.createDataFrame([(" a \x1f\n\n  b\tc  \n",)], "v string").select(T.strip_lines("v"), T.strip("v")).first()
    assert tuple(row) == ("a\n\nb\tc\n", "a \x1f\n\n  b\tc")


def test_ranked_rows_carry_no_texts(spark, sf):
    assert registry._keyed_scores(spark, sf).columns == ["key", "f1_2"]


def test_small_draws_count_no_buckets(spark):
    df = spark.range(500).select(F.concat(F.lit("q"), "id").alias("id"))
    few = {r.id for r in df.where(od.drawn(df, 20, 7)).collect()}
    order = [r.id for r in df.orderBy(T.seeded_key(7, "id")).collect()]
    assert few == set(order[:20])
    assert "bucket" not in _plan(df.where(od.drawn(df, 20, 7)))
    assert df.where(od.drawn(df, 501, 7)).count() == 500


def test_grid_counts_tokens_of_few_shot_prompts(spark, sf):
    ents, res = registry.D.entities(spark, sf), registry._resolved(spark, sf).limit(30)
    shots = builds.exemplar_table(res.limit(5), registry._grid(), entities=ents)
    built = builds.build_grid(res, registry._grid(), shots, True, 2, 42, ents)
    again = built.withColumn("p", T.token_count("prompt")).withColumn("t", T.token_count("target"))
    assert again.where("examplars").count() > 0
    assert again.where("NOT (num_prompt_tokens <=> p AND num_target_tokens <=> t AND num_tokens <=> p + t)").count() == 0


def test_overlap_equals_direct_counts():
    import random
    from collections import Counter

    import pandas as pd

    draw = random.Random(3)
    texts = [" ".join(draw.choices("abcd", k=draw.choice([0, 1, 2, 9]))) for _ in range(300)]
    left, right = pd.Series(texts), pd.Series(texts[::-1])
    got = overlap_batch(left, right, None, False)
    for one, other, row in zip(left, right, got.itertuples(index=False), strict=True):
        a, b = one.split(), other.split()
        pairs = (Counter(zip(a, a[1:])) & Counter(zip(b, b[1:]))).total()
        assert tuple(row) == (len(a), len(b), (Counter(a) & Counter(b)).total(), pairs, 0)


def test_runs_meet_in_one_grouping_by_question(spark):
    df = spark.createDataFrame(
        [("q1", "a", True), ("q1", "b", False), ("q2", "a", None), ("q2", "a", False), (None, "b", True), ("q3", "other", True)],
        "id string, run_id string, correct boolean")
    wide = an.runs_wide(df, ["a", "b"])
    got = {r["id"]: (r["a"], r["b"]) for r in wide.collect()}
    assert got == {"q1": (True, False), "q2": (False, None), None: (None, True), "q3": (None, None)}
    assert _plan(wide).count("Aggregate [") == 1


def test_drawn_exemplars_come_from_a_stored_pool(spark):
    rows = spark.range(40).select(F.concat(F.lit("r"), "id").alias("id"), F.lit("P").alias("prompt"), F.lit("T").alias("target"))
    pool = spark.range(9).select(F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lit("text"), "id").alias("text"))
    out = exm.with_exemplars(rows, pool, 2, False, 42)
    assert "Window" not in _plan(out)  # numbered once, not per joined exemplar
    assert out.count() == 40 and out.where(F.size(F.regexp_extract_all("prompt", F.lit(r"(text\d)"), 1)) == 2).count() == 40


def test_places_of_sections_are_sought_once(spark):
    df = spark.createDataFrame([("Examples:\na\nFacts:\nb\nQuestion: c",), ("Question: only",)], "prompt string")
    out = se.prompt_sections(df)
    assert [tuple(r)[1:4] for r in out.collect()] == [("Examples:\na", "Facts:\nb", "Question: c"), ("", "", "Question: only")]
    assert _plan(out.withColumn("more", F.rand())).count("locate(") == 3


def test_first_batch_of_a_stream_joins_no_earlier_keys(spark, tmp_path):
    from hopframe.streaming.scores import KeyStore

    rows = spark.createDataFrame([("x", "0"), ("x", "1"), ("y", "0")], "run_id string, id string")
    store = KeyStore(spark, f"{tmp_path}/keys", 3, 5)
    assert "Join" not in _plan(store.unseen(rows, 0))
    store.remember(rows.where("id = '0'"), 0)
    later = store.unseen(rows, 1)
    assert [tuple(r) for r in later.collect()] == [("x", "1")] and "bucket" not in later.columns


def test_evaluate_run_makes_its_responses_once(spark, sf):
    assert "Generate" not in _plan(registry.evaluate_run(spark, sf))


def test_forms_of_a_question_leave_from_one_pass(spark, sf):
    out = registry.hotpot_examples(spark, sf)
    # the questions are resolved once and their texts measured by bytes in one Arrow pass
    assert _plan(out).count("element_at(filter(") == 1 and _plan(out).count("ArrowEvalPython") == 1
    raw = fa.resolve_facts(registry.D.hotpot(spark, sf))[0]
    for form, kw in (("self_ask", {"entities": registry.D.entities(spark, sf)}), ("direct", {})):
        apart = make_examples(raw, "hotpot", form, counter=T.token_count, **kw)  # by regular expression
        cols = [c for c in out.columns if c != "form"]
        some = out.where(F.col("form") == form).select(cols)
        assert some.exceptAll(apart.select(cols)).isEmpty() and some.count() == apart.count()


def test_texts_measured_by_bytes_equal_patterns(spark):
    texts = ["", None, "a b\nc.", " a", "a \nb", "a\n\tb", "a\r\nb", "\n", "a\x1f", "a \x1cb c", "x\x00\x7fy", "n\u00e9e 1\u00bd", "\u2003z", "_a-1_", " ", "a\n ", "\U0001f600"]
    rows = [(str(i), q, a) for i, (q, a) in enumerate(zip(texts, reversed(texts), strict=True))] * 2
    raw = spark.createDataFrame([(i, q, [a or "", "  f\u00e9 "], a) for i, q, a in rows], "id string, question string, facts array<string>, answer string")
    for forms in ("direct", ("direct", "squad")):
        fast, slow = (make_examples(raw.repartition(2), "strategyqa", forms, counter=c) for c in (None, T.token_count))
        assert fast.schema == slow.schema
        key = [str(tuple(r)) for r in slow.collect()]
        assert sorted(str(tuple(r)) for r in fast.collect()) == sorted(key) and len(key) == len(rows) * (1 if forms == "direct" else 2)
    pairs = spark.createDataFrame(rows, "id string, prompt string, target string")
    counted = with_token_counts(pairs).collect()
    assert [tuple(r) for r in counted] == [tuple(r) for r in with_token_counts(pairs, T.token_count).collect()]
    assert with_token_counts(pairs).select("num_tokens").count() == len(rows)
    assert with_token_counts(pairs.where("false")).collect() == []


def test_measures_of_sliced_batches_equal_brute_force():
    import random
    import re

    import pyarrow as pa

    from hopframe.functions.tokens import measure

    draw = random.Random(4)
    for _ in range(200):
        chars = "ab1 \n\t\r._\x00" + ("\u00e9\x1d" if draw.random() < 0.3 else "")
        texts = [None if draw.random() < 0.1 else "".join(draw.choices(chars, k=draw.choice([0, 1, 2, 9]))) for _ in range(draw.choice([0, 1, 30]))]
        want = [
            {"tokens": None, "bare": None} if t is None or re.search(r"[^\x00-\x7f]|\x1d", t) else
            {"tokens": len(re.findall(r"[a-z0-9]+|[^\sa-z0-9]", t)), "bare": all(x == x.strip(" \t\r") for x in t.split("\n"))}
            for t in texts
        ]
        assert measure(pa.array(texts, pa.string())).to_pylist() == want
        assert measure(pa.array(texts, pa.large_string()).slice(len(texts) // 3)).to_pylist() == want[len(texts) // 3 :]
