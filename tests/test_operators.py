import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hopframe.functions.sequence import lcs_length
from hopframe.operators import analysis as an
from hopframe.operators import evaluate as ev
from hopframe.operators import exemplars as exm
from hopframe.operators import facts as fa
from hopframe.operators import filters as fl
from hopframe.operators import ordering as od
from hopframe.operators import overlap as ov
from hopframe.operators import rationale as ra
from hopframe.operators import sections as se
from hopframe.operators.attention import phrase_window
from hopframe.operators.examples import make_examples
from hopframe.operators.pack import pack
from hopframe.plans import builds, derived, grid


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rouge_bounds_and_identity(spark):
    rows = [("a", "the cats sat", "the cats sat"), ("b", "one two", ""), ("c", "running dogs run", "run dog"),
            ("d", "a b c d", "d c b a")]
    got = {r.id: r for r in ev.rouge(spark.createDataFrame(rows, "id string, target string, response string")).collect()}
    assert all(0 <= getattr(r, m) <= 1 for r in got.values() for m in ev.METRICS)
    assert all(getattr(got["a"], m) == 1 for m in ev.METRICS)
    assert all(getattr(got["b"], m) == 0 for m in ev.METRICS)
    assert got["c"].rouge_1 == pytest.approx(2 / 3) and got["c"].bleu_1 == 1
    assert got["c"].rouge_l == pytest.approx(2 / 3)  # dog run / run dog share one in order, run dog stems to 'run dog'
    assert got["d"].rouge_1 == 1 and got["d"].rouge_l == 0.25 and got["d"].rouge_2 == 0


def test_resolve_facts_last_title_wins_and_rejects(spark):
    schema = (
        "id string, supporting_facts array<struct<title:string,sent_id:int>>, "
        "context array<struct<title:string,sentences:array<string>>>"
    )
    ctx = [("A", ["old"]), ("A", ["new", "more"])]
    df = spark.createDataFrame(
        [("ok", [("A", 0), ("A", 1)], ctx), ("far", [("A", 0), ("A", 9)], ctx), ("gone", [("B", 0)], ctx)], schema)
    good, bad = fa.resolve_facts(df)
    assert [r.facts for r in good.collect()] == [["new", "more"]]
    assert {r.id: r.bad_ref for r in bad.collect()} == {"far": 1, "gone": 0}


def test_entity_types_join_equals_map(spark, sf):
    qa, _ = fa.resolve_facts(derived.wiki(spark, sf))
    ents = derived.entities(spark, sf)
    small = ra.sub_questions(qa, "wiki", ents).select("id", F.to_json("sub_questions").alias("q"))
    large = ra.sub_questions(qa, "wiki", ents, map_limit=0).select("id", F.to_json("sub_questions").alias("q"))
    assert small.exceptAll(large).count() == 0 and large.count() == small.count()


def test_entity_types_of_nulls_and_repeated_ids(spark):
    rows = [("1", ["a", None]), ("1", ["2020-01-01"]), ("2", None), ("3", []), ("1", ["a", None])]
    df = spark.createDataFrame(rows, "id string, names array<string>")
    ents = spark.createDataFrame([("a", "ORG"), (None, "LOC")], "name string, type string")
    for limit in (0, 500):
        got = ra.with_entity_types(df, F.col("names"), "types", ents, map_limit=limit)
        assert got.columns == ["id", "names", "types"]
        assert sorted((r.id, str(r.types)) for r in got.collect()) == [
            ("1", "['DATE']"), ("1", "['ORG', 'PERSON']"), ("1", "['ORG', 'PERSON']"), ("2", "None"), ("3", "[]")]


def test_split_is_an_exact_partition(spark):
    df = spark.range(5000).selectExpr("cast(id AS string) AS id")
    head, rest = od.split_exact(df, 777, 1)
    assert head.count() == 777 and rest.count() == 4223
    assert head.join(rest, "id").count() == 0
    again, _ = od.split_exact(df.repartition(7), 777, 1)
    assert again.exceptAll(head).count() == 0
    assert od.split_exact(df, 6000, 1)[0].count() == 5000
    assert od.split_exact(df, 0, 1)[0].count() == 0
    assert "Exchange" not in _plan(rest).split("Subquery")[0]


def test_row_index_over_sparse_keys(spark):
    df = spark.range(1000).selectExpr("id * id * 977 - 5000 AS pos")
    got = [r.row_index for r in od.with_row_index(df, ranges=9).orderBy("pos").collect()]
    assert got == list(range(1000))


@pytest.mark.parametrize("ranges", [1, 2, 37])
def test_row_index_by_any_key(spark, ranges):
    df = spark.range(700).selectExpr(
        "IF(id % 3 = 0, NULL, md5(string(id % 200))) AS a", "IF(id % 5 = 0, double('nan'), id / 7.0) AS b", "id", "timestamp_seconds(id % 50) AS t", "'x' AS row_index")
    for keys in (["a", "b", "id"], ["t", "id"], ["b", "a", "id"], ["id"]):
        numbered = od.with_row_index(df, keys, out="at", ranges=ranges, total="all")
        rows = numbered.orderBy("at").select("id", "at", "all").collect()
        want = [r.id for r in df.orderBy(*keys).select("id").collect()]
        assert [r.id for r in rows] == want and [r["at"] for r in rows] == list(range(700)) and {r["all"] for r in rows} == {700}
    plan = _plan(numbered)
    assert ranges == 1 or plan.count("hashpartitioning(__range") == plan.count("Exchange ") == 1 and "SinglePartition" not in plan and "Join" not in plan


def test_row_index_of_odd_tables(spark):
    assert od.with_row_index(spark.range(0).withColumnRenamed("id", "pos")).count() == 0
    same = spark.range(60).selectExpr("1 AS pos")
    assert sorted(r.row_index for r in od.with_row_index(same, ranges=7).collect()) == list(range(60))
    nulls = spark.range(5).selectExpr("CAST(NULL AS string) AS pos", "id")
    assert sorted(r.row_index for r in od.with_row_index(nulls, ranges=3).collect()) == list(range(5))


def test_head_of_many_rows_is_a_filter(spark, monkeypatch):
    monkeypatch.setattr(od, "FEW_ROWS", 10)
    df = spark.range(500).selectExpr("id", "md5(string(id)) AS k")
    got = sorted(r.id for r in od.head_n(df, 123, ["k"]).collect())
    assert got == sorted(r.id for r in df.orderBy("k").limit(123).collect())
    assert od.head_n(df, 900, "k").count() == 500


def _ranked(rows):
    """The descending order: rows without a metric last, ties by key."""
    bad = lambda m: m is None or m != m
    return [r[0] for r in sorted(rows, key=lambda r: (bad(r[1]), 0 if bad(r[1]) else -r[1], r[0]))]


@pytest.fixture(scope="module")
def metric_rows():
    return [(f"k{i:04d}", None if i % 41 == 0 else float("nan") if i % 43 == 0 else float(i * 7919 % 60) / 4) for i in range(900)]


def test_extremes_in_one_pass(spark, metric_rows):
    df = spark.createDataFrame([(*r, "t") for r in metric_rows], "id string, f1_2 double, text string").repartition(7)
    got = od.extremes(df, n=6)
    by = {s: [r.id for r in got.where(F.col("section") == s).orderBy("rank").collect()] for s in ("top", "bottom", "random")}
    order = _ranked(metric_rows)
    assert by["top"] == order[:6] and by["bottom"] == order[-6:] and len(set(by["random"])) == 6
    assert _plan(got).split("== Initial Plan ==")[0].count("Scan") == 1
    parted = od.extremes(df.withColumn("run", F.length("id") + F.ascii(F.substring("id", 5, 1)) % 3), n=4, by=["run"])
    for run in range(5, 8):
        mine = _ranked([r for r in metric_rows if 5 + ord(r[0][4]) % 3 == run])
        of = {s: [r.id for r in parted.where((F.col("section") == s) & (F.col("run") == run)).orderBy("rank").collect()] for s in ("top", "bottom")}
        assert of == {"top": mine[:4], "bottom": mine[-4:]}
    few = od.extremes(df.limit(3), n=6)
    assert few.where("section = 'bottom'").agg(F.max("rank")).first()[0] == 3 and few.count() == 9
    assert od.extremes(df.limit(0)).count() == 0


def test_places_near_the_ends_and_inside(spark, metric_rows, monkeypatch):
    from hopframe.operators import ranks

    df = spark.createDataFrame(metric_rows, "id string, f1_2 double").repartition(5)
    order = _ranked(metric_rows)
    places = [0, 15, -1, -3, 400, 899, 900, -900, -901]
    want = {k: order[k] for k in places if -900 <= k < 900}
    assert {r.place: r.id for r in od.ranked_rows(df, "f1_2", places).collect()} == want
    monkeypatch.setattr(ranks, "FEW", 5)
    assert {r.place: r.id for r in od.ranked_rows(df, "f1_2", places).collect()} == want
    assert od.nth_ranked(df, "f1_2", 450).first().id == order[450]
    hot = spark.range(3000).selectExpr("string(id) AS id", "IF(id % 3 = 0, 0.5, id / 3000.0) AS f1_2")
    best = _ranked([(r.id, r.f1_2) for r in hot.collect()])
    assert {r.place: r.id for r in od.ranked_rows(hot, "f1_2", [1500, 1700, -2999]).collect()} == {1500: best[1500], 1700: best[1700], -2999: best[1]}


def test_chunks_and_batches(spark):
    df = spark.range(103).withColumnRenamed("id", "pos")
    dropped = od.with_chunk(df, 10)
    assert dropped.count() == 100 and dropped.agg(F.max("chunk")).first()[0] == 10
    assert od.with_chunk(df, 10, keep_remainder=True).count() == 103
    assert od.with_batch(df, 25, 2).count() == 53
    assert od.with_batch(df, 25, 2, keep_tail=False).count() == 50
    with pytest.raises(Exception, match="fewer rows than chunks"):
        od.with_chunk(spark.range(3).withColumnRenamed("id", "pos"), 15).count()


def test_dedup_survives_a_hot_prompt(spark):
    df = spark.range(3000).selectExpr("id AS pos", "IF(id % 3 = 0, 'same', concat('p', id)) AS prompt")
    kept, rejects = fl.dedup_prompts(df)
    assert kept.count() == 2001 and rejects.count() == 999
    assert kept.where("prompt = 'same'").first().pos == 0
    assert fl.dedup_prompts(kept)[1].count() == 0


def test_verify_modes(spark):
    df = spark.createDataFrame(
        [("1", "Paris is big", "paris"), ("2", "x", "no"), ("3", "x", "No"), ("4", "x", "So the answer is Yes."),
         ("5", "x", "y")], "id string, prompt string, target string")
    ids = lambda pair: sorted(r.id for r in pair[0].collect())
    assert ids(fl.verify_answer(df)) == ["1", "2"]
    assert ids(fl.verify_answer(df, "strict")) == ["4"]


def test_date_category(spark):
    texts = ["on 15/03/1990.", "on 29-07-2023.", "is 25 years old", "March 15, 1990", "was born", "not this one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, prompt string")
    assert [r.i for r in fl.date_category(df).where("any_date").orderBy("i").collect()] == [0, 1, 2, 3, 4]


def test_exemplars_sticky_and_per_row(spark):
    pool = spark.createDataFrame([(str(i), f"T{i}") for i in range(9)], "id string, text string")
    df = spark.createDataFrame([(str(i), "P", "t") for i in range(40)], "id string, prompt string, target string")
    sticky = {frozenset(w for w in r.prompt.split() if w[0] == "T" and w[1:].isdigit())
              for r in exm.with_exemplars(df, pool, 2, True).collect()}
    assert len(sticky) == 1 and len(next(iter(sticky))) == 2
    per_row = {frozenset(w for w in r.prompt.split() if w[0] == "T" and w[1:].isdigit())
               for r in exm.with_exemplars(df, pool, 2, False).collect()}
    assert len(per_row) > 5
    large = spark.range(5000).selectExpr("cast(id AS string) AS id", "concat('T', id) AS text")
    drawn = [[w for w in r.prompt.split() if w[0] == "T" and w[1:].isdigit()]
             for r in exm.with_exemplars(df, large, 3, False).collect()]
    assert all(len(set(d)) == 3 for d in drawn) and len({w for d in drawn for w in d}) > 100
    assert exm.with_exemplars(df, pool.limit(0), 2, False).first().prompt == "P"
    assert all(r.prompt.count("START") == 2 for r in exm.with_exemplars(df, pool.limit(2), 4, False).collect())
    one = exm.with_exemplars(df, pool, 2, True).first().prompt
    assert one.startswith("Examples:\nSTART\n") and one.endswith("\nEND\n\nP") and "\nEND\n\nSTART\n" in one


def _near(text):
    return text.replace("region", "regoin"), text[: len(text) // 2], text + " indeed", text.upper()


def test_fuzzy_pairs_equal_brute_force(spark):
    base = [f"Which {a} does the {b} of {c} lie in?" for a in ("region", "street") for b in ("city", "firm", "x")
            for c in ("Ada", "Customer 12", "q")]
    extra = [v for t in base for v in _near(t)]
    left = base + ["ab", "abc", "a", "née", ""] + base
    right = extra + ["abd", "abc", "ab", "nee", "b"]
    a = spark.createDataFrame([(t,) for t in left], "s string")
    b = spark.createDataFrame([(t,) for t in right], "s string")
    for threshold in (60, 80):
        want = {
            (x, y, round(200 * lcs_length(x, y) / (len(x) + len(y))))
            for x in set(left) for y in set(right)
            if x and y and round(200 * lcs_length(x, y) / (len(x) + len(y))) >= threshold
        }
        got = ov.fuzzy_pairs(a, b, "s", threshold)
        assert {tuple(r) for r in got.collect()} == want
    assert "CartesianProduct" not in _plan(got) and "BroadcastNestedLoopJoin" not in _plan(got)
    top = ov.fuzzy_top(a, b, "s", 2, 80).groupBy("text_a").count().agg(F.max("count")).first()[0]
    assert top <= 2


def test_fuzzy_splits_common_keys(spark, monkeypatch):
    a = spark.range(60).selectExpr("concat('same text number ', id) AS s")
    b = spark.range(5).selectExpr("concat('same text number ', id * 7) AS s")
    whole = {tuple(r) for r in ov.fuzzy_pairs(a, b, "s", 90).collect()}
    monkeypatch.setattr(ov, "KEY_ROWS", 7)
    assert {tuple(r) for r in ov.fuzzy_pairs(a, b, "s", 90).collect()} == whole and whole


def test_resume_equals_one_shot(spark):
    rows = spark.createDataFrame([("r", str(i), f"x{i}") for i in range(20)], "run_id string, id string, response string")
    first = rows.where("id % 3 = 0")
    todo = ev.pending(rows, first)
    both = ev.append_new(first, todo.unionByName(first))  # a repeated batch does no harm
    assert both.count() == 20 and both.exceptAll(rows).count() == 0
    assert ev.append_new(first, todo.unionByName(todo)).count() == 20
    report = ev.completeness(rows, both).first()
    assert report.complete and report.missing == 0
    assert ev.completeness(rows, first).first().missing == 13
    with pytest.raises(Exception, match="do not match"):
        ev.require_complete(ev.completeness(rows, first)).collect()


def test_generate_runs_a_user_function(spark):
    df = spark.createDataFrame([("1", "ab"), ("2", "cd")], "id string, prompt string")
    got = ev.generate(df, lambda s: pd.Series([x[::-1] for x in s], index=s.index), batch_size=1)
    assert {r.id: r.response for r in got.collect()} == {"1": "ba", "2": "dc"}


def test_unknown_pairs_raise(spark, sf):
    with pytest.raises(NotImplementedError):
        make_examples(derived.celebrities(spark, sf), "celebrities", "direct")


def test_sections_of_a_prompt_without_examples(spark):
    df = spark.createDataFrame([("Facts:\nFact #1: x\n\nQuestion: q?\nAnswer:",)], "prompt string")
    row = se.prompt_sections(df).first()
    assert (row.examples_part, row.facts_part, row.question_part) == ("", "Facts:\nFact #1: x", "Question: q?\nAnswer:")


def test_pack_shapes(spark):
    df = spark.createDataFrame([("1", "a b c", "d"), ("2", " ".join("x" * 20), "y z")], "id string, prompt string, target string")
    for r in pack(df, 8).collect():
        assert [len(x) for x in (r.input_ids, r.attention_mask, r.labels, r.decoder_input_ids)] == [8] * 4
        assert r.decoder_input_ids == [0] + r.labels[:-1]


def test_phrase_window(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"],), (["a"],)], "tokens array<string>")
    assert [r[0] for r in df.select(phrase_window("tokens", ["a", "c"])).collect()] == [2, None]


def test_grid_leaves_out_one_combination(spark):
    flags = grid.flag_grid()
    assert len(flags) == 9 and not any(g["random_facts"] and g["answer_first"] for g in flags)
    runs = grid.run_grid(spark, ["m1", "m2"])
    assert runs.count() == 36 and runs.select("run_id").distinct().count() == 36


def test_finetuning_holds_out_exemplars(spark, sf):
    built, shots = builds.build_finetuning_data(
        derived.wiki(spark, sf), n_exemplars=5, dev_size=100, limit=1000, entities=derived.entities(spark, sf))
    rows = built.select("id", "split", "strategy").distinct().cache()
    assert shots.count() == 5
    train = rows.where("split = 'train' AND strategy = 'self_ask'")
    assert train.join(shots, "id").count() == 0
    assert train.join(rows.where("split = 'dev'"), "id").count() == 0


def test_plans_have_no_cross_joins(spark, sf):
    from hopframe.plans import registry

    for name in ("self_ask_examples", "few_shot_prompts", "evaluation_wide", "allow_list_filter", "conditional_agreement"):
        plan = _plan(registry.QUERIES[name](spark, sf))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_every_row_gets_another_rows_fact(spark):
    from hopframe.operators.perturb import perturb

    rows = [(f"r{i}", "q?", [f"fact {i}"] if i % 5 else []) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, question string, facts array<string>")
    got = perturb(df, "add_fact").collect()
    assert len(got) == 300 and all(r["changed"] and r["facts"][-1] != f"fact {r['id'][1:]}" for r in got)
    two = perturb(df.where("id in ('r1', 'r2')"), "replace_fact").collect()
    assert {r["id"]: r["facts"] for r in two} == {"r1": ["fact 2"], "r2": ["fact 1"]}


def test_a_key_hot_on_the_right_is_split(spark, monkeypatch):
    from hopframe.operators import overlap

    monkeypatch.setattr(overlap, "KEY_ROWS", 3)
    left = spark.createDataFrame([("abcdef ghij",), ("zzzz yyyy",)], "t string")
    right = spark.createDataFrame([(f"abcdef ghi{c}",) for c in "abcdefghijklmno"] + [("zzzz yyyx",)], "t string")
    got = {(r["text_a"], r["text_b"]) for r in overlap.fuzzy_pairs(left, right, "t").collect()}
    assert got == {("abcdef ghij", f"abcdef ghi{c}") for c in "abcdefghijklmno"} | {("zzzz yyyy", "zzzz yyyx")}


def test_agreement_of_run_pairs_equals_brute_force(spark):
    runs = ["a b", "r/1", "r.2", "d"]
    rng = random.Random(3)
    rows = [tuple(rng.choice([True, False, False, None]) for _ in runs) for _ in range(300)]
    wide = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "id string, " + ", ".join(f"`{r}` boolean" for r in runs)).repartition(5)
    want = {}
    for r in rows:
        for i, a in enumerate(runs):
            for j, b in enumerate(runs):
                if i != j and r[i] is not None and r[j] is not None:
                    want[a, b, r[i], r[j]] = want.get((a, b, r[i], r[j]), 0) + 1
    found = an.conditional_agreement(wide, runs)
    got = {(r.run_a, r.run_b, r.a_correct, r.b_correct): (r.questions, r.share) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == want
    for (a, b, x, y), (n, share) in got.items():
        assert share == pytest.approx(n / sum(want.get((a, b, x, z), 0) for z in (True, False)))
    assert an.conditional_agreement(wide.limit(0), runs).count() == 0
    assert "Generate" not in _plan(found)


def test_runs_are_scored_on_the_set_they_answer(spark):
    sets = spark.createDataFrame(
        [("s1", "1", "Oslo", "The answer is Oslo."), ("s2", "1", "Bergen", "The answer is Bergen."), ("s1", "2", "Rome", "Rome")],
        "test_set string, id string, answer string, target string")
    said = spark.createDataFrame(
        [("r", "s1", "1", "The answer is Oslo."), ("r", "s2", "1", "The answer is Oslo."), ("r", "s2", "2", "The answer is Rome."), ("r", None, "1", "x")],
        "run_id string, test_set string, id string, response string")
    scored, rejects = ev.evaluate_on(sets, said, use_stemmer=False)
    assert {(r.test_set, r.id): (r.correct, r.rouge_1) for r in scored.collect()} == {("s1", "1"): (True, 1.0), ("s2", "1"): (False, 0.75)}
    assert sorted((r.test_set or "", r.id) for r in rejects.collect()) == [("", "1"), ("s2", "2")]


def test_which_test_set_a_run_uses(spark):
    crossed = {(r.run_no, r.eval_examplars): r for r in grid.cross_runs(derived.runs(spark)).collect()}
    # a direct run with exemplars is evaluated on the self-ask prompts, results on foreign sets name the set
    direct = [r for r in crossed.values() if r.strategy == "direct"]
    assert {r.test_set for r in direct if r.eval_examplars} == {"self_ask-answer_first=False-random_facts=False-with-examplars"}
    assert {r.set_strategy for r in direct if not r.eval_examplars} == {"direct"}
    assert all(r.own_set == (r.examplars == r.eval_examplars) for r in crossed.values())
    assert all(r.results_name == r.run_id + ("-results" if r.own_set else f"-results-on-{r.test_set}") for r in crossed.values())


def test_similar_in_blocks_equals_brute_force():
    from hopframe.functions.sequence import similar_in_blocks

    rng = random.Random(5)
    for letters, threshold in (("ab", 80), ("abc dé€😀", 67), ("abcdefgh ", 90), ("ab", 100)):
        left = ["".join(rng.choice(letters) for _ in range(rng.choice((1, 3, 63, 64, 65, 150)))) for _ in range(60)]
        right = left[:5] + [t[: len(t) // 2] + rng.choice(letters) + t[len(t) // 2 :] for t in left[:40]]
        score = lambda x, y: round(200 * lcs_length(x, y) / (len(x) + len(y)))
        want = {(i, j, score(x, y)) for i, x in enumerate(left) for j, y in enumerate(right) if score(x, y) >= threshold}
        assert want and set(zip(*similar_in_blocks(left, right, threshold, (threshold - 0.5) / 100))) == want


def test_fuzzy_pairs_writes_no_candidates(spark):
    """Texts of one alphabet share most character pairs; they travel as texts, not as keys or candidates."""
    a = spark.range(300).selectExpr("concat('the text of number ', id * 7919) AS s")
    got = ov.fuzzy_pairs(a, a, "s", 95)
    assert "numbered" not in _plan(got) and "Join" not in _plan(got) and "Window" not in _plan(got)
    assert got.where("text_a = text_b AND score = 100").count() == 300
