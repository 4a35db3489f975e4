import json

import pytest
from pyspark.sql import functions as F

from hopframe.operators import evaluate as ev
from hopframe.operators.facts import resolve_facts
from hopframe.plans import derived
from hopframe.sources import prepared, raw, sinks
from hopframe.sources.progress import Progress
from hopframe.streaming import scores as st

WIKI = [
    {"_id": "w1", "question": "q1?", "answer": "yes", "type": "comparison", "entity_ids": "Q1_Q2",
     "supporting_facts": [["A", 0], ["B", 1]], "context": [["A", ["a0", "a1"]], ["B", ["b0", "b1"]]],
     "evidences": [["A", "country", "X"]]},
    {"_id": "w2", "question": "q2?", "answer": "no", "type": "inference", "entity_ids": "",
     "supporting_facts": [["A", 1]], "context": [["A", ["a0", "a\"1"]]], "evidences": [["A", "spouse", "B"]]},
]


def _dump(path, data):
    path.write_text(json.dumps(data))
    return str(path)


def test_raw_readers(spark, tmp_path):
    _dump(tmp_path / "dev.json", WIKI)
    got = raw.read_wiki(spark, str(tmp_path), "dev")
    good, _ = resolve_facts(got)
    assert [(r.id, r.facts) for r in good.orderBy("pos").collect()] == [("w1", ["a0", "b1"]), ("w2", ['a"1'])]
    assert raw.read_wiki(spark, str(tmp_path), "dev", 1).first().id == "w1"
    landed = raw.land(got, str(tmp_path / "landed"))
    assert landed.count() == 2
    hot = [{k: v for k, v in w.items() if k not in ("evidences", "entity_ids")} | {"level": "easy"} for w in WIKI]
    _dump(tmp_path / "train.json", hot)
    assert raw.read_hotpot(spark, str(tmp_path)).first().level == "easy"
    cc = {"data": [{"Question": "q", "Answer": ["a"], "Q1": "x", "A1": ["y"], "Q2": "z", "A2": ["w"]}]}
    assert raw.read_celebrities(spark, _dump(tmp_path / "cc.json", cc)).first().a2 == ["w"]
    sq = [{"qid": "s", "term": "t", "description": "d", "question": "q", "answer": True, "facts": ["f"], "decomposition": ["e"]}]
    _dump(tmp_path / "test.json", sq)
    assert raw.read_strategyqa(spark, str(tmp_path), "test").first().answer == "true"


def test_other_readers(spark, tmp_path):
    task = {"Instances": [{"input": "i", "output": ["o"]}, {"input": "j", "output": ["p"]}]}
    assert raw.read_instances(spark, _dump(tmp_path / "task.json", task)).count() == 2
    lines = tmp_path / "q.jsonl"
    lines.write_text('{"id":"a","answerKey":"A","para":"p","question":{"stem":"s","choices":[{"label":"A","text":"t"}]}}\n')
    assert raw.read_jsonl(spark, str(lines)).first().question.choices[0].text == "t"
    passages = [{"title": "T", "text": "x", "links": [], "questions": [{"question": "q1", "answer": {"type": "span"}}, {"question": "q2"}]}]
    got = raw.read_passages(spark, _dump(tmp_path / "iirc.json", passages))
    assert [(r.question_no, r.question) for r in got.collect()] == [(0, "q1"), (1, "q2")]


def test_result_documents_round_trip(spark, tmp_path):
    folder = tmp_path / "results"
    folder.mkdir()
    micro = {"correct": [True, False], "bleu-1": [0.1, 0.2], "bleu-2": [0.0, 0.0], "rouge-1": [1.0, 0.0],
             "rouge-2": [1.0, 0.0], "rouge-L": [1.0, 0.0], "F1-1": [0.5, 0.5], "F1-2": [0.5, 0.25]}
    macro = {"accuracy": 0.5, "F1-1": 0.5, "F1-2": 0.4, "bleu-1": 0.1, "bleu-2": 0.0, "rouge-1": 0.5, "rouge-2": 0.5, "rouge-L": 0.5}
    doc = {"model": "m", "micro_results": micro, "macro_results": macro}
    own = "flan-t5-small-self_ask-answer_first=True-random_facts=False-with-examplars"
    _dump(folder / f"{own}-results.json", doc)
    _dump(folder / f"{own}-results-on-self_ask-answer_first=False-random_facts=True-without-examplars.json", doc)
    _dump(folder / f"{own}-responses.json", [{"response": "r0", "answer": "a", "self_ask": True}, {"response": "r1", "answer": "", "self_ask": False}])
    board = {r.eval_random_facts: r for r in prepared.leaderboard_from_files(spark, str(folder)).collect()}
    assert len(board) == 2
    assert board[True].base_model == "flan-t5-small" and board[True].strategy == "self_ask" and board[True].answer_first
    assert not board[True].eval_examplars and not board[True].eval_answer_first and board[False].eval_examplars
    scores = prepared.read_scores(spark, str(folder / f"{own}-results.json")).orderBy("pos").collect()
    assert [r.f1_2 for r in scores] == [0.5, 0.25] and scores[0].run_id == own
    resp = prepared.read_responses(spark, str(folder / f"{own}-responses.json")).orderBy("pos").collect()
    assert [(r.pos, r.response) for r in resp] == [(0, "r0"), (1, "r1")]
    _dump(folder / f"{own}-responses-on-other-set.json", [{"response": "x0", "answer": "a", "self_ask": True}])
    both = prepared.read_responses(spark, str(folder / f"{own}-responses*.json")).collect()
    assert {(r.run_id, r.eval_set, r.pos, r.response) for r in both} == {
        (own, None, 0, "r0"), (own, None, 1, "r1"), (own, "other-set", 0, "x0")}
    sets = prepared.read_scores(spark, str(folder / f"{own}-results*.json")).groupBy("run_id", "eval_set").count().collect()
    assert sorted((r.run_id, r.eval_set or "", r["count"]) for r in sets) == [
        (own, "", 2), (own, "self_ask-answer_first=False-random_facts=True-without-examplars", 2)]
    old = tmp_path / "old"
    old.mkdir()
    _dump(old / "t5-small-direct-with-examplars-results.json", doc)
    row = prepared.leaderboard_from_files(spark, str(old), "v1").first()
    assert (row.model, row.finetune, row.with_examplars) == ("t5-small", "Direct", "Y")


def test_examples_written_by_flags_are_pruned(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", "p", "t", 5, "train", "direct", False), ("2", "p", "t", 50, "dev", "self_ask", True)],
        "id string, prompt string, target string, num_prompt_tokens int, split string, strategy string, answer_first boolean")
    root = str(tmp_path / "ex")
    sinks.write_examples(df, root)
    got = prepared.read_examples(spark, root, strategy="direct", split="train")
    assert [r.id for r in got.collect()] == ["1"]
    assert "PartitionFilters: [isnotnull(" in got._jdf.queryExecution().executedPlan().toString()
    sinks.write_filtered(df, str(tmp_path / "f"), 10)
    assert spark.read.parquet(str(tmp_path / "f")).first().max_tokens == 10
    sinks.write_csv(df, str(tmp_path / "csv"), ["id", "split"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["id", "split"]
    inv = tmp_path / "inv"
    inv.mkdir()
    _dump(inv / "a.json", [{"id": "1", "prompt": "p"}, {"id": "2", "prompt": "q"}])
    row = prepared.inventory(spark, str(inv)).first()
    assert row.file == "a.json" and row.rows == 2 and '"id":"1"' in row.first_row
    _dump(inv / "b.json", [{"question": "q", "score": 0.5, "facts": ["f"]}])
    _dump(inv / "c.json", {"macro_results": {"accuracy": 1.0}})
    rows = {r.file: r for r in prepared.inventory(spark, str(inv)).collect()}
    assert [rows[f].rows for f in ("a.json", "b.json", "c.json")] == [2, 1, 1]
    assert json.loads(rows["b.json"].first_row) == {"question": "q", "score": 0.5, "facts": ["f"]}
    assert json.loads(rows["c.json"].first_row) == {"macro_results": {"accuracy": 1.0}}
    assert "macro_results" in rows["c.json"].fields and "score" in rows["b.json"].fields and "score" not in rows["a.json"].fields
    assert prepared.read_examples_json(spark, str(inv / "a.json")).count() == 2


def test_small_sinks(spark, tmp_path):
    pool = spark.createDataFrame([("1", "Question: a\nline\n"), ("2", "Question: b\n")], "id string, text string")
    sinks.write_exemplars(pool, str(tmp_path / "pool"))
    assert [r.text for r in prepared.read_exemplars(spark, str(tmp_path / "pool")).orderBy("id").collect()] == [
        "Question: a\nline", "Question: b"]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    sinks.accumulate_ids(spark, str(tmp_path / "ids"), ids("a", "b"), 0)
    got = sinks.accumulate_ids(spark, str(tmp_path / "ids"), ids("b", "c"), 1)
    assert sorted(r.id for r in got.collect()) == ["a", "b", "c"]
    sinks.start_attempt(spark, str(tmp_path / "att"), ids("x", "y"), 1)
    sinks.start_attempt(spark, str(tmp_path / "att"), ids("z"), 2)
    assert [r.id for r in sinks.latest_attempt(spark, str(tmp_path / "att")).collect()] == ["z"]
    resp = spark.createDataFrame([("r", "1", "x")], "run_id string, id string, response string")
    for _ in range(2):
        sinks.append_responses(resp, str(tmp_path / "resp"), 0)
    assert spark.read.parquet(str(tmp_path / "resp")).count() == 1
    rows = spark.range(31).selectExpr("id AS pos", "concat('t', id) AS prompt")
    sinks.write_chunks(rows, str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).select("chunk").distinct().count() == 15


def test_exemplar_file_is_as_given(spark, tmp_path):
    pool = spark.createDataFrame([("2", "b\n"), ("1", "a\nline\n")], "id string, text string")
    sinks.write_exemplars(pool, str(tmp_path / "pool"))
    assert "".join(p.read_text() for p in (tmp_path / "pool").glob("part-*")) == "a\nline\n\nb\n\n"


def test_progress_resumes_after_a_kill(spark, tmp_path):
    rows = spark.range(12).selectExpr("'r' AS run_id", "cast(id AS string) AS id", "concat('x', id) AS response", "'a' AS answer", "'t' AS target")
    progress = Progress(spark, str(tmp_path / "p"))
    assert progress.batches() == [] and progress.remaining(rows).count() == 12
    progress.save(rows.where("id < 4"), rows.where("id < 4"), 0)
    # the writer dies after the responses of batch 1
    progress.write("responses", rows.where("id >= 4 AND id < 8").select("run_id", "id", "response"), 1)
    assert progress.batches() == [0] and progress.responses().count() == 4
    got = progress.completeness(rows).first().asDict()
    assert got == {"run_id": "r", "expected": 12, "responses": 4, "answers": 4, "targets": 4, "missing": 8, "unaligned": 0}
    left = progress.remaining(rows)
    progress.save(left, left.where("id <> 11"), 1)
    got = progress.completeness(rows).first().asDict()
    assert progress.batches() == [0, 1] and got["missing"] == 0 and got["responses"] == 12 and got["unaligned"] == 1


def test_run_documents(spark, tmp_path, sf):
    rows = derived.responses(spark, sf).where("run_no IN (1, 9)")
    scored = ev.score(rows).select("run_id", "id", "pos", "correct", *ev.METRICS)
    macro = ev.macro(scored)
    for _ in range(2):
        sinks.write_run(scored, macro, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run/macro")).count() == 2
    stored = spark.read.parquet(str(tmp_path / "run/scores"))
    assert stored.count() == scored.count()
    docs = sinks.nested_results(stored, macro, derived.runs(spark))
    row = docs.select(F.size("micro_results.correct").alias("n"), "macro_results.*").first()
    assert row.n == stored.count() // 2
    ex = rows.where("run_no = 1").select("id", "pos", "target", "response", F.lit("p\n").alias("prompt"))
    report = sinks.sample_report(ev.rouge(ex), "sample")
    sinks.write_report(report, str(tmp_path / "report"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect())
    assert text.count("### Example") == 15 and text.count("bleu-1: ") == 5 and "# sample" in text


def test_stream_equals_batch(spark, tmp_path):
    rows = [("r", str(i), f"So the answer is {i}." if i % 2 else "none", "2024-01-01 00:00:00") for i in range(40)]
    df = spark.createDataFrame(rows, "run_id string, id string, response string, arrived string").withColumn(
        "arrived", F.to_timestamp("arrived"))
    truth = df.select("run_id", "id", F.col("id").alias("answer"), F.concat(F.lit("So the answer is "), "id", F.lit(".")).alias("target"))
    df.where("id < 25").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    df.where("id >= 20").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = st.response_stream(spark, str(tmp_path / "in/*"), 1)
    st.stream_scores(stream, truth, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = st.stored_scores(spark, str(tmp_path / "out"))
    batch = ev.score(df.join(truth, ["run_id", "id"]))
    cols = ["run_id", "id", "correct", *ev.METRICS]
    assert got.count() == 40 and got.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert st.streamed_macro(spark, str(tmp_path / "out")).first().accuracy == pytest.approx(0.5)


def _arrive(spark, path, rows, n):
    spark.createDataFrame(rows, "run_id string, id string, response string, arrived string").withColumn(
        "arrived", F.to_timestamp("arrived")).coalesce(1).write.parquet(f"{path}/f{n}")


def _run(spark, tmp_path, **options):
    truth = spark.createDataFrame([(r, str(i), f"a{i}", f"The answer is a{i}.") for r in ("x", "y") for i in range(6)], "run_id string, id string, answer string, target string")
    stream = st.response_stream(spark, f"{tmp_path}/in/*", 1)
    st.stream_scores(stream, truth, f"{tmp_path}/out", f"{tmp_path}/state", use_stemmer=False, **options).awaitTermination()
    found = st.stored_scores(spark, f"{tmp_path}/out").select("run_id", "id", "correct").collect()
    assert len({(r.run_id, r.id) for r in found}) == len(found)
    return {(r.run_id, r.id): r.correct for r in found}


def test_late_and_repeated_rows_are_scored_once(spark, tmp_path):
    right = lambda i: f"The answer is a{i}."
    _arrive(spark, f"{tmp_path}/in", [("x", "0", right(0), "2024-05-01 10:00:00"), ("x", "1", "no", "2024-05-01 10:00:01"), ("x", "1", right(1), "2024-05-01 10:00:02")], 0)
    assert _run(spark, tmp_path) == {("x", "0"): True, ("x", "1"): False}  # the earlier copy counts
    _arrive(spark, f"{tmp_path}/in", [("x", "0", "no", "2024-05-09 10:00:00"), ("y", "0", right(0), "2024-05-09 10:00:00")], 1)
    # years late, and a copy of what was scored two runs ago
    _arrive(spark, f"{tmp_path}/in", [("x", "2", right(2), "2019-01-01 00:00:00"), ("x", "1", right(1), "2019-01-01 00:00:00"), ("x", "77", "?", "2024-05-09 10:00:00")], 2)
    assert _run(spark, tmp_path) == {("x", "0"): True, ("x", "1"): False, ("y", "0"): True, ("x", "2"): True}
    assert [r.id for r in st.stored_rejects(spark, f"{tmp_path}/out").collect()] == ["77"]


def test_repeated_batch_and_snapshots_change_nothing(spark, tmp_path):
    import os

    rows = [("xy"[i % 2], str(i % 6), f"The answer is a{i % 4}.", f"2024-01-{1 + i:02d} 00:00:00") for i in range(18)]
    for n in range(9):
        _arrive(spark, f"{tmp_path}/in", rows[2 * n : 2 * n + 2], n)
    want = {}
    for run, i, response, _ in rows:
        want.setdefault((run, i), f"a{i}" in response)
    assert _run(spark, tmp_path, buckets=3, snapshot=2) == want
    folders = os.listdir(f"{tmp_path}/out/keys")
    assert "upto=7" in folders and "upto=1" not in folders and "batch=0" not in folders and "batch=8" in folders
    # a crash after the scores of the last batch were written, before it was committed
    for name in ("commits/8", "commits/.8.crc"):
        os.remove(f"{tmp_path}/state/{name}")
    assert _run(spark, tmp_path, buckets=3, snapshot=2) == want
    store = st.KeyStore(spark, f"{tmp_path}/out/keys", 3, 2)
    assert store.before(99).distinct().count() == store.before(99).count() == len(want)
    assert store.before(8).count() <= store.before(9).count() and "Scan parquet" in store.before(9)._jdf.queryExecution().toString()
