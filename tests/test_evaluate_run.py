"""The two-stage evaluation keeps and moves only what it judges."""

from hopframe.plans import derived, registry


def test_evaluate_run_stores_no_targets(spark, monkeypatch):
    schema = "run_id string, run_no int, strategy string, id string, pos long, n long, type string, answer string, hops int, target string, num_prompt_tokens int, response string"
    rows = [("r", 0, "direct", f"q{n}", n, n, "t", f"a{n}", 2, f"The answer is a{n}.", 5, f"The answer is a{n % 6}.") for n in range(9)]
    rows += [rows[3], rows[7]]  # late responses that come twice count once
    monkeypatch.setattr(derived, "responses", lambda spark, sf: spark.createDataFrame(rows, schema))
    kept = []
    monkeypatch.setattr(registry, "materialized", lambda df, purpose, real=registry.materialized: kept.append(df.columns) or real(df, purpose))
    got = registry.evaluate_run(spark, "").collect()
    assert [tuple(r) for r in got] == [("r", 9, 6, 0)]
    assert len(kept) == 1 and not {"target", "strategy", "run_no", "num_prompt_tokens"} & set(kept[0])
