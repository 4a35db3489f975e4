"""Run averages of the registered query: whole scores, and SQL that repeats them."""

import re

import pytest

from hopframe.functions.stemming import stem_word
from hopframe.operators.evaluate import METRICS
from hopframe.plans import derived, oracles, registry


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_macro_results_are_stemmed_and_have_the_subsequence(spark, monkeypatch):
    target = "The answer is running dogs."
    rows = [("r", "a", "running dogs", target, "dog runs: the answer is run."), ("r", "b", "cats", "The answer is cats.", "The answer is cats."),
            ("s", "a", "running dogs", target, "")]
    frame = spark.createDataFrame(rows, "run_id string, id string, answer string, target string, response string")
    monkeypatch.setattr(derived, "responses", lambda spark, sf: frame)
    got = {r.run_id: r for r in registry.macro_results(spark, "").collect()}
    words = lambda text: [stem_word(w) for w in re.findall("[a-z0-9]+", text.lower())]
    shares = []
    for _, _, _, truth, response in rows[:2]:
        t, r = words(truth), words(response)
        both = sum(min(t.count(w), r.count(w)) for w in set(t))
        shares.append((both / len(t), both / len(r), _lcs(t, r) / len(t)))
    assert got["r"].rouge_1 == pytest.approx(round(sum(s[0] for s in shares) / 2, 4))
    assert got["r"].bleu_1 == pytest.approx(round(sum(s[1] for s in shares) / 2, 4))
    assert got["r"].rouge_l == pytest.approx(round(sum(s[2] for s in shares) / 2, 4))
    assert all(getattr(got["s"], m) == 0 for m in METRICS)


def test_sql_stems_are_the_stems():
    duckdb = pytest.importorskip("duckdb")
    ends = ["", "s", "es", "ies", "ied", "eed", "ed", "ing", "y", "alli", "ationalli", "ization", "logi", "fulness", "icate", "ement", "ion", "e", "ll"]
    words = sorted({a + b for a in ("skies", "ho", "hop", "hopp", "fizz", "cry", "relat", "sens", "controll", "vietnam", "agr", "tr", "yy", "b2") for b in ends})
    con = duckdb.connect()
    found = dict(con.execute(f"WITH plain AS (SELECT ?::VARCHAR[] AS words), {oracles._stems('plain')} SELECT w, x FROM stems", [words]).fetchall())
    assert found == {w: stem_word(w) for w in words}
