import random

import pytest
from pyspark.sql import functions as F

from hopframe.functions import text as T
from hopframe.functions.sequence import lcs_length
from hopframe.functions.stemming import stem_word

STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster",
    "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi",
    "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit",
    "operator": "oper", "feudalism": "feudal", "hopefulness": "hope", "formalize": "formal",
    "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow",
    "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "effective": "effect",
    "probate": "probat", "controlling": "control", "roll": "roll", "sky": "sky", "dying": "die",
    "died": "die", "flies": "fli", "dies": "die", "enjoy": "enjoy", "the": "the",
}


@pytest.mark.parametrize("word,stem", STEMS.items())
def test_stems(word, stem):
    assert stem_word(word) == stem


def test_lcs_equals_table():
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert lcs_length(a, b) == table[-1][-1]


def _one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first().r


def test_strip_removes_all_white_space(spark):
    raw = " \t a b \x1f\n"
    assert _one(spark, T.strip("v"), raw) == raw.strip()


def test_strip_lines_keeps_structure(spark):
    raw = "  a \n\n\t b \n   \nc"
    assert _one(spark, T.strip_lines("v"), raw) == "\n".join(x.strip() for x in raw.split("\n"))


@pytest.mark.parametrize("text,mode,found", [
    ("So the answer is U.S. citizen.", "response", "U.S. citizen"),
    ("So the answer is U.S. citizen.", "target", "U"),
    ("first\nSo the answer is Paris. More.", "response", "Paris. More"),
    ("Moscow", "response", ""),
    ("Moscow", "target", "Moscow"),
    ("The answer is\n Paris .", "target", "Paris"),
    ("So the answer is Yes.", "strict", "yes"),
    ("Moscow", "strict", None),
    ("Yes.\nSo the final answer is: 5 June 1988\n", "colon", "5 June 1988"),
    ("So the final answer is: Moscow.", "colon", "Moscow"),
])
def test_extract_answer(spark, text, mode, found):
    assert _one(spark, T.extract_answer("v", mode), text) == found


@pytest.mark.parametrize("generated,truth,right", [
    ("  PARIS, France ", "paris", True), ("18 May", "19 May", False), ("anything", "", True), ("", "x", False),
])
def test_correctness(spark, generated, truth, right):
    row = spark.createDataFrame([(generated, truth)], "g string, t string")
    assert row.select(T.is_correct("g", "t").alias("r")).first().r is right


def test_self_ask_and_yes_no(spark):
    assert _one(spark, T.is_self_ask("v"), "Follow Up: who?") is True
    assert _one(spark, T.is_self_ask("v"), "Paris") is False
    assert [_one(spark, T.yes_no("v"), x) for x in ("True", "FALSE", "maybe")] == ["Yes", "No", "maybe"]


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "a double, b double")
    assert df.agg(T.safe_corr(F.col("a"), F.col("b")).alias("c")).first().c is None


def test_numbered_runs(spark):
    rows = [(["b", "a", "b", "b"],), ([],), (None,), (["x"] * 20_000,)]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<string>").select(T.numbered(F.col("a"))).collect()]
    assert got[0] == ["a\x010", "b\x010", "b\x011", "b\x012"] and got[1] == [] and got[2] is None
    assert len(set(got[3])) == 20_000 and got[3][-1] == "x\x0119999"


def test_overlap_of_a_batch_equals_brute_force():
    import random
    from collections import Counter

    import pandas as pd

    from hopframe.functions.sequence import lcs_length, overlap_batch
    from hopframe.functions.stemming import stem_word

    rng = random.Random(9)
    said = [" ".join(rng.choice("the cats cat running run city".split()) for _ in range(rng.randrange(9))) for _ in range(25)]
    left, right = ([rng.choice(said) for _ in range(200)] for _ in range(2))
    for stem in (None, stem_word):
        for with_lcs in (True, False):
            got = overlap_batch(pd.Series(left), pd.Series(right), stem, with_lcs)
            for (a, b), row in zip(zip(left, right), got.itertuples(index=False)):
                a, b = ([stem(w) if stem else w for w in x.split()] for x in (a, b))
                shared = [(Counter(zip(*[a[i:] for i in range(n)])) & Counter(zip(*[b[i:] for i in range(n)]))).total() for n in (1, 2)]
                assert tuple(row) == (len(a), len(b), *shared, lcs_length(a, b) if with_lcs else 0)


def test_words_are_cut_in_the_arrow_pass(spark):
    from hopframe.operators import evaluate as ev

    rows = [("a", "The cat,\nsat: DOWN.", "the cat sat down"), ("b", "née 12 Ünder \U0001f600x ", "n e 12 nder x"), ("c", "a-b", "?? !!"), ("d", "KKİ", "kki")]
    got = ev.rouge(spark.createDataFrame(rows, "id string, target string, response string"), use_stemmer=False)
    plan = got._jdf.queryExecution().executedPlan().toString()
    found = {r.id: r for r in got.collect()}
    assert "regexp_replace" not in plan  # a regular expression per row cost more than all the counting
    assert all(found[k].f1_1 == 1 and found[k].rouge_l == 1 for k in "abd") and found["c"].f1_1 == 0


def test_lines_are_stripped_and_answers_found_without_scans_per_character(spark):
    blanks = [chr(c) for c in (9, 11, 12, 13, *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    raw = "".join(f"{b}{b} x{b}y {b}\n" for b in blanks) + "\n  \n\u200bz\u200b"
    df = spark.createDataFrame([(raw,), ("",), (None,)], "v string").select(T.strip_lines("v").alias("a"), T.strip("v").alias("b"))
    lines = "\n".join("".join(x).strip("".join(blanks)) for x in raw.split("\n"))
    assert [tuple(r) for r in df.collect()] == [(lines, raw.strip("".join(blanks) + "\n")), ("", ""), (None, None)]
    assert "regexp" not in df._jdf.queryExecution().executedPlan().toString()
    both = T.extract_answer("v", "response", "text")
    said = ["so the answer is .", "the answer is a.b.\nanswer is c.", " none ", "", None]
    got = spark.createDataFrame([(x,) for x in said], "v string").select(both.alias("r"), T.extract_answer("v").alias("e"), T.extract_answer("v", "target").alias("t"))
    assert [tuple(r) for r in got.collect()] == [("", "", ""), ("a.b", "a.b", "a"), ("none", "", " none "), ("", "", ""), (None, None, None)]
    assert "RLIKE" not in got._jdf.queryExecution().executedPlan().toString()  # one search per text, not a test and a search
