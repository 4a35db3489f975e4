"""The registered queries against their SQL at the smallest scale."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
CHECKED = [
    "direct_examples", "self_ask_examples", "answer_first_examples", "celebrity_examples", "hotpot_examples",
    "strategy_examples", "few_shot_prompts", "few_shot_per_row", "random_fact_order", "verify_answer", "dedup_prompts", "date_category",
    "extract_answers", "macro_results", "token_stats", "run_corr", "conditional_agreement", "context_hist",
    "rouge_n", "stream_scores", "top_bottom_random", "nth_ranked", "middle_ranked", "digest_batches",
    "train_dev_split", "chunks", "test_build", "perturbed_prompts", "attention_top_words", "packed_inputs", "token_counts", "sample_report", "cross_evaluation",
    "phrase_top_words", "progress_counts",
]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(round(v, 6))
    return str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, sf, con, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    left = sorted(tuple(_norm(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    right = sorted(tuple(_norm(r[i]) for i in at) for r in res.fetchall())
    assert left == right and left
