"""The near-duplicate stage links by fingerprints as well as by shingles."""

from __future__ import annotations

import corpus_pipeline


def test_stage_links_by_fingerprint_and_by_shingles(spark):
    phrase = "one two three four five six seven " * 200  # an odd number of shingles: no bit is tied
    long = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([
        # nearly all 3-word shingles are the phrase's, but few distinct 5-word shingles are shared
        (1, phrase + " ".join(f"x{i}" for i in range(12))), (2, phrase + " ".join(f"y{i}" for i in range(12))),
        (3, " ".join(long)), (4, " ".join([*long[:-1], "other"])), (5, "something else altogether, and no copy of it"),
    ], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in corpus_pipeline.linked_texts(docs).collect()}
    assert found[1] == found[2] and found[3] == found[4] and len(set(found.values())) == 3
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3, 5]
