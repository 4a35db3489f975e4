"""Packing by powers of two against the tokenizer's own encoding."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hopframe.llm import packing, queries
from hopframe.llm._store import read_bytes, stored

SCHEMA = "doc_id long, text string, ids long, piece string, length int, shard int, slot string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.TOKENIZER)


@pytest.fixture(scope="module")
def coder():
    return packing.Coder(read_bytes(packing.TOKENIZER))


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


ODD = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aZ'sdé×÷ÿßİΣς 0\n\t\x0b\x1c\x85  ́<|>")), max_size=40)


@given(ODD)
@settings(max_examples=400, deadline=None)
def test_ids_are_the_tokenizers(tokenizer, coder, text):
    assert np.frombuffer(coder.encode(text.encode()), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|> a <|ENDOFTEXT|>b", "A'S it'Ll 're", "don't\nwon’t ½ ² ª", "x" * 5000, "á étude ﬁ"])
def test_ids_of_special_texts(tokenizer, coder, text):
    assert np.frombuffer(coder.encode(text.encode()), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_blocks_and_a_small_memory_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "STEP", 50)
    monkeypatch.setattr(packing, "KNOWN", 7)
    text = "Thé quick brown fox, jumps 123 over “the” lazy dog. " * 40
    assert np.frombuffer(packing.Coder(read_bytes(packing.TOKENIZER)).encode(text.encode()), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.integers(1, 10**6))
def test_lengths_are_binary_digits(n):
    found = packing.lengths(n)
    assert sum(found) == n and all(x & (x - 1) == 0 and x <= 2048 for x in found)
    assert found == sorted(found, reverse=True) and len({x for x in found if x < 2048}) == len([x for x in found if x < 2048])


def check(rows, texts, tokenizer):
    """Each id in one piece, digests right, sequences whole and without padding."""
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(texts)
    for doc, parts in by.items():
        want = ids(tokenizer, texts[doc])
        parts.sort(key=lambda r: r["start"])
        assert [r["start"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts]).tolist()[:-1]]
        assert sum(r["length"] for r in parts) == len(want) == parts[0]["doc_tokens"]
        for r in parts:
            own = np.array(want[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(own)
            assert r["length"] <= 2048 and math.log2(r["length"]).is_integer() and r["offset"] == 0
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))


def test_query_against_the_tokenizer(spark, sf, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(queries.op11_packing(spark, sf).collect(), texts, tokenizer)


def test_odd_tables(spark, tokenizer):
    rows = [(1, "The cat sat. " * 900), (2, None), (3, ""), (None, "no id"), (5, "same text"), (5, "same text"), (6, "  \n ")]
    df = spark.createDataFrame([(*r, 9, "p", 3, 4, "s") for r in rows], SCHEMA)
    packed = packing.pack(df).collect()
    assert sorted(r["sequence_id"] for r in packed) == list(range(len(packed)))
    for doc, text in dict(rows).items():
        parts = sorted((r for r in packed if r["doc_id"] == doc), key=lambda r: (r["start"], r["sequence_id"]))
        got = [np.frombuffer(r["ids"], dtype="<u4").tolist() for r in parts]
        want = ids(tokenizer, text)
        assert sum(got, []) == want or doc == 5
    assert sorted(r["length"] for r in packed if r["doc_id"] == 5) == sorted(2 * packing.lengths(len(ids(tokenizer, "same text"))))
    assert {(r["doc_id"], r["length"]) for r in packed if r["doc_id"] in (2, 3, 6)} == {(2, 1), (3, 1), (6, 1)}
    assert packing.pack(df.limit(0)).count() == 0


def test_slots_and_batches_of_a_length(spark):
    df = spark.createDataFrame([(i, "word " * (i % 70)) for i in range(400)], "doc_id long, text string")
    rows = packing.with_batch(packing.pack(df, longest=16), 32).collect()
    sizes = {r["length"] for r in rows}
    assert max(sizes) == 16
    heads = []
    for size in sorted(sizes, reverse=True):
        own = [r for r in rows if r["length"] == size]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert all(r["batch"] == r["slot"] * size // 32 for r in own)
        heads.append(min(r["sequence_id"] for r in own))
    assert heads == sorted(heads)
    with pytest.raises(ValueError):
        packing.pieces(df, longest=100)


def test_long_text_in_bounded_batches(spark, tokenizer):
    text = "The cat sat on the mat, then left. " * 100_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    table = stored(packing.pieces(df).drop("ids"), "test-pieces")
    n = len(ids(tokenizer, text))
    assert table.agg({"length": "sum"}).head()[0] == n
    assert table.where("length < 2048").count() == bin(n % 2048).count("1")
