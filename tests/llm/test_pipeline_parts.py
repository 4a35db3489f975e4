"""Learned mixture weights, near-duplicate groups and dropped tables against brute force."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopframe.llm import lm, resemblance, simhash
from hopframe.llm._store import scratch, stored


def tokens_of(text):
    return [*(text or "").encode().lower().split(), None]


def brute_weights(rows, gone):
    """EM over exact counts of the documents that are not deleted."""
    words, pairs, starts, types = Counter(), Counter(), 0, set()
    for doc, text, training in rows:
        if training:
            types |= set(tokens_of(text))
        if training and doc not in gone:
            t = tokens_of(text)
            starts += 1
            words.update(t)
            pairs.update(zip(["<"] + t[:-1], t, strict=True))
    total = sum(words.values())
    near = lambda p: math.exp(-round(-math.log(p) * lm.BINS) / lm.BINS) if p else 0.0
    cells = {}
    for doc, text, training in rows:
        if training and doc in gone:
            t = tokens_of(text)
            for h, w in zip(["<"] + t[:-1], t, strict=True):
                c = starts if h == "<" else words[h]
                estimates = near(pairs[h, w] / c) if c else 0.0, near(words[w] / total)
                cells.setdefault(math.frexp(c)[1] if c else 0, Counter())[estimates] += 1
    out = {}
    for b, counts in cells.items():
        p = np.array([[a, c, 1 / (len(types) + 1)] for a, c in counts]).T
        n, w = np.array([*counts.values()], dtype=float), np.array([0.0 if b == 0 else 0.4, 0.4, 0.2])
        w /= w.sum()
        for _ in range(lm.ROUNDS):
            share = w[:, None] * p
            share /= share.sum(axis=0)
            w = (share * n).sum(axis=1)
            w = np.maximum(w / w.sum(), [0.0 if b == 0 else 1e-9, 1e-9, 1e-9])
        out[b] = w / w.sum()
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 40_000])
def test_learned_weights_are_those_of_deleted_documents(spark, sf, block_bytes):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("training", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    rows = [(r["doc_id"], r["text"], r["training"]) for r in docs.select("doc_id", "text", "training").collect()]
    assert all(t == (zlib.crc32(str(d).encode()) % 7 != 2) for d, _, t in rows)
    gone = {r["doc_id"] for r in docs.where(lm.deleted("doc_id")).select("doc_id").collect()}
    assert 0.1 < len(gone) / len(rows) < 0.3
    counts = lm.token_counts(docs, block_bytes=block_bytes)
    types = counts.agg(F.sum("owned")).first()[0]
    got, want = lm.learn_weights(counts, types), brute_weights(rows, gone)
    assert set(got) == set(want) and len(got) > 5
    for b in want:
        assert got[b] == pytest.approx(tuple(want[b]), abs=1e-6)


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def similarity(a, b):
    sets = []
    for text in (a, b):
        w = text.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies around the threshold, chains, texts that share a passage, empty texts."""
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(60))
    texts = ["", " ", "\n", "one two", "one two", "One TWO"]
    for _ in range(6):
        base = [word() for _ in range(120)]
        texts += [edited(base, rng.randrange(6), rng) for _ in range(25)]
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(60)] + passage) for _ in range(40)]
    chain = [word() for _ in range(100)]
    for _ in range(12):
        chain = chain[4:] + [word() for _ in range(4)]
        texts.append(" ".join(chain))
    return texts


def brute_groups(texts, least=0.8):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= least:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block, set_block", [(20_000, 1000), (7, 5)])
def test_near_copies_equal_brute_force(spark, monkeypatch, copies, block, set_block):
    monkeypatch.setattr(resemblance, "BLOCK", block)
    monkeypatch.setattr(resemblance, "SET_BLOCK", set_block)
    rows = [(i, t) for i, t in enumerate(copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in resemblance.similar_texts(docs, "doc_id").collect()}
    assert [got[i] for i in range(len(copies))] == brute_groups(copies)
    kept = simhash.keep_one(docs, grouped=resemblance.similar_texts)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_groups(copies)))


def test_near_copies_of_odd_tables(spark):
    schema = "doc_id long, text string, node long, bucket long, signature string, n long, component string"
    rows = [(1, None), (2, ""), (None, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g"), (4, "x" * 200_000), (4, "y " * 100_000)]
    docs = spark.createDataFrame([(*r, 1, 2, "s", 3, "c") for r in rows], schema)
    kept = simhash.keep_one(docs, grouped=resemblance.similar_texts)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], (r["text"] or "")[:1]) for r in kept.collect()) == [(1, ""), (3, "a"), (4, "x"), (4, "y")]
    assert simhash.keep_one(docs.limit(0), grouped=resemblance.similar_texts).count() == 0


def test_walk_spans_what_all_pairs_join():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 30):
        both = rng.random((n, n)) < 0.06
        both |= both.T
        edges = resemblance.walk(n, lambda i, rest: both[i, rest])  # noqa: B023
        label = list(range(n))
        for _ in range(n):
            for i in range(n):
                for j in range(n):
                    if both[i, j]:
                        label[i] = label[j] = min(label[i], label[j])
        assert len(edges) == n - len(set(label)) and all(label[i] == label[j] for i, j in edges)


def test_overlaps_count_shared_values():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(17)]
    for cells in (1, 100, 1 << 24):
        got = resemblance.overlaps(sets, cells)
        for i in range(17):
            for j in range(17):
                if i != j:
                    assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_scratch_keeps_what_it_is_told(spark):
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir", None) or "/tmp"))
    with scratch(spark) as keep:
        first = stored(spark.range(3), "scratch-one")
        with scratch(spark) as inner:
            second = inner(first.selectExpr("id + 1 AS id"), "scratch-two")
        third = keep(second.selectExpr("id * 2 AS id"), "scratch-three")
    left = {n for n in set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - before if n.startswith("scratch-")}
    assert [n.split("-")[1] for n in left] == ["three"]
    assert sorted(r["id"] for r in third.collect()) == [2, 4, 6]
