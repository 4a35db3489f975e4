"""Spelling groups against comparison of all words."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hopframe.llm import queries, spelling
from hopframe.llm._store import stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_words(rows, damage=97):
    n = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = lower_az(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n, pairs=None):
    by = {w: [] for w in n}
    for a, b in pairs if pairs is not None else ((a, b) for a in n for b in n if a < b and abs(len(a) - len(b)) <= 1 and near(a, b)):
        by[a].append(b)
        by[b].append(a)
    form = {}
    for w, others in by.items():
        if others:
            best = min(others, key=lambda o: (-n[o], o))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(by[w]), n[form[w]] if w in form else None)
    return out


def deletions(n):
    """Near pairs through common deletions, for tables too large to compare all words."""
    by, pairs = {}, set()
    for w in n:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(v, []).append(w)
    for group in by.values():
        pairs |= {(a, b) for a in group for b in group if a < b and near(a, b)}
    return pairs


def rows_of(df):
    found = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r["word"] for r in found}) == len(found)
    return {r["word"]: tuple(r)[1:] for r in found}


def test_query_against_all_words(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n = brute_words(docs)
    want = brute(n, deletions(n))
    got = rows_of(queries.op12_spelling(spark, sf))
    assert got == want
    assert sum(w[0] is not None for w in want.values()) > 20


WORD = st.text("abé", min_size=5, max_size=9)


@given(st.dictionaries(WORD, st.integers(3, 40), min_size=1, max_size=40), st.integers(1, 60))
@settings(max_examples=200, deadline=None)
def test_lists_of_near_words_meet(words, share):
    """The lemma: at any pruning, two words at one edit have a gram in common among their chosen ones, at fitting places."""
    counts = Counter(g for w in words for k in (2, 3, 4) for m in ["^" + w + "$$$"] for g in [m[p : p + k] for p in range(len(w) + 1)])
    places = sum(len(w) + 1 for w in words)
    frequent = {g: c for g, c in counts.items() if c * share > places}
    chosen = {}
    for w in words:
        grams, bound = spelling.decompose(w, frequent)
        assert bound <= 4 < len(grams)
        chosen[w] = {(grams[p], p) for p in sorted(range(len(grams)), key=lambda p: (frequent.get(grams[p], 0), grams[p], p))[: bound + 1]}
    for a in words:
        for b in words:
            if near(a, b) and len(a) >= len(b):
                shifts = (0,) if len(a) == len(b) else (0, 1)
                assert any((g, p - s) in chosen[b] for g, p in chosen[a] for s in shifts)
                assert bin((spelling.parity(a) ^ spelling.parity(b)) & (2**64 - 1)).count("1") <= 2


@pytest.mark.parametrize("share", [1, 30, 50_000])
def test_groups_at_any_pruning(spark, share):
    import itertools
    import random

    rng = random.Random(5)
    n = {"".join(w): rng.randint(3, 60) for w in itertools.islice(itertools.product("abé", repeat=6), 0, 700, 3)}
    n |= {w + rng.choice("abéz"): rng.randint(3, 60) for w in [*n][:120]} | {"a" * k: 3 * k for k in range(5, 12)}
    table = stored(spark.createDataFrame([*n.items()], "word string, n long"), "test-words")
    assert rows_of(spelling.group_variants(table, share=share)) == brute(n)


def test_form_ties_and_chains(spark):
    n = {"abcde": 3, "abcdx": 12, "abcdf": 12, "abcdfg": 24, "zzzzz": 9, "zzzzy": 5, "zzzzzz": 10}
    table = stored(spark.createDataFrame([*n.items()], "word string, n long"), "test-words")
    got = rows_of(spelling.group_variants(table))
    assert got["abcde"] == ("abcdf", "abcdfg", 3, 2, 12)
    assert got["zzzzy"] == (None, "zzzzy", 5, 1, None)  # 9 is less than twice 5; "zzzzzz" is two edits away
    assert got == brute(n)


def test_odd_tables(spark, monkeypatch):
    rows = [
        (1, "Éclair éclair ÉCLAIR eclair"), (2, None), (3, ""), (None, "Hello hello HELLO helloo helloo helloo jello"), (5, "wörld wörld wörld×wörld"),
        (5, "wörld wörld wörld×wörld"), (6, ("longword shortwords " * 90_000) + "x" * 3000), (7, "abcd abcd abcd abcde abcde abcde"),
    ]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n long")
    want = brute(brute_words(rows))
    assert rows_of(spelling.variants(df)) == want
    monkeypatch.setattr(spelling, "HELD", 3)
    monkeypatch.setattr(spelling, "STEP", 64)
    assert rows_of(spelling.variants(df)) == want
    assert rows_of(spelling.variants(df, damage=None)) == brute(brute_words(rows, None))
    assert spelling.variants(df.limit(0)).count() == 0
    assert spelling.variants(df.withColumn("text", F.lit(None).cast("string"))).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(df, least_length=3)
