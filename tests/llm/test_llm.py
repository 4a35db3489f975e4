"""The training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hopframe.llm import chat, decontam, grading, langid, lm, mixing, quality_rules, queries, resemblance, sharding, simhash, sql, toxicity
from hopframe.llm._text import Tokens, lower_table, pack, pack_sorted, plain_words, space_words, unpack, unpack_sorted

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, key string, fp long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [
        (1, "The cat sat on the mat. " * 12, "en", "a"), (2, "The cat sat on the mat. " * 12, "en", "a"), (3, None, None, None), (4, "", "en", "b"),
        (5, "É ça va\tbien\nça va bien\n" * 9, "fr", None), (None, "no id here", "en", "a"), (6, "x" * 5000 + " " + "y z " * 4000, "en", "c"),
        (7, "   ", "fr", "c"), (7, "   ", "fr", "c"), (8, "!!! ### 12", None, "a"),
    ]
    return spark.createDataFrame([(*r, 1, 2, 0.5, "k", 9) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def words(text):
    return (text or "").encode().lower().split()


# --- helpers


@given(st.lists(st.text(max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_tokens_are_those_of_the_patterns(texts):
    raw = [t.encode("utf-8", "ignore") for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    for mask, split in ((space_words(), lambda b: b.lower().split()), (plain_words(), lambda b: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", b.lower()))):
        t = Tokens(data, offsets, mask, lower_table())
        got = [t.bytes[a:b].tobytes() for a, b in zip(t.starts, t.ends, strict=True)]
        want = [split(r) for r in raw]
        assert got == [w for x in want for w in x]
        assert np.diff(t.first).tolist() == [len(x) for x in want]
        hashes = t.hashes().tolist()
        assert len({*zip(got, hashes, strict=True)}) == len(set(got)) == len(set(hashes))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40))
def test_packing_is_reversible(values):
    x = np.array(values, dtype=np.uint64)
    assert unpack(pack(x)).tolist() == values
    assert unpack_sorted(pack_sorted(np.sort(x))).tolist() == sorted(values)


# --- 1 quality rules


def repeat_words(text, width=8):
    w = text.split()
    seen = Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    return len({p for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for p in range(i, i + width)})


def test_measures_match_brute_force(spark, odd):
    for r, m in zip(odd.collect(), quality_rules.measure(odd.withColumn("at", F.monotonically_increasing_id())).orderBy("at").collect(), strict=True):
        t = r["text"] or ""
        found = WORDS.findall(t)
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert m["n_words"] == len(found)
        assert m["word_chars"] == sum(map(len, found))
        assert m["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert m["n_dup_lines"] == len(lines) - len(set(lines))
        if " " not in t:
            assert m["n_repeat_words"] == repeat_words(t)


def test_binomial_tail(spark):
    rows = [(k, n) for n in (1, 7, 60, 1500) for k in {0, 1, n // 100, n // 60}]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect()
    for r in got:
        want = sum(math.comb(r["n"], i) * 0.02**i * 0.98 ** (r["n"] - i) for i in range(r["k"] + 1)) if r["k"] < r["n"] * 0.02 else 1.0
        assert r["p"] == pytest.approx(want, rel=1e-9)


def test_cutoffs_hold_their_risk(spark):
    """Of many good documents few are rejected; documents far outside go; thin strata reject nothing."""
    n = 4000
    base = spark.range(n).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "rare").otherwise("big").alias("stratum"), F.lit(100).alias("n_words"), F.lit(0).alias("n_repeat_words"),
        F.lit(500).alias("word_chars"), F.when(F.col("id") % 10 == 0, 90).otherwise(F.col("id") % 7).alias("n_symbols"), F.lit(0).alias("n_dup_lines"),
        F.lit(5).alias("n_capitals"), F.lit(3).alias("n_marks"),
    )
    labels = base.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    judged = quality_rules.judge(base, quality_rules.calibrate(base, labels))
    rates = {r["bad"]: r["kept"] for r in judged.where("stratum = 'big'").groupBy((F.col("doc_id") % 10 == 0).alias("bad")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rates[False] >= 0.95 and rates[True] == 0
    assert judged.where("stratum = 'rare' and not kept").count() == 0


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    rows = quality_rules.quality_rules(odd, labels).collect()
    assert len(rows) == 10 and all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (3, 4, 7))
    assert quality_rules.quality_rules(none, labels).count() == 0


# --- 2 SimHash


def brute_components(prints):
    ids = list(prints)
    group = {i: i for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_matches_brute_force(spark, sf, docs):
    from xxhash import xxh64_intdigest

    got = {r["doc_id"]: r for r in queries.op2_simhash(spark, sf).collect()}
    want = {}
    for i, r in docs.items():
        w = words(r["text"])
        shingles = [b" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        h = [xxh64_intdigest(s, 42) for s in shingles]
        want[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{x:016x}" for i, x in want.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(want)


def test_every_pair_within_two_bits_meets(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 12)
    flipped = [int(np.int64(b) ^ np.int64(np.uint64(1 << i | 1 << j).astype(np.int64))) for b in base[:4] for i in range(0, 64, 7) for j in range(0, 64, 9)]
    values = sorted({*map(int, base), *flipped})
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).distinct().collect()}
    assert got == {(a, b) for a in values for b in values if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


def test_components_of_a_long_chain(spark):
    n = 300
    ends = [(i, i + 1) for i in range(n)] + [(i + 1, i) for i in range(n)] + [(1000, 1001), (1001, 1000)]
    got = dict(simhash.components(spark.createDataFrame(ends, "a long, b long")).collect())
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_simhash_edges(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (3, 4)} == {"0" * 16}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert simhash.near_duplicates(none).count() == 0
    kept = [r["doc_id"] for r in simhash.keep_one(odd).collect()]
    assert 1 in kept and 2 not in kept and kept.count(7) <= 1 and set(simhash.keep_one(odd).columns) == set(odd.columns)


def test_keep_one_and_clean_judge_rows(spark):
    """Several rows without an id, and one id with two texts, one of which another id copies."""
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    rows = [(None, text[0], "s"), (None, text[1], "s"), (None, text[1], "s"), (1, text[2], "s"), (1, text[3], "s"), (0, text[3], "s"), (9, text[0], "s"), (2, text[4], "s"), (2, text[4], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    kept = sorted([(r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()], key=key)
    assert kept == [(0, text[3]), (1, text[2]), (2, text[4]), (9, text[0]), (None, text[1])]
    bench = spark.createDataFrame([("i", text[1]), ("j", text[2])], "item_id string, text string")
    left = sorted([(r["doc_id"], r["text"]) for r in decontam.clean(docs, bench).collect()], key=key)
    assert left == sorted([(r[0], r[1]) for r in rows if r[1] not in (text[1], text[2])], key=key)


def test_planted_copies_by_similarity(spark):
    """Copies of 400 words with so many changed words that five-word shingles agree to 0.98 ... 0.6, a chain, and brute force over all."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for changed in (1, 2, 4, 7, 8, 9, 10, 14, 20):
        for _ in range(4):
            base = rng.choice(vocabulary, 400).tolist()
            copy = list(base)
            for at in np.linspace(5, 390, changed).astype(int):
                copy[at] = "new"
            texts += [" ".join(base), " ".join(copy).upper()]
    chain = rng.choice(vocabulary, 300).tolist()
    texts += [" ".join(chain[i : i + 240]) for i in range(0, 60, 10)]
    texts += ["", "  ", "a b", "A  b", "a c"]
    cut = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in cut]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                group = [group[j] if g == group[i] else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    want = sorted({min(i for i, g in enumerate(group) if g == h) for h in group})
    assert got == want and len(texts) - len(want) > 25


# --- 3 language model


def test_lm_matches_direct_counts(spark, sf, docs):
    rows = {r["doc_id"]: r for r in queries.op3_lm_scoring(spark, sf).collect()}
    tokens = {i: [*words(r["text"]), None] for i, r in docs.items()}
    training = [i for i in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in training for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, r in rows.items():
        assert r["held_out"] == (i not in training)
        assert (r["n_tokens"], r["train_tokens"]) == (len(tokens[i]), n)
        assert r["n_known"] == sum(c[w] > 0 for w in tokens[i])
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[i]), rel=1e-9)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_score_is_the_mixture(spark, monkeypatch):
    """With fixed weights the score equals a direct computation, over several blocks."""
    texts = ["a b a c", "b a b", "a b a c", None, "z q", "c c c b a"]
    docs = spark.createDataFrame([(i, t, i != 4) for i, t in enumerate(texts)], "doc_id long, text string, training boolean")
    monkeypatch.setattr(lm, "learn_weights", lambda counts, types: {b: (0.5, 0.3, 0.2) for b in range(1, 65)} | {0: (0.0, 0.6, 0.4)})
    monkeypatch.setattr(lm, "BLOCK_BYTES", 8)
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs).collect()}
    seqs = [[*(t or "").split(), "</>"] for t in texts]
    train = [s for i, s in enumerate(seqs) if i != 4]
    c, pair = Counter(w for s in train for w in s), Counter(p for s in train for p in zip(["<>", *s], s, strict=False))
    n, v = sum(c.values()), len(c)
    for i, s in enumerate(seqs):
        want = 0.0
        for h, w in zip(["<>", *s], s, strict=False):
            ch = len(train) if h == "<>" else c[h]
            mix = (0.5, 0.3, 0.2) if ch else (0.0, 0.6, 0.4)
            want += math.log10(mix[0] * (pair[h, w] / ch if ch else 0) + mix[1] * c[w] / n + mix[2] / (v + 1))
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_lm_edges(spark, odd, none):
    marked = odd.withColumn("training", F.lit(True))
    rows = lm.lm_scores(marked).collect()
    assert len(rows) == 10 and all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (3, 4))
    assert all(r["score"] <= 0 for r in rows)
    untrained = lm.lm_scores(odd.withColumn("training", F.lit(False))).collect()
    assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in untrained)
    assert lm.lm_scores(none.withColumn("training", F.lit(True))).count() == 0


# --- 4 mixing, 5 sharding, 10 decontamination against SQL


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_queries_match_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(sql.oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == columns
    rows = sorted([tuple(r[c] for c in columns) for r in got.collect()])
    for a, b in zip(rows, sorted(want.project(", ".join(columns)).fetchall()), strict=True):
        assert a == pytest.approx(b) if not any(isinstance(x, str) for x in a) else a == b


def test_mix_follows_its_table(spark, odd, none):
    table = mixing.mix_table(odd)
    assert table.count() == 10
    assert mixing.mix(odd).count() == table.agg(F.sum("times")).first()[0]
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix(none).count() == mixing.mix_table(none).count() == 0


def test_mix_targets_are_met(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    sums = mixing.mix_table(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert sum(r["target"] for r in sums) == pytest.approx(sum(r["source_size"] for r in sums))
    assert all(abs(r["taken"] - r["target"]) <= 8 and r["target"] <= 3 * r["source_size"] for r in sums)


def test_mix_cuts_through_equal_rows(spark):
    """The threshold of a source falls among 60 rows of one id and text; query, SQL and corpus agree."""
    import duckdb

    rows = [(1, "w " * 15, "b")] * 60 + [(i, "w " * 10, "b") for i in range(2, 12)] + [(i, "w " * 10, "a") for i in range(20, 420)]
    rows += [(500, "w " * 50, "c")] * 40 + [(501, None, None)] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    table = mixing.mix_table(frame)
    got = sorted(tuple(r[c] for c in columns) for r in table.collect())
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    want = sorted(con.sql(sql.oracle_sql()["op4_mixing"]).project(", ".join(columns)).fetchall())
    assert got == [pytest.approx(w) for w in want]
    for r in table.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= r["most"] / 2
    mixed = mixing.mix(frame).groupBy("doc_id").count().collect()
    assert dict(mixed) == {k: n for k, n in table.groupBy("doc_id").agg(F.sum("times")).collect() if n}


def test_shards(spark, sf, docs):
    rows = queries.op5_sharding(spark, sf).collect()
    assert all(r["text_crc32"] == zlib.crc32(docs[r["doc_id"]]["text"].encode()) and r["size"] == len(docs[r["doc_id"]]["text"].encode()) + 1 for r in rows)
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert {r["grown_shard"] for r in rows if r["grown_shard"] != r["shard"]} <= {8}

    def draw(key, shard):
        return -math.log((int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)

    assert all(r["shard"] == min(range(8), key=lambda s: draw(r["doc_id"], s)) for r in rows)


def test_shard_weights_and_edges(spark, odd, none):
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = dict(sharding.shard(many, (3, 1, 0)).groupBy("shard").count().collect())
    assert set(got) == {0, 1} and abs(got[0] / 20000 - 0.75) < 0.02
    rows = sharding.shard(odd, (1, 1), keep=odd.columns).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, i) for s in (0, 1) for i in range(sum(r["shard"] == s for r in rows))]
    assert sharding.shard(none).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of("doc_id", [0, 0])


# --- 6 language, 8 toxicity, 9 grades


def test_language_accuracy(spark, sf, docs):
    rows = queries.op6_langid(spark, sf.replace("0.001", "0.01")).where("held_out").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").collect()}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, odd, none):
    learned = langid.learn(odd)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd, learned).collect()}
    assert {got[i] for i in (3, 4, 7, 8)} == {"und"} and got[5] == "fr" and got[1] == "en"
    assert langid.predict(none, learned).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.learn(none)).collect()} == {"und"}


def test_toxicity_finds_altered_insults(spark):
    rng = np.random.default_rng(3)
    syllables = ["an", "er", "th", "on", "in", "ed", "re", "ou", "ti", "le"]
    line = lambda: " ".join("".join(rng.choice(syllables, 3)) for _ in range(8))
    bags = [(0, [line() for _ in range(5)]) for _ in range(120)] + [(1, [line(), f"{line()} blockhead {line()}", line()]) for _ in range(60)]
    model = toxicity.fit(bags)
    score = lambda t: float(model.scores(model.text_margins([t]))[0])
    for text in ("an blockhead", "an bloxckhead", "an b.l.o.c.k.h.e.a.d", "an b l o c k h e a d er", "blockheads"):
        assert score(text) >= 0.5, text
    assert np.mean([score(line()) < 0.5 for _ in range(100)]) >= 0.97
    assert score("") < 0.5 and score("z" * 3000) < 0.7


def test_kernel_of_many_words_of_one_length():
    """1,000 words of one length have the kernel each has alone, and the folded margins are those of the features."""
    rng = np.random.default_rng(4)
    found = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(1000)]
    maker, marks = toxicity.Words(toxicity.SYMBOL_OF), found[:12]
    used = sorted({int(c) for w in marks for codes, _ in maker.codes([w]) for c in np.unique(codes)})
    columns = np.full(2 * toxicity.SLOTS, len(used), dtype=np.int32)
    columns[used] = np.arange(len(used))
    features = rng.normal(size=(len(used) + 1, len(marks))).astype(np.float32)
    features[-1] = 0
    got = toxicity._kernel(found, maker, columns, features)
    assert np.allclose(got, np.vstack([toxicity._kernel([w], maker, columns, features) for w in found]), atol=1e-4)
    weights = rng.normal(size=len(marks))
    table = np.zeros(2 * toxicity.SLOTS, dtype=np.float32)
    table[used] = (features[:-1] @ weights).astype(np.float32)
    assert np.allclose(toxicity.Model(table, 0.25, 1.0, 0.0).margins(found), got @ weights + 0.25, atol=1e-3)


def test_toxicity_kernel_is_a_count_of_subsequences():
    """Margins against every pick of three and four characters within the span, counted one by one."""
    from itertools import combinations

    rng = np.random.default_rng(5)
    table = rng.normal(size=2 * toxicity.SLOTS).astype(np.float32)
    of = toxicity.symbol_table()
    for word in ("scum", "w0rthless", "ça", "it", "x" * 24, "disgusting"):
        s = [int(of[ord(c)]) for c in f"^{word}$"]
        total = 0.0
        for k in (3, 4):
            for at in combinations(range(len(s)), k):
                if at[-1] - at[0] <= toxicity.SPAN:
                    code = 0
                    for i in at:
                        code = code * toxicity.SYMBOLS + s[i]
                    slot = code if k == 3 else toxicity.SLOTS + ((code * 40503) >> 6) % toxicity.SLOTS
                    total += toxicity.DECAY ** (at[-1] - at[0] + 1 - k) * float(table[slot])
        got = toxicity.Model(table, 0.5, 1.0, 0.0).margins([word])[0]
        assert got == pytest.approx(total / toxicity.length_norm(len(word)) + 0.5, rel=1e-3, abs=1e-3)


def test_toxicity_learns_insults_of_few_sentences():
    """Three toxic sentences with one insult are enough on a small table; no number of sentences is required."""
    rng = np.random.default_rng(9)
    calm = [" ".join(rng.choice("the sun rises over green hills and rivers while children play games near old houses".split(), 9)) for _ in range(120)]
    bags = [(0, calm[3 * i : 3 * i + 3]) for i in range(30)] + [(1, [calm[90 + i], f"{calm[100 + i]} grubwort {calm[110 + i]}"]) for i in range(3)]
    model = toxicity.fit(bags)
    margins = model.text_margins(["the sun and a grubwort", "old hills and rivers", "a gru-bwort near houses"])
    assert margins[0] > margins[1] and margins[2] > margins[1]


def test_toxicity_edges(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 0), (8, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels)
    rows = toxicity.add_scores(odd, model, column="tox").collect()
    assert len(rows) == 10 and all(0 <= r["tox"] <= 1 for r in rows)
    assert toxicity.add_scores(none, model, column="tox").count() == 0
    nothing = toxicity.learn(none, labels)
    assert {r["tox"] for r in toxicity.add_scores(odd, nothing, column="tox").collect()} == {0.0}


def test_grades(spark, sf):
    big = sf.replace("0.001", "0.01")
    rows = queries.op9_quality_classifier(spark, big).where("held_out").collect()
    bad = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    good = [r["expected_grade"] for r in rows if bad.get(r["doc_id"]) == 1]
    poor = [r["expected_grade"] for r in rows if bad.get(r["doc_id"]) == 0]
    assert np.mean([g > p for g in good for p in poor]) > 0.9  # area under the curve
    assert all(0 <= r["tail"] <= 1 and r["tail"] <= r["expected_grade"] for r in rows)


def test_repeated_id_counts_once_in_the_fit(spark):
    """One id repeated many times: the model is that of the same table with each id once."""
    rows = [(i, f"word{i % 7} {'good fine' if i % 2 else 'bad poor'} text{i % 3}", 2 * (i % 2)) for i in range(60)]
    once = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    often = once.union(spark.createDataFrame([rows[4][:2]] * 500, "doc_id long, text string"))
    ratings = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, grade int")
    a, b = (grading.learn(d, ratings) for d in (once, often))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds) and len(a.thresholds)


def test_thresholds_are_ordered():
    rng = np.random.default_rng(1)
    rows = [(g, np.array([g, 3 + g]), np.array([15, 15])) for g in rng.integers(0, 3, 300).tolist()]
    model = grading.fit(rows, {0: 0.3, 1: 0.3, 2: 0.4})
    assert (np.diff(model.thresholds) > 0).all()
    assert [round(float(model.tails(i, v).sum())) for _, i, v in rows[:20]] == [g for g, _, _ in rows[:20]]


def test_grade_edges(spark, odd, none):
    ratings = spark.createDataFrame([(1, 2), (4, 0), (5, 1), (8, None)], "doc_id long, grade int")
    model = grading.learn(odd, ratings)
    assert grading.predict(odd, model).count() == 10 and grading.predict(none, model).count() == 0
    assert {r["tail"] for r in grading.predict(odd, grading.learn(none, ratings)).collect()} == {0.0}


# --- 7 chat


@given(st.text(alphabet="<|end>\\s/[INST]<S Yaturn", max_size=60))
@settings(max_examples=300, deadline=None)
def test_escaping_is_reversible(text):
    escape = chat.Escape()
    hidden = escape.hide(text)
    assert escape.show(hidden) == text
    assert not any(c in hidden for c in chat.CONTROLS)


def test_chat_round_trip(spark, sf):
    rows = {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        rows.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    rows[-7] = [("user", queries.ADDED), ("assistant", queries.ADDED)]
    got = {r["conv_id"]: r for r in queries.op7_chat(spark, sf).collect()}
    assert set(got) == set(rows)
    for c, turns in rows.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_edges(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (1, 1, "assistant", "<|end|>"), (None, 0, "user", "hi"), (None, 1, "assistant", "a" * 3000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(frame)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 7 and got[None]["loss_chars"] == 3000
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0


def test_chat_reads_any_layout(spark, tmp_path):
    """Segments written, dealt anew by something else and reread give the same digests."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in range(30) for t in range(6)]
    formatted = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    formatted.repartition(7, F.xxhash64("seq", "conv_id")).write.parquet(str(tmp_path / "segments"))
    stored = spark.read.parquet(str(tmp_path / "segments"))
    assert sorted(chat.read_back(stored).collect()) == sorted(chat.read_back(formatted).collect())
    assert {r["n_turns"] for r in chat.read_back(stored).collect()} == {6}


def test_a_score_replaces_a_column_of_its_name(odd):
    scored = toxicity.add_scores(odd, toxicity.fit([]))
    assert scored.columns.count("score") == 1 and {r["score"] for r in scored.collect()} == {0.0}


# --- 10 decontamination


def test_index_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(6)]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 60)))) for _ in range(60)] + [None, "", "W1 w2, w3"]
    items = [" ".join(rng.choice(vocabulary, int(k))) for k in (0, 1, 2, 3, 4, 5, 6)] + ["w1 w2 w3", "w1 w2 w3", None, "absent word"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, term string, segment long")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    split = lambda t: re.findall(r"[0-9a-z]+", (t or "").lower())
    for bound in (0, 100):  # all terms indexed, and only those of the test set
        got = {r["doc_id"]: r for r in decontam.contamination(docs, bench, width=4, bound=bound).collect()}
        for i, t in enumerate(texts):
            w, hit, found = split(t), set(), set()
            for j, item in enumerate(items):
                q = split(item)
                for window in [q[k : k + 4] for k in range(max(1, len(q) - 3))] if q else []:
                    for p in range(len(w) - len(window) + 1):
                        if w[p : p + len(window)] == window:
                            hit.update(range(p, p + len(window)))
                            found.add(str(j))
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(found))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two x three four"), (2, "one two three four"), (3, "one x x x x two three four"), (4, "one two"), (5, "three four")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "one two three four")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(docs, bench, slop=1).collect()}
    assert got[1]["near_items"] == ["9"] and got[1]["n_hit"] == 0
    assert got[2]["items"] == ["9"] and got[2]["near_items"] == []
    assert all(got[i]["near_items"] == [] for i in (3, 4, 5))


def test_decontamination_edges(spark, odd, none):
    bench = spark.createDataFrame([(1, "cat sat on"), (None, "va bien"), (2, None)], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontam.contamination(odd, bench).collect() if r["doc_id"] != 7}
    assert rows[1]["items"] == ["1"] and rows[5]["items"] == [""] and rows[3]["n_words"] == 0
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.clean(odd, bench).count() == 7


# --- pipeline


def test_pipeline(spark, sf, docs):
    import corpus_pipeline

    frame, kept = spark.read.parquet(f"{sf}/documents.parquet"), None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf)
        assert set(frame.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        kept = frame
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} <= set(docs) and len(rows) == kept.count()
