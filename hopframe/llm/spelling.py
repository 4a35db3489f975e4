"""Spelling variants by an index of variable-length grams.

Words get a mark before and marks behind them.  A gram starts at every place
but the last marks: two characters, and one more as long as the gram so far is
frequent and shorter than ``LONGEST``.  Which grams are frequent is counted over
all words; the dictionary of frequent grams is pruned at the total of gram
places over ``SHARE``, so it has at most ``SHARE`` grams of each length, however
many words there are.  Whether a gram ends depends on its own characters only,
so an edit leaves every gram alone that does not cover it.

The affected-gram bound of a word is the largest number of its grams that cover
one character.  Words at one edit share all but so many grams, in the same
order and at places shifted by what the edit inserts.  The first shared gram in
an order by frequency then lies among the bound plus one rarest grams of both
words.  Only these lists are merged, by gram, length and place; pairs that meet
are compared by the parity of their letters and verified by edit distance.  As
words have at least ``LONGEST`` characters, the bound never uses up all grams and
no pair needs another path.

Nulls: a null text has no words; a null id counts as an empty text.  Repeated
documents count each time.  Very long texts are read in blocks cut between
words; a single run is held whole.  An empty table gives an empty result.
Other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopframe.llm._store import stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
OUTSIDE = re.compile(rb"[^A-Za-z\x80-\xff]")
SHORTEST, LONGEST, SHARE = 2, 4, 50_000
LEAST_LENGTH, LEAST_COUNT = 5, 3
DAMAGE = 97
HEAD, TAIL = "^", "$"
STEP = 1 << 20  # bytes of a text read at once
HELD = 400_000  # distinct words or grams a task holds


def _tally(batches, counts_of, name: str):
    """Sums of ``counts_of(batch)`` (pairs of a text and a number) by text, emitted whenever a task holds many."""

    def out(total):
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], [name, "n"])

    total: dict[str, int] = {}
    for batch in batches:
        for text, n in counts_of(batch):
            total[text] = total.get(text, 0) + n
            if len(total) >= HELD:
                yield out(total)
                total = {}
    if total:
        yield out(total)


def _parts(raw: bytes):
    at = 0
    while at < len(raw):
        found = OUTSIDE.search(raw, at + STEP)
        end = found.start() if found else len(raw)
        yield raw[at:end].decode()
        at = end


def word_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int | None = DAMAGE
) -> DataFrame:
    """(word, n): letter runs in lower case, of a least length and count.

    With ``damage``, a run loses one code point where that number divides the
    checksum of id and run, which plants variants of known origin.
    """

    def counts_of(batch):
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            start = crc32(f"{doc}:".encode())
            for part in _parts((raw.as_py() or b"").lower()):
                for word, n in Counter(RUN.findall(part)).items():
                    if len(word) < least_length:
                        continue  # a lost code point only makes it shorter
                    if damage:
                        h = crc32(word.encode(), start)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                    yield word, n

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text).cast("binary"))
    found = rows.mapInArrow(lambda batches: _tally(batches, counts_of, "word"), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def frequent_grams(words: DataFrame, share: int = SHARE, longest: int = LONGEST) -> dict[str, int]:
    """Grams of up to ``longest`` characters found at more than one of ``share`` gram places, with their counts."""

    def counts_of(batch):
        seen = Counter()
        for word in batch.column(0).to_pylist():
            marked = HEAD + word + TAIL * (longest - 1)
            for size in range(SHORTEST, longest + 1):
                seen.update([marked[p : p + size] for p in range(len(word) + 1)])
        return seen.items()

    places = words.agg(F.sum(F.length("word") + 1)).head()[0] or 0
    found = words.select("word").mapInArrow(lambda batches: _tally(batches, counts_of, "gram"), "gram string, n long")
    return {r["gram"]: r["n"] for r in found.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") * share > places).collect()}


def decompose(word: str, frequent, longest: int = LONGEST) -> tuple[list[str], int]:
    """The gram at every place, and the affected-gram bound: how many cover one character at most."""
    marked, n = HEAD + word + TAIL * (longest - 1), len(word) + 1
    grams, change = [], [0] * (n + longest + 1)
    for p in range(n):
        size = SHORTEST
        while size < longest and marked[p : p + size] in frequent:
            size += 1
        grams.append(marked[p : p + size])
        change[p] += 1
        change[p + size] -= 1
    covering, bound = change[0], 0
    for i in range(1, n):
        covering += change[i]
        bound = max(bound, covering)
    return grams, bound


def parity(word: str) -> int:
    """A bit per letter, set if it occurs an odd number of times; letters may share one of the 64 bits."""
    mask = 0
    for c in word:
        mask ^= 1 << (ord(c) & 63)
    return mask - (1 << 64) if mask >> 63 else mask


def lists(words: DataFrame, frequent: dict[str, int], longest: int = LONGEST) -> DataFrame:
    """Each word with its parity and the places and texts of its bound plus one rarest grams."""

    def run(batches):
        for batch in batches:
            masks, grams, places = [], [], []
            for word in batch.column(0).to_pylist():
                own, bound = decompose(word, frequent, longest)
                chosen = sorted(range(len(own)), key=lambda p: (frequent.get(own[p], 0), own[p], p))[: bound + 1]  # noqa: B023
                masks.append(parity(word))
                grams.append([own[p] for p in chosen])
                places.append(chosen)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(masks, pa.int64()), pa.array(grams, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))],
                ["word", "n", "mask", "grams", "places"],
            )

    return words.select("word", "n").mapInArrow(run, "word string, n long, mask long, grams array<string>, places array<int>")


def near_pairs(words: DataFrame, share: int = SHARE, longest: int = LONGEST) -> DataFrame:
    """Pairs (a, n_a, b, n_b) of the stored ``words`` (word, n) at edit distance one, each once; ``a`` is the longer or lesser."""
    listed = stored(lists(words, frequent_grams(words, share, longest), longest), "spelling-lists")
    rows = listed.select("word", "n", "mask", F.length("word").alias("size"), F.explode(F.arrays_zip("grams", "places")).alias("at"))

    def entry(size: Column, place: Column) -> Column:
        return F.xxhash64(F.col("at.grams"), size.cast("int"), place.cast("int"))

    size, place = F.col("size"), F.col("at.places")
    index = rows.select(entry(size, place).alias("entry"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("mask").alias("mask_b"), F.col("size").alias("size_b"))
    # A word asks words of its length at the same place, and shorter ones at the same place or one before.
    asked = rows.select(
        F.explode(F.array(entry(size, place), entry(size - 1, place), entry(size - 1, place - 1))).alias("entry"),
        F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("mask").alias("mask_a"), F.col("size").alias("size_a"),
    )
    met = asked.join(index, "entry").where(
        ((F.col("size_a") > F.col("size_b")) | (F.col("a") < F.col("b")))
        & (F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b"))) <= 2)
        & (F.levenshtein("a", "b", 1) == 1)
    )
    return met.select("a", "n_a", "b", "n_b").dropDuplicates(["a", "b"])


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of the stored ``links`` (word, form), which lead to ever more frequent words: paths are halved until they end."""
    state = links.select("word", F.col("form").alias("root"))
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = stored(state.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if state.where("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")


def group_variants(words: DataFrame, ratio: int = 2, share: int = SHARE, longest: int = LONGEST) -> DataFrame:
    """word, form, root, n, n_near, form_n of the stored ``words`` (word, n) of ``longest`` code points and more.

    The form is the near word of largest n, the least if tied, where it has
    ``ratio`` times the n of the word, else null.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    pairs = stored(near_pairs(words, share, longest), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("other_n"))
    )
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.first("n").alias("own"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other"))).alias("best")
    )
    good = -F.col("best.minus") >= ratio * F.col("own")
    near = stored(
        best.select("word", "n_near", F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.minus")).alias("form_n")), "spelling-near"
    )
    ends = roots(near.where("form IS NOT NULL"))
    return words.join(near, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int | None = DAMAGE) -> DataFrame:
    """The words of documents with their spelling groups."""
    if least_length < LONGEST:
        raise ValueError(f"words of fewer than {LONGEST} code points may share no gram")
    return group_variants(stored(word_counts(docs, key, text, least_length, least_count, damage), "spelling-words"))
