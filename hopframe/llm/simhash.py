"""SimHash fingerprints linked through anchors of a covering code.

Anchors are pairs of codewords of the binary Golay code, which covers 23 bits
with radius 3: bits 0-22 and 23-45 of a fingerprint each lie within 3 bits of
exactly one codeword.  A fingerprint is at home at its nearest anchor, and a
copy goes to every anchor within covering radius plus threshold: with
differing bits split between the two halves, to all codewords whose distances
exceed the radius by ``threshold`` bits together.  Two fingerprints within the
threshold then meet at the home of either.  They are compared over all 64 bits
there.  The 18 bits outside the code only take part in that comparison.

Equal fingerprints are one record before anything is replicated, and a
fingerprint has at most 2,081 others within two bits, so links stay linear in
the number of distinct fingerprints.  Components come from joins and minima;
nothing is gathered in one place.

Nulls: a null text has no words and the fingerprint zero, which links like any
other.  Rows without an id get the component of their fingerprint.  Rows that
share an id are fingerprinted each.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm._store import stored, way

SHINGLE, BITS_APART = 3, 2
RADIUS, BLOCK = 3, 23
GENERATOR = 0b101011100011  # of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def bit_sums(hashes: np.ndarray, step: int = 8192) -> np.ndarray:
    """How often each of the 64 bits is set."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), step):
        part = hashes[i : i + step].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if set in over half of the shingle hashes; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII blanks part
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n)), dtype=np.uint64, count=n)
    set_bits = bit_sums(hashes) * 2 > n
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    id_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["id", "fp"])

    return docs.select(key, text).mapInArrow(run, f"id {id_type}, fp long").select(F.col("id").alias(key), "fp")


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials by the generator: 11 bits, zero for codewords."""
    rest = words.astype(np.int64)
    for bit in range(BLOCK - 1, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def near_codewords(reach: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each syndrome the error patterns of up to RADIUS + reach bits and by how much they exceed the radius."""
    patterns = np.array([sum(1 << i for i in c) for w in range(RADIUS + reach + 1) for c in combinations(range(BLOCK), w)], dtype=np.int64)
    weight = np.array([bin(int(p)).count("1") for p in patterns])
    of = syndrome(patterns)
    order = np.lexsort((patterns, weight, of))
    bounds = np.searchsorted(of[order], np.arange(2049))
    return [
        (patterns[order[a:b]], np.maximum(weight[order[a:b]] - RADIUS, 0)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)
    ]


def anchored(prints: DataFrame, threshold: int = BITS_APART) -> DataFrame:
    """(anchor, fp, home): each distinct fingerprint at its home and at all anchors within radius plus threshold."""

    def run(batches):
        near = near_codewords(threshold)
        low = (1 << BLOCK) - 1
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                fps = batch.column(0).slice(at, 2000).to_numpy(zero_copy_only=False).astype(np.int64)
                first, second = fps & low, (fps >> BLOCK) & low
                anchors, owners, homes = [], [], []
                for fp, a, b, s, t in zip(fps, first, second, syndrome(first), syndrome(second), strict=True):
                    (pa_, ea), (pb_, eb) = near[s], near[t]
                    over = ea[:, None] + eb[None, :]
                    i, j = np.nonzero(over <= threshold)
                    anchors.append((a ^ pa_[i]) | ((b ^ pb_[j]) << BLOCK))
                    owners.append(np.full(len(i), fp, dtype=np.int64))
                    homes.append(over[i, j] == 0)
                if anchors:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(anchors)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(homes))],
                        ["anchor", "fp", "home"],
                    )

    return prints.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def links(prints: DataFrame, threshold: int = BITS_APART) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within ``threshold`` bits, both ways round; ``prints`` is stored.

    The copies are some sixty times the fingerprints, which Spark does not see: they are never sent whole.
    """
    spread = anchored(prints, threshold)
    homes = spread.where("home").select("anchor", F.col("fp").alias("a"))
    copies = spread.select("anchor", F.col("fp").alias("b"))
    return homes.join(copies.hint("merge"), "anchor").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for nodes of ``edges`` (a, b), a stored table with both directions.

    Each round takes the least label among a node and its neighbours, then
    follows labels once more (pointer jumping); rounds are written out, so a
    lost executor costs one round.
    """
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "components")
    hint = way(labels)  # no side joined below has more rows
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label").hint(hint), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near.hint(hint), labels.node == near.a).select("node", F.least("label", "m").alias("next"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("further"))
        moved = stored(lower.join(jump.hint(hint), "next").select("node", F.least("next", "further").alias("label"), "was"), "components")
        labels = moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            return labels.withColumnRenamed("label", "component")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = BITS_APART) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id: the least id reachable over linked fingerprints)."""
    marked = stored(fingerprints(docs, key, text), "simhash")
    prints = stored(marked.groupBy("fp").agg(F.min(key).alias("least")), "simhash-prints")
    pairs = stored(links(prints, threshold).distinct(), "simhash-links")
    groups = components(pairs)
    hint = way(prints)  # there are no more groups than fingerprints
    named = prints.join(groups.hint(hint), prints.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(first.hint(hint), "component").select("fp", "component_id")
    return marked.join(classes.hint(hint), "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", grouped=near_duplicates) -> DataFrame:
    """One row of each component: the one of the least id, then of the least text digest; rows without an id come last.

    Rows are told apart by id and text, so rows that share an id, or have none,
    stand for themselves.  ``grouped`` takes (documents, key, text) and names
    the ``component_id`` of each key; here a 64-bit digest of the text is the key.
    """
    digest = F.xxhash64(F.coalesce(text, F.lit("")))
    found = grouped(docs.select(digest.alias("__text"), text), "__text", text).groupBy("__text").agg(F.min("component_id").alias("__component"))
    own = F.when(F.col(key).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(key).cast("string")))
    # Rows of the same id and text become one before any join, however many there are.
    single = docs.groupBy(digest.alias("__text"), own.alias("__own")).agg(F.min(F.struct(*docs.columns)).alias("__row"))
    least = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), digest.alias("__text"), own.alias("__own")))
    of_text = docs.groupBy(digest.alias("__text")).agg(least.alias("best"))
    chosen = of_text.join(found.hint("merge"), "__text").groupBy("__component").agg(F.min("best").alias("best")).select("best.__text", "best.__own")
    return single.join(chosen, ["__text", "__own"], "left_semi").select("__row.*")
