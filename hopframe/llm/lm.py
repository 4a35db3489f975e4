"""Deleted interpolation of n-gram estimates, trained and applied without moving a row per word.

The model is P(w | h) = a(h) c(h, w) / c(h) + b(h) c(w) / N + (1 - a - b) / (V + 1),
with maximum-likelihood estimates of word pairs and words, a uniform rest that
also covers unknown words, and mixture weights per bucket of the context's
frequency (powers of two).  The weights are learned by expectation-
maximisation on held-out counts: a fifth of the documents, by a hash of their
id, is deleted from the counts, and its training texts show how well the counts
of the others predict.  The final counts hold all training texts.

Texts are dealt to blocks of a few megabytes, deleted ones to blocks of their
own, so the weights depend on neither the size nor the number of blocks.  A block asks for each of its
distinct words and pairs once: sorted 64-bit hashes and its own counts, packed
per hash range.  A range sums what the blocks send and answers each in the
order it asked.  So per distinct pair and block about six bytes move, and a
frequent word is one entry per block whatever its share.  Blocks and ranges
grow in number with the input, not in size; rows that are equal in id and text
share a block.  Words and pairs are compared by 64-bit hashes.

Nulls: a null or empty text is one end token.  A null id hashes like an empty
text.  Repeated rows count each.  Without training texts all counts are zero
and the uniform part decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopframe.llm._store import stored
from hopframe.llm._text import Tokens, chain, lower_table, pack, pack_sorted, row_chunks, space_words, text_buffers, unpack, unpack_sorted

BLOCK_BYTES = 8 << 20
RANGE_BYTES = 12 << 20
DELETED = 5  # one document in so many is deleted while weights are learned
END, BEGIN = np.uint64(1), np.uint64(2)
BINS = 8  # steps of a natural logarithm in the held-out histogram
ROUNDS = 60


def _sequence(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in a row: token hashes with an end after each text, pair hashes, and n + 1 bounds."""
    parts, sizes = [], []
    for a, b in row_chunks(offsets, 1 << 20):
        bounds = offsets[a : b + 1]
        t = Tokens(raw[bounds[0] : bounds[-1]], bounds - bounds[0], space_words(), lower_table())
        parts.append(np.insert(t.hashes(), t.first[1:], END))
        sizes.append(np.diff(t.first) + 1)
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    tokens = np.concatenate(parts)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = BEGIN
    return tokens, chain(before, tokens), bounds


def _ask(part: pa.Table, n_ranges: int) -> pa.Table:
    """Distinct hashes of a block and how often its training texts hold them, per range of hashes."""
    block = part.column("block")[0].as_py()
    raw, offsets = text_buffers(part.column("text"))
    tokens, pairs, bounds = _sequence(raw, offsets)
    training = np.repeat(part.column("training").to_numpy(), np.diff(bounds))
    out: dict[str, list] = {"block": [], "kind": [], "range": [], "hashes": [], "counts": []}
    for kind, values in ((1, tokens), (2, pairs)):
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        keys = ranked[heads]
        counts = np.add.reduceat(training[order].astype(np.int64), heads).astype(np.uint64)
        width = (1 << 64) // n_ranges + 1
        cuts = np.searchsorted(keys, np.array([i * width for i in range(n_ranges)], dtype=np.uint64))
        for r, (a, b) in enumerate(zip(cuts, np.append(cuts[1:], len(keys)), strict=True)):
            if b > a:
                for name, x in zip(out, (block, kind, r, pack_sorted(keys[a:b]), pack(counts[a:b])), strict=True):
                    out[name].append(x)
    return pa.table(out, schema=pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("range", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]))


def _answer(part: pa.Table) -> pa.Table:
    """Sum a range over all blocks; answer each block its hashes' counts.

    One block that asks for a hash owns it, so that owned words add up to the
    vocabulary.  Blocks to be deleted also get the counts of the others.
    """
    blocks = part.column("block").to_numpy()
    order = np.argsort(blocks, kind="stable")
    hashes = [unpack_sorted(part.column("hashes")[int(i)].as_py()) for i in order]
    counts = [unpack(part.column("counts")[int(i)].as_py()) for i in order]
    flat, added = np.concatenate(hashes), np.concatenate(counts)
    kept = np.concatenate([c * np.uint64(0) if blocks[i] & 1 else c for i, c in zip(order, counts, strict=True)])
    rank = np.argsort(flat, kind="stable")  # the lowest block of each hash comes first
    ranked = flat[rank]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    spans = np.diff(np.append(heads, len(flat)))
    total = np.empty_like(added)
    total[rank] = np.repeat(np.add.reduceat(added[rank], heads), spans)
    others = np.empty_like(added)
    others[rank] = np.repeat(np.add.reduceat(kept[rank], heads), spans)
    owned = np.zeros(len(flat), dtype=np.uint64)
    owned[rank[heads]] = 1
    rows: dict[str, list] = {"block": [], "kind": [], "range": [], "total": [], "kept": [], "owned": []}
    at = 0
    kind, place = part.column("kind")[0].as_py(), part.column("range")[0].as_py()
    for i, h in zip(order, hashes, strict=True):
        cut = slice(at, at + len(h))
        at += len(h)
        deleted = bool(blocks[i] & 1)
        values = (int(blocks[i]), kind, place, pack(total[cut]), pack(others[cut]) if deleted else None, int((owned[cut] * (total[cut] > 0)).sum()))
        for name, x in zip(rows, values, strict=True):
            rows[name].append(x)
    return pa.table(rows, schema=pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("range", pa.int32()), ("total", pa.binary()), ("kept", pa.binary()), ("owned", pa.int64())]))


def _joined(answers: pa.Table, kind: int, column: str) -> np.ndarray:
    """A block's answers of one kind, in the order of its sorted hashes."""
    rows = [(r, x) for k, r, x in zip(answers.column("kind").to_pylist(), answers.column("range").to_pylist(), answers.column(column).to_pylist(), strict=True) if k == kind]
    return np.concatenate([unpack(x) for _, x in sorted(rows)]) if rows else np.zeros(0, dtype=np.uint64)


def _count_tokens(part: pa.Table, answers: pa.Table, id_kind: pa.DataType) -> pa.Table:
    """Per document: the counts of its words and pairs in text order, packed."""
    raw, offsets = text_buffers(part.column("text"))
    tokens, pairs, bounds = _sequence(raw, offsets)
    n = part.num_rows
    word_at = np.unique(tokens, return_inverse=True)[1] if len(tokens) else np.zeros(0, dtype=np.int64)
    pair_at = np.unique(pairs, return_inverse=True)[1] if len(pairs) else np.zeros(0, dtype=np.int64)
    words, bigrams = _joined(answers, 1, "total")[word_at], _joined(answers, 2, "total")[pair_at]
    deleted = n > 0 and bool(part.column("block")[0].as_py() & 1)
    if deleted:
        words_kept, bigrams_kept = _joined(answers, 1, "kept")[word_at], _joined(answers, 2, "kept")[pair_at]
    training = part.column("training").to_pylist()
    logs = np.concatenate([[0.0], np.cumsum(np.log10(words.astype(np.float64) + 1))])
    known = np.concatenate([[0], np.cumsum(words > 0)])
    cuts = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    owned = sum(x for k, x in zip(answers.column("kind").to_pylist(), answers.column("owned").to_pylist(), strict=True) if k == 1)
    return pa.table({
        "id": part.column("id").combine_chunks().cast(id_kind),
        "training": pa.array(training, pa.bool_()),
        "n_tokens": pa.array(np.diff(bounds), pa.int64()),
        "n_known": pa.array(np.diff(known[bounds]), pa.int64()),
        "log_sum": pa.array(np.diff(logs[bounds]), pa.float64()),
        "words": pa.array([pack(words[c]) for c in cuts], pa.binary()),
        "pairs": pa.array([pack(bigrams[c]) for c in cuts], pa.binary()),
        "words_kept": pa.array([pack(words_kept[c]) if deleted and t else None for c, t in zip(cuts, training, strict=True)], pa.binary()),
        "pairs_kept": pa.array([pack(bigrams_kept[c]) if deleted and t else None for c, t in zip(cuts, training, strict=True)], pa.binary()),
        "owned": pa.array([owned, *[0] * (n - 1)][:n], pa.int64()),
    })


def deleted(key: str) -> Column:
    """Whether a document is deleted while weights are learned."""
    return F.pmod(F.xxhash64(F.lit("deleted"), F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(DELETED)) == 0


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", training: str = "training", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The stored table of ``_count_tokens``: lineage ends there."""
    id_type = docs.schema[key].dataType
    spark = docs.sparkSession
    n_bytes = docs.select(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1)).first()[0] or 0
    n_blocks, n_ranges = max(1, math.ceil(n_bytes / block_bytes)), max(1, math.ceil(n_bytes / RANGE_BYTES))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / (64 << 20)))
    apart = math.ceil(n_blocks / DELETED)
    draw = F.xxhash64(key, text)
    block = F.when(deleted(key), 2 * F.pmod(draw, F.lit(apart)) + 1).otherwise(2 * F.pmod(draw, F.lit(max(1, n_blocks - apart))))
    dealt = docs.select(
        F.col(key).alias("id"), F.col(text).alias("text"), F.col(training).alias("training"), block.alias("block")
    ).repartition(parts, "block")
    asked = dealt.groupBy("block").applyInArrow(lambda part: _ask(part, n_ranges), "block long, kind int, range int, hashes binary, counts binary")
    answers = asked.groupBy("kind", "range").applyInArrow(_answer, "block long, kind int, range int, total binary, kept binary, owned long")

    def run(part: pa.Table, got: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_type

        return _count_tokens(part, got, to_arrow_type(id_type))

    columns = (
        f"id {id_type.simpleString()}, training boolean, n_tokens long, n_known long, log_sum double, "
        "words binary, pairs binary, words_kept binary, pairs_kept binary, owned long"
    )
    return stored(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, columns), "lm-counts")


def _contexts(words: np.ndarray, texts: float) -> np.ndarray:
    """Frequency of each token's context: of the word before, or of all texts at the beginning."""
    before = np.empty(len(words))
    before[1:] = words[:-1]
    before[0] = texts
    return before


def _estimates(words: np.ndarray, pairs: np.ndarray, total: float, texts: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the context and both maximum-likelihood estimates for each token."""
    context = _contexts(words.astype(np.float64), texts)
    bucket = np.frexp(context)[1].astype(np.int64)  # 0 for an unseen context, else 1 + floor of the binary logarithm
    p2 = np.divide(pairs, context, out=np.zeros(len(words)), where=context > 0)
    return np.where(context > 0, bucket, 0), p2, words / total if total else np.zeros(len(words))


def _bin(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(-np.log(np.where(p > 0, p, 1.0)) * BINS), -1).astype(np.int64)


def learn_weights(counts: DataFrame, n_types: int) -> dict[int, tuple[float, float, float]]:
    """Mixture weights per bucket by EM on the held-out histogram.

    What reaches the driver is a count per bucket and rounded pair of
    estimates: at most 64 buckets times the bins, however many texts there are.
    """
    held = counts.where("words_kept is not null")
    totals = counts.where("training").agg(F.sum("n_tokens"), F.count("*")).first()
    gone = held.agg(F.sum("n_tokens"), F.count("*")).first()
    total, texts = (totals[0] or 0) - (gone[0] or 0), totals[1] - gone[1]

    def run(batches):
        for batch in batches:
            for w, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bucket, p2, p1 = _estimates(unpack(w), unpack(p), total, texts)
                cell = (bucket << 40) + ((_bin(p2) + 1) << 20) + _bin(p1) + 1
                cells, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], ["cell", "n"])

    cells = held.select("words_kept", "pairs_kept").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = cells.column("cell").to_numpy(), cells.column("n").to_numpy().astype(np.float64)
    bucket, b2, b1 = cell >> 40, ((cell >> 20) & 0xFFFFF) - 1, (cell & 0xFFFFF) - 1
    p = np.stack([np.where(b2 >= 0, np.exp(-b2 / BINS), 0.0), np.where(b1 >= 0, np.exp(-b1 / BINS), 0.0), np.full(len(n), 1.0 / (n_types + 1))])
    weights: dict[int, tuple[float, float, float]] = {}
    for b in np.unique(bucket).tolist():
        mine, size = p[:, bucket == b], n[bucket == b]
        w = np.array([0.0 if b == 0 else 0.4, 0.4, 0.2])
        w /= w.sum()
        for _ in range(ROUNDS):
            share = w[:, None] * mine
            share /= share.sum(axis=0)
            w = (share * size).sum(axis=1)
            w = np.maximum(w / w.sum(), [0.0 if b == 0 else 1e-9, 1e-9, 1e-9])
        weights[b] = tuple((w / w.sum()).tolist())
    return weights


def weight_table(weights: dict[int, tuple[float, float, float]]) -> np.ndarray:
    """Weights of buckets 0 to 64; a bucket that EM never saw takes those of the one below."""
    rows, last = [], None
    for b in range(65):
        last = weights.get(b, last if b > 1 and last else (0.0, 0.5, 0.5) if b == 0 else (0.3, 0.4, 0.3))
        rows.append(last)
    return np.array(rows)


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", training: str = "training") -> DataFrame:
    """Train on the rows marked ``training`` and score all: id, training, n_tokens, n_known, train_tokens, base_score, score."""
    counts = token_counts(docs, key, text, training)
    sums = counts.agg(
        F.sum(F.when(F.col("training"), F.col("n_tokens"))).alias("tokens"), F.count(F.when(F.col("training"), 1)).alias("texts"), F.sum("owned").alias("types")
    ).first()
    total, texts, types = sums["tokens"] or 0, sums["texts"], sums["types"] or 0
    table = weight_table(learn_weights(counts, types))

    def run(batches):
        for batch in batches:
            scores = []
            for w, p in zip(batch.column("words").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                bucket, p2, p1 = _estimates(unpack(w), unpack(p), total, texts)
                mix = table[bucket]
                scores.append(float(np.log10(mix[:, 0] * p2 + mix[:, 1] * p1 + mix[:, 2] / (types + 1)).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores, pa.float64())], [*names, "score"])

    names = ["id", "training", "n_tokens", "n_known", "log_sum"]
    id_type = docs.schema[key].dataType.simpleString()
    scored = counts.select(*names, "words", "pairs").mapInArrow(
        run, f"id {id_type}, training boolean, n_tokens long, n_known long, log_sum double, score double"
    )
    base = F.col("log_sum") - F.col("n_tokens") * math.log10(total + types + 1)
    return scored.select(
        F.col("id").alias(key), "training", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )
