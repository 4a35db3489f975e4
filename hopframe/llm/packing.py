"""Packing by powers of two: no sequence crosses documents and none is padded.

A document's tokens, with an end mark, are cut into pieces whose lengths are the
binary digits of their number, the largest first and ``longest`` as often as it
fits.  Every piece is a sequence by itself; sequences of one length form a
bucket, are dealt in random order within it and numbered without gaps, bucket
after bucket, so batches of one length and equally many tokens can be read off
(``with_batch``).

Ids are those of the tokenizer's own encoding.  It drops white space before it
merges, so the words between blanks can be encoded apart: a task keeps the ids
of words it has met, within a bounded table, and asks the tokenizer for others.

Nulls: a null text is empty, and an empty text is its end mark.  Documents
without an id, and repeated ones, are packed each.  Very long texts are encoded
in blocks cut at blanks; the ids of one document are held at a time.  An empty
table gives an empty result.  Other columns do not matter.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm._store import read_bytes, stored
from hopframe.llm.sharding import number_slots

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
LONGEST, END_ID = 2048, 1
KNOWN = 400_000  # words whose ids a task keeps
STEP = 1 << 20  # bytes encoded at once
FLUSH = 1 << 22  # bytes of ids in a batch
BLANK = re.compile(rb"[ \t\n\v\f\r]")

# Texts of these characters only are cut into words here: they have one form, and one lower-case form.
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
# Fixed value: the vocabulary's split pattern, for lower-case texts of those characters.
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next beyond 255."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)}


class _Words(dict):
    """Ids of words as little-endian 32-bit numbers; forgets all when full, which costs time only."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, word):
        ids = np.array(self.ids_of(word), dtype="<u4").tobytes()
        if len(self) >= KNOWN:
            self.clear()
        self[word] = ids
        return ids


class Coder:
    """A tokenizer built from the bytes of its file; one per task."""

    def __init__(self, vocabulary: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(vocabulary.decode())
        model, letters = whole.model, byte_letters()
        self.words = _Words(lambda w: [t.id for t in model.tokenize(w.encode().decode("latin-1").translate(letters))])
        self.pieces = _Words(lambda raw: whole.encode(raw.decode(), add_special_tokens=False).ids)

    def encode(self, raw: bytes) -> bytes:
        """Ids of a UTF-8 text."""
        return b"".join(self._block(raw[a:b]) for a, b in self._cuts(raw))

    def _block(self, raw: bytes) -> bytes:
        text = raw.decode()
        if "<|" not in text and PLAIN.fullmatch(text):
            return b"".join(map(self.words.__getitem__, WORD.findall(text.lower())))
        return b"".join(map(self.pieces.__getitem__, raw.split()))

    @staticmethod
    def _cuts(raw: bytes):
        at = 0
        while at < len(raw):
            found = BLANK.search(raw, at + STEP)
            end = found.start() if found else len(raw)
            yield at, end
            at = end


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The pieces of n tokens: ``longest`` as often as it fits, then the binary digits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, vocabulary: bytes | None = None, key: str = "doc_id", text: str = "text", longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """A row per piece: id, start, length, doc_tokens, ``ids`` (little-endian unsigned 32-bit) and ``piece``, a number of its own.

    Store the table before it is read twice; ``piece`` depends on how rows lie in partitions.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    data = vocabulary if vocabulary is not None else read_bytes(TOKENIZER)
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        coder, number = Coder(data), TaskContext.get().partitionId() << 33
        names = ["id", "start", "length", "doc_tokens", "ids", "piece"]
        for batch in batches:
            owners, starts, sizes, tokens, parts, held = [], [], [], [], [], 0

            def flush():
                numbers = np.arange(number, number + len(parts))
                return pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owners, pa.int64())), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                        pa.array(tokens, pa.int64()), pa.array(parts, pa.binary()), pa.array(numbers),
                    ], names,
                )

            for row, raw in enumerate(batch.column(1)):
                ids, at = coder.encode(raw.as_py() or b"") + end, 0
                for size in lengths(len(ids) // 4, longest):
                    owners.append(row)
                    starts.append(at)
                    sizes.append(size)
                    tokens.append(len(ids) // 4)
                    parts.append(ids[4 * at : 4 * (at + size)])
                    at += size
                    held += 4 * size + 64
                    if held >= FLUSH:
                        yield flush()
                        number += len(parts)
                        owners, starts, sizes, tokens, parts, held = [], [], [], [], [], 0
            if parts:
                yield flush()
                number += len(parts)

    found = docs.select(key, F.col(text).cast("binary")).mapInArrow(run, f"id {kind}, start long, length long, doc_tokens long, ids binary, piece long")
    return found.withColumnRenamed("id", key)


def number_sequences(table: DataFrame) -> DataFrame:
    """Add ``sequence_id``, ``slot`` and ``offset`` to a stored table of pieces.

    Slots number a bucket without gaps in random order; sequence ids go on from
    bucket to bucket, the longest first.  One count per length, at most 1 +
    log2(longest), comes to the driver.
    """
    dealt = table.withColumn("shard", F.col("length")).withColumn("__spread", F.shiftrightunsigned(F.xxhash64("piece"), 33))
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    first = F.lit(0).cast("long")
    for size in sorted(counts):
        first = F.when(F.col("length") == size, sum(n for other, n in counts.items() if other > size)).otherwise(first)
    return (
        number_slots(dealt, ["piece"], "__spread")
        .withColumn("sequence_id", (first + F.col("slot")).cast("long")).withColumn("offset", F.lit(0).cast("long")).drop("shard", "__spread", "piece")
    )


def pack(docs: DataFrame, vocabulary: bytes | None = None, key: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """The numbered sequences with their ids."""
    return number_sequences(stored(pieces(docs, vocabulary, key, text, longest), "packing"))


def with_batch(packed: DataFrame, tokens: int) -> DataFrame:
    """Add ``batch``: within each length, batches of ``tokens`` tokens, which the longest length must divide."""
    return packed.withColumn("batch", F.floor(F.col("slot") * F.col("length") / F.lit(tokens)).cast("long"))
