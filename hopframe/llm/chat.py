"""Chat formatting at the level of tokens.

Role and text of a turn are encoded apart, as ordinary text, and joined by
reserved ids beyond the vocabulary, so no content can produce a marker.  The
loss mask of a turn is the prefix sum of +1 where an assistant's text begins
and -1 where it ends.  A conversation is the sequence of its segments, one row
per turn in order; long conversations are never gathered in memory.

In the text form reserved ids are written as control strings.  Control strings
within content are escaped by one backslash after their first character; those
that have backslashes there get one more, so unescaping is exact.

Nulls: a null role or text is empty.  Rows of a null conversation id form one
conversation.  Repeated turns are ordered by role and text.  Empty texts keep
their markers.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm._store import read_bytes

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARKERS = ("<|begin|>", "<|turn|>", "<|say|>", "<|end|>")  # ids after the vocabulary, in this order
BEGIN, TURN, SAY, END = range(4)
CONTROLS = (*MARKERS, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"


class Escape:
    """Reversible escaping of control strings.

    The first character of a control string must not occur again within one, except doubled at its start.
    """

    def __init__(self, controls: Iterable[str] = CONTROLS):
        tails = "|".join(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})" for c in sorted(controls, key=len, reverse=True))
        self.add = re.compile(f"(?:{tails})")
        gone = "|".join(f"{re.escape(c[0])}\\\\(?=\\\\*{re.escape(c[1:])})" for c in sorted(controls, key=len, reverse=True))
        self.drop = re.compile(f"(?:{gone})")

    def hide(self, text: str) -> str:
        return self.add.sub(lambda m: m.group() + "\\", text)

    def show(self, text: str) -> str:
        return self.drop.sub(lambda m: m.group()[0], text)


class Codec:
    """Tokenizer with reserved ids; built once in a task from the vocabulary's bytes."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.tokens = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1
        self.escape = Escape()

    def segment(self, role: str, text: str, opens: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of a turn; the first of a conversation begins with its marker."""
        who, what = (self.tokens.encode_ordinary(self.escape.hide(x)) for x in (role, text))
        lead = [self.first + BEGIN] * opens + [self.first + TURN, *who, self.first + SAY]
        ids = np.array([*lead, *what, self.first + END], dtype=np.int32)
        change = np.zeros(len(ids) + 1, dtype=np.int8)
        if role == LOSS_ROLE:
            change[len(lead)] += 1
            change[len(lead) + len(what)] -= 1
        return ids, np.cumsum(change[:-1], dtype=np.int8)

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str | None, int]:
        """Role, text, text under the mask (None without any) and length of the text form, from a segment alone."""
        marks = np.flatnonzero(ids >= self.first)
        by = {int(ids[i]) - self.first: int(i) for i in marks}
        plain = lambda part: self.tokens.decode_bytes(part.tolist()).decode()
        who, what = plain(ids[by[TURN] + 1 : by[SAY]]), plain(ids[by[SAY] + 1 : by[END]])
        under = ids[mask > 0]
        loss = self.escape.show(plain(under)) if len(under) else None
        size = len(who) + len(what) + sum(len(MARKERS[int(ids[i]) - self.first]) for i in marks)
        return self.escape.show(who), self.escape.show(what), loss, size


def format_turns(rows: DataFrame, vocabulary: bytes | None = None, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row per turn, ordered within its conversation: conv, seq, input_ids, loss_mask.

    A conversation's rows are neighbours in one partition; only one turn is held at a time.
    """
    data = vocabulary if vocabulary is not None else read_bytes(TOKENIZER)
    conv_type = rows.schema[conv].dataType.simpleString()
    dealt = (
        rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    )

    def run(batches):
        codec = Codec(data)
        last, seq = object(), 0
        for batch in batches:
            seqs, ids, masks = [], [], []
            for c, role, text in zip(batch.column("conv").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seq, last = (seq + 1, last) if c == last else (0, c)
                segment, mask = codec.segment(role, text, seq == 0)
                seqs.append(seq)
                ids.append(segment)
                masks.append(mask)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), pa.array(seqs, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8()))],
                ["conv", "seq", "input_ids", "loss_mask"],
            )

    return dealt.mapInArrow(run, f"conv {conv_type}, seq long, input_ids array<int>, loss_mask array<tinyint>").withColumnRenamed("conv", conv)


def read_back(segments: DataFrame, vocabulary: bytes | None = None, conv: str = "conv_id") -> DataFrame:
    """Digests of each conversation from its segments, in whatever order and layout they are stored."""
    data = vocabulary if vocabulary is not None else read_bytes(TOKENIZER)
    conv_type = segments.schema[conv].dataType
    columns = f"conv {conv_type.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        codec = Codec(data)
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [to_arrow_type(conv_type), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state = None

        def done(s):
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                c, seq = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids, mask = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (2, 3))
                if seq == 0:
                    if state:
                        rows.append(done(state))
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, loss, size = codec.read(ids, mask)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += size
            if rows:
                yield emit(rows)
        if state:
            yield emit([done(state)])

    ordered = segments.select(conv, "seq", "input_ids", "loss_mask").repartition(conv).sortWithinPartitions(conv, "seq")
    return ordered.mapInArrow(run, columns).withColumnRenamed("conv", conv)
