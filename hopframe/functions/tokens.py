"""Token counts and line ends of texts in Arrow batches, by byte tables.

Only texts of plain ASCII are answered: there a byte is a character, and one
pass over the bytes of a batch serves all its texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# What ``text.TOKEN_PATTERN`` and the surrounding-whitespace rule mean for single bytes.  Of another
# kind is what lies beyond ASCII, and four separators that are tokens but are stripped from lines.
_GAP, _WORD, _SYMBOL, _OTHER = range(4)
_BLANKS = b"\t\x0b\x0c\r "
_KINDS = bytes(
    _OTHER if b >= 128 or 0x1C <= b < 0x20 else _GAP if b in _BLANKS + b"\n" else _WORD if chr(b).isalnum() else _SYMBOL
    for b in range(256)
)
_IS_BLANK = np.array([b in _BLANKS for b in range(256)])


def measure(texts: pa.Array) -> pa.Array:
    """(tokens, bare) of each text, null where the text is null or not plain.

    ``tokens`` is the count by ``TOKEN_PATTERN``; stripping lines does not change
    it.  ``bare`` tells that no line begins or ends with a blank.
    """
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    n = len(texts)
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    chars = data[at[0] : at[-1]].to_pybytes() if data is not None else b""
    codes, kinds = np.frombuffer(chars, dtype=np.uint8), np.frombuffer(chars.translate(_KINDS), dtype=np.uint8)
    at = at - at[0]
    full = at[1:] > at[:-1]
    begins, ends = at[:-1][full], at[1:][full] - 1

    in_word = kinds == _WORD
    starts = in_word.copy()
    starts[1:] &= ~in_word[:-1]
    starts[begins] = in_word[begins]
    tokens = np.diff(np.searchsorted(np.flatnonzero(starts | (kinds == _SYMBOL)), at))
    plain = np.diff(np.searchsorted(np.flatnonzero(kinds == _OTHER), at)) == 0

    # first and last bytes of lines; one beside a break at a text's end is its neighbour's first or last byte
    breaks = np.flatnonzero(codes == 10)
    edges = np.concatenate([begins, ends, breaks[breaks > 0] - 1, breaks[breaks + 1 < len(codes)] + 1])
    bare = np.ones(n, dtype=bool)
    bare[np.searchsorted(at, edges[_IS_BLANK[codes[edges]]], side="right") - 1] = False

    unknown = ~plain | texts.is_null().to_numpy(zero_copy_only=False)
    return pa.StructArray.from_arrays(
        [pa.array(tokens, pa.int32(), mask=unknown), pa.array(bare, pa.bool_(), mask=unknown)], ["tokens", "bare"]
    )
