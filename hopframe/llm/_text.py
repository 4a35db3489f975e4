"""Whole-text tokens and hashes over Arrow buffers, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\v\f\r"
FACTOR = np.uint64(0x9E3779B97F4A7C55)
_U = np.uint64


def space_words() -> np.ndarray:
    """Bytes of words that only blanks and the controls 9 to 13 part."""
    mask = np.ones(256, dtype=bool)
    mask[list(SPACES)] = False
    return mask


def plain_words() -> np.ndarray:
    """Bytes of words of digits, lower-case letters and everything beyond ASCII."""
    mask = np.zeros(256, dtype=bool)
    mask[ord("0") : ord("9") + 1] = True
    mask[ord("a") : ord("z") + 1] = True
    mask[128:] = True
    return mask


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def scramble(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that all bits of a hash depend on all bits of its input."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def chain(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return scramble(first * _U(0xC2B2AE3D27D4EB4F) + second)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n + 1 bounds; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = 1 << 21):
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Tokens:
    """Words of a range of texts: where they start and end, and the first word of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, mask: np.ndarray, lower: np.ndarray):
        self.bytes = lower[raw]
        inside = mask[self.bytes]
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(inside)]
        before[edges] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        edges = offsets[1:]
        after[edges[edges > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)  # n + 1 bounds in words
        self._inside = inside

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        lengths = self.ends - self.starts
        stops = np.cumsum(lengths)
        heads = stops - lengths
        place = np.arange(stops[-1]) - np.repeat(heads, lengths)
        powers = np.full(int(lengths.max()), FACTOR)
        powers[0] = 1
        powers = np.cumprod(powers)
        values = (self.bytes[self._inside].astype(np.uint64) + _U(1)) * powers[place]
        return scramble(np.add.reduceat(values, heads))


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers by planes of bytes, compressed; ``unpack`` restores them."""
    import zstandard

    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    width = data[0]
    planes = zstandard.ZstdDecompressor().decompress(data[1:])
    flat = np.frombuffer(planes, dtype=np.uint8).reshape(width, -1).T
    return np.ascontiguousarray(flat).view(f"<u{width}").ravel().astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned integers by their gaps."""
    return pack(np.diff(values, prepend=values[:1] * 0)) if len(values) else pack(values)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def digest_of(texts: list[str]) -> str:
    import hashlib

    return hashlib.sha256(",".join(texts).encode()).hexdigest()
