"""Token overlap and longest common subsequence for Arrow batches.

Counting is linear in the length of both texts.  For the subsequence one Python
big integer per text holds a row of the comparison table, so a pair costs one
add/and/or per element of the second side.  Where one text meets many, the rows
of all of them are machine words of one array.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd


# Fixed value: bytes of words stay, all others become blanks.
_WORD_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


def lcs_length(left, right) -> int:
    """Length of the longest common subsequence of two sequences."""
    if not len(left) or not len(right):
        return 0
    where: dict = {}
    bit = 1
    for item in left:
        where[item] = where.get(item, 0) | bit
        bit <<= 1
    full = bit - 1
    row = full
    for item in right:
        hits = row & where.get(item, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(left) - row.bit_count()


# Cells of a table of texts that are compared at once.
CELLS = 4_000_000


class TextBlock:
    """Texts by rising length, with their characters and pairs of neighbours counted in classes.

    Classes may merge characters, so what two texts share by classes is never
    less than what they share.  ``chars`` has a row per class, ``pairs`` one per text.
    """

    CHARS, PAIRS = 64, 128

    def __init__(self, texts: list[str]):
        codes = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in texts]
        self.order = np.argsort(np.array([len(c) for c in codes], dtype=np.int64), kind="stable")
        self.codes = [codes[i] for i in self.order]
        self.lengths = np.array([len(c) for c in self.codes], dtype=np.int64)
        n = len(texts)
        self.flat = np.concatenate(self.codes) if n else np.zeros(0, dtype=np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        owner = np.repeat(np.arange(n), self.lengths)
        small = np.uint8 if n == 0 or self.lengths[-1] < 256 else np.int32
        self.chars = np.bincount((self.flat % self.CHARS).astype(np.int64) * n + owner, minlength=self.CHARS * n).reshape(self.CHARS, n).astype(small)
        inner = owner[1:] == owner[:-1]
        kind = ((self.flat[:-1] * np.uint32(2654435761) + self.flat[1:] * np.uint32(40503)) >> np.uint32(7)) % np.uint32(self.PAIRS)
        self.pairs = np.bincount(owner[:-1][inner] * self.PAIRS + kind[inner], minlength=self.PAIRS * n).reshape(n, self.PAIRS).astype(small)

    def table(self, rows: np.ndarray) -> np.ndarray:
        """Characters of some texts, a text a column, filled up with zeros."""
        sizes = self.lengths[rows]
        out = np.zeros((int(sizes.max()), len(rows)), dtype=np.uint32)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[place, np.repeat(np.arange(len(rows)), sizes)] = self.flat[np.repeat(self.starts[rows], sizes) + place]
        return out


def lcs_with_all(text: np.ndarray, table: np.ndarray) -> np.ndarray:
    """LCS length of one text with each column of a table, 64 of its characters a machine word."""
    letters, which = np.unique(text, return_inverse=True)
    words = (len(text) + 63) // 64
    masks = np.zeros((words, len(letters) + 1), dtype=np.uint64)
    at = np.arange(len(text))
    np.bitwise_or.at(masks, (at // 64, which), np.uint64(1) << (at % 64).astype(np.uint64))
    found = np.minimum(np.searchsorted(letters, table), len(letters) - 1)
    found[letters[found] != table] = len(letters)
    rows = [np.full(table.shape[1], np.iinfo(np.uint64).max) for _ in range(words)]
    for column in found:
        carry = None
        for w in range(words):
            hits = rows[w] & masks[w][column]
            total = rows[w] + hits
            over = total < hits
            if carry is not None:
                total = total + carry
                over |= total < carry
            rows[w] = total | (rows[w] - hits)
            carry = over.astype(np.uint64)
    tail = np.uint64(2 ** (len(text) - 64 * (words - 1)) - 1)
    left = sum(np.bitwise_count(r).astype(np.int64) for r in rows[:-1]) + np.bitwise_count(rows[-1] & tail)
    return len(text) - left


def similar_in_blocks(left: list[str], right: list[str], threshold: int, r: float) -> tuple[list[int], list[int], list[int]]:
    """(place left, place right, score) of all pairs of two blocks with a score of at least ``threshold``.

    The score is 200 * LCS / S, S the sum of lengths; a pair needs an LCS of at
    least r*S/2.  For each text of the smaller block those of the other that
    are too short or long, share too few characters or too few pairs of
    neighbours (3*LCS - S - 1 at least) are put out, the LCS of the rest is exact.
    """
    turned = len(left) > len(right)
    few, many = (TextBlock(right), TextBlock(left)) if turned else (TextBlock(left), TextBlock(right))
    out_few, out_many, out_score = [], [], []
    wide = np.uint8 if few.chars.dtype == many.chars.dtype == np.uint8 else np.int32
    for i, text in enumerate(few.codes):
        n = len(text)
        lo = np.searchsorted(many.lengths, n * r / (2 - r) - 1e-6)
        hi = np.searchsorted(many.lengths, n * (2 - r) / r + 1e-6, side="right")
        if lo >= hi:
            continue
        need = np.ceil((many.lengths[lo:hi] + n) * (r / 2) - 1e-9).astype(np.int64)
        shared = np.zeros(hi - lo, dtype=wide)
        for c in np.flatnonzero(few.chars[:, i]):
            shared += np.minimum(many.chars[c, lo:hi], few.chars[c, i]).astype(wide, copy=False)
        rows = np.flatnonzero(shared >= need)
        pairs_needed = 3 * need[rows] - (many.lengths[lo + rows] + n) - 1
        kinds = np.flatnonzero(few.pairs[i])
        step = max(1, CELLS // max(1, len(kinds)))
        both = [np.minimum(many.pairs[np.ix_(lo + rows[k : k + step], kinds)], few.pairs[i, kinds]).sum(axis=1, dtype=np.int64) for k in range(0, len(rows), step)]
        rows = rows[np.concatenate(both) >= pairs_needed] if both else rows
        k = 0
        while k < len(rows):
            # rows rise in length, so the last one of a part is its longest
            size = max(1, CELLS // int(many.lengths[lo + rows[-1]]))
            part = lo + rows[k : k + size]
            k += size
            # few long texts are faster one by one: a step over an array costs as much as 40 of its elements
            if len(part) >= 40 * (n / 64):
                lcs = lcs_with_all(text, many.table(part))
            else:
                lcs = np.array([lcs_length(text.tolist(), many.codes[j].tolist()) for j in part], dtype=np.int64)
            score = np.rint(200.0 * lcs / (many.lengths[part] + n)).astype(np.int64)
            good = score >= threshold
            out_few += [int(few.order[i])] * int(good.sum())
            out_many += many.order[part[good]].tolist()
            out_score += score[good].tolist()
    return (out_many, out_few, out_score) if turned else (out_few, out_many, out_score)


def _shared(left, right) -> int:
    """Elements two sequences share, with repeats."""
    if not left or not right:
        return 0
    one, other = Counter(left), Counter(right)
    if len(one) > len(other):
        one, other = other, one
    return sum(min(n, other[item]) for item, n in one.items() if item in other)


def _shared_ends(left: list, right: list) -> tuple[int, int]:
    """Lengths of the common start and, behind it, the common end of two sequences."""
    n = min(len(left), len(right))
    head = 0
    if left[:n] == right[:n]:
        return n, 0
    while left[head] == right[head]:
        head += 1
    tail = 0
    while tail < n - head and left[-1 - tail] == right[-1 - tail]:
        tail += 1
    return head, tail


def overlap_batch(left: pd.Series, right: pd.Series, stem=None, with_lcs: bool = True) -> pd.DataFrame:
    """Lengths, shared 1- and 2-grams and subsequence length of two columns of lower-case texts.

    Words are runs of ASCII letters and digits; ``stem`` maps a word to its stem.
    Within a batch each distinct word is stemmed once, each distinct text is cut
    once and each distinct pair of texts compared once: many runs answer a
    question alike, against one target.  What two texts have in common at their
    start and end is shared whatever lies between, so only the rest is counted.
    """
    known: dict[bytes, str] = {}
    texts: dict[str, list] = {}
    pairs: dict[tuple[str, str], tuple[int, ...]] = {}

    def cut(text: str) -> list:
        items = texts.get(text)
        if items is None:
            # a character that is not ASCII becomes a question mark, and so a blank
            items = text.encode("ascii", "replace").translate(_WORD_BYTES).split()
            if stem is not None:
                for w in items:
                    if w not in known:
                        known[w] = stem(w.decode())
                items = [known[w] for w in items]
            texts[text] = items
        return items

    def compare(one: str, other: str) -> tuple[int, ...]:
        a, b = cut(one), cut(other)
        head, tail = _shared_ends(a, b)
        rest_a, rest_b = a[head : len(a) - tail], b[head : len(b) - tail]
        both = head + tail
        # the pairs at the seams have one word of the common start or end
        seam_a, seam_b = (x[max(head - 1, 0) : len(x) - max(tail - 1, 0)] for x in (a, b))
        shared_2 = max(head - 1, 0) + max(tail - 1, 0)
        if len(seam_a) > 1 and len(seam_b) > 1:
            shared_2 += _shared(list(zip(seam_a, seam_a[1:])), list(zip(seam_b, seam_b[1:])))
        lcs = both + lcs_length(rest_a, rest_b) if with_lcs else 0
        return len(a), len(b), both + _shared(rest_a, rest_b), shared_2, lcs

    rows = []
    for key in zip(left, right):
        row = pairs.get(key)
        if row is None:
            row = pairs[key] = compare(*key)
        rows.append(row)
    return pd.DataFrame(np.array(rows, dtype="int32").reshape(-1, 5), columns=["n_truth", "n_response", "shared_1", "shared_2", "lcs"])
