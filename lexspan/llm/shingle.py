"""Word shingles of whole Arrow batches as 64-bit hashes, without a Python step for each word.

Words are runs of bytes other than space and 9-13; A-Z count as a-z. A word's hash is a polynomial over a random table of
byte values modulo 2**64, read off prefix sums of a block of text; a shingle's is a sum of its words' hashes with odd factors.
Both are finalised by mixing. Distinct shingles share a hash with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

from lexspan.llm.cuckoo import mix

WIDTH = 5
#: Bytes of text whose prefix sums are made together; a word isn't cut.
BLOCK = 1 << 18

_BYTES = np.random.Generator(np.random.PCG64(20)).integers(1, 2**64 - 1, 256, dtype=np.uint64, endpoint=True)
_BASE = 0x9E3779B97F4A7C15
_FACTORS = np.random.Generator(np.random.PCG64(21)).integers(1, 2**63 - 1, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The table by byte, with A-Z as a-z.
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers, and its inverse's, of which there are n at least."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        made = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x))
        _powers = made[0], made[1]
    return _powers


def word_bounds(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the texts (offsets into raw[at[0]:at[-1]]), and how many words each text has."""
    a, off = raw[at[0] : at[-1]], at - at[0]
    word = ~_SPACE[a]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(a))]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def word_hashes(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, words in each text, start of each word."""
    starts, ends, n = word_bounds(at, raw)
    a, out, i = raw[at[0] : at[-1]], np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        size, x, y = int(ends[j - 1]) - lo, starts[i:j] - lo, ends[i:j] - lo
        up, down = _up_to(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_FOLDED[a[lo : lo + size]] * up[:size], out=sums[1:])
        out[i:j] = (sums[y] - sums[x]) * down[x]
        i = j
    return mix(out), n, starts


def combine(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each position on; positions too near to the end are left out."""
    n = max(0, len(words) - width + 1)
    total = np.full(n, width, np.uint64)
    for j in range(width):
        total += words[j : j + n] * _FACTORS[j]
    return mix(total)


def shingles(at: np.ndarray, raw: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts in their order, and offsets (n + 1). A text of fewer words than width, but not none, has
    its whole sequence as one shingle."""
    words, n, _ = word_hashes(at, raw)
    first = np.concatenate(([0], np.cumsum(n)))
    if not len(words):
        return np.empty(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    all_ = combine(words, width)
    of = np.repeat(np.arange(len(n)), n)
    whole = first[of + 1] - np.arange(len(words)) >= width
    short = np.flatnonzero((n > 0) & (n < width))
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    offsets = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(offsets[-1], np.uint64)
    place = np.ones(len(out), bool)
    place[offsets[short]] = False
    out[place] = all_[whole[: len(all_)]]
    for i in short.tolist():
        out[offsets[i]] = combine(words[first[i] : first[i + 1]], int(n[i]))[0]
    return out, offsets
