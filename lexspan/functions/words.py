"""What tasks do with texts as Arrow arrays, byte by byte in numpy: words, and the texts that hold others."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTERS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: For bytes.translate(): small letters, whether a byte is of a word, and the bytes that aren't.
_LOW, _HELD, _REST = bytes(range(256)).lower(), bytes(c in _LETTERS for c in range(256)), bytes(c for c in range(256) if c not in _LETTERS)
#: The letters beyond ASCII that have one of ASCII when they are small.
_SMALL = {"\u0130": "i\u0307", "\u212a": "k"}


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of texts without nulls, and where each begins, the end included."""
    texts = pc.cast(texts, pa.large_string())
    _, at, data = texts.buffers()
    ends = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
    return raw, ends - ends[0]


def word_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """word_tokens() of texts: how many each has, and all in a row."""
    texts = pc.fill_null(texts, "")
    raw, ends = _bytes(texts)
    whole = raw.tobytes()
    if any(x.encode() in whole for x in _SMALL):
        for x, small in _SMALL.items():
            texts = pc.replace_substring(texts, x, small)
        raw, ends = _bytes(texts)
        whole = raw.tobytes()
    held = np.frombuffer(whole.translate(_HELD), bool)
    first, last = held.copy(), held.copy()
    first[1:] &= ~held[:-1]
    last[:-1] &= ~held[1:]
    begins = ends[:-1][ends[:-1] < len(raw)]
    first[begins] = held[begins]
    begins = begins[begins > 0] - 1
    last[begins] = held[begins]
    at = np.flatnonzero(first)
    places = np.zeros(len(at) + 1, np.int32)
    np.cumsum(np.flatnonzero(last) - at + 1, out=places[1:])
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(whole.translate(_LOW, _REST)))
    return np.diff(np.searchsorted(at, ends)), words


_SHIFTS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_ORDER = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]


def md5_heads(words: pa.Array) -> np.ndarray:
    """The first 32 bits of each word's MD5 (RFC 1321), of all words at once; those that don't fit one block one by one."""
    raw, ends = _bytes(words)
    size = np.diff(ends)
    short = size < 56
    block = np.zeros((len(size), 64), np.uint8)
    block.reshape(-1)[np.repeat(np.arange(len(size)) * 64 - ends[:-1], size * short) + np.flatnonzero(np.repeat(short, size))] = raw[np.repeat(short, size)]
    block[np.flatnonzero(short), size[short]] = 0x80
    block[:, 56:58] = (size * short * 8).astype("<u2").view(np.uint8).reshape(-1, 2)
    heads = np.concatenate([np.empty(0, np.int64), *(_heads(block[lo : lo + 4096]) for lo in range(0, len(size), 4096))])
    for i in np.flatnonzero(~short).tolist():
        heads[i] = int(hashlib.md5(words[i].as_py().encode(), usedforsecurity=False).hexdigest()[:8], 16)
    return heads


def _heads(block: np.ndarray) -> np.ndarray:
    """The same of padded blocks of 64 bytes."""
    m = np.ascontiguousarray(block.view("<u4").T)
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(block), x) for x in start)
    for i in range(64):
        turn = i // 16
        f = _mixed(turn, b, c, d)
        f += a
        f += m[_ORDER[turn](i % 16)]
        f += _SINES[i]
        left = _SHIFTS[turn][i % 4]
        a, d, c, b = d, c, b, ((f << np.uint32(left)) | (f >> np.uint32(32 - left))) + b
    return (a + start[0]).byteswap().astype(np.int64)


def _mixed(turn: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if turn == 0:
        return d ^ (b & (c ^ d))
    if turn == 1:
        return c ^ (d & (b ^ c))
    return b ^ c ^ d if turn == 2 else c ^ (b | ~d)


class Needles:
    """Texts that are looked for all at once: by the eight bytes in their middle, and where these stand, by the rest. Those of fewer bytes
    are looked for one by one."""

    WIDTH, BITS, STEP, FACTOR = 8, 20, 1 << 17, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, needles: list[str]):
        self.short = [(i, x) for i, x in enumerate(needles) if len(x.encode()) < self.WIDTH]
        self.by_key: dict[int, list[tuple[int, int, int, list[tuple[int, int]]]]] = {}
        for i, x in enumerate(needles):
            raw = x.encode()
            if (n := len(raw)) < self.WIDTH:
                continue
            at = lambda j, raw=raw: int.from_bytes(raw[j : j + self.WIDTH], "little")
            places = dict.fromkeys([*range(0, n - self.WIDTH + 1, self.WIDTH), n - self.WIDTH])
            self.by_key.setdefault(at(middle := (n - self.WIDTH) // 2), []).append((i, middle, n, [(j, at(j)) for j in places]))
        self.keys = np.array(sorted(self.by_key), np.uint64)
        self.marked = np.zeros(1 << self.BITS, bool)
        self.marked[self._mixed(self.keys)] = True

    def _mixed(self, windows: np.ndarray) -> np.ndarray:
        return (windows * self.FACTOR) >> np.uint64(64 - self.BITS)

    def found(self, texts: pa.Array) -> list[tuple[int, int]]:
        """(place of a text, place of a needle that it holds), each pair once. texts: without nulls."""
        out = [(r, i) for i, x in self.short for r in np.flatnonzero(pc.match_substring(texts, x).to_numpy(zero_copy_only=False)).tolist()]
        raw, ends = _bytes(texts)
        if len(raw) < self.WIDTH or not len(self.keys):
            return out
        windows = np.ndarray(len(raw) - self.WIDTH + 1, "<u8", np.ascontiguousarray(raw), 0, (1,))
        near = [np.flatnonzero(self.marked[self._mixed(windows[lo : lo + self.STEP])]) + lo for lo in range(0, len(windows), self.STEP)]
        at = np.concatenate(near)
        key = windows[at]
        for k in np.intersect1d(key, self.keys).tolist():
            places = at[key == k]
            for i, middle, n, blocks in self.by_key[k]:
                p = places - middle
                p = p[(p >= 0) & (p + n <= len(raw))]
                for j, block in blocks:
                    p = p[windows[p + j] == block]
                row = np.searchsorted(ends, p, side="right") - 1
                out += [(r, i) for r in np.unique(row[p + n <= ends[row + 1]]).tolist()]
        return out
