"""A byte-level BPE vocabulary as arrays, and the merging of many fragments of words at once."""

from __future__ import annotations

import heapq
from itertools import pairwise

import numpy as np

#: Rounds of all fragments together; what then isn't merged (very long fragments) is merged one by one.
ROUNDS = 64
NEVER = np.int32(np.iinfo(np.int32).max)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Merges:
    """A byte-level BPE vocabulary as arrays: first symbols, forced cuts, ranks and products of merges."""

    def __init__(self, model: dict):
        """model: that of a tokenizer's file."""
        vocab, suffix, letters = model["vocab"], model.get("end_of_word_suffix") or "", byte_letters()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        byte_of = {c: b for b, c in enumerate(letters)}
        #: Symbols of a byte inside a word and at its end.
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        made = [a.removesuffix(suffix) + b if suffix else a + b for a, b in pairs]
        self._in_order({vocab[c] for c in letters} | {vocab[c + suffix] for c in letters}, [(vocab[a], vocab[b], vocab[m]) for (a, b), m in zip(pairs, made, strict=True)])
        self.size = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.product = key[order], order.astype(np.int32), np.array([vocab[m] for m in made], np.int32)
        #: Ranks of pairs of bytes that no merge has touched, [1] with the second at a word's end.
        self.first = np.full((2, 256, 256), NEVER)
        for end, symbols in enumerate((self.inner, self.last)):
            a, b = np.meshgrid(self.inner, symbols, indexing="ij")
            self.first[end] = self.look(a.ravel(), b.ravel()).reshape(256, 256)
        #: Whether bytes a, b stand side by side in some token: [0] inside a word, [1] with b at its end.
        self.joint = np.zeros((2, 256, 256), bool)
        for token in vocab:
            ended = bool(suffix) and token.endswith(suffix)
            raw = [byte_of[c] for c in (token.removesuffix(suffix) if ended else token)]
            for i, (a, b) in enumerate(pairwise(raw)):
                self.joint[int(ended and i == len(raw) - 2), a, b] = True
        if not suffix:
            self.joint[1] = self.joint[0]

    @staticmethod
    def _in_order(first: set[int], merges: list[tuple[int, int, int]]) -> None:
        """Merging every occurrence of the lowest rank at once is right only if each token has one merge, after those of its parts."""
        known = set(first)
        for a, b, m in merges:
            if a not in known or b not in known or m in known:
                raise ValueError("a merge makes a token twice, or before its parts")
            known.add(m)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NEVER if it isn't merged."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NEVER)

    def cuts(self, raw: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether a fragment starts at each byte. last: the byte ends its word."""
        start = np.ones(len(raw), bool)
        start[1:] = last[:-1] | ~self.joint[last[1:].view(np.int8), raw[:-1], raw[1:]]
        return start

    def merge(self, raw: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all fragments, and the place of the first byte of each. raw, last: as cuts() takes them."""
        start = self.cuts(raw, last)
        symbols = np.where(last, self.last[raw], self.inner[raw])
        at, frag = np.arange(len(symbols)), np.cumsum(start) - 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbols), NEVER)
        rank[:-1] = np.where(start[1:], NEVER, self.first[last[1:].view(np.int8), raw[:-1], raw[1:]])
        for _ in range(ROUNDS):
            if not len(symbols):
                break
            first = np.flatnonzero(np.diff(frag, prepend=-1))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(frag)))
            over = low == NEVER
            if over.any():
                done.append((at[over], symbols[over]))
                at, frag, rank, symbols, low = (x[~over] for x in (at, frag, rank, symbols, low))
            hit = rank == low
            if (hit[1:] & hit[:-1]).any():  # a run of one symbol: every second pair, from the left
                n = np.arange(len(hit))
                hit &= (n - np.maximum.accumulate(np.where(hit, -1, n))) % 2 == 1
            place = np.flatnonzero(hit)
            symbols[place] = self.product[rank[place]]
            stay = np.ones(len(symbols), bool)
            stay[place + 1] = False
            at, frag, rank, symbols = (x[stay] for x in (at, frag, rank, symbols))
            place -= np.arange(len(place))
            new = np.zeros(len(symbols) + 1, bool)  # one more, for the place before the first
            new[place] = new[place - 1] = True
            again = np.flatnonzero(new[:-1])
            rank[again] = NEVER
            again = again[again + 1 < len(frag)]
            again = again[frag[again] == frag[again + 1]]
            rank[again] = self.look(symbols[again], symbols[again + 1])
        for i in np.split(np.arange(len(symbols)), np.flatnonzero(np.diff(frag)) + 1) if len(symbols) else []:
            ids, kept = self.merge_one(symbols[i].tolist())
            done.append((at[i][kept], np.array(ids, np.int32)))
        if not done:
            return symbols, at
        at, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(at, kind="stable")
        return symbols[order], at[order]

    def merge_one(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The same of one fragment by a heap of pairs: n log n for any length. Ids, and the places of their first symbols."""
        n = len(symbols)
        ranks = self.look(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64)).tolist()
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i, r in enumerate(ranks) if r != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j], after[i] = int(self.product[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (r := int(self.look(np.array([symbols[x]]), np.array([symbols[y]]))[0])) != NEVER:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        kept = [i for i, s in enumerate(symbols) if s >= 0]
        return [symbols[i] for i in kept], kept
