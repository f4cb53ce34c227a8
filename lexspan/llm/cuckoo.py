"""A cuckoo filter over 64-bit keys: membership without false negatives, insertion and deletion, in a numpy table."""

from __future__ import annotations

import numpy as np

SLOTS = 4
#: Keys for each slot at most when a filter is made.
LOAD = 0.7
#: Keys for each slot from which on a filter is full.
FULL = 0.9
KICKS = 200


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class CuckooFilter:
    """16-bit fingerprints in two candidate buckets of four slots; what can't be placed is kept whole in a stash. fits() tells whether
    more keys can be placed without long searches; a fuller filter should be made anew."""

    def __init__(self, table: np.ndarray, stash: np.ndarray):
        self.table, self.stash = table, stash

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(n, 1) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16), np.empty(0, np.uint64))

    def fits(self, more: int) -> bool:
        return np.count_nonzero(self.table) + len(self.stash) + more <= FULL * self.table.size

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.uint64))
        print_ = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)  # 0 is a free slot
        first = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return print_, first, self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(print_.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, a, b = self._places(keys)
        found = (self.table[a] == print_[:, None]).any(1) | (self.table[b] == print_[:, None]).any(1)
        return found | np.isin(keys.astype(np.uint64), self.stash) if len(self.stash) else found

    def insert(self, keys: np.ndarray) -> None:
        """Adds distinct keys that aren't in the filter. Rounds place as many as there is room for; the rest kicks."""
        print_, a, b = self._places(keys)
        left = np.arange(len(keys))
        for where in (a, b):
            order = left[np.argsort(where[left], kind="stable")]
            bucket = where[order]
            rank = np.arange(len(order)) - np.searchsorted(bucket, bucket)
            used = (self.table[bucket] != 0).sum(1)
            fits = used + rank < SLOTS
            free = np.argsort(self.table[bucket] != 0, axis=1, kind="stable")  # free slots first
            self.table[bucket[fits], free[np.flatnonzero(fits), rank[fits]]] = print_[order[fits]]
            left = order[~fits]
        for i in left:
            self._kick(int(print_[i]), int(a[i]), int(keys[i]))

    def _kick(self, print_: int, bucket: int, key: int) -> None:
        trail = []
        for n in range(KICKS):
            row = self.table[bucket]
            if len(free := np.flatnonzero(row == 0)):
                row[free[0]] = print_
                return
            slot = (print_ + n) % SLOTS
            trail.append((bucket, slot, print_))
            print_, row[slot] = int(row[slot]), print_
            bucket = int(self._other(np.array([bucket]), np.array([print_], np.uint16))[0])
        for bucket, slot, own in reversed(trail):  # as it was before
            self.table[bucket, slot], print_ = print_, own
        self.stash = np.append(self.stash, np.uint64(key))

    def delete(self, keys: np.ndarray) -> None:
        """Removes distinct keys that are in the filter."""
        print_, a, b = self._places(keys)
        for k, f, x, y in zip(keys.astype(np.uint64), print_, a, b, strict=True):
            if len(self.stash) and (self.stash == k).any():
                self.stash = self.stash[self.stash != k]
                continue
            bucket = x if (self.table[x] == f).any() else y
            if len(at := np.flatnonzero(self.table[bucket] == f)):
                self.table[bucket, at[0]] = 0

    def to_bytes(self) -> bytes:
        return np.uint64(len(self.table)).tobytes() + self.table.tobytes() + self.stash.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        n = int(np.frombuffer(raw, np.uint64, 1)[0])
        body = 8 + n * SLOTS * 2
        return cls(np.frombuffer(raw[8:body], np.uint16).reshape(n, SLOTS).copy(), np.frombuffer(raw[body:], np.uint64).copy())
